"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import numbered, row_key, stored

#: The published generator: key = key * MULTIPLIER + 1 modulo 2**64.
MULTIPLIER = 2862933555777941757
_LOW = (1 << 32) - 1


def _times(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state as two 32-bit halves; no product passes 2**49, so ANSI mode can't overflow."""
    ch, cl = MULTIPLIER >> 32, MULTIPLIER & _LOW

    def low_product(x: Column, c: int) -> Column:
        top = F.shiftright(x, 16) * F.lit(c)
        return (x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c) + F.shiftleft(top.bitwiseAND(F.lit(0xFFFF)), 16)).cast("long")

    low = low_product(lo, cl) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(F.shiftright(lo, 16) * F.lit(cl), 16)
    mask = F.lit(_LOW)
    high = low_product(hi, cl).bitwiseAND(mask) + low_product(lo, ch).bitwiseAND(mask) + carry
    return high.bitwiseAND(mask), low.bitwiseAND(mask)


def jump_hash(key: Column, shards: int) -> Column:
    """``struct<shard, grown>``: the shard of a long key among ``shards``, and among one more.

    Every jump goes to a later shard, so ``shards + 1`` steps are enough for any
    key; about ln(shards) of them do something. Both numbers come from one walk:
    with one more shard a key stays or goes into the new one.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    hi, lo = _times(F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_LOW)))
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"))

    def step(acc: Column, _: Column) -> Column:
        part = F.lit(float(1 << 31)) / (F.shiftright(acc.hi, 1) + F.lit(1)).cast("double")
        to = F.floor((acc.grown + F.lit(1)).cast("double") * part)
        hi, lo = _times(acc.hi, acc.lo)
        moved = F.struct(
            hi.alias("hi"), lo.alias("lo"), F.when(to < shards, to).otherwise(acc.shard).alias("shard"), to.alias("grown")
        )
        return F.when(to < shards + 1, moved).otherwise(acc)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards + 1)),
        start,
        step,
        lambda acc: F.struct(acc.shard.cast("int").alias("shard"), acc.grown.cast("int").alias("grown")),
    )


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard, its slot there, and its shard if there were one more.

    Law ``key``: the key and the number of shards alone decide. Rows are ordered
    by key inside a shard (null keys first; they hash as 0). Equal keys share a
    shard; repeated rows each get a slot of their own. A null text has size 16
    and no CRC; an empty one size 16 and CRC 0. An empty table gives no rows.

    Rows without their texts are dealt into ranges of the key (a hot key spreads
    by row) and counted by range and shard; only counts meet in one group.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        jump_hash(F.col(key), shards).alias("_at"),
        row_key().alias("_row"),
    ).select("doc_id", "size", "text_crc32", "_at.shard", F.col("_at.grown").alias("grown_shard"), "_row")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, "doc_id", "_row").withColumn("_part", F.spark_partition_id()), "shards")
    nth = Window.partitionBy("_part", "shard").orderBy("doc_id", "_row")
    dealt = dealt.withColumn("_nth", F.row_number().over(nth).cast("long") - 1)
    out = numbered(dealt, ["shard"], "_part", "_nth", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, text,
         CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE coalesce(doc_id, 0)::HUGEINT END AS k
  FROM documents
), walk(r, key, b, j) AS (
  SELECT r, k, (-1)::BIGINT, 0::BIGINT FROM d
  UNION ALL
  SELECT r, key2, j, CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((key2 // 8589934592::HUGEINT) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT r, j, (key * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS key2 FROM walk WHERE j < 41)
), crc AS (
  SELECT r, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
           lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])) AS c
  FROM d, (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || range(8),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS t)
  WHERE text IS NOT NULL
), placed AS (
  SELECT r, max(b) FILTER (WHERE b < 40) AS shard, max(b) AS grown FROM walk GROUP BY r
)
SELECT doc_id, (coalesce(strlen(text), 0) + 16)::BIGINT AS size,
       xor(c, 4294967295::BIGINT) AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1)::BIGINT AS slot,
       grown::INTEGER AS grown_shard
FROM d JOIN placed USING (r) LEFT JOIN crc USING (r)
"""
