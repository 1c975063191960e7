"""Importance resampling towards a target: a dictionary of distinct n-grams, counted globally and hashed once each.

Documents are read once into blocks of bounded size, in which each word is a
small number. A block sends each of its different n-grams once, with its count,
to the part of the dictionary that the n-gram belongs to; the part counts it
over all blocks, hashes each distinct string once, sums the hash buckets and
answers with the buckets of each block's n-grams. When all buckets are summed,
the gains join the blocks' documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import numbered, row_key, stored
from tracewright.llm.words import STEP, is_word, mixed, words_of

#: Bytes of texts in a block (a longer text is a block of its own), and of texts for each part of the dictionary.
BLOCK_BYTES, PART_BYTES = 8 << 20, 4 << 20
_BLOCKS = "block long, bytes long, ids array<long>, no_id array<boolean>, n_words array<long>, words binary, sequence binary"
_DICTIONARY = "block long, part int, buckets binary, sums array<long>, feature binary, n long"


def _packed(data: bytes | memoryview) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _plain(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words, the frequent ones first; all texts' words as numbers of these; and the number of words of each text."""
    low = b" ".join(texts).lower()  # of ASCII letters only
    raw = np.frombuffer(low, np.uint8)
    inside = np.concatenate(([False], is_word(raw), [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    n_words = np.diff(np.searchsorted(start, text_ends), prepend=0)
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    letters = raw[inside[1:-1]]
    told = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    at = told.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(at, minlength=len(told.dictionary)), kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return told.dictionary.take(pa.array(order)).to_pylist(), place[at], n_words


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The documents in blocks: ids and numbers of words by document, different words, and all words as numbers of these."""

    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, weight = TaskContext.get().partitionId() << 33, [], 0

        def block() -> pa.RecordBatch:
            nonlocal first, held, weight
            words, sequence, n_words = _numbered_words([h[2] for h in held])
            row = (first, weight, [h[0] for h in held], [h[1] for h in held], n_words.tolist(), _packed(b"\n".join(words)), _packed(sequence.tobytes()))
            first, held, weight = first + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

        for batch in batches:
            body = batch.column("body").cast(pa.large_binary())
            for i, (doc, no_id) in enumerate(zip(batch.column("id").to_pylist(), batch.column("no_id").to_pylist(), strict=True)):
                text = body[i].as_py()
                if held and weight + len(text) > BLOCK_BYTES:
                    yield block()
                held.append((doc, no_id, text))
                weight += len(text)
        if held:
            yield block()

    ids = F.col(key).cast("long")
    rows = docs.select(F.coalesce(ids, F.lit(0).cast("long")).alias("id"), ids.isNull().alias("no_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return stored(rows.mapInArrow(scan, _BLOCKS), "blocks")


class _Features:
    """A block's different features in a fixed order, by the part of the dictionary that each belongs to.

    ``at[k]`` has the feature number of the run of ``k + 1`` words that starts at
    each place, and ``places[k]`` these places. Numbers and parts follow from the
    block alone, so that they are the same whenever it is read.
    """

    def __init__(self, words: bytes, sequence: bytes, n_words: np.ndarray, longest: int, parts: int) -> None:
        self.words = words.split(b"\n") if words else []
        ids = np.frombuffer(sequence, np.uint32).astype(np.int64)
        left = (np.repeat(np.cumsum(n_words), n_words) - np.arange(len(ids))).astype(np.int32)  # words from here to the text's end
        own = words_of(words.decode("utf-8", "surrogatepass"))[0]
        self.at, self.places, self.pairs, self.counts = [ids], [np.arange(len(ids))], [], [np.bincount(ids, minlength=len(self.words))]
        hashes, before = [own], ids
        for k in range(1, longest):
            place = np.flatnonzero(left > k)
            key = before[place] * len(self.words) + ids[place + k]
            distinct, found, n = np.unique(key, return_inverse=True, return_counts=True)
            a, b = (distinct // max(1, len(self.words)), distinct % max(1, len(self.words)))
            hashes.append(mixed(hashes[-1][a] * STEP + own[b]))
            before = np.zeros(len(ids), np.int64)
            before[place] = found
            self.at.append(found)
            self.places.append(place)
            self.pairs.append((a, b))
            self.counts.append(n)
        part = np.concatenate(hashes) % np.uint64(parts)
        self.order = np.argsort(part, kind="stable")
        self.part, self.start = np.unique(part[self.order], return_index=True)

    def strings(self) -> pa.Array:
        """All features as UTF-8 bytes, in the order of numbers."""
        words = level = pa.array(self.words, pa.large_binary())
        levels = [words]
        for a, b in self.pairs:
            level = pc.binary_join_element_wise(level.take(pa.array(a)), words.take(pa.array(b)), pa.scalar(b" ", pa.large_binary()))
            levels.append(level)
        return pa.concat_arrays(levels)

    def by_part(self) -> Iterator[tuple[int, bytes, bytes]]:
        """For each part: its features, a line each, and their counts."""
        lines = pc.binary_join_element_wise(self.strings().take(pa.array(self.order)), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        counts = np.concatenate(self.counts)[self.order].astype(np.uint32)
        ends = np.append(self.start[1:], len(counts))[: len(self.start)]  # a block without words has no part
        for part, a, b in zip(self.part.tolist(), self.start.tolist(), ends.tolist(), strict=True):
            some = lines.slice(a, b - a)
            begin, *_, end = np.frombuffer(some.buffers()[1], np.int64)[a : b + 1].tolist()
            yield part, bytes(memoryview(some.buffers()[2])[begin : end - 1]), counts[a:b].tobytes()

    def totals(self, of_feature: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """The sum of a number by feature over all features of each text."""
        first, out = 0, np.zeros(len(n_words), np.int64)
        ends = np.cumsum(n_words)
        for at, place, n in zip(self.at, self.places, self.counts, strict=True):
            sums = np.concatenate(([0], np.cumsum(of_feature[first + at])))
            upto = np.searchsorted(place, ends)
            out += np.diff(sums[upto], prepend=0)
            first += len(n)
        return out


def _sent(blocks: DataFrame, longest: int, parts: int) -> DataFrame:
    """Each block's different features with their counts, a row for each part of the dictionary."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                features = _Features(_plain(r.words), _plain(r.sequence), np.asarray(r.n_words), longest, parts)
                out = [(r.block, part, _packed(lines), _packed(counts)) for part, lines, counts in features.by_part()]
                yield pd.DataFrame(out, columns=["block", "part", "features", "counts"])

    return blocks.select("block", "n_words", "words", "sequence").mapInPandas(cut, "block long, part int, features binary, counts binary")


def _counted(sent: DataFrame, buckets: int, listed: bool) -> DataFrame:
    """The dictionary, part by part: every string counted over all blocks and hashed once.

    Rows with ``buckets`` answer a block's part, one row a task has the
    ``sums`` of its buckets; ``listed`` gives ``feature``, ``n`` instead.
    """
    fields = [x.split()[0] for x in _DICTIONARY.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(buckets, np.int64)

        def told(asked: list[tuple[int, np.ndarray]], number: dict[bytes, int], n: np.ndarray, part: int) -> pd.DataFrame:
            nonlocal sums
            of = np.fromiter((zlib.crc32(x) % buckets for x in number), np.uint32, len(number))
            sums += np.bincount(of, n, minlength=buckets).astype(np.int64)
            if listed:
                return pd.DataFrame([(None, part, None, None, x, k) for x, k in zip(number, n.tolist(), strict=True)], columns=fields)
            return pd.DataFrame([(block, part, _packed(of[at].astype("<u4" if buckets > 1 << 16 else "<u2").tobytes()), None, None, None) for block, at in asked], columns=fields)

        part, asked, number, n = None, [], {}, np.zeros(0, np.int64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.part != part:
                    if asked:
                        yield told(asked, number, n, part)
                    part, asked, number, n = r.part, [], {}, np.zeros(0, np.int64)
                lines = _plain(r.features).split(b"\n")
                at = np.fromiter((number.setdefault(x, len(number)) for x in lines), np.int64, len(lines))
                n = np.concatenate((n, np.zeros(len(number) - len(n), np.int64)))
                n[at] += np.frombuffer(_plain(r.counts), np.uint32)  # a block's features are different
                asked.append((r.block, at.astype(np.uint32)))
        if asked:
            yield told(asked, number, n, part)
            if not listed:
                yield pd.DataFrame([(None, None, None, sums, None, None)], columns=fields)

    return sent.repartition("part").sortWithinPartitions("part").mapInPandas(walk, _DICTIONARY)


def _parts(blocks: DataFrame) -> int:
    return max(1, -(-blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // PART_BYTES))


def _by_bucket(counted: DataFrame, name: str) -> DataFrame:
    return counted.where("sums is not null").select(F.posexplode("sums").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias(name))


def feature_counts(docs: DataFrame, longest: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``feature``, ``n``: every different run of 1 to ``longest`` words, with its count over all documents."""
    blocks = _blocks(docs, key, text)
    return _counted(_sent(blocks, longest, _parts(blocks)), 1, True).select(F.decode("feature", "UTF-8").alias("feature"), "n")


def _weighed(blocks: DataFrame, answers: DataFrame, gains: np.ndarray, longest: int, parts: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` of each document: the gains joined to the blocks' feature counts."""
    shipped = blocks.sparkSession.sparkContext.broadcast(gains)  # a long a bucket
    fields = ["id", "no_id", "n_words", "n_features", "weight"]

    def joined(_: tuple, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        r = block.iloc[0]
        n_words = np.asarray(r["n_words"])
        features = _Features(_plain(r["words"]), _plain(r["sequence"]), n_words, longest, parts)
        answers = answers.sort_values("part")
        kind = "<u4" if len(shipped.value) > 1 << 16 else "<u2"
        found = np.concatenate([np.zeros(0, kind), *(np.frombuffer(_plain(x), kind) for x in answers["buckets"])])
        gain = np.zeros(len(features.order), np.int64)
        gain[features.order] = shipped.value[found]
        n = sum(np.maximum(n_words - k, 0) for k in range(longest))
        weight = features.totals(gain, n_words) // np.maximum(n, 1)
        return pd.DataFrame(dict(zip(fields, (r["ids"], r["no_id"], n_words, n, weight), strict=True)))

    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(joined, "id long, no_id boolean, n_words long, n_features long, weight long")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_words", "n_features", "weight")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    longest: int = 2,
    buckets: int = 10_000,
    least_words: int = 20,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """Every document's ``n_features``, ``weight``, ``score``, and ``rank`` among those drawn.

    Features are all runs of 1 to ``longest`` words, repeats counted; a feature
    belongs to the bucket of its CRC-32. A bucket's gain is the floored
    thousandfold logarithm of its share in the target over its share in the
    documents, both with one added to each bucket; a document's weight is the
    floored mean of its features' gains, 0 without features. The score adds
    Gumbel noise that follows from the seed and the id, so that the ``percent``
    of highest scores are a weighted draw without replacement. Only documents
    of at least ``least_words`` words can be drawn; ties go to the smaller id.

    Null texts count as empty; these have no words and weight 0. A null id gets
    the noise of an empty one and comes first among ties. Repeated rows count
    each, and are drawn each; of equal rows any may come first. An empty table
    gives no rows; with an empty target all gains compare with even shares. Texts of any length are
    read whole. Only the named columns are read, so others may have any name.

    A block holds texts of at most ``BLOCK_BYTES`` (one text, if it is longer).
    Of each block a feature travels once, however often it occurs, and is met
    in a part of the dictionary as large as some ``PART_BYTES`` of texts, so
    that a frequent feature is one row a block and no key is hot. The driver
    receives the gains, a number a bucket.
    """
    blocks = _blocks(docs, key, text)
    parts = _parts(blocks)
    counted = stored(_counted(_sent(blocks, longest, parts), buckets, False), "dictionary")
    aims = _blocks(target.select(F.lit(0).alias("_id"), F.col(target_text).alias("_text")), "_id", "_text")
    aimed = _counted(_sent(aims, longest, _parts(aims)), buckets, False)
    every = blocks.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_by_bucket(counted, "s"), "bucket", "left").join(_by_bucket(aimed, "t"), "bucket", "left").fillna(0)
    rows = sorted(both.collect())  # a row a bucket
    all_s, all_t = sum(r.s for r in rows), sum(r.t for r in rows)
    gains = np.array([np.floor(1000 * np.log((r.t + 1) * float(all_s + buckets) / ((r.s + 1) * float(all_t + buckets)))) for r in rows]).astype(np.int64)

    found = _weighed(blocks, counted.where("buckets is not null").select("block", "part", "buckets"), gains, longest, parts)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(found.withColumn("score", F.col("weight") + noise).withColumn("_row", row_key()), "scored")
    most = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    return _ranked(scored, F.col("n_words") >= least_words, most).select("doc_id", "n_features", "weight", "score", "rank")


def _ranked(scored: DataFrame, fit: F.Column, most: int) -> DataFrame:
    """``rank`` of the first ``most`` fit rows by score, over ranges of the score: only counts of ranges meet in one place."""
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    dealt = stored(scored.where(fit).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    dealt = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1)
    placed = numbered(dealt, [], "_part", "_nth", "rank").withColumn("rank", F.when(F.col("rank") < most, F.col("rank") + 1))
    return placed.drop("_part", "_nth").unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_RUNS = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS MATERIALIZED (SELECT r, f, count(*) AS n FROM (SELECT r, unnest({_RUNS}) AS f FROM d) GROUP BY r, f),
tf AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest({_RUNS}) AS f FROM b) GROUP BY f),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT),
           lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM tf), (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || range(8),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS t)
),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM tf JOIN hashed USING (f) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS all_t),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM range(10000) AS e(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums
),
docs AS (
  SELECT r, sum(n) AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM df JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r
),
scored AS (
  SELECT d.r, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN docs USING (r)
),
placed AS (SELECT *, n_words >= 20 AS fit, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT count(*) FROM placed WHERE fit) * 25 // 100 THEN place END::BIGINT AS rank FROM placed
"""
