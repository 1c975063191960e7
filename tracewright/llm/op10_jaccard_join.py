"""Near-duplicate documents: an n-gram Jaccard join by MinHash banding, with every candidate verified on full sets."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import bounded, components, row_key, stored
from tracewright.llm.words import STEP, mixed, shingles

#: A cell of a bucket holds at most about two blocks of so many shingles or documents.
BLOCK_SHINGLES, BLOCK_ROWS = 400_000, 800
#: Bands in which it is looked whether a whole bucket was met before.
EARLY = 6
#: Keys (one long each) up to this number are sent to the scan of texts; more meet it in a shuffle.
SENT_KEYS = 2_000_000
#: Shared buckets (three numbers each) up to which they are sent to all band hashes; more meet them in a shuffle.
SENT_BUCKETS = 500_000


def banding(similarity: float, recall: float, rows: int = 4) -> tuple[int, int]:
    """(bands, rows): the least number of bands with which a pair at the threshold is met with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))), rows


def _band_hashes(sets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    rng = np.random.default_rng(10)
    n = bands * rows
    factor = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, n, dtype=np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(sets), 2048):
        part = sets[None, a : a + 2048] * factor[:, None]
        part += shift[:, None]
        least = np.minimum(least, part.min(axis=1))
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        out = out * STEP + least[k::rows]
    return mixed(out).view(np.int64)


def _features(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for body in batch["body"]:
                s = shingles(body, size)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append(((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, len(s), _band_hashes(s, bands, rows) if len(s) else []))
            got = pd.DataFrame(out, columns=["h1", "h2", "n", "bands"])
            yield pd.concat([batch[["_row", "doc_id"]].reset_index(drop=True), got], axis=1)

    return docs.mapInPandas(scan, "_row long, doc_id long, h1 long, h2 long, n int, bands array<long>")


def _verified(cells: DataFrame, size: int, similarity: float) -> DataFrame:
    """A row for each member of each cell: documents and sets linked to it there, and the least member it hangs together with."""

    def judge(rows: list) -> pd.DataFrame:
        rep = [r.rep for r in rows]
        n = np.array([r.n for r in rows])
        copies = np.array([r.copies for r in rows])
        block = np.array([r.block for r in rows])
        earlier = np.stack([np.asarray(r.hubs[: r.band], np.int64) for r in rows])
        sets = [shingles(zlib.decompress(r.body).decode("utf-8", "surrogatepass"), size) for r in rows]
        apart = rows[0].a != rows[0].b
        docs, texts, root = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), list(range(len(rows)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            fit = np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i])
            fit &= ~((earlier[rest] == earlier[i]) & (earlier[i] >= 0)).any(axis=1)  # judged in the first band that they share
            if apart:
                fit &= block[rest] != block[i]
            for j in (np.flatnonzero(fit) + i + 1).tolist():
                few, many = (sets[i], sets[j]) if n[i] < n[j] else (sets[j], sets[i])
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                both = int((many[at] == few).sum())
                if both >= similarity * (n[i] + n[j] - both):
                    docs[i] += copies[j]
                    docs[j] += copies[i]
                    texts[i] += 1
                    texts[j] += 1
                    x, y = top(i), top(j)
                    root[max(x, y)] = min(x, y)
        return pd.DataFrame({"rep": rep, "root": [rep[top(i)] for i in range(len(rows))], "docs": docs, "texts": texts})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, rows = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.band, row.hub, row.a, row.b) != cell:
                    if len(rows) > 1:
                        yield judge(rows)
                    cell, rows = (row.band, row.hub, row.a, row.b), []
                rows.append(row)
        if len(rows) > 1:
            yield judge(rows)

    return cells.mapInPandas(walk, "rep long, root long, docs long, texts long")


def _cells(sets: DataFrame, keyed: DataFrame, bands: int) -> DataFrame:
    """The members of every bucket in which some pair shares its first band, with their texts, cut into cells.

    Texts travel compressed and are cut into shingles where they are judged: a
    set's hashes take three to four times the room of its compressed text.

    A bucket is named by its band and its least member, the hub. ``hubs`` are a
    member's buckets by band, -1 where it is alone, so that two members share a
    band if they have the same hub there. A bucket whose members all share one
    of the ``EARLY`` first bands before it has no pair to judge and is left out;
    that only spares work, as pairs are judged in their first band anyway.
    """
    banded = sets.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    buckets = bounded(buckets, "buckets", SENT_BUCKETS)
    places = banded.join(buckets, ["band", "hash"]).groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("band", "hub"))).alias("at"))
    hubs = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.try_element_at("at", b), F.lit(-1).cast("long")))
    members = stored(places.join(sets, "rep").select("rep", "n", "copies", hubs.alias("hubs")), "members")

    shared = members.select("rep", "n", "hubs", F.posexplode("hubs").alias("band", "hub")).where("hub >= 0")
    early = range(min(EARLY, bands))
    ends = [f(F.get("hubs", F.lit(b))).alias(f"{name}{b}") for b in early for name, f in (("lo", F.min), ("hi", F.max))]
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("k")
    judged = shared.groupBy("band", "hub").agg(blocks, *ends)
    for b in early:
        judged = judged.where(~((F.col("band") > b) & (F.col(f"lo{b}") == F.col(f"hi{b}")) & (F.col(f"lo{b}") >= 0)))
    dealt = shared.select("rep", "band", "hub").join(judged.select("band", "hub", "k"), ["band", "hub"])
    dealt = dealt.groupBy("rep").agg(F.collect_list(F.struct("band", "hub", "k")).alias("cells"))  # at most one a band
    dealt = stored(dealt.join(members, "rep"), "dealt")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rep": batch["_row"], "body": [zlib.compress(x.encode("utf-8", "surrogatepass")) for x in batch["body"]]})

    texts = keyed.select("_row", "body").join(bounded(dealt.select(F.col("rep").alias("_row")), "keys", SENT_KEYS), "_row", "left_semi")
    found = texts.mapInPandas(packed, "rep long, body binary").join(dealt, "rep")
    found = found.select("rep", "n", "copies", "hubs", "body", F.inline("cells")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    return found.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "band", "hub", F.least("block", "c").alias("a"), F.greatest("block", "c").alias("b"), "rep", "n", "copies", "hubs", "block", "body"
    )


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    similarity: float = 0.8,
    recall: float = 0.9999,
    key: str = "doc_id",
    text: str = "text",
    row: str | None = None,
) -> DataFrame:
    """Each document's near-duplicate class and number of links.

    Two documents are linked if the Jaccard similarity of their sets of
    ``size``-word shingles is at least ``similarity``. ``class_id`` is the
    doc_id of the first row of the connected component, ``set_id`` that of the
    first row with the same set, ``n_copies`` the rows with the same set,
    ``n_links`` the other documents linked to this one (copies of a linked text
    count each), ``n_linked_sets`` the different sets among them; ``kept`` marks
    the component's first row, ``row_key`` names the row. Rows are numbered and
    stored first, unless ``row`` is a column of a stored table that holds a
    different long in each row.

    Words are runs of ASCII digits and letters (case folded) and non-ASCII
    characters; a text of fewer words than ``size`` is one shingle. Null texts
    and texts without words have no links and form a class each. Repeated rows
    are copies. An empty table gives no rows.

    Rows with equal sets are first reduced to one representative by a partial
    aggregate. Bands and rows follow from ``recall`` at the threshold. Sets meet
    in a shuffle on (band, band hash); a bucket too large for a task is cut into
    blocks whose pairs are cells. A pair that shares several bands is judged in
    the first of them only, on its full sets. Only counts and a spanning forest
    leave a cell, never the pairs. Texts of any length are read whole; only the
    named columns are read, so others may have any name.
    """
    bands, rows = banding(similarity, recall)
    fields = [F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body")]
    keyed = docs.select(F.col(row).alias("_row"), *fields) if row else stored(docs.select(row_key().alias("_row"), *fields), "docs")
    features = stored(_features(keyed, size, bands, rows), "features")
    sets = features.where("n > 0").groupBy("h1", "h2").agg(
        F.min(F.struct("_row", "doc_id")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    sets = stored(sets.select("h1", "h2", F.col("first._row").alias("rep"), F.col("first.doc_id").alias("set_id"), "copies", "n", "bands"), "sets")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _cells(sets, keyed, bands).repartition(parts, "band", "hub", "a", "b").sortWithinPartitions("band", "hub", "a", "b", "rep")
    judged = stored(_verified(cells, size, similarity), "judged")

    roots = components(judged.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    names = sets.select(F.col("rep").alias("root"), F.col("set_id").alias("class_id"))
    counts = judged.groupBy("rep").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    told = (
        sets.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .withColumn("root", F.coalesce("root", "rep"))
        .join(names, "root")
        .join(counts, "rep", "left")
        .select("h1", "h2", "root", "class_id", "set_id", "copies", "docs", "texts")
    )
    zero = F.lit(0).cast("long")
    return features.join(stored(told, "classes"), ["h1", "h2"], "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("set_id", "doc_id").alias("set_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("docs", zero)).alias("n_links"),
        F.coalesce("texts", zero).alias("n_linked_sets"),
        (F.coalesce("root", "_row") == F.col("_row")).alias("kept"),
        F.col("_row").alias("row_key"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", sent_rows: int = SENT_KEYS) -> DataFrame:
    """``docs`` without the rows that aren't the first of their class, with all their columns.

    Texts are stored once and stay in place while the other rows' keys can be
    sent; more than ``sent_rows`` of them meet the rows in a shuffle.
    """
    whole = stored(docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "documents")
    texts = whole.select("key", F.col(f"doc.`{key}`").alias("doc_id"), F.col(f"doc.`{text}`").alias("text"))
    others = near_duplicates(texts, row="key").where("not kept").select(F.col("row_key").alias("key"))
    return whole.join(bounded(others, "others", sent_rows), "key", "left_anti").select("doc.*")


def op10_minhash_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key")
