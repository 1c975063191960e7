"""Ranked search over a stored inverted index: a query reads the postings of its own words' buckets and nothing else.

The index is three tables in one folder, each partitioned by a bucket:

- ``postings``: (term, key, project_path, hits, n), by a hash of the term's first letters,
- ``terms``: (term, rows), the dictionary with document counts, by the same bucket,
- ``notes``: (key, project_path, val, n), by a hash of the key,

and a row of totals. Only the buckets that a change touches are written again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.lines import once
from tracewright.functions.storage import get_buckets, put_buckets, stored
from tracewright.operators.search import K1, LEAST_IDF, MOST, WORD, B

#: Buckets of terms and of notes, and letters of a term that choose its bucket: a shorter word of a query reads all.
TERM_BUCKETS, NOTE_BUCKETS, LETTERS = 64, 64, 2
_POSTINGS = "term string, key string, project_path string, hits int, n int"
_NOTES = "key string, project_path string, val string, n int"
# Letters with marks, and what they count as where marks are left out; other letters are their own.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
BARE = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def folded(text: Column) -> Column:
    """Lower case, without marks on Latin letters, be they letters of their own or signs behind one."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, BARE), r"\p{Mn}+", "")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, LETTERS)), F.lit(buckets)).cast("int")


def _note_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("project_path", "key"), F.lit(buckets)).cast("int")


def _analysed(notes: DataFrame) -> DataFrame:
    words = F.regexp_extract_all(folded(F.concat_ws(" ", "key", "val")), F.lit(WORD), F.lit(0))
    rows = notes.where("key is not null").select("key", "project_path", "val", words.alias("words"))
    return rows.withColumn("n", F.size("words")).withColumn("bucket", _note_bucket(NOTE_BUCKETS))


def _counted(words: Column) -> Column:
    """Each different word with its number, counted along the sorted words of the one note; null for no words."""

    def of_sorted(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return once(first, lambda at: F.transform(at, lambda a, j: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - a).alias("hits"))))

    return F.when(F.size(words) > 0, once(F.sort_array(words), of_sorted))


def _postings(analysed: DataFrame) -> DataFrame:
    # Keys are unique in a project, so that a note's words are counted where it stands, without a table of all words in a task.
    rows = analysed.select("key", "project_path", "n", F.inline(_counted(F.col("words"))))
    return rows.select("term", "key", "project_path", "hits", "n", _bucket(F.col("term"), TERM_BUCKETS).alias("bucket"))


class Index:
    """A search index in a folder that all executors share. Keys are unique in a project."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _get(self, table: str, schema: str, key: str) -> DataFrame:
        return get_buckets(self.spark, f"{self.path}/{table}", schema, key)

    @property
    def postings(self) -> DataFrame:
        return self._get("postings", _POSTINGS, "term")

    @property
    def terms(self) -> DataFrame:
        return self._get("terms", "term string, rows long", "term")

    @property
    def notes(self) -> DataFrame:
        return self._get("notes", _NOTES, "key")

    def _totals(self) -> None:
        # Two columns of the notes' files; a prefix's document counts come from its postings.
        sums = self.notes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
        stored(sums, "totals").write.mode("overwrite").parquet(f"{self.path}/totals")

    def _counted(self, buckets: DataFrame) -> None:
        counts = self.postings.join(F.broadcast(buckets), "bucket", "left_semi").groupBy("term", "bucket").agg(F.count("*").alias("rows"))
        put_buckets(counts.select("term", "rows", "bucket"), f"{self.path}/terms", buckets)

    def build(self, notes: DataFrame) -> Index:
        """The index of all ``notes`` (key, project_path, val), in place of what was there."""
        rows = stored(_analysed(notes), "analysed")
        every = self.spark.range(NOTE_BUCKETS).select(F.col("id").cast("int").alias("bucket"))
        put_buckets(rows.drop("words"), f"{self.path}/notes", every)
        every = self.spark.range(TERM_BUCKETS).select(F.col("id").cast("int").alias("bucket"))
        put_buckets(_postings(rows), f"{self.path}/postings", every)
        self._counted(every)
        self._totals()
        return self

    def upsert(self, new: DataFrame, gone: DataFrame | None = None) -> Index:
        """Notes of ``new`` (key, project_path, val) win over those with their key; those of ``gone`` (key, project_path) vanish.

        Terms of the old and the new texts name the buckets of postings that are
        written again. A change that fails is done again by calling this again.
        """
        rows = stored(_analysed(new), "analysed")
        keys = rows.select("key", "project_path", "bucket")
        if gone is not None:
            keys = keys.unionByName(gone.select("key", "project_path", _note_bucket(NOTE_BUCKETS).alias("bucket")))
        keys = stored(keys.distinct(), "keys")
        at = keys.select("bucket").distinct()  # at most NOTE_BUCKETS rows
        near = self.notes.join(F.broadcast(at), "bucket", "left_semi")
        old = _analysed(near.join(keys.drop("bucket"), ["key", "project_path"], "left_semi"))
        fresh = _postings(rows)
        touched = stored(_postings(old).select("bucket").union(fresh.select("bucket")).distinct(), "touched")  # at most TERM_BUCKETS rows
        kept = self.postings.join(F.broadcast(touched), "bucket", "left_semi").join(keys.drop("bucket"), ["key", "project_path"], "left_anti")
        put_buckets(kept.select(fresh.columns).unionByName(fresh), f"{self.path}/postings", touched)
        self._counted(touched)
        # The notes come last: until then their old terms can be told again.
        left = near.join(keys.drop("bucket"), ["key", "project_path"], "left_anti")
        put_buckets(left.select("key", "project_path", "val", "n", "bucket").unionByName(rows.drop("words")), f"{self.path}/notes", at)
        self._totals()
        return self

    def matching(self, start: str) -> DataFrame:
        """Postings of the terms that begin with a word: of one bucket, or of all for fewer letters than ``LETTERS``."""
        rows = self.postings.where(F.col("term").startswith(start))
        if len(start) < LETTERS:
            return rows
        bucket = self.spark.range(1).select(_bucket(F.lit(start), TERM_BUCKETS).alias("b")).first().b
        return rows.where(F.col("bucket") == bucket)

    def search(self, query: str, project: str, most: int = MOST) -> DataFrame:
        """``key``, ``val``, ``score``: as the search over the notes themselves, without marks on letters; ties by key.

        Each word's hits are summed by note in its own bucket. Only the best
        ``most`` rows meet the notes, of whose buckets only theirs are read.
        """
        asked = self.spark.range(1).select(folded(F.lit(query)).alias("q")).first().q
        wanted = list(dict.fromkeys(re.findall(r"[^\W_]+", asked)))
        totals = self.spark.read.parquet(f"{self.path}/totals").first()
        if not wanted or not totals["rows"]:
            return self.notes.select("key", "val", F.lit(0.0).alias("score")).limit(0)
        mean = totals["words"] / totals["rows"]
        found = None
        for start in wanted:
            hits = self.matching(start).groupBy("key", "project_path", "n").agg(F.sum("hits").alias("h"))
            hits = stored(hits, "hits")
            d = hits.count()
            idf = F.greatest(F.ln(F.lit((totals["rows"] - d + 0.5) / (d + 0.5))), F.lit(LEAST_IDF))
            h, size = F.col("h"), F.col("n") / F.lit(mean)
            part = hits.where(F.col("project_path") == project).select("key", "n", (idf * h * (K1 + 1) / (h + K1 * (1 - B + B * size))).alias("part"))
            found = part if found is None else found.unionByName(part)
        best = found.groupBy("key").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "key").limit(most)
        best = stored(best.withColumn("project_path", F.lit(project)).withColumn("b", _note_bucket(NOTE_BUCKETS)), "best")
        buckets = [r.b for r in best.select("b").distinct().collect()]  # at most ``most``
        own = self.notes.where(F.col("bucket").isin(buckets) & (F.col("project_path") == project)).select("key", "val")
        return own.join(F.broadcast(best.select("key", "score")), "key").select("key", "val", F.round("score", 6).alias("score"))
