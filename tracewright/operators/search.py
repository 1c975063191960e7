"""Ranked search over notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ranking's constants, and how many notes a search gives.
K1, B, LEAST_IDF, MOST = 1.2, 0.75, 1e-6, 5
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _hits(start: str) -> Column:
    return F.size(F.filter("words", lambda x: x.startswith(start)))


def ranked(notes: DataFrame, query: str, project: str, most: int = MOST) -> DataFrame:
    """``key``, ``val``, ``score``: a project's notes with words that begin as a word of the query, best first; ties by key.

    The score is BM25 over key and value, with frequencies of the whole table.
    Two passes over the notes: one for the counts (a single row), one for the
    scores; only the best rows leave a task. Marks in the query part words.
    """
    wanted = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not wanted:
        return notes.select("key", "val", F.lit(0.0).alias("score")).limit(0)
    held = notes.select("key", "val", "project_path", words(F.concat_ws(" ", "key", "val")).alias("words"))
    hits = [_hits(w).alias(f"h{i}") for i, w in enumerate(wanted)]
    held = held.select("key", "val", "project_path", F.size("words").alias("n"), *hits)
    counts = held.agg(
        F.count("*").alias("rows"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"h{i}") > 0).alias(f"d{i}") for i in range(len(wanted))]
    )
    score = F.lit(0.0)
    for i in range(len(wanted)):
        h, d = F.col(f"h{i}"), F.col(f"d{i}")
        idf = F.greatest(F.ln((F.col("rows") - d + 0.5) / (d + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * h * (K1 + 1) / (h + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    some = F.lit(False)
    for i in range(len(wanted)):
        some = some | (F.col(f"h{i}") > 0)
    found = held.where((F.col("project_path") == project) & some).join(F.broadcast(counts))
    best = found.select("key", "val", score.alias("score")).orderBy(F.desc("score"), "key").limit(most)
    return best.withColumn("score", F.round("score", 6))
