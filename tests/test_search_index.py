"""The stored index gives what the search over the notes gives, reads only its words' buckets, and keeps up with changes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions.storage import new_path
from tracewright.operators import search, search_index
from tracewright.operators.search_index import Index

SCHEMA = "key string, project_path string, val string"


def notes_of(rng, n):
    words = ["alpha", "alp", "al", "beta", "bet", "gamma", "straße", "東京", "x9", "a", "delta-x", "Alpine"]
    return [(f"k{i}", f"p{i % 2}", None if i % 17 == 3 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def files(path, table):
    return {f"{d}/{x}" for d, _, names in os.walk(f"{path}/{table}") for x in names if x.endswith(".parquet")}


def rows(df):
    return [(r.key, r.val, r.score) for r in df.orderBy(F.desc("score"), "key").collect()]


@pytest.fixture(scope="module", autouse=True)
def few_buckets():
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(search_index, "TERM_BUCKETS", 8)
        patch.setattr(search_index, "NOTE_BUCKETS", 8)
        yield


@pytest.fixture(scope="module")
def built(spark, few_buckets):
    notes = notes_of(random.Random(1), 120)
    return notes, Index(spark, new_path(spark, "search")).build(spark.createDataFrame(notes, SCHEMA))


@pytest.mark.parametrize("query", ["alp bet a", "STRASSE straße 東", "gamma gamma, delta-x", "nothing", "?! "])
def test_equals_the_search_over_the_notes(spark, built, query):
    notes, index = built
    for most in (5, 200):
        got, want = rows(index.search(query, "p1", most)), rows(search.ranked(spark.createDataFrame(notes, SCHEMA), query, "p1", most))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_a_query_reads_one_bucket_a_word(built):
    _, index = built
    plan = index.matching("alp")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and len(index.matching("alp").inputFiles()) <= len(files(index.path, "postings"))
    assert index.matching("alp").select("bucket").distinct().count() == 1
    assert {r.term for r in index.matching("al").select("term").distinct().collect()} == {"alpha", "alp", "al", "alpine"}
    assert {r.term for r in index.matching("a").select("term").distinct().collect()} == {"alpha", "alp", "al", "alpine", "a"}
    assert {(r.term, r.rows) for r in index.terms.collect()} == {(r.term, r.n) for r in index.postings.groupBy("term").agg(F.count("*").alias("n")).collect()}


def test_letters_with_marks_count_without_them(spark):
    index = Index(spark, new_path(spark, "search")).build(spark.createDataFrame([("a", "p", "Café crème"), ("b", "p", "café"), ("c", "p", "caff")], SCHEMA))
    assert sorted(r.key for r in index.search("CAFE", "p").collect()) == ["a", "b"] == sorted(r.key for r in index.search("café", "p").collect())
    assert len(search_index.MARKED) == len(search_index.BARE)


def test_changes_rewrite_only_the_buckets_that_they_touch(spark):
    notes = notes_of(random.Random(2), 60)
    index = Index(spark, new_path(spark, "search")).build(spark.createDataFrame(notes, SCHEMA))
    before = {t: files(index.path, t) for t in ("postings", "notes", "terms")}
    new = [("k4", "p0", "zebra alpha"), ("k200", "p1", "zebra"), ("k5", "p1", None)]
    for _ in range(2):  # the second time changes nothing more
        index.upsert(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([("k7", "p1"), ("none", "p0")], "key string, project_path string"))
        left = [n for n in notes if n[:2] not in {("k7", "p1"), *(x[:2] for x in new)}] + new
        for query in ("zeb", "alp k"):
            want = rows(search.ranked(spark.createDataFrame(left, SCHEMA), query, "p1", 99))
            assert [x[:2] for x in rows(index.search(query, "p1", 99))] == [x[:2] for x in want]
    assert before["notes"] & files(index.path, "notes")  # other buckets' files are the same ones
    touched = {r.bucket for r in spark.createDataFrame([(n[0], n[1]) for n in [*new, ("k7", "p1", ""), ("none", "p0", "")]], "key string, project_path string").select(search_index._note_bucket(search_index.NOTE_BUCKETS).alias("bucket")).collect()}
    same = {f for f in before["notes"] if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert same and same <= files(index.path, "notes")


def test_a_bucket_may_become_empty_and_an_index_too(spark):
    index = Index(spark, new_path(spark, "search")).build(spark.createDataFrame([("a", "p", "zz"), ("b", "p", "yy")], SCHEMA))
    index.upsert(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", "p")], "key string, project_path string"))
    assert [r.key for r in index.search("z y", "p").collect()] == ["b"] and index.terms.where("term = 'zz'").isEmpty()
    index.upsert(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("b", "p")], "key string, project_path string"))
    assert index.search("y", "p").collect() == [] and index.notes.isEmpty()
    assert Index(spark, new_path(spark, "search")).build(spark.createDataFrame([], SCHEMA)).search("a", "p").collect() == []
