import random

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import table, words


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    item = words(rng, 40)
    base = [words(rng, 80) for _ in range(30)]
    texts = [*base, base[0], base[1] + " more", item, "mail me at a@b.example now", None, "123"]
    docs = table(spark, texts, langs=["aa"] * len(texts)).drop("_row", "body", "h")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    ids = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        ids = sorted(r.doc_id for r in docs.collect())
    assert ids == [*range(30), 33]
    assert {r.doc_id: r.text for r in docs.collect()}[33] == "mail me at <email> now"
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}) == ids


def test_stages_take_awkward_tables(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rng = random.Random(12)
    texts = [None, "", "...", words(rng, 60), words(rng, 60), words(rng, 5000)]
    clashing = table(spark, [*texts, texts[3]], [1, 1, None, 2, 3, 4, 2], ["aa"] * 7)
    for docs in (clashing, clashing.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == clashing.columns and docs.dtypes == clashing.dtypes
            docs = spark.createDataFrame(docs.collect(), clashing.schema)
        left = sorted(r.doc_id for r in docs.collect())
        assert left in ([2, 3, 4], [])
        assert sorted({r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}) == left


def test_entry_has_the_eleven_queries():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_sql_has_a_query(name):
    assert name in __spark_entry__.queries()
