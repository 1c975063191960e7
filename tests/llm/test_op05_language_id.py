import random
import zlib

from tests.llm.helpers import table
from tracewright.llm import op05_language_id as op

PARTS = {"aa": ["the", "and", "ing", "tion", "wh"], "bb": ["sch", "ung", "ein", "pf", "heit"], "cc": ["ción", "rr", "as", "os", "ñ"]}


def corpus(n):
    rng = random.Random(5)
    langs = [rng.choice(list(PARTS)) for _ in range(n)]
    return [" ".join("".join(rng.choice(PARTS[g]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 60))) for g in langs], langs


def test_held_out_accuracy_and_awkward_texts(spark):
    texts, langs = corpus(600)
    odd = [None, "", "123 !! ..", "日本語", "the", "sch " * 30_000]
    got = {r.doc_id: r for r in op.identify(table(spark, texts + odd, langs=langs + ["aa", None, "bb", None, None, None])).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (600, 601, 602)] == ["und"] * 3 and not any(got[i].accepted for i in (600, 601, 602))
    assert got[603].lang_pred in PARTS and not got[603].accepted
    assert got[605].lang_pred == "bb" and got[605].accepted


def test_held_out_labels_and_sources_are_not_used(spark):
    texts, langs = corpus(200)
    lied = [g if zlib.crc32(str(i).encode()) % 4 != 2 else "zz" for i, g in enumerate(langs)]
    a = op.identify(table(spark, texts, langs=langs)).select("doc_id", "lang_pred", "score").collect()
    b = op.identify(table(spark, texts, langs=lied)).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = op.identify(docs).where("held_out and accepted").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars >= 40 and lang is not null").collect()
    assert len(got) >= 20 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.9


def test_copies_do_not_empty_the_sample(spark):
    texts, langs = corpus(40)
    rows = table(spark, [*texts, *["sch ung ein pf heit sch"] * 3000], [*range(40), *[40] * 3000], [*langs, *["bb"] * 3000])
    assert [k for k, _ in op.fit(rows).dictionaries][0] == "bb" and len(op.fit(rows).dictionaries) == 3


def test_nothing_to_learn_and_empty(spark):
    (r,) = op.identify(table(spark, ["hello there"])).collect()
    assert r.lang_pred == "und" and r.score == 0
    assert op.identify(table(spark, [])).collect() == []
    assert op.identify(table(spark, ["x", "x"], [None, None])).count() == 2
