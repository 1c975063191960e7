import hashlib
import random
import re

import pytest

from tests.llm.helpers import table, words
from tracewright.llm import op08_decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    w, hit, found = split(text), set(), set()
    for item, body in items:
        v = split(body)
        n = min(13, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    found |= {str(item)} if item is not None else set()
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def cases():
    rng = random.Random(8)
    items = [(i, words(rng, rng.randint(1, 40))) for i in range(20)] + [(20, None), (21, ""), (22, "!!"), (None, words(rng, 15)), (2, words(rng, 14)), (23, "É été ünder one Two")]
    items += [(24, items[3][1]), (10, items[10][1]), (25, "a a a a a a a a a a a a a a")]
    texts = [None, "", "...", "a " * 40, "É ÉTÉ ünder ONE two"]
    for item, body in items:
        v = (body or "").split()
        texts += [words(rng, 30) + " " + " ".join(v).upper() + "; " + words(rng, 500), ", ".join(v[: len(v) // 2 + 1]), " ".join(v * 2)]
    return texts + [words(rng, 8000) + " " + items[0][1]], items


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_equals_brute_force(spark, bound):
    texts, items = cases()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    rows = op.decontaminate(table(spark, texts), bench, index_bytes=bound).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in rows}
    want = [brute(t, items) for t in texts]
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []
    assert any(w[4] for w in want) and not all(w[4] for w in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert op.decontaminate(table(spark, []), some).collect() == []
    (r,) = op.decontaminate(table(spark, ["a b c"], [None]), none).collect()
    assert (r.doc_id, r.n_words, r.n_hit, r.contaminated) == (None, 3, 0, False)
    assert op.decontaminate(table(spark, ["a b c"] * 2, [1, 1]), some).where("contaminated").count() == 2
    assert op.decontaminate(table(spark, []), some, index_bytes=0).collect() == []
    (r,) = op.decontaminate(table(spark, ["a b c"], [None]), none, index_bytes=-1).collect()
    assert (r.doc_id, r.n_words, r.n_hit, r.contaminated) == (None, 3, 0, False)


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_clean_rows_stay_with_all_columns(spark, bound):
    texts, items = cases()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    docs = table(spark, texts)
    got = op.uncontaminated(docs, bench, index_bytes=bound)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for i, t in enumerate(texts) if not brute(t, items)[4]]


def test_only_words_of_the_windows_reach_the_driver(spark, monkeypatch):
    texts, items = cases()
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    holders = op.item_windows(bench, 13, "item_id", "text")
    known = {w for _, body in items for w in split(body)}
    found, count = [], op._word_counts
    monkeypatch.setattr(op, "_word_counts", lambda *args: found.append(count(*args)) or found[0])
    windows, counts = op._local(table(spark, texts), holders, "text")
    assert found[0].count() == len(counts) <= len(known)
    every = [w for t in texts for w in split(t)]
    assert counts == {op._word_hash(w.encode()): every.count(w) for w in known if w in every}
