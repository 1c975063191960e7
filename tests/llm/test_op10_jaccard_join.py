import itertools
import random
import re

import pytest

from tests.llm.helpers import table, words
from tracewright.llm import op10_jaccard_join
from tracewright.llm import op10_jaccard_join as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    links, root = [0] * len(texts), list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return links, root


@pytest.mark.parametrize("rows", [800, 5])
@pytest.mark.parametrize("sent", [10**6, 0])
def test_equals_brute_force(spark, monkeypatch, rows, sent):
    monkeypatch.setattr(op, "BLOCK_ROWS", rows)  # 5: large buckets are cut into cells
    monkeypatch.setattr(op, "SENT_KEYS", sent)
    monkeypatch.setattr(op, "SENT_BUCKETS", sent)
    rng = random.Random(10)
    texts = [None, "", "!!! ...", "one", "One.", "one two three", "a b c d e", "A b, c d e", words(rng, 9000)]
    base = [words(rng, rng.randint(30, 120)) for _ in range(12)]
    for i, b in enumerate(base):
        w = b.split()
        for _ in range(25 if i == 0 else 3):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = "zzz" + str(rng.randrange(9))
            texts.append(" ".join(v))
        texts += [b, b]
    got = {r.doc_id: r for r in op.near_duplicates(table(spark, texts)).collect()}
    links, root = brute(texts)
    assert [got[i].n_links for i in range(len(texts))] == links
    assert [got[i].class_id for i in range(len(texts))] == root
    assert [got[i].kept for i in range(len(texts))] == [root[i] == i for i in range(len(texts))]
    assert max(links) >= 10


def test_recall_on_documents(spark):
    """All true pairs of the smallest table, from an inverted index of shingles, against the links that were found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_links for r in op.near_duplicates(docs).collect()}
    rows = sorted(docs.select("doc_id", "text").collect())
    links, _ = brute([r.text for r in rows])
    true = sum(links)
    assert true and sum(got.values()) >= 0.99 * true
    assert all(got[r.doc_id] <= n for r, n in zip(rows, links, strict=True))


def test_ids_may_be_null_or_repeated_and_tables_empty(spark):
    got = op.near_duplicates(table(spark, ["a b c d e f"] * 3 + ["x"], [None, 5, 5, None])).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 2 and sorted(r.n_links for r in got) == [0, 2, 2, 2]
    assert op.near_duplicates(table(spark, [])).collect() == []


def test_banding_reaches_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands, rows = op.banding(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall > 1 - (1 - 0.8**rows) ** (bands - 1)


@pytest.mark.parametrize("sent", [10**6, 0])
def test_one_row_of_each_class_stays_with_all_columns(spark, sent):
    docs = table(spark, ["a b c d e f", "A b c d e f", None, None, "x y", "x z"])
    got = op.one_of_each(docs, sent_rows=sent)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.h) for r in got.collect()) == [(0, "a b c d e f", 7), (2, "", 7), (3, "", 7), (4, "x y", 7), (5, "x z", 7)]


def test_cells_hold_compressed_texts(spark, monkeypatch):
    word = [f"word{i * 7919 % 1000}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(word[i * 300 : i * 300 + 300] + [f"x{j}"])) for i in range(8) for j in range(2)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(op10_jaccard_join, "_verified", lambda cells, *a, f=op10_jaccard_join._verified: seen.append(cells) or f(cells, *a))
    assert {r.n_links for r in op10_jaccard_join.near_duplicates(docs).collect()} == {1}
    r = seen[0].selectExpr("sum(length(body)) AS sent", "sum(n) * 8 AS hashes").first()
    assert 0 < r.sent < r.hashes * 0.6
