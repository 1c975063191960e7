import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import table, words
from tracewright.llm import op11_importance_resampling as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest=2):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)


def brute(rows, target, percent=25, longest=2, buckets=10000, least=20):
    def place(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(place, runs(text, longest)[0]))
    for text in target:
        t.update(map(place, runs(text, longest)[0]))
    n_s, n_t = sum(s.values()), sum(t.values())
    out, fit = [], []
    for at, (doc, text) in enumerate(rows):
        f, n = runs(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in map(place, f)]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None])
        if n >= least:
            fit.append((-score, doc is not None, doc or 0, at))
    for rank, x in enumerate(sorted(fit)[: len(fit) * percent // 100], 1):
        out[x[-1]][-1] = rank
    return sorted(map(str, out))


def awkward():
    rng = random.Random(11)
    texts = [None, "", "?! --", "One", "one ONE one", "Größe größe 東京 x1", "don't", " a b\tA\nB", words(rng, 6000), " ".join(["hot"] * 5000)]
    texts += [words(rng, rng.randint(15, 60)) for _ in range(60)] + ["same words here " * 10] * 30
    ids = [*range(len(texts) - 2), None, 5]
    return texts, ids


@pytest.mark.parametrize(("longest", "block", "part"), [(2, 8 << 20, 4 << 20), (2, 300, 500), (3, 1000, 100)])
def test_equals_brute_force(spark, monkeypatch, longest, block, part):
    monkeypatch.setattr(op, "BLOCK_BYTES", block)  # many blocks and parts
    monkeypatch.setattr(op, "PART_BYTES", part)
    texts, ids = awkward()
    target = ["the same WORDS here", None, "", words(random.Random(3), 200)]
    got = op.resample(table(spark, texts, ids), table(spark, target), longest=longest, percent=40).collect()
    assert got and sorted(str(list(r)) for r in got) == brute(list(zip(ids, texts, strict=True)), target, 40, longest)


def test_few_buckets_and_many(spark):
    texts, ids = awkward()
    for buckets in (1, 7, 100_000):
        got = op.resample(table(spark, texts, ids), table(spark, ["one two"]), buckets=buckets).collect()
        assert sorted(str(list(r)) for r in got) == brute(list(zip(ids, texts, strict=True)), ["one two"], buckets=buckets)


def test_ties_go_to_the_smaller_id_and_every_fit_row_may_be_drawn(spark):
    texts = ["w " * 20, "w " * 19, "w " * 20, "w " * 20]
    got = {r.doc_id: r["rank"] for r in op.resample(table(spark, texts), table(spark, ["w"]), percent=100).collect()}
    assert got[1] is None and sorted(x for x in got.values() if x) == [1, 2, 3]
    same = op.resample(table(spark, texts, [4, 4, 4, 4]), table(spark, ["w"]), percent=67).collect()
    assert sorted(r["rank"] or 0 for r in same) == [0, 0, 1, 2]


def test_dictionary_counts_every_string_once(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 200)
    texts, ids = awkward()
    got = op.feature_counts(table(spark, texts, ids)).collect()
    want = Counter(f for t in texts for f in runs(t)[0])
    assert len(got) == len(want) and {r.feature: r.n for r in got} == want


def test_empty_tables(spark):
    assert op.resample(table(spark, []), table(spark, ["a b"])).collect() == []
    texts, ids = awkward()
    got = op.resample(table(spark, texts, ids), table(spark, [])).collect()
    assert sorted(str(list(r)) for r in got) == brute(list(zip(ids, texts, strict=True)), [])
    assert op.feature_counts(table(spark, [None, ""])).collect() == []
