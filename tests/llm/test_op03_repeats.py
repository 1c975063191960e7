import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import table, words
from tracewright.functions.storage import SMALL_BATCHES
from tracewright.llm import op03_repeats as op


def brute(texts, depth):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + depth] for b in bodies for i in range(len(b) - depth + 1))
    out = []
    for b in bodies:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                cover[i] += 1
                cover[i + depth] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    shared = [words(rng, 60) for _ in range(4)]
    texts = [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "c" * 5000, "ab" * 300, "é" * 150, words(rng, 5000)]
    for i in range(60):
        body = words(rng, rng.randint(1, 200))
        for s in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, 150)
            body += " " + s[cut:] + " " + words(rng, 5)
        texts.append(body)
        if i % 5 == 0:
            texts += [body, body[:-1] + "x", "z" + body]
    return texts + [texts[9][1000:1400] * 2, texts[9][2000:2199], texts[9][3000:3200]]


@pytest.mark.parametrize("kinds", [4000, 1])
@pytest.mark.parametrize("sent", [10**6, 0])
def test_equals_brute_force(spark, monkeypatch, kinds, sent):
    texts = corpus()
    monkeypatch.setattr(op, "TASK_KINDS", kinds)  # 1: every group is sorted by shuffles
    monkeypatch.setattr(op, "SENT_BLOCKS", sent)  # 0: texts meet their blocks in a shuffle
    monkeypatch.setattr(op, "SORT_BYTES", 20_000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.remove_repeats(table(spark, texts)).collect()}
    want = brute(texts, 200)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []
    assert sum(w[1] for w in want) > 0


def test_other_depth_and_empty(spark):
    texts = corpus()[:40]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.remove_repeats(table(spark, texts), depth=83).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 83)
    assert op.remove_repeats(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        op.remove_repeats(table(spark, []), depth=50)


def test_blocks_of_one_first_digit_without_an_equal_window(spark):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh") for _ in range(150))  # shorter than a window: the first digit is shared, no window is
    texts = [x * 60 + shared + y * 60 for x, y in ("ij", "kl", "mn")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.remove_repeats(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200) and all(g[1] == 0 for g in got.values())


def test_large_groups_are_sorted_without_a_row_for_each_window(spark, monkeypatch):
    rng = random.Random(11)
    line, base = words(rng, 25)[:120], words(rng, 90)[:400]
    texts = []
    for i in range(60):  # a line among other words, and near copies of one text
        at = rng.randrange(len(base))
        texts += [words(rng, 20) + line + words(rng, 20), base[:at] + chr(0x100 + i) + base[at + 1 :]]
    texts += [texts[0], texts[1], "x" + texts[3]]
    rows, stored = Counter(), op.stored

    def counted(df, name):
        out = stored(df, name)
        rows[name] = max(rows[name], out.count())
        return out

    monkeypatch.setattr(op, "TASK_KINDS", 20)
    monkeypatch.setattr(op, "stored", counted)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.remove_repeats(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)
    assert max(rows.values()) <= 2 * rows["again"]
    assert rows["halves"] > 0


def test_tasks_have_one_python_worker_and_get_small_batches(spark, monkeypatch, capsys):
    before, seen, stored = {k: spark.conf.get(k) for k in SMALL_BATCHES}, [], op.stored

    def watched(df, name):
        capsys.readouterr()
        df.explain()
        seen.append((name, capsys.readouterr().out, {k: spark.conf.get(k) for k in SMALL_BATCHES}))
        return stored(df, name)

    monkeypatch.setattr(op, "TASK_KINDS", 1)
    monkeypatch.setattr(op, "stored", watched)
    out = op.remove_repeats(table(spark, corpus()))
    assert {"halves", "told"} <= {name for name, _, _ in seen}
    assert all(conf == {k: str(v) for k, v in SMALL_BATCHES.items()} for _, _, conf in seen)
    assert {k: spark.conf.get(k) for k in SMALL_BATCHES} == before
    out.explain()
    assert "MapInPandas" not in capsys.readouterr().out  # nothing is left that would run under the session's own batches
    for name, plan, _ in seen:
        python = False
        for line in plan.splitlines():  # from the result down
            assert not (python and "MapInPandas" in line), name
            python = "MapInPandas" in line or python and "Exchange" not in line and "Scan" not in line


def test_sorting_takes_few_bytes_a_window():
    rng = np.random.default_rng(5)
    buffer = rng.integers(97, 123, 1 << 19, dtype=np.uint8)
    buffer[1 << 18 :] = buffer[: 1 << 18]  # all windows of one half stay to the last pass
    start = np.arange(len(buffer) - 199, dtype=np.int32)
    tracemalloc.start()
    try:
        left = op.equal_windows(buffer, np.zeros(len(start), np.int32), start, 200)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Windows across the middle have no partner.
    assert len(left) == 2 * ((1 << 18) - 199)
    assert peak < 50 * len(start)
