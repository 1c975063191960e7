import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import table, words
from tracewright.llm import op07_packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids():
    return op.Ids(PATH)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from("'sdtrevml <|>İſK日́"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_the_tokenizers(text):
    one = op._loaded.get(PATH) or op._loaded.setdefault(PATH, op.Ids(PATH))
    assert one.of(text) == np.array(one.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_and_places(spark, ids):
    rng = random.Random(7)
    texts = [None, "", "a", "<|endoftext|>", "日本 text", *[words(rng, int(rng.expovariate(1 / 80)) + 1) for _ in range(80)], words(rng, 3000), *["same text here"] * 5]
    got = op.pack(table(spark, texts), PATH, size=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        want = [*ids.whole.encode(t or "", add_special_tokens=False).ids, 0]
        rows = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in rows] == list(range(0, len(want), 256))
        for r in rows:
            one = want[r.start : r.start + 256]
            assert (r.length, r.ids_crc32) == (len(one), zlib.crc32(np.array(one, "<u4").tobytes()))
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // 256) + 1
    assert op.pack(table(spark, []), PATH).collect() == []


def least_bins(items, size):
    best = len(items)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        tried = set()
        for i, b in enumerate(bins):
            if b + rest[0] <= size and b not in tried:
                tried.add(b)
                bins[i] += rest[0]
                go(rest[1:], bins)
                bins[i] -= rest[0]
        go(rest[1:], [*bins, rest[0]])

    go(sorted(items, reverse=True), [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_an_optimum(items):
    counts = {n: items.count(n) for n in set(items)}
    made = op._Plan(dict(counts), 20)
    made.reduce()
    rest = [n for n, c in made.left.items() for _ in range(c)]
    assert made.next + least_bins(rest, 20) == least_bins(items, 20)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 5000), min_size=1, max_size=30))
def test_plan_places_each_rank_once(counts):
    rows, fill, seen = op.plan(counts, 64), defaultdict(list), defaultdict(list)
    for length, first, last, sequence, each, offset in rows:
        seen[length].append((first, last))
        for r in range(first, last):
            fill[sequence + (r - first) // each].append((offset + (r - first) % each * length, length))
    for n, c in counts.items():
        assert sorted(seen[n])[0][0] == 0 and sorted(seen[n])[-1][1] == c
        assert all(a[1] == b[0] for a, b in zip(sorted(seen[n]), sorted(seen[n])[1:], strict=False))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
