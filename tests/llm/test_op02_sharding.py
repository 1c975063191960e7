import zlib

from tests.llm.helpers import table
from tracewright.llm import op02_sharding as op


def jump(key, n):
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_published_hash_slots_and_growth(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), None, 7, 7, 7, *range(100, 400)]
    texts = ["", None, "é€", "a" * 5000, *["same"] * (len(ids) - 4)]
    got = op.shard(table(spark, texts, ids), 40).collect()
    assert len(got) == len(ids)
    size = dict(zip(ids[:5], [16, 16, 21, 5016, 20], strict=True))
    for r in got:
        assert r.shard == jump(r.doc_id or 0, 40)
        assert r.grown_shard == jump(r.doc_id or 0, 41)
        assert r.grown_shard in (r.shard, 40)
        if r.doc_id in size:
            assert r["size"] == size[r.doc_id]
    assert {r.doc_id: r.text_crc32 for r in got}[2**63 - 1] == zlib.crc32(b"a" * 5000)
    assert {r.doc_id: r.text_crc32 for r in got}[1] is None
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_hot_key_and_empty(spark):
    got = op.shard(table(spark, ["x"] * 500, [3] * 500), 4).collect()
    assert sorted(r.slot for r in got) == list(range(500)) and len({r.shard for r in got}) == 1
    assert op.shard(table(spark, []), 40).collect() == []
    assert {r.shard for r in op.shard(table(spark, ["x"], [9]), 1).collect()} == {0}
