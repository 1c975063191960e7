"""Tables that are kept up to date in place: only what a change touches is written, only what a query asks for is read."""

import os
from datetime import date, datetime

import pytest

from tracewright.functions.storage import new_path
from tracewright.operators import code_index, graph, ledger_store
from tracewright.operators.code_index import CodeIndex


def files(path, table):
    return {f"{d}/{x}" for d, _, names in os.walk(f"{path}/{table}") for x in names if x.endswith(".parquet")}


def by_bucket(found):
    out = {}
    for f in found:
        out.setdefault(int(f.split("bucket=")[1].split("/")[0]), set()).add(f)
    return out


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(code_index, "BUCKETS", 6)


def test_code_index_follows_its_files(spark, few):
    def table(content):
        return spark.createDataFrame([(p, p.rpartition(".")[2], c) for p, c in content.items()], "path string, ext string, content string")

    content = {f"d/m{i}.rs": f"fn f{i}() {{ f{i + 1}(); }}\n" for i in range(12)} | {"a.txt": "no code", "null.rs": None}
    index = CodeIndex(spark, new_path(spark, "code"))
    assert {r.state for r in index.refresh(table(content), 1).collect()} == {"added"}

    def check(content, at):
        symbols = ["id", "name", "kind", "file_path", "line_start", "line_end"]
        assert sorted(index.symbols.select(symbols).collect()) == sorted(graph.extracted_symbols(table(content)).select(symbols).collect())
        assert sorted(index.calls.select("caller_id", "callee_name").collect()) == sorted(graph.extracted_calls(table(content)).collect())
        assert {r.file_path: r.last_indexed for r in index.hashes.collect()} == at

    at = {p: 1 for p, c in content.items() if c is not None}
    check(content, at)
    before = {t: by_bucket(files(index.path, t)) for t in ("symbols", "calls", "hashes")}
    assert {r.state for r in index.refresh(table(content), 2).collect()} == {"same"}
    assert before == {t: by_bucket(files(index.path, t)) for t in before}  # nothing changed, nothing was written

    content["d/m3.rs"] = "\nfn f3() { other(); }\nstruct New;\n"
    index.refresh(table(content), 3)
    check(content, at | {"d/m3.rs": 3})
    own = spark.range(1).select(code_index.bucket(graph.F.lit("d/m3.rs")).alias("b")).first().b
    for t, old in before.items():
        now = by_bucket(files(index.path, t))
        assert {b for b in now if now[b] != old[b]} == {own}  # one file, one bucket

    gone = {p: c for p, c in content.items() if p != "d/m5.rs"} | {"d/new.py": "def g():\n  h()\n"}
    states = {r.file_path: r.state for r in index.refresh(table(gone), 4).collect()}
    assert (states["d/m5.rs"], states["d/new.py"], states["d/m3.rs"]) == ("gone", "added", "same")
    check(gone, {p: 1 for p, c in gone.items() if c is not None} | {"d/m3.rs": 3, "d/new.py": 4})
    index.refresh(table({"x.rs": "fn x() {}"}), 5)
    check({"x.rs": "fn x() {}"}, {"x.rs": 5})


def test_a_refresh_that_ended_early_is_done_again(spark, few, monkeypatch):
    rows = spark.createDataFrame([("a.rs", "rs", "fn a() { b(); }")], "path string, ext string, content string")
    index, put, n = CodeIndex(spark, new_path(spark, "code")), code_index.put_buckets, 0

    def fails(*args):
        nonlocal n
        n += 1
        if n == 3:
            raise RuntimeError("lost")
        put(*args)

    monkeypatch.setattr(code_index, "put_buckets", fails)
    with pytest.raises(RuntimeError, match="lost"):
        index.refresh(rows, 1)
    index.refresh(rows, 2)
    assert [(r.id, r.last_indexed) for r in index.symbols.join(index.hashes, "file_path").collect()] == [("Function:a.rs:a", 2)]
    assert index.calls.count() == 1


def test_ledger_by_day(spark):
    path = new_path(spark, "ledger")
    rows = [(i, "c", 10, 5, datetime(2024, 1, 1 + i // 4, 6 * (i % 4)), "raw", "m", "p", "b", 1) for i in range(40)] + [(99, "c", 1, 1, None, "raw", "m", "p", "b", 1)]
    table = spark.createDataFrame(rows, ledger_store.SCHEMAS["ledger"])
    ledger_store.save(table.where("id < 20 or id = 99"), path)
    ledger_store.save(table.where("id between 20 and 98"), path)
    assert sorted(map(str, ledger_store.load(spark, path).collect())) == sorted(map(str, table.collect()))
    some = ledger_store.load(spark, path, datetime(2024, 1, 3, 6), datetime(2024, 1, 4, 12))
    assert sorted(r.id for r in some.collect()) == [9, 10, 11, 12, 13]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    now = datetime(2024, 2, 3, 12)  # the time to live ends at noon of January 4
    assert ledger_store.expire(spark, path, now) == [date(2024, 1, d) for d in (1, 2, 3)]
    assert ledger_store.days(spark, path)[0] == date(2024, 1, 4)
    assert sorted(r.id for r in ledger_store.current(spark, path, now).collect()) == list(range(14, 40))
    assert ledger_store.expire(spark, path, now) == []
    assert 99 in {r.id for r in ledger_store.load(spark, path).collect()}
