"""The tree and diff sources: rows as by whole listing, folders that must not be listed, filters that reach the reader."""

import os

import pytest

from tracewright.operators import graph
from tracewright.sources import tree, tree_source


@pytest.fixture
def root(spark, tmp_path):
    tree_source.register(spark)
    files = {
        "a/x.rs": b"fn a() {}", "a/b/y.md": "é".encode(), "a/z.bin": b"a\0b", "target/t.rs": b"x", "own/o.rs": b"x", "e.py": b"pass", "a/none.py": b"",
        "node_modules/p/i.js": b"x", "c/q.patch": b"--- a/x.rs\n+++ b/x.rs\n@@ -1,2 +1,3 @@ fn\n x\n@@ -9 +10 @@\n+y\n@@ -20,2 +22,0 @@\n-z\n+++ b/n.py\r\n@@ -0,0 +1 @@\n+v\n", "c/bad.txt": b"\xff",
    }
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    return str(tmp_path)


def load(spark, root, **options):
    return spark.read.format("source_tree").options(**options).load(root)


def test_rows_are_those_of_a_whole_listing(spark, root):
    got = {tuple(r) for r in load(spark, root, ignore="own").collect()}
    want = {tuple(r) for r in tree.source_files(spark, root, ("own",)).collect()}
    assert want | {("a/none.py", "py", "")} == got and ("c/bad.txt", "txt", "�") in got
    assert {r.path for r in load(spark, root, codeOnly="true").collect()} == {"a/x.rs", "a/none.py", "e.py", "own/o.rs"}


def test_ignored_and_unwanted_folders_are_never_listed(spark, root, monkeypatch):
    listed, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: listed.append(os.path.relpath(p, root)) or scan(p))
    reader = tree_source._TreeReader({"path": root})
    assert sum(len(p.paths) for p in reader.partitions()) == 8
    assert sorted(listed) == [".", "a", "a/b", "c", "own"]
    listed.clear()
    reader = tree_source._TreeReader({"path": root})
    kept = list(reader.pushFilters([tree_source.StringStartsWith(("path",), "a/b/"), tree_source.EqualTo(("content",), "x")]))
    assert [f.attribute for f in kept] == [("content",)]
    assert [p.paths for p in reader.partitions()] == [("a/b/y.md",)] and listed == [".", "a", "a/b"]


def test_filters_reach_the_reader_and_rows_stay_right(spark, root):
    rows = load(spark, root)
    assert [r.path for r in rows.where("ext = 'py'").orderBy("path").collect()] == ["a/none.py", "e.py"]
    assert [r.path for r in rows.where("path LIKE 'a/%' AND ext IN ('md', 'rs')").orderBy("path").collect()] == ["a/b/y.md", "a/x.rs"]
    assert [r.path for r in rows.where("path = 'e.py' AND content = 'pass'").collect()] == ["e.py"]
    assert rows.where("path = 'target/t.rs'").count() == 0
    plan = rows.where("ext = 'py'")._jdf.queryExecution().executedPlan().toString()
    assert ") Filter " not in plan


def test_many_files_are_several_partitions(spark, root):
    for i in range(tree_source.PARTITION_FILES + 1):
        with open(f"{root}/own/m{i}.rs", "w") as f:
            f.write("x" * i)
    rows = load(spark, root).where("path LIKE 'own/m%'")
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == tree_source.PARTITION_FILES + 1


def test_empty_and_missing_trees(spark, tmp_path):
    tree_source.register(spark)
    assert load(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="not a folder"):
        load(spark, str(tmp_path / "missing")).count()


def test_hunks_are_those_of_the_parsed_texts(spark, root):
    got = sorted(tuple(r) for r in spark.read.format("source_diffs").load(root).collect())
    texts = load(spark, root).where("ext = 'patch'")
    want = sorted((r.path, r.file_path, r.first_line, r.last_line) for r in graph.parse_hunks(texts, "path", "content").collect())
    assert got == want == [("c/q.patch", "n.py", 1, 1), ("c/q.patch", "x.rs", 1, 3), ("c/q.patch", "x.rs", 10, 10)]
    assert spark.read.format("source_diffs").load(root).where("file_path = 'n.py' AND path LIKE 'c/%'").count() == 1
