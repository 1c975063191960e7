"""Source trees and diffs as registered data sources: folders are partitions, ignored folders are never listed."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from tracewright.operators.packing import CODE, IGNORED, SNIFFED_BYTES

#: Files a partition, and bytes of texts that a reader gives at once (or one larger file).
PARTITION_FILES, BATCH_BYTES = 500, 8 << 20

#: The filters that paths and extensions answer.
KINDS = {("path",): (EqualTo, In, StringStartsWith, StringEndsWith), ("ext",): (EqualTo, In)}
_HUNK = re.compile(r"@@ .*?\+(\d+)(?:,(\d+))?")


def _ignored(path: str, patterns: tuple[str, ...]) -> bool:
    parts = path.split("/")
    return any(p in parts or path.startswith(p) or f"/{p}" in path for p in patterns)


def _ext(path: str) -> str:
    found = re.search(r"\.([^./]+)$", path)
    return found[1] if found else ""


@dataclass
class _Files(InputPartition):
    """Some files of one folder, by their paths below the root."""

    paths: tuple[str, ...]


class _TreeReader(DataSourceReader):
    """Lists folders from the root down where planning runs, and reads files in the tasks."""

    known = ("path", "ext")

    def __init__(self, options: Mapping[str, str]) -> None:
        root = re.sub(r"^file:/+", "/", options.get("path", ""))
        if not os.path.isdir(root):
            raise ValueError(f"not a folder that this machine can list: {root!r}")
        self.root = root.rstrip("/") or "/"
        own = tuple(x for x in options.get("ignore", "").split(",") if x)
        self.patterns = tuple(p.rstrip("/") for p in (*IGNORED, *own))
        self.code_only = options.get("codeOnly", "false").lower() == "true"
        self.paths: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what a path or its extension can answer; gives back the rest. No column is ever null."""
        for f in filters:
            if isinstance(f, KINDS.get(f.attribute, ())) and f.attribute[0] in self.known:
                self.paths.append(f)
            elif not isinstance(f, IsNotNull):
                yield f

    def _wanted(self, path: str) -> bool:
        if self.code_only and (not (found := re.search(r"\.([A-Za-z]+)$", path)) or found[1] not in CODE):
            return False
        for f in self.paths:
            x = path if f.attribute == ("path",) else _ext(path)
            match f:
                case EqualTo():
                    ok = x == f.value
                case In():
                    ok = x in f.value
                case StringStartsWith():
                    ok = x.startswith(f.value)
                case _:
                    ok = x.endswith(f.value)
            if not ok:
                return False
        return True

    def _entered(self, folder: str) -> bool:
        """Whether a folder (ending in a slash) may hold a wanted path."""
        for f in self.paths:
            if f.attribute != ("path",) or isinstance(f, StringEndsWith):
                continue
            values = f.value if isinstance(f, In) else (f.value,)
            below = [v.startswith(folder) or (isinstance(f, StringStartsWith) and folder.startswith(v)) for v in values if v is not None]
            if not any(below):
                return False
        return True

    def _listed(self) -> Iterator[_Files]:
        folders = [""]
        while folders:
            folder, files = folders.pop(), []
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    path = folder + e.name
                    if _ignored(path, self.patterns):
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if self._entered(f"{path}/"):
                            folders.append(f"{path}/")
                    elif e.is_file() and self._wanted(path):
                        files.append(path)
            for i in range(0, len(files), PARTITION_FILES):
                yield _Files(tuple(files[i : i + PARTITION_FILES]))

    def partitions(self) -> list[InputPartition]:
        return list(self._listed()) or [_Files(())]

    def _texts(self, paths: tuple[str, ...]) -> Iterator[tuple[str, str]]:
        for path in paths:
            with open(os.path.join(self.root, path), "rb") as f:
                content = f.read(SNIFFED_BYTES)
                if b"\0" not in content:
                    yield path, (content + f.read()).decode("utf-8", "replace")

    def _batches(self, rows: Iterator[tuple[tuple, int]], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row, n in rows:
            held.append(row)
            size += n
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], list(names))
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], list(names))

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows = (((path, _ext(path), text), len(text)) for path, text in self._texts(partition.paths))
        return self._batches(rows, ("path", "ext", "content"))


class SourceTree(DataSource):
    """``path`` (below the root), ``ext`` and ``content`` of the text files of a tree that every machine sees at the same place.

    Options: the path to load, ``ignore`` (own patterns, comma-separated) and
    ``codeOnly``. Files that are binary or ignored give no rows, empty files
    give empty texts, bytes that are no UTF-8 become marks. Links to folders are
    not followed. Only listing, one name and path a file, runs in one place.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, ext string, content string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(self.options)


def hunks(rows: Iterable[str]) -> Iterator[tuple[str, int, int]]:
    """File and changed lines of the new side of each hunk of a diff, line by line; the same as ``graph.parse_hunks`` of its text."""
    path = None
    for line in rows:
        line = line.removesuffix("\n").removesuffix("\r")
        if line.startswith("+++ b/"):
            path = line[6:]
        elif path is not None and (m := _HUNK.match(line)):
            size = int(m[2] or 1)
            if size:
                yield path, int(m[1]), int(m[1]) + size - 1


class _DiffReader(_TreeReader):
    known = ("path",)

    def _wanted(self, path: str) -> bool:
        return _ext(path) in ("diff", "patch") and super()._wanted(path)

    def _hunks(self, paths: tuple[str, ...]) -> Iterator[tuple[tuple, int]]:
        for path in paths:
            with open(os.path.join(self.root, path), encoding="utf-8", errors="replace", newline="\n") as f:
                for h in hunks(f):
                    yield (path, *h), 64 + len(path)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for b in self._batches(self._hunks(partition.paths), ("path", "file_path", "first_line", "last_line")):
            yield b.cast(pa.schema([("path", pa.string()), ("file_path", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32())]))


class DiffTree(SourceTree):
    """The hunks of all diff and patch files of a tree: ``path`` of the diff, ``file_path``, ``first_line``, ``last_line``.

    Files are read a line at a time, so a diff may have any size.
    """

    @classmethod
    def name(cls) -> str:
        return "source_diffs"

    def schema(self) -> str:
        return "path string, file_path string, first_line int, last_line int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _DiffReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session and lets filters reach them."""
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(DiffTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
