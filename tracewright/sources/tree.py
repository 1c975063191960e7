"""Files of source trees as rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.packing import is_binary, is_code, is_ignored


def source_files(spark: SparkSession, root: str, own: tuple[str, ...] = (), code_only: bool = False) -> DataFrame:
    """``path`` (below the root), ``ext`` and ``content`` of each text file that isn't ignored; with ``code_only`` of those with symbols.

    Paths are judged before contents are read. Empty files give no rows; bytes that
    are no UTF-8 become marks. The ``source_tree`` format lists less: it never
    enters ignored folders, but needs a tree that every machine sees.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root).rstrip("/") + "/"  # without the store's name
    path = F.substr(F.col("path"), F.instr("path", top) + len(top))
    rows = rows.select(path.alias("path"), "content").where(~is_ignored(F.col("path"), own))
    if code_only:
        rows = rows.where(is_code(F.col("path")))
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return rows.where(~is_binary(F.col("content"))).select("path", ext.alias("ext"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))

