"""Log filters with memory: lines as rows, windows over each log, and the log put together again.

Each takes (df, key, text) and gives ``key`` and ``filtered``. Keys are unique.
The state a line depends on is a running count, the last value so far, or a
place in a run, so one shuffle by key serves a whole filter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.lines import cut_bytes, is_blank, lines, starts_with_any, strip, strip_end

Filter = Callable[[DataFrame, str, str], DataFrame]

# Patterns and bounds on which results must agree.
DIFF_FILE = r"^diff --git a/.+ b/(.+)$"
DIFF_HUNK = r"(?U)^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
DIFF_META = ("index ", "--- ", "+++ ", "deleted file mode", "new file mode", "\\ No newline")
LINE_BYTES, HUNK_LINES, HUNK_HEAD = 80, 8, 3
UNTRACKED_SHOWN, ADDED_SHOWN, WARNINGS_SHOWN = 10, 5, 3
RULE = r"(?U)^={3,}\s+(.+)\s+={3,}$"
PREAMBLE = r"(?U)^(platform|plugins|rootdir|configfile|collected|plugins)[:\s]"
RUFF_HEADER = r"(?U)^([A-Z]{1,4}\d{1,4})\s+(\[\*\]\s+)?(.*)$"
RUFF_LOCATION = r"(?U)^\s*-->\s+(\S+:\d+:\d+)\s*$"
RUFF_CONCISE = r"(?U)^\S+:\d+:\d+:\s+[A-Z]{1,4}\d{1,4}\b"
RUFF_SUMMARY = r"(?U)^\s*(Found \d+ error|\[\*\] \d+ fixable|All checks passed|warning:|error:)"
MYPY_FOUND = r"(?U)^(\S+:\d+:(?:\d+:)?)\s+(error|note|warning):\s?(.*)$"
MYPY_SUMMARY = r"(?U)^(Found \d+ error|Success: no issues|No issues found)"
CARET = r"(?U)^\s*\^[~^]*\s*$"
TOLD_ERROR = r"(?iU)\b(error|panic|failed|exception|fatal|critical|severe|warning)\b"
TOLD_DIAGNOSTIC = r"(?U)^(error|warning|note|info|err|warn):\s+|^\[(ERROR|WARN|FATAL|SEVERE)\]"


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("bare", strip(F.col("line")))


def _so_far(condition: Column, *by: str) -> Column:
    """How many rows up to this one fulfil the condition."""
    w = Window.partitionBy("key", *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(condition.cast("int")).over(w)


def _before(x: Column, *by: str) -> Column:
    """The last value that isn't null on an earlier row."""
    w = Window.partitionBy("key", *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(x, ignorenulls=True).over(w)


def _up_to(x: Column) -> Column:
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(x, ignorenulls=True).over(w)


def _together(df: DataFrame, key: str, text: str, out: DataFrame, end: str) -> DataFrame:
    """The kept lines (key, pos, sub, told) of each log, or the log itself when ``end`` says so."""
    told = out.where("told is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "told"))).alias("rows"))
    joined = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(told, "key", "left")
    body = F.array_join(F.transform("rows", lambda x: F.concat(x.told, F.lit("\n"))), "")
    body = F.coalesce(body, F.lit(""))
    whole = F.col("text")
    if end == "empty":
        result = F.when(body == "", whole).otherwise(body)
    elif end == "blank":
        result = F.when(is_blank(body), whole).otherwise(body)
    elif end == "trimmed":
        result = F.when(is_blank(body), whole).otherwise(F.concat(strip_end(body), F.lit("\n")))
    else:  # "ended": a blank log gives one line end
        result = F.when(is_blank(body) & ~is_blank(whole), whole).otherwise(F.concat(strip_end(body), F.lit("\n")))
    return joined.select(F.col("key").alias(key), result.alias("filtered"))


def git_diff(df: DataFrame, key: str, text: str) -> DataFrame:
    """File names, short hunk headers and changed lines; long hunks keep their first lines and counts of the rest."""
    line = F.col("line")
    kind = (
        F.when(line.rlike(DIFF_FILE), "file")
        .when(line.rlike(DIFF_HUNK), "hunk")
        .when(starts_with_any(line, (*DIFF_META, " ")) | (line == ""), "dropped")
        .when(line.startswith("+"), "added")
        .when(line.startswith("-"), "removed")
        .otherwise("other")
    )
    rows = _rows(df, key, text).withColumn("kind", kind).where("kind <> 'dropped'")
    change = F.col("kind").isin("added", "removed")
    header = F.concat(F.lit("@@ -"), F.regexp_extract(line, DIFF_HUNK, 1), F.lit(" +"), F.regexp_extract(line, DIFF_HUNK, 2), F.lit(" @@"))
    rows = rows.withColumn("part", _so_far(~change)).withColumn("header", _up_to(F.when(~change, F.when(F.col("kind") == "hunk", header).otherwise(""))))
    rows = rows.withColumn("nth", _so_far(change, "part"))
    part = Window.partitionBy("key", "part")

    def late(kind: str) -> Column:
        return F.sum(((F.col("kind") == kind) & (F.col("nth") > HUNK_HEAD)).cast("int")).over(part)

    rows = rows.withColumn("n", F.max("nth").over(part)).withColumn("more", late("added")).withColumn("less", late("removed"))
    plus = F.when(F.col("more") > 0, F.concat(F.lit("+"), F.col("more").cast("string"))).otherwise("")
    minus = F.when(F.col("less") > 0, F.concat(F.lit(" -"), F.col("less").cast("string"))).otherwise("")
    rest = F.concat(F.lit("[…"), plus, minus, F.lit(" more lines]"))
    shown = F.when((F.col("n") <= HUNK_LINES) | (F.col("nth") <= HUNK_HEAD), cut_bytes(line, LINE_BYTES)).when(F.col("nth") == HUNK_HEAD + 1, rest)
    own = F.when(change, shown).when(F.col("kind") == "file", F.concat(F.lit("["), F.regexp_extract(line, DIFF_FILE, 1), F.lit("]"))).when(F.col("kind") == "other", line)
    first = F.when(change & (F.col("nth") == 1), F.coalesce("header", F.lit("")))
    out = rows.select("key", "pos", F.posexplode(F.array(first, own)).alias("sub", "told"))
    return _together(df, key, text, out, "empty")


def git_status(df: DataFrame, key: str, text: str) -> DataFrame:
    """Entries with their section before them; the first untracked ones and the number of the others."""
    bare = F.col("bare")
    section = (
        F.when(bare.startswith("Changes to be committed"), "staged")
        .when(bare.startswith("Changes not staged for commit"), "unstaged")
        .when(bare.startswith("Untracked files"), "untracked")
        .when(bare.startswith("Unmerged paths"), "conflict")
    )
    dropped = (bare == "") | starts_with_any(bare, ("(use ", "nothing added", "no changes added"))
    rows = _rows(df, key, text).where(~dropped).withColumn("title", section).withColumn("section", _up_to(section))
    clean = bare == "nothing to commit, working tree clean"
    entry = F.col("line").startswith("\t") & F.col("section").isNotNull() & ~clean & F.col("title").isNull()
    rows = rows.withColumn("entry", entry).withColumn("nth", _so_far(entry & (F.col("section") == "untracked")))
    listed = (F.col("section") != "untracked") | (F.col("nth") <= UNTRACKED_SHOWN)
    told = F.when(clean, "clean").when(F.col("entry"), F.when(listed, F.concat_ws(": ", "section", "bare"))).otherwise(bare)
    out = rows.select("key", "pos", F.lit(0).alias("sub"), F.when(F.col("title").isNull(), told).alias("told"))
    over = rows.groupBy("key").agg((F.max("nth") - UNTRACKED_SHOWN).alias("over")).where("over > 0")
    more = over.select("key", F.lit(2**31 - 1).alias("pos"), F.lit(0).alias("sub"), F.concat(F.lit("... and "), F.col("over").cast("string"), F.lit(" more untracked")).alias("told"))
    return _together(df, key, text, out.union(more), "blank")


def git_log(df: DataFrame, key: str, text: str) -> DataFrame:
    """Short hash and subject of each commit."""
    line = F.col("line")
    code = F.regexp_extract(line, r"(?U)^commit \s*([0-9a-fA-F]{7,})(?=\s|$)", 1)
    rows = _rows(df, key, text).withColumn("code", F.when(code != "", F.substring(code, 1, 7))).withColumn("commit", _so_far(F.col("code").isNotNull()))
    rows = rows.withColumn("hash", _up_to(F.col("code")))
    body = F.col("code").isNull() & (F.col("commit") > 0) & (F.col("bare") != "") & ~starts_with_any(line, ("Author:", "Date:", "Merge:"))
    rows = rows.withColumn("subject", body & (_so_far(body, "commit") == 1))
    out = rows.where("subject").select("key", "pos", F.lit(0).alias("sub"), F.concat_ws("  ", "hash", "bare").alias("told"))
    return _together(df, key, text, out, "empty")


def _collapsed(df: DataFrame, key: str, text: str, rows: DataFrame, notes: list[tuple[str, int | None, str]]) -> DataFrame:
    """Package managers' logs: of each noted kind the first ones, counts of the others before the next shown line."""
    shown = F.col("kind") == "kept"
    for kind, most, _ in notes:
        rows = rows.withColumn(f"nth_{kind}", _so_far(F.col("kind") == kind))
        if most:
            shown = shown | ((F.col("kind") == kind) & (F.col(f"nth_{kind}") <= most))
    rows = rows.withColumn("shown", shown).withColumn("part", _so_far(F.col("shown")))
    out = rows.where("shown").select("key", F.col("part").alias("pos"), F.lit(0).alias("sub"), F.col("line").alias("told"))
    hidden = rows.where(~F.col("shown")).groupBy("key", "part", "kind").agg(F.count("*").alias("n"))
    for i, (kind, _, note) in enumerate(notes, 1):
        before, after = note.split("{n}")
        told = F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after))
        out = out.union(hidden.where(F.col("kind") == kind).select("key", F.col("part").alias("pos"), F.lit(i).alias("sub"), told.alias("told")))
    return _together(df, key, text, out, "ended")


def npm_install(df: DataFrame, key: str, text: str) -> DataFrame:
    bare = F.col("bare")
    kind = (
        F.when((bare == "") | bare.rlike(r"(?U)^Progress: resolved \d+"), "dropped")
        .when(bare.startswith("npm ERR!"), "kept")
        .when(bare.startswith("npm warn "), "warning")
        .when(bare.rlike("^added .+"), "added")
        .otherwise("kept")
    )
    rows = _rows(df, key, text).withColumn("kind", kind).where("kind <> 'dropped'")
    notes = [("added", ADDED_SHOWN, "... {n} packages added (collapsed) ..."), ("warning", WARNINGS_SHOWN, "... {n} deprecation warnings collapsed ...")]
    return _collapsed(df, key, text, rows, notes)


def yarn_install(df: DataFrame, key: str, text: str) -> DataFrame:
    bare = F.col("bare")
    kind = (
        F.when(bare == "", "dropped")
        .when(bare.startswith("error ") | bare.contains("ERR!"), "kept")
        .when(bare.rlike(r"(?U)^\[\d+/\d+\]"), "step")
        .when(bare.rlike("^warning .+"), "warning")
        .when(bare.rlike("^(info|warning) .+@(file:|npm:|https?:)"), "package")
        .otherwise("kept")
    )
    rows = _rows(df, key, text).withColumn("kind", kind).where("kind <> 'dropped'")
    notes = [
        ("step", None, "... {n} yarn steps collapsed ..."),
        ("package", ADDED_SHOWN, "... {n} package lines collapsed ..."),
        ("warning", WARNINGS_SHOWN, "... {n} warnings collapsed ..."),
    ]
    return _collapsed(df, key, text, rows, notes)


def pytest_run(df: DataFrame, key: str, text: str) -> DataFrame:
    """Without the preamble; sections of warnings as a count."""
    bare = F.col("bare")
    title = strip(F.regexp_extract(bare, RULE, 1))
    rows = _rows(df, key, text).withColumn("title", F.when(bare.rlike(RULE), title))
    warns = (F.col("title") == "WARNINGS") | F.col("title").startswith("warnings summary")
    rows = rows.withColumn("in_warnings", F.coalesce(_up_to(warns), F.lit(False)))
    was = F.lag("in_warnings", 1, False).over(Window.partitionBy("key").orderBy("pos"))
    counted = F.col("in_warnings") & F.col("title").isNull() & bare.contains("Warning")
    rows = rows.withColumn("was", was).withColumn("n", _so_far(counted))
    begun = F.when(F.col("title").isNotNull(), ~F.col("title").contains("test session starts")).otherwise(
        ~F.col("in_warnings") & (bare != "") & ~bare.rlike(PREAMBLE)
    )
    rows = rows.withColumn("preamble", _so_far(begun) == 0)
    plain = ~F.col("in_warnings") & ~(F.col("preamble") & (bare.rlike(PREAMBLE) | (bare == "")))
    note = F.concat(F.lit("=== "), F.col("n").cast("string"), F.lit(" warnings collapsed (run with -W ignore to suppress) ==="))
    left = F.col("was") & ~F.col("in_warnings") & (F.col("n") > 0)
    out = rows.select("key", "pos", F.posexplode(F.array(F.when(left, F.concat(note, F.lit("\n"))), F.when(plain, F.col("line")))).alias("sub", "told"))
    last = rows.groupBy("key").agg(F.max_by("in_warnings", "pos").alias("open"), F.max("n").alias("n")).where("open and n > 0")
    end = last.select("key", F.lit(2**31 - 1).alias("pos"), F.lit(0).alias("sub"), note.alias("told"))
    return _together(df, key, text, out.union(end), "ended")


def ruff_check(df: DataFrame, key: str, text: str) -> DataFrame:
    """A rule's header joined to the location below it; concise findings and summaries as they are."""
    line = F.col("line")
    kind = (
        F.when(line.rlike(RUFF_LOCATION), "location")
        .when(line.rlike(RUFF_HEADER), "header")
        .when(line.rlike(RUFF_CONCISE) | line.rlike(RUFF_SUMMARY), "kept")
    )
    rows = _rows(df, key, text).withColumn("kind", kind).where("kind is not null")
    star = F.when(F.regexp_extract(line, RUFF_HEADER, 2) != "", " [*]").otherwise("")
    rule = F.concat(F.regexp_extract(line, RUFF_HEADER, 1), star, F.lit(" "), strip(F.regexp_extract(line, RUFF_HEADER, 3)))
    rows = rows.withColumn("above", F.lag(F.when(F.col("kind") == "header", rule)).over(Window.partitionBy("key").orderBy("pos")))
    place = F.concat(F.regexp_extract(line, RUFF_LOCATION, 1), F.lit(": "), F.col("above"))
    out = rows.select("key", "pos", F.lit(0).alias("sub"), F.when(F.col("kind") == "location", place).when(F.col("kind") == "kept", line).alias("told"))
    return _together(df, key, text, out, "trimmed")


def mypy_run(df: DataFrame, key: str, text: str) -> DataFrame:
    """Findings with their wrapped lines in one; frames (a source line and its caret) go."""
    line, bare = F.col("line"), F.col("bare")
    caret = line.rlike(CARET)
    rows = _rows(df, key, text).withColumn("frame", caret | F.coalesce(F.lead(caret).over(Window.partitionBy("key").orderBy("pos")), F.lit(False)))
    found, summary = line.rlike(MYPY_FOUND), line.rlike(MYPY_SUMMARY)
    rows = rows.where("not frame").withColumn("kind", F.when(found, "found").when(summary, "summary"))
    rows = rows.where((bare != "") | F.col("kind").isNotNull())
    rows = rows.withColumn("part", _so_far(F.col("kind").isNotNull())).withColumn("under", F.coalesce(_up_to(F.col("kind")), F.lit("none")))
    head = F.concat(F.regexp_extract(line, MYPY_FOUND, 1), F.lit(" "), F.regexp_extract(line, MYPY_FOUND, 2), F.lit(": "), strip(F.regexp_extract(line, MYPY_FOUND, 3)))
    told = F.when(F.col("kind") == "found", head).when((F.col("under") == "found") & F.col("kind").isNull(), bare).otherwise(line)
    rows = rows.withColumn("told", told)
    wrapped = rows.where("under = 'found'").groupBy("key", "part").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "told"))).alias("x"))
    wrapped = wrapped.select("key", "pos", F.lit(0).alias("sub"), F.array_join(F.transform("x", lambda x: x.told), " ").alias("told"))
    return _together(df, key, text, rows.where("under <> 'found'").select("key", "pos", F.lit(0).alias("sub"), "told").union(wrapped), "trimmed")


def distil(df: DataFrame, key: str, text: str, most: int = 80, head: int = 15, tail: int = 15) -> DataFrame:
    """Long logs: the first and last lines, findings between them, and counts of what was left out."""
    head = min(head, most // 2)
    tail = min(tail, most - head)
    rows = _rows(df, key, text).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    long = rows.where(F.col("n") > most)
    outer = (F.col("pos") < head) | (F.col("pos") >= F.greatest(F.col("n") - tail, F.lit(head)))
    shown = outer | F.col("bare").rlike(TOLD_ERROR) | F.col("bare").rlike(TOLD_DIAGNOSTIC)
    long = long.withColumn("shown", shown).withColumn("part", _so_far(F.col("shown")))
    out = long.where("shown").select("key", F.col("part").alias("pos"), F.lit(0).alias("sub"), F.col("line").alias("told"))
    gaps = long.where("not shown").groupBy("key", "part").agg(F.count("*").alias("n"))
    note = F.concat(F.lit("... ["), F.col("n").cast("string"), F.lit(" lines collapsed] ..."))
    return _together(df, key, text, out.union(gaps.select("key", F.col("part").alias("pos"), F.lit(1).alias("sub"), note.alias("told"))), "empty")


BY_NAME: dict[str, Filter] = {
    "distil": distil,
    "git_diff": git_diff,
    "git_log": git_log,
    "git_status": git_status,
    "mypy": mypy_run,
    "npm_install": npm_install,
    "pytest": pytest_run,
    "ruff_check": ruff_check,
    "yarn_install": yarn_install,
}
