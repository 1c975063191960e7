"""Log filters that judge each line by itself or by its place: expressions over the array of lines, no shuffle.

Each takes a text column and gives the shortened text. The last step of each
decides what happens when nothing is left; a text that holds something never
becomes empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.lines import (
    is_blank,
    lines,
    or_input_if_blank,
    or_input_if_empty,
    size_label,
    starts_with_any,
    strip,
    strip_end,
    strip_start,
    trimmed_or_input,
    trimmed_or_input_if_not_blank,
)

# Line prefixes and patterns of the tools' output, as results must agree on them.
BUILD_PROGRESS = (
    "   Compiling ",
    "    Checking ",
    "   Locking ",
    "      Adding ",
    "  Downloading ",
    "  Downloaded ",
    "   Downloaded ",
    " Downloading ",
)
TEST_PROGRESS = (*BUILD_PROGRESS, "    Finished ", "     Running ")
LAYER = r"(?U)^[a-f0-9]{12}:\s+(Pulling fs layer|Waiting|Downloading|Extracting|Verifying|Download complete|Pull complete|Already exists)\b"
PROGRESS_BAR = r"(?U)\[[=\->\s]{5,}\]"
GO_NOISE = r"(?U)^===\s*RUN\b|^---\s*PASS\b|^ok\s+[^\s]+\s+[0-9\.]+s\s*(?:\[no tests to run\])?$"
GRADLE_NOISE = r"(?U)^>\s*Task\s+:|^(Download|Caching|Download progress|Preparing)\b"
LINT_PROBLEM = r"(?U)^\s+(\d+:\d+)\s+(error|warning)\s+(.+?)\s{2,}(\S+)\s*$"
ANSI = "\x1b\\[[0-9;]*m"
UNDERLINE = r"(?U)^\s*~+\s*$"
LONG_LISTING = r"(?U)^([bcdlp\-][rwx\-sStT]{9}[@+]?)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\d+)\s+((?:\S+\s+){1,2}\S+)\s+(.+)$"
PIP_KEPT = r"^(Successfully |ERROR|DEPRECATION|WARNING|Could not|No matching distribution|error:)"
PIP_NOTICE = r"(?U)A new release of pip|You are using pip version|^\s*\[notice\]"
DOTNET_KEPT = r"error CS|warning CS|Build FAILED|^Failed!|^Passed!|^Total tests:"
ERROR_WORDS = ("error", "warning", "failed")


def cargo_build(text: Column) -> Column:
    kept = F.filter(lines(text), lambda x: ~starts_with_any(x, BUILD_PROGRESS))
    return trimmed_or_input_if_not_blank(kept, text)


def cargo_test(text: Column) -> Column:
    def noise(x: Column) -> Column:
        passed = strip_start(x).startswith("test ") & (x.endswith(" ... ok") | x.endswith(" ... ignored"))
        return starts_with_any(x, TEST_PROGRESS) | passed

    return trimmed_or_input_if_not_blank(F.filter(lines(text), lambda x: ~noise(x)), text)


def docker_build(text: Column) -> Column:
    kept = F.filter(lines(text), lambda x: ~(is_blank(x) | strip(x).rlike(LAYER) | strip(x).rlike(PROGRESS_BAR)))
    return or_input_if_blank(kept, text)


def go_test(text: Column) -> Column:
    return or_input_if_blank(F.filter(lines(text), lambda x: ~(is_blank(x) | strip(x).rlike(GO_NOISE))), text)


def gradle(text: Column) -> Column:
    return or_input_if_blank(F.filter(lines(text), lambda x: ~(is_blank(x) | strip(x).rlike(GRADLE_NOISE))), text)


def docker_ps(text: Column) -> Column:
    """Name, image, status and ports of the standard table; other output as it is."""
    rows = lines(text)

    def short(x: Column) -> Column:
        f = F.split(strip_end(x), r"(?U)\s{2,}", -1)
        def at(i: int) -> Column:
            return F.get(f, i)

        full = F.concat_ws("  ", at(6), at(1), at(4), F.nullif(at(5), F.lit("")))
        return F.when(F.size(f) == 7, full).when(F.size(f) == 6, F.concat_ws("  ", at(5), at(1), at(4))).otherwise(x)

    body = F.transform(F.filter(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda x: ~is_blank(x)), short)
    table = trimmed_or_input(F.concat(F.array(F.lit("NAMES  IMAGE  STATUS  PORTS")), body), text)
    return F.when(F.get(rows, 0).startswith("CONTAINER ID"), table).otherwise(text)


def eslint(text: Column) -> Column:
    def told(x: Column) -> Column:
        parts = [F.regexp_extract(x, LINT_PROBLEM, i) for i in range(1, 5)]
        line = F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2], F.lit(" ("), parts[3], F.lit(")"))
        return F.when(x.rlike(LINT_PROBLEM), line).when(~x.rlike(r"(?U)^\s") & ~is_blank(x), x)

    return trimmed_or_input(F.filter(F.transform(lines(text), told), lambda x: x.isNotNull()), text)


def tsc(text: Column) -> Column:
    """Without colours, blank lines, underlines and the source line above each."""
    rows = F.transform(lines(text), lambda x: F.regexp_replace(x, ANSI, ""))
    under = F.transform(rows, lambda x: x.rlike(UNDERLINE))
    kept = F.filter(rows, lambda x, i: ~(F.get(under, i) | F.coalesce(F.get(under, i + 1), F.lit(False)) | is_blank(x)))
    return trimmed_or_input(kept, text)


def vitest(text: Column) -> Column:
    def told(x: Column) -> Column:
        title = strip(F.replace(x, F.lit("⎯"), F.lit("")))
        marker = F.regexp_replace(title, r"(?U)[\[\]/\s]", "")
        rule = F.when(~((title == "") | marker.rlike("^[0-9]+$")), title)
        start = strip_start(x)
        frame = x.rlike(r"(?U)^\s*\d+\|") | start.startswith("|")
        noise = start.startswith("RUN ") | start.startswith("Start at") | frame | is_blank(x)
        return F.when(x.contains("⎯"), rule).when(~noise, x)

    return trimmed_or_input(F.filter(F.transform(lines(text), told), lambda x: x.isNotNull()), text)


def ls(text: Column, most: int = 20, head: int = 12, tail: int = 5) -> Column:
    def told(x: Column) -> Column:
        part = [F.regexp_extract(x, LONG_LISTING, i) for i in range(8)]
        size = F.coalesce(part[5].try_cast("long"), F.lit(0).cast("long"))
        label = size_label(size)
        wide = F.when(F.length(label) < 6, F.lpad(label, 6, " ")).otherwise(label)
        return F.when(part[0] != "", F.concat_ws(" ", part[1], wide, part[6], part[7])).otherwise(x)

    rows = F.transform(lines(text), strip)
    rows = F.transform(F.filter(rows, lambda x: ~((x == "") | x.rlike(r"(?U)^total\s+\d+$"))), told)
    n = F.size(rows)
    gap = F.array(F.concat(F.lit("... and "), (n - head - tail).cast("string"), F.lit(" more entries ...")))
    short = F.concat(F.slice(rows, 1, head), gap, F.slice(rows, F.greatest(n - tail + 1, F.lit(1)), tail))
    return or_input_if_empty(F.when(n > most, short).otherwise(rows), text)


def gh_checks(text: Column) -> Column:
    """Checks without their links; unchanged if there is none."""
    link = r"(?U)\thttps?://\S+"
    rows = F.transform(lines(text), lambda x: F.when(x.rlike(link), strip_end(F.regexp_replace(x, link, ""))).otherwise(x))
    return F.when(F.exists(lines(text), lambda x: x.rlike(link)), trimmed_or_input(rows, text)).otherwise(text)


def git_branch(text: Column) -> Column:
    def told(x: Column) -> Column:
        words = F.split(strip(x), r"(?U)\s+", -1)
        star = F.get(words, 0) == "*"
        at = F.when(star, 2).otherwise(1)
        name, code = F.get(words, at - 1), F.get(words, at)
        rest = F.array_join(F.slice(words, at + 2, F.greatest(F.size(words) - at - 1, F.lit(0))), " ")
        line = F.concat(F.when(star, "* ").otherwise("  "), name, F.lit(" "), F.substring(code, 1, 7), F.lit(" "), rest)
        return F.when(F.size(words) >= 3, line).otherwise(strip_end(x))

    return or_input_if_empty(F.transform(F.filter(lines(text), lambda x: ~is_blank(x)), told), text)


def git_show(text: Column) -> Column:
    """Short hash and message before the patch, the patch as it is."""
    patch = ("diff --git", "--- ", "+++ ", "index ")
    rows = lines(text)
    begins = F.array_position(F.transform(rows, lambda x: starts_with_any(x, patch)), True)
    cut = F.when(begins > 0, begins - 1).otherwise(F.size(rows)).cast("int")

    def told(x: Column) -> Column:
        code = F.regexp_extract(x, r"(?U)^commit \s*(\S+)", 1)
        short = F.when(code.rlike("^[0-9a-fA-F]{7,}$"), F.substring(code, 1, 7))
        dropped = starts_with_any(x, ("Author:", "Date:", "Merge:", "Merge-tag:")) | is_blank(x)
        return F.when(x.startswith("commit "), short).when(~dropped, strip(x))

    head = F.filter(F.transform(F.slice(rows, 1, cut), told), lambda x: x.isNotNull())
    return or_input_if_empty(F.concat(head, F.slice(rows, cut + 1, F.size(rows))), text)


def pip_install(text: Column) -> Column:
    """Results and errors; satisfied requirements as one note where the first stood."""
    rows = lines(text)
    met = F.transform(rows, lambda x: x.startswith("Requirement already satisfied:"))
    n = F.size(F.filter(met, lambda x: x))
    first = F.array_position(met, True).cast("int")
    unit = F.when(n == 1, "requirement").otherwise("requirements")
    note = F.concat(F.lit("["), n.cast("string"), F.lit(" "), unit, F.lit(" already satisfied]"))

    def kept(part: Column) -> Column:
        return F.filter(part, lambda x: x.rlike(PIP_KEPT) & ~x.rlike(PIP_NOTICE))

    with_note = F.concat(
        kept(F.slice(rows, 1, F.greatest(first - 1, F.lit(0)))), F.array(note), kept(F.slice(rows, F.greatest(first, F.lit(1)), F.size(rows)))
    )
    return or_input_if_empty(F.when(n > 0, with_note).otherwise(kept(rows)), text)


def dotnet(text: Column) -> Column:
    """Diagnostics and totals, then what is new in the last five lines; short output as it is."""
    rows = lines(text)
    found = F.filter(rows, lambda x: x.rlike(DOTNET_KEPT))
    last = F.slice(rows, F.greatest(F.size(rows) - 4, F.lit(1)), 5)
    fresh = F.filter(F.array_distinct(last), lambda x: ~is_blank(x) & ~F.array_contains(found, x))
    long = F.concat(found, fresh)
    out = F.when(F.size(rows) > 5, long).when(F.size(found) == 0, rows).otherwise(found)
    return F.array_join(out, "\n")


def plugin(text: Column, drop: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> Column:
    """Lines without the dropped prefixes; with ``keep``, only kept prefixes and lines that tell of an error."""

    def stays(x: Column) -> Column:
        start, low = strip_start(x), F.lower(x)
        told = F.lit(False)
        for w in ERROR_WORDS:
            told = told | low.contains(w)
        return ~starts_with_any(start, drop) & ((starts_with_any(start, keep) | told) if keep else F.lit(True))

    return trimmed_or_input_if_not_blank(F.filter(lines(text), stays), text)


def compact(text: Column, most_words: int, profile: str = "default") -> Column:
    """Texts of more words than allowed: by profile without comments, only with findings, or without double blank lines."""
    rows = lines(text)
    if profile == "strict":
        kept = F.filter(rows, lambda x: ~is_blank(x) & ~starts_with_any(strip(x), ("//", "#", "/*", "*")))
    elif profile == "developer":
        kept = F.filter(rows, lambda x: F.lower(x).rlike("error|fail|warn|summary"))
    else:
        kept = single_blanks(rows)
    words = F.size(F.filter(F.split(text, r"(?U)\s+", -1), lambda x: x != ""))
    return F.when(words <= most_words, text).otherwise(F.array_join(kept, "\n"))


def single_blanks(rows: Column) -> Column:
    """Runs of blank lines as one empty line."""
    bare = F.transform(rows, lambda x: F.when(is_blank(x), "").otherwise(x))
    return F.filter(bare, lambda x, i: (x != "") | (i == 0) | (F.get(bare, i - 1) != ""))


def rule_file(text: Column) -> Column:
    """A rule file without HTML comments, spaces at line ends and double blank lines."""
    plain = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return each_line(single_blanks(F.transform(lines(plain), strip_end)))


def compacted_rule_files(files: DataFrame) -> DataFrame:
    """``path``, ``content``, ``backup``, ``saved_bytes``, ``saved_tokens`` of rule files (path, content) after ``rule_file``.

    A file that gets no shorter stays as it is, without a backup; of the others
    the old text is kept. Four bytes saved are a token, rounded down.
    """
    rows = files.select("path", F.col("content").alias("old"), rule_file(F.col("content")).alias("new"))
    saved = F.greatest(F.octet_length("old") - F.octet_length("new"), F.lit(0)).cast("long")
    rows = rows.withColumn("saved_bytes", saved)
    shorter = F.col("saved_bytes") > 0
    return rows.select(
        "path", F.when(shorter, F.col("new")).otherwise(F.col("old")).alias("content"), F.when(shorter, F.col("old")).alias("backup"),
        "saved_bytes", F.floor(F.col("saved_bytes") / 4).cast("long").alias("saved_tokens"),
    )


def each_line(rows: Column) -> Column:
    return F.array_join(rows, "\n")


BY_NAME: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (cargo_build, cargo_test, docker_build, docker_ps, dotnet, eslint, gh_checks, git_branch, git_show, go_test, gradle, ls, pip_install, tsc, vitest)
}
