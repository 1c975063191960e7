"""Texts as arrays of lines, and the scalars that all log operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)``, with ``x`` computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def is_pattern(text: str) -> bool:
    """True if Spark's regular expressions take ``text``: asked of the JVM where there is one, else of Python."""
    jvm = getattr(SparkContext._active_spark_context, "_jvm", None)
    try:
        if jvm is None:
            re.compile(text)
        else:
            jvm.java.util.regex.Pattern.compile(text)
    except (re.error, IllegalArgumentException):
        return False
    return True


def lines(text: Column) -> Column:
    """Lines without their ends (``\\n`` or ``\\r\\n``); a final line end starts no further line."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_start(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+", "")


def strip_end(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def is_blank(x: Column) -> Column:
    return strip(x) == ""


def starts_with_any(x: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | x.startswith(p)
    return found


def each_ended(rows: Column) -> Column:
    """Every line with a line end."""
    return F.array_join(F.transform(rows, lambda x: F.concat(x, F.lit("\n"))), "")


# What a filter gives for its kept lines. A text that isn't empty never becomes empty.


def or_input_if_empty(rows: Column, text: Column) -> Column:
    out = each_ended(rows)
    return F.when(out == "", text).otherwise(out)


def or_input_if_blank(rows: Column, text: Column) -> Column:
    out = each_ended(rows)
    return F.when(is_blank(out), text).otherwise(out)


def trimmed_or_input(rows: Column, text: Column) -> Column:
    """Without line ends at the end but one; the input if nothing is left."""
    out = strip_end(F.array_join(rows, "\n"))
    return F.when(out == "", text).otherwise(F.concat(out, F.lit("\n")))


def trimmed_or_input_if_not_blank(rows: Column, text: Column) -> Column:
    """As above, but a blank input gives a single line end."""
    out = strip_end(F.array_join(rows, "\n"))
    return F.when((out == "") & ~is_blank(text), text).otherwise(F.concat(out, F.lit("\n")))


def tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def rounded(x: Column, places: int) -> Column:
    """Rounded as SQL engines on C doubles do: the scaled double decides, where Spark's own ``round`` goes by its shortest decimals (0.0002535 * 1e6 is below 253.5)."""
    return F.round(x * F.lit(10.0**places)) / F.lit(10.0**places)


def cut_bytes(x: Column, most: int) -> Column:
    """At most ``most`` bytes: a longer text ends before that at a character's end, with an ellipsis."""
    head = F.make_valid_utf8(F.substring(F.encode(x, "UTF-8"), 1, most - 1).cast("string"))
    return F.when(F.octet_length(x) > most, F.concat(F.regexp_replace(head, "�+$", ""), F.lit("…"))).otherwise(x)


def size_label(n: Column) -> Column:
    """Bytes as B, K, M or G with one decimal."""

    def scaled(power: int) -> Column:
        return F.call_function("format_number", n / float(1024**power), F.lit("0.0"))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
        .when(n < 1024**2, F.concat(scaled(1), F.lit("K")))
        .when(n < 1024**3, F.concat(scaled(2), F.lit("M")))
        .otherwise(F.concat(scaled(3), F.lit("G")))
    )
