"""Where a pattern matches in a text, and texts with spans replaced, by SQL functions alone.

Running values over an array are taken in chunks of ``CHUNK``, first inside
each, then over the chunks, and long texts are cut into blocks of
``BLOCK_CHARS``, so that the work grows with the text and its matches and not
with their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.lines import once

CHUNK, BLOCK_CHARS = 256, 2048
_MARK, _OTHER = "\u0001", "\u0002"
_NO_MATCHES = "cast(array() as array<struct<s:int,e:int,m:string>>)"


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each int of an array what ``both``, from 0 on, makes of those before it; one more item for all of them."""

    def before(items: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(both(acc.at, value(x)).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    return once(
        F.transform(chunks, lambda c: before(c, lambda x: x)),
        lambda inner: once(
            before(inner, lambda x: x.at),
            lambda outer: F.concat(F.flatten(F.zip_with(inner, outer.out, lambda i, o: F.transform(i.out, lambda x: both(o, x)))), F.array(outer.at)),
        ),
    )


def matches(text: Column, pattern: str | Column, some: Column | None = None) -> Column:
    """``array<struct<s, e, m>>`` of the leftmost non-overlapping matches of a Java pattern.

    ``s`` and ``e`` (exclusive) count code points, ``m`` is the match. Each match
    is put between marks and the text split at these, so that pieces take turns:
    outside, match, outside ... A mark in the text itself first becomes another
    control character; patterns here match neither. A null text has no matches.
    ``some`` may spare a text the search: where it isn't true nothing can match.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(_OTHER))
    group = f"({pattern})" if isinstance(pattern, str) else F.concat(F.lit("("), pattern, F.lit(")"))
    pieces = F.split(F.regexp_replace(plain, group, f"{_MARK}$1{_MARK}"), _MARK, -1)

    def found(p: Column) -> Column:
        odd = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
        at = running(F.transform(p, F.length), lambda a, b: a + b)
        spans = once(at, lambda s: F.transform(odd, lambda i: F.struct(F.get(s, i).alias("s"), F.get(s, i + 1).alias("e"), F.get(p, i).alias("m"))))
        return F.when(F.size(p) > 1, spans).otherwise(F.expr(_NO_MATCHES))

    out = once(pieces, found)
    return out if some is None else F.when(F.coalesce(some, F.lit(False)), out).otherwise(F.expr(_NO_MATCHES))


def replaced(text: Column, spans: Column, marked: Callable[[Column, Column], Column]) -> Column:
    """The text with ``marked(span, done)`` in place of each span, of an array sorted by start.

    ``done`` is where the earlier spans end; a span that begins before it only
    extends what goes, and what ``marked`` gives for it follows at once.
    """

    def rest(blocks: Column, done: Column, size: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            i, j = F.floor(a / BLOCK_CHARS).cast("int"), F.floor(b / BLOCK_CHARS).cast("int")

            def block(n: Column) -> Column:
                return F.coalesce(F.get(blocks, n), F.lit(""))

            far = F.concat(
                F.substr(block(i), a % BLOCK_CHARS + 1),
                F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
                F.substr(block(j), F.lit(1), b % BLOCK_CHARS),
            )
            return F.when(i == j, F.substr(block(i), a % BLOCK_CHARS + 1, b - a)).otherwise(far)

        def step(x: Column, i: Column) -> Column:
            at = F.get(done, i)
            return F.concat(F.when(x.s > at, part(at, x.s)).otherwise(F.lit("")), marked(x, at))

        end = F.get(done, F.size(spans))
        return F.concat(F.array_join(F.transform(spans, step), ""), F.when(end < size, part(end, size)).otherwise(F.lit("")))

    ends = running(F.transform(spans, lambda x: x.e), lambda a, b: F.greatest(a, b))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))
    out = once(cut, lambda blocks: once(ends, lambda done: rest(blocks, done, F.length(text))))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def told(spans: Column) -> Column:
    """``kind:start:end`` of structs with fields k, s and e, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x.k, x.s.cast("string"), x.e.cast("string"))), ","
    )
