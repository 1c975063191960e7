"""Secret scans: plain patterns, and weaker parts linked when complementary ones stand together. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import row_key
from tracewright.llm.spans import matches, told

#: The contract's patterns. Where a shorter match would be dropped anyway and
#: can't hide a longer one, the least length is part of the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex")

#: Weak parts. None is reported alone.
IDENTIFIER = r"""\b(?i:user|username|login|account|client_?id|key_?id|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}+"""
ENDPOINT = r"""\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>\u0001\u0002]{3,}+"""
RANDOM = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]{0,40}[0-9])(?=[a-z0-9+/_=-]{0,40}[A-Z])(?=[A-Z0-9+/_=-]{0,40}[a-z])"
    r"[A-Za-z0-9+/_=-]{20,}+"
)
SHORT_HEX = r"(?<![0-9a-zA-Z])(?=[a-f]{0,30}[0-9])(?=[0-9]{0,30}[a-f])[0-9a-f]{16,31}(?![0-9a-zA-Z])"


#: What every match of a pattern holds, in lower case, to spare other texts the search.
_IN_ASSIGN, _IN_IDENTIFIER = ("passw", "secret", "token", "api_key", "apikey"), ("user", "login", "account", "client", "key")
_LONG = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16}"


def _holds_any(x: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def _part(spans: Column, kind: str, role: str, weak: bool) -> Column:
    return F.transform(
        spans, lambda x: F.struct(F.lit(kind).alias("k"), x.s.alias("s"), x.e.alias("e"), F.lit(role).alias("role"), F.lit(weak).alias("weak"))
    )


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The rows with ``keep`` (a weak part that complementary ones stand by) and, at secrets, the nearest identifier and endpoint."""
    up = Window.partitionBy("_row").orderBy("p.s")
    down = Window.partitionBy("_row").orderBy(F.desc("p.s"))
    base = ~F.col("p.weak")
    # A weak part touches a base span that starts at or before it and ends later, or starts inside it.
    before = F.max(F.when(base, F.col("p.e"))).over(up.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("p.s"))).over(down.rangeBetween(Window.unboundedPreceding, -1))
    touches = F.coalesce(before > F.col("p.s"), F.lit(False)) | F.coalesce(after < F.col("p.e"), F.lit(False))
    parts = parts.withColumn("role", F.when(base | ~touches, F.col("p.role")))

    near = up.rangeBetween(-scope, scope)
    some = {r: F.max(F.coalesce(F.col("role") == r, F.lit(False))).over(near) for r in ("identifier", "secret", "endpoint")}
    keep = (
        F.when(F.col("role") == "secret", some["identifier"] | some["endpoint"])
        .when(F.col("role") == "identifier", some["secret"])
        .when(F.col("role") == "endpoint", some["identifier"] & some["secret"])
        .otherwise(False)
    )

    def nearest(role: str) -> Column:
        """The nearest part of a role within the scope, of equals the one before, as kind, start and end."""
        part = F.when(F.col("role") == role, F.struct("p.k", "p.s", "p.e"))
        left = F.last(part, ignorenulls=True).over(up.rangeBetween(-scope, 0))
        right = F.first(part, ignorenulls=True).over(up.rangeBetween(0, scope))
        return F.when(left.isNull() | (right.s - F.col("p.s") < F.col("p.s") - left.s), F.coalesce(right, left)).otherwise(left)

    out = parts.withColumn("keep", F.col("p.weak") & keep)
    for role in ("identifier", "endpoint"):
        out = out.withColumn(role, F.when(F.col("role") == "secret", nearest(role)))
    return out


def find_secrets(docs: DataFrame, scope: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets in every whole text, as code point spans, and the credentials that they form.

    Base spans (``assign``, ``access``, ``hex``) always stay. Weak parts are
    account identifiers (``identifier``), random-looking strings
    (``candidate``) and URLs (``endpoint``). Roles complement each other: a weak
    secret needs an identifier or endpoint whose start lies within ``scope``
    code points of its own; a weak identifier needs a secret there; an endpoint
    needs an identifier and a secret there. Keys of form AKIA are identifiers,
    other base spans secrets. Weak parts that touch a base span are left out.
    ``credentials`` names, for each secret that has any, the nearest identifier
    and endpoint in its scope (ties: the earlier).

    The interval join is a RANGE frame of ``scope`` around each part's start,
    by document: parts meet in counts and nearest ones, pairs are never made, and
    the work grows with the text and its parts. Null and empty texts have no
    spans; texts of any length are read whole; repeated rows are scanned each for
    itself; only the two named columns are read, so others may have any name; an
    empty table gives no rows.
    """
    c, low = F.col("body"), F.col("low")
    rows = docs.select(row_key().alias("_row"), F.col(key).alias("doc_id"), F.col(text).alias("body"))
    rows = rows.select("_row", "doc_id", "body", F.lower("body").alias("low"), c.rlike(_LONG).alias("long"))
    assign = F.filter(matches(c, ASSIGN, _holds_any(low, _IN_ASSIGN)), lambda x: F.length(F.regexp_extract(x.m, ASSIGN, 1)) >= 8)
    parts = F.concat(
        _part(assign, "assign", "secret", False),
        _part(matches(c, ACCESS, F.contains(c, F.lit("AKIA"))), "access", "identifier", False),
        _part(matches(c, HEX, F.col("long")), "hex", "secret", False),
        _part(matches(c, IDENTIFIER, _holds_any(low, _IN_IDENTIFIER)), "identifier", "identifier", True),
        _part(matches(c, ENDPOINT, F.contains(c, F.lit("://"))), "endpoint", "endpoint", True),
        _part(matches(c, RANDOM, F.col("long")), "candidate", "secret", True),
        _part(matches(c, SHORT_HEX, F.col("long")), "candidate", "secret", True),
    )
    # Only parts are exploded, a row without any stays one: a row of many parts isn't copied with each of them.
    parts = _linked(rows.select("_row", "doc_id", F.explode_outer(parts).alias("p")), scope)
    # Equal starts are told in the order of KINDS; "n" is a kind's place there.
    place = F.coalesce(*[F.when(F.col("p.k") == k, i) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    span = F.struct("p.s", place.alias("n"), "p.e", "p.k")
    credential = F.struct(F.struct("p.s", "p.e", "p.k").alias("secret"), "identifier", "endpoint")
    told_of = (F.col("keep") | ~F.col("p.weak")) & (F.col("identifier").isNotNull() | F.col("endpoint").isNotNull())
    out = parts.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count_if(F.col("p.k") == k).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(~F.col("p.weak"), span))).alias("told"),
        F.collect_list(F.when(F.col("keep"), span)).alias("found"),
        F.array_sort(F.collect_list(F.when(told_of, credential))).alias("credentials"),
    )
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(told(F.col("told")), 256).alias("base_sha256"),
        told(F.array_sort(F.concat("told", "found"))).alias("spans"),
        F.size("found").cast("long").alias("n_linked"),
        "credentials",
    )


def op9_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("credentials", F.to_json("credentials"))
