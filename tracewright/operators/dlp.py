"""Redaction of secrets from logs, and an audit row for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.lines import is_pattern, once

# Patterns, in the order in which they are applied, with their audit labels and replacements.
PEM = r"(?s)-----BEGIN [A-Z ]+-----.*?-----END [A-Z ]+-----"
CREDENTIAL_URI = r"\b([a-zA-Z0-9\+]+://)[a-zA-Z0-9_\-\.]+:[^@\s]+(@[a-zA-Z0-9_\-\.]+)"
JWT = r"\beyJ[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]+\.[A-Za-z0-9-_.+/=]*\b"
API_KEY = (
    r"(?i)\b(sk_(live|test)_[a-zA-Z0-9]{24}|sk-proj-[a-zA-Z0-9]{20,}|sk-ant-api[0-9a-zA-Z\-_]{30,}|sk-[a-zA-Z0-9]{20,}|github_pat_[a-zA-Z0-9_]{22,}"
    r"|gh[oprsu]_[a-zA-Z0-9]{36}|glpat-[a-zA-Z0-9\-_]{20,}|npm_[a-zA-Z0-9]{36}|hf_[a-zA-Z0-9]{34,}|dop_v1_[a-f0-9]{64}|xox[baprs]-[0-9a-zA-Z]{10,}"
    r"|AIza[0-9A-Za-z\-_]{35}|AKIA[0-9A-Z]{16})\b"
)
STAGES = (
    ("Private Key", PEM, "[REDACTED_PRIVATE_KEY]"),
    ("Database URI", CREDENTIAL_URI, "$1[REDACTED_CREDENTIALS]$2"),
    ("JWT", JWT, "[REDACTED_JWT]"),
    ("API Key", API_KEY, "[REDACTED_API_KEY]"),
)
# Parts of which every match holds one, in lower case: texts without any are spared the search.
PARTS = {
    "Private Key": ("-----begin ",), "Database URI": ("://",), "JWT": ("eyj",),
    "API Key": ("sk_", "sk-", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "npm_", "hf_", "dop_v1_", "xox", "aiza", "akia"),
}
CUSTOM = ("Custom Secret", "[REDACTED_SECRET]")
RANDOM = ("High Entropy Secret", "[REDACTED_SECRET]")
WORD = r"[\p{IsAlphabetic}\p{N}_\-/+=]+"
LEAST_BYTES, MOST_BYTES, LEAST_BITS = 24, 128, 4.7
_MARK = "\u0001"
_HITS = "array<struct<label: string, hash: string>>"


def entropy(word: Column) -> Column:
    """Bits a byte of the word's own distribution of bytes."""
    codes = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit("(..)"), F.lit(1))
    n = F.size(codes).cast("double")

    def add(acc: Column, c: Column) -> Column:
        p = F.size(F.filter(codes, lambda x: x == c)).cast("double") / n
        return acc - p * F.log2(p)

    return F.aggregate(F.array_distinct(codes), F.lit(0.0), add)


def _is_random(word: Column) -> Column:
    size = F.octet_length(word)
    hash40 = (size == 40) & word.rlike("^[0-9a-fA-F]{40}$")
    return F.when((size >= LEAST_BYTES) & (size <= MOST_BYTES) & ~hash40, entropy(word) > LEAST_BITS).otherwise(False)


def _pieces(text: Column) -> Column:
    """The text cut at its long words, which have odd places: all that may have ``LEAST_BYTES``, at two bytes a character or, with wider ones, at four."""
    plain = F.replace(text, F.lit(_MARK), F.lit("\u0002"))
    one = WORD.removesuffix("+")
    long = rf"(?<!{one})({one}{{{LEAST_BYTES // 2},}}+|(?={one}*[\x{{800}}-\x{{10FFFF}}]){one}{{{LEAST_BYTES // 4},}}+)"
    return F.split(F.regexp_replace(plain, long, f"{_MARK}$1{_MARK}"), _MARK, -1)


def redact_random(text: Column) -> Column:
    pieces = F.transform(_pieces(text), lambda x, i: F.when((i % 2 == 1) & _is_random(x), F.lit(RANDOM[1])).otherwise(x))
    return F.array_join(pieces, "")


def _may_hold(text: Column, label: str) -> Column:
    def any_of(low: Column) -> Column:
        found = F.contains(low, F.lit(PARTS[label][0]))
        for part in PARTS[label][1:]:
            found = found | F.contains(low, F.lit(part))
        return found

    return once(F.lower(text), any_of)


def _marked(label: str, pattern: str, mark: str) -> Callable[[Column], Column]:
    return lambda x: F.when(_may_hold(x, label), F.regexp_replace(x, pattern, mark)).otherwise(x)


def redact(text: Column, custom: tuple[str, ...] = ()) -> Column:
    """Each stage on what the one before left: keys, credentials, tokens, own patterns (but those that are none), then random-looking words."""
    for label, pattern, mark in STAGES:
        text = once(text, _marked(label, pattern, mark))
    for pattern in filter(is_pattern, custom):
        text = F.regexp_replace(text, pattern, CUSTOM[1])
    return redact_random(text)


def audit(df: DataFrame, key: str, text: str, custom: tuple[str, ...] = (), now: Column | None = None, source: Column | None = None) -> DataFrame:
    """One row (key, label, hash of the secret) for each replacement that redaction makes.

    With ``now`` the rows tell the second (``epoch_s``) and the ``source``, by
    default unknown, as an audit log does that is only ever appended to.
    """
    told = [] if now is None else [F.unix_timestamp(now).alias("epoch_s"), F.coalesce(F.lit(None) if source is None else source, F.lit("unknown")).alias("source")]
    names = [key, *(["epoch_s", "source"] if told else [])]
    rows, found = df.select(F.col(key), *told, F.col(text).alias("_left"), F.array().cast(_HITS).alias("_found")), F.col("_found")
    for label, pattern, mark in (*STAGES, *((CUSTOM[0], p, CUSTOM[1]) for p in custom if is_pattern(p))):
        # A step each, so that what it left is computed once for the next one's two uses.
        x, may = F.col("_left"), F.col("_may")
        rows = rows.withColumn("_may", _may_hold(x, label) if label in PARTS else x.rlike(pattern))
        hits = F.when(may, _labelled(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), label)).otherwise(F.array().cast(_HITS))
        left = F.when(may, F.regexp_replace(x, pattern, mark)).otherwise(x)
        rows = rows.select(*names, F.concat(found, hits).alias("_found"), left.alias("_left"))
    words = F.filter(F.transform(_pieces(F.col("_left")), lambda s, i: F.when((i % 2 == 1) & _is_random(s), s)), lambda s: s.isNotNull())
    return rows.select(*names, F.explode(F.concat(found, _labelled(words, RANDOM[0]))).alias("hit")).select(*names, "hit.label", "hit.hash")


def _labelled(hits: Column, label: str) -> Column:
    return F.transform(hits, lambda s: F.struct(F.lit(label).alias("label"), F.sha2(s, 256).alias("hash")))
