"""What happens to a filtered text: own rules, the output profile, redaction and counts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.lines import cut_bytes, is_blank, is_pattern, lines, once, strip, strip_end, strip_start, tokens
from tracewright.operators import dlp

Rules = Iterable[tuple[str, str]]
#: What an own rule's matches become, the tokens from which a text counts as too long for its reader.
ACTIONS = {"strip": "", "collapse": "[collapsed]"}
SATURATED_TOKENS = 3000


@dataclass(frozen=True)
class Profile:
    """What a profile takes away; no bound on lines if ``line_bytes`` is None."""

    line_bytes: int | None = None
    comments: bool = False
    minify: bool = False
    json_only: bool = False


# The profiles and the one that holds where no other is named.
PROFILES = {
    "strict": Profile(80, comments=True, minify=True),
    "balanced": Profile(100, comments=True),
    "developer": Profile(120),
    "audit": Profile(),
    "json-only": Profile(json_only=True),
}
DEFAULT = "strict"


def invalid_rules(rules: Rules, denied: Iterable[str] = ()) -> list[str]:
    """A message for each own pattern that is none."""
    bad = [f"rule pattern invalid: {p}" for p, _ in rules if not is_pattern(p)]
    return bad + [f"denied command pattern invalid: {p}" for p in denied if not is_pattern(p)]


def apply_rules(text: Column, rules: Rules) -> Column:
    """Own rules (pattern, action) in order, each on what the one before left; other actions and patterns that are none do nothing."""
    for pattern, action in rules:
        if action in ACTIONS and is_pattern(pattern):
            text = F.regexp_replace(text, pattern, ACTIONS[action])
    return text


def _is_json(line: Column) -> Column:
    t = strip(line)
    return t.startswith("{") | t.startswith("[") | t.startswith('"') | t.contains(": {") | t.contains(": [")


def _without_comment(line: Column) -> Column:
    cut = strip_end(F.substring_index(line, "//", 1))
    return F.when(strip_start(line).startswith("#"), "").when(line.contains("//"), cut).otherwise(line)


def _minified(line: Column) -> Column:
    """A line that is a JSON object or array without spaces and with its keys sorted."""
    t = strip(line)
    whole = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    return F.when(whole, F.coalesce(F.to_json(F.try_parse_json(t)), line)).otherwise(line)


def apply_profile(text: Column, profile: Profile) -> Column:
    """A profile's steps in order: JSON lines only, comments, long lines, one-line JSON. A line is cut at a character's end."""

    def of(source: Column) -> Column:
        rows = lines(source)
        if profile.json_only:
            rows = F.filter(rows, _is_json)
        if profile.comments:
            rows = F.filter(F.transform(rows, _without_comment), lambda x: x != "")
        if profile.line_bytes:
            rows = F.transform(rows, lambda x: cut_bytes(x, profile.line_bytes))
        if profile.minify:  # the last line end goes
            return F.array_join(F.transform(rows, _minified), "\n")
        body = F.array_join(rows, "\n")
        return once(body, lambda b: F.when(source.endswith("\n") & (b != ""), F.concat(b, F.lit("\n"))).otherwise(b))

    return once(text, of)


def profile_name(cmd: Column, overrides: Mapping[str, str], default: str = DEFAULT) -> Column:
    """The profile of a command: that of the longest own part it contains, of equals the first by name, else the default."""
    out = F.lit(default if default in PROFILES else DEFAULT)
    known = {k: v for k, v in overrides.items() if v in PROFILES}
    for part in sorted(sorted(known, reverse=True), key=lambda x: len(x.encode())):  # the last one wins
        out = F.when(cmd.contains(part), known[part]).otherwise(out)
    return out


def by_profile(text: Column, name: Column) -> Column:
    """Each text by the profile that is named beside it."""
    out = apply_profile(text, PROFILES[DEFAULT])
    for other, profile in PROFILES.items():
        if other != DEFAULT:
            out = F.when(name == other, apply_profile(text, profile)).otherwise(out)
    return out


def post_processed(
    runs: DataFrame,
    cmd: str = "cmd",
    raw: str = "raw",
    filtered: str = "filtered",
    rules: Rules = (),
    overrides: Mapping[str, str] | None = None,
    custom: tuple[str, ...] = (),
    distilled: Column | None = None,
) -> DataFrame:
    """The chain behind every filter: rules, profile, redaction of both texts, token counts and the notes' conditions.

    Rows for which ``distilled`` holds skip rules and profile. Adds ``shown``,
    ``kept_raw``, ``original_tokens``, ``filtered_tokens``, ``cached`` (the full
    text is worth keeping at hand) and ``saturated``.
    """
    text = F.col(filtered)
    done = by_profile(apply_rules(text, rules), profile_name(F.col(cmd), overrides or {}))
    if distilled is not None:
        done = F.when(distilled, text).otherwise(done)
    rows = runs.withColumn("shown", dlp.redact(done, custom)).withColumn("kept_raw", dlp.redact(F.col(raw), custom))
    shorter = (F.octet_length("shown") < F.octet_length("kept_raw")) & ~is_blank(F.col("shown"))
    rows = rows.withColumn("original_tokens", tokens(F.col("kept_raw"))).withColumn("filtered_tokens", tokens(F.col("shown")))
    return rows.withColumn("cached", shorter).withColumn("saturated", F.col("filtered_tokens") > SATURATED_TOKENS)
