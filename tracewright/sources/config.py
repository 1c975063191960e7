"""Own settings: rules, profiles and plugins, from JSON and TOML texts, on the driver."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, replace
from typing import Any

from tracewright.functions.lines import is_pattern
from tracewright.operators.profiles import DEFAULT, PROFILES, Profile
from tracewright.operators.router import DENIED_BY_DEFAULT

# Names of a profile's settings.
_PROFILE_KEYS = {"max_line_length": "line_bytes", "remove_comments": "comments", "minify_json": "minify", "json_only": "json_only"}


@dataclass(frozen=True)
class Settings:
    denied: tuple[str, ...] = DENIED_BY_DEFAULT
    secrets: tuple[str, ...] = ()
    rules: tuple[tuple[str, str], ...] = ()
    profiles: dict[str, Profile] = field(default_factory=lambda: dict(PROFILES))
    default_profile: str = DEFAULT
    overrides: dict[str, str] = field(default_factory=dict)
    strict_chained: bool = False


def merged(settings: Settings, text: str) -> Settings:
    """The settings after a JSON text: lists replace, maps are joined, patterns that are none are left out; no JSON object changes nothing."""
    try:
        new: Any = json.loads(text)
    except ValueError:
        return settings
    if not isinstance(new, dict):
        return settings
    out = settings
    if isinstance(x := new.get("denied_commands"), list):
        out = replace(out, denied=tuple(p for p in x if isinstance(p, str) and is_pattern(p)))
    own = new.get("custom_dlp_patterns")
    if own is None and isinstance(new.get("dlp"), dict):
        own = new["dlp"].get("custom_patterns")
    if isinstance(own, list):
        out = replace(out, secrets=tuple(p for p in own if isinstance(p, str) and is_pattern(p)))
    if isinstance(x := new.get("regex_filters"), list):
        rules = [(r.get("pattern"), r.get("action")) for r in x if isinstance(r, dict)]
        out = replace(out, rules=tuple((p, a) for p, a in rules if isinstance(p, str) and isinstance(a, str) and is_pattern(p)))
    if isinstance(x := new.get("output_profiles"), dict):
        made = {n: Profile(**{_PROFILE_KEYS[k]: v for k, v in p.items() if k in _PROFILE_KEYS and v is not None}) for n, p in x.items() if isinstance(p, dict)}
        out = replace(out, profiles=out.profiles | made)
    if isinstance(x := new.get("overrides"), dict):
        out = replace(out, overrides=out.overrides | {k: v for k, v in x.items() if isinstance(v, str)})
    if isinstance(x := new.get("default_profile"), str):
        out = replace(out, default_profile=x)
    if isinstance(x := new.get("strict_chained"), bool):
        out = replace(out, strict_chained=x)
    return out


@dataclass(frozen=True)
class Plugin:
    name: str
    program: str
    args: tuple[str, ...] = ()
    mode: str = "stdout"
    drop: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()


def plugins(*texts: str) -> list[Plugin]:
    """The plugins of TOML texts, general ones first; a later one of the same name takes the earlier one's place."""
    out: dict[str, Plugin] = {}
    for text in texts:
        try:
            rows = tomllib.loads(text).get("plugins", [])
        except tomllib.TOMLDecodeError:
            continue
        for r in rows:
            if isinstance(r, dict) and isinstance(r.get("name"), str) and isinstance(r.get("bin"), str):
                lists = {k: tuple(r.get(source) or ()) for k, source in (("args", "args"), ("drop", "drop_prefixes"), ("keep", "keep_prefixes"))}
                out[r["name"]] = Plugin(r["name"], r["bin"], mode=r.get("filter_mode") or "stdout", **lists)
    return list(out.values())


def branch(head: str) -> str:
    """The branch that a repository's HEAD names; else the first seven characters of the commit, or ``detached``."""
    bare = head.strip()
    return bare.removeprefix("ref: refs/heads/") if bare.startswith("ref: refs/heads/") else bare[:7] or "detached"
