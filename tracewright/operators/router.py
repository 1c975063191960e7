"""What to do with a command line: deny it, leave it, ask, or rewrite it to its filtered form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.lines import is_pattern, once, strip, strip_end

REWRITE, NONE, DENY, ASK = 0, 1, 2, 3

# Rules on which decisions must agree.
DENIED = (r"(?U)^rm\s+-rf?\s+/", r"(?U)^git\s+push\s+.*--force", r"(?U)^git\s+reset\s+--hard")
DENIED_BY_DEFAULT = ("git push.*--force", "git reset --hard")
SEGMENT_ENDS = r"(?U)\s*&&\s*|\s*;\s*|\s*\|\|\s*|\s*\|\s*"
CHAINED = r"&&|;|\||`|\$\("
#: Program to the sub-commands that are rewritten; None: any.
SUBCOMMANDS: dict[str, tuple[str, ...] | None] = {
    "git": ("diff", "log", "branch", "stash", "show"),
    "cargo": ("test", "build", "check", "clippy"),
    "npm": ("install",),
    "docker": ("build", "run", "ps"),
    "dotnet": ("build", "run", "test"),
    "yarn": ("install",),
    "pnpm": ("install",),
    "composer": ("install", "update"),
    "terraform": ("plan", "apply"),
    "ruff": ("check",),
    "mypy": None,
}
ALONE = ("pytest", "eslint", "tsc", "ls")
GRADLE = ("gradle", "./gradlew", "gradlew")


def is_denied(cmd: Column, custom: tuple[str, ...] = DENIED_BY_DEFAULT) -> Column:
    """True if a segment of the chain matches a rule; an own rule that is no pattern is looked for as text."""

    def hit(x: Column) -> Column:
        found = F.lit(False)
        for p in DENIED:
            found = found | x.rlike(p)
        for p in custom:
            found = found | (x.rlike(p) if is_pattern(p) else x.contains(p))
        return found

    parts = F.filter(F.transform(F.split(cmd, SEGMENT_ENDS, -1), strip), lambda x: x != "")
    return once(parts, lambda p: F.when(F.size(p) == 0, hit(cmd)).otherwise(F.exists(p, hit)))


def is_chained(cmd: Column) -> Column:
    return cmd.rlike(CHAINED)


def words_of(cmd: Column) -> Column:
    return F.filter(F.split(cmd, r"(?U)\s+", -1), lambda x: x != "")


def rewritten(cmd: Column, wrapper: str, plugins: tuple[tuple[str, str, tuple[str, ...]], ...] = ()) -> Column:
    """The wrapped command, or null. Plugins (name, program, first arguments) come before the fixed rules."""
    return once(words_of(cmd), lambda words: _rewritten(cmd, words, wrapper, plugins))


def _rewritten(cmd: Column, words: Column, wrapper: str, plugins: tuple[tuple[str, str, tuple[str, ...]], ...]) -> Column:
    n = F.size(words)

    def word(i: int) -> Column:
        return F.coalesce(F.get(words, i), F.lit(""))

    def first(a: str | Column, b: str | Column) -> Column:
        """The first ``a`` in the command replaced."""
        a, b = (F.lit(x) if isinstance(x, str) else x for x in (a, b))
        at = F.position(a, cmd)
        return F.concat(F.substr(cmd, F.lit(1), at - 1), b, F.substr(cmd, at + F.length(a)))

    rules: list[tuple[Column, Column]] = []
    for name, program, args in plugins:
        same = word(0) == program
        for i, a in enumerate(args, 1):
            same = same & (word(i) == a)
        rules.append((same & (n > len(args)), first(program, f"{wrapper} plugin {name}")))
    rules.append(((word(0) == "git") & (word(1) == "status"), F.lit(f"{wrapper} git status")))
    for program, subs in SUBCOMMANDS.items():
        rules.append(((word(0) == program) & (word(1).isin(*subs) if subs else n >= 2), first(program, f"{wrapper} {program}")))
    rules.append(((word(0) == "go") & (word(1) == "test") & cmd.contains("go test"), first("go test", f"{wrapper} go-test")))
    rules.append(((word(0) == "gh") & (word(1) == "pr") & (word(2) == "checks"), first("gh", f"{wrapper} gh")))
    module = word(0).isin("python", "python3") & (word(1) == "-m") & (word(2) == "pip") & (word(3) == "install")
    rest = F.array_join(F.slice(words, 5, F.greatest(n - 4, F.lit(0))), " ")
    rules.append((module, strip_end(F.concat(F.lit(f"{wrapper} pip install "), rest))))
    rules.append((word(0).isin("pip", "pip3") & (word(1) == "install"), first(word(0), f"{wrapper} pip")))
    rules += [(word(0) == p, first(p, f"{wrapper} {p}")) for p in ALONE]
    rules.append(((word(0) == "vitest") & (word(1) != "watch"), first("vitest", f"{wrapper} vitest")))
    rules.append((word(0).isin(*GRADLE), first(word(0), f"{wrapper} gradle")))
    out = F.lit(None).cast("string")
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def decision(cmd: Column, wrapper: str = "tw", custom: tuple[str, ...] = DENIED_BY_DEFAULT, plugins: tuple = (), strict: bool = False) -> Column:
    """``struct<code, rewritten>``: deny before chained before ask before rewrite."""

    def decided(c: Column, words: Column, new: Column) -> Column:
        asks = (F.get(words, 0) == "git") & F.get(words, 1).isin("push", "commit")
        code = (
            F.when(is_denied(c, custom), DENY)
            .when(is_chained(c), DENY if strict else NONE)
            .when(F.coalesce(asks, F.lit(False)), ASK)
            .when(new.isNotNull(), REWRITE)
            .otherwise(NONE)
        )
        asked = F.concat(F.lit(f"{wrapper} git "), F.get(words, 1))
        return once(code, lambda k: F.struct(k.alias("code"), F.when(k == ASK, asked).when(k == REWRITE, new).alias("rewritten")))

    def of(c: Column) -> Column:
        return once(words_of(c), lambda w: once(_rewritten(c, w, wrapper, plugins), lambda new: decided(c, w, new)))

    return once(strip(cmd), of)


def has_flag(words: Column, flags: tuple[str, ...]) -> Column:
    """True if an argument of the command's words is one of the flags."""
    return F.coalesce(F.arrays_overlap(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), F.array(*[F.lit(f) for f in flags])), F.lit(False))


# Forms of output that are short already.
SHORT_STATUS = ("--porcelain", "--short", "-s")


def is_filtered(cmd: Column) -> Column:
    """True if a rewritten command's output is filtered: the short forms of a status are not."""
    return once(words_of(cmd), lambda w: ~((F.get(w, 0) == "git") & (F.get(w, 1) == "status") & has_flag(w, SHORT_STATUS)))
