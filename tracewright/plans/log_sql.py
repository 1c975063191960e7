"""DuckDB SQL with the results of the log filters, profiles, redaction and routing, written over lists of lines and windows."""

from __future__ import annotations

from tracewright.operators import dlp, line_filters, router, sequence_filters
from tracewright.operators.profiles import Profile

_NL = "chr(10)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pattern(p: str) -> str:
    return _quoted(p.replace("(?U)", ""))


def _any_start(x: str, prefixes: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {_quoted(p)})" for p in prefixes) + ")"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _rtrim(x: str) -> str:
    return rf"regexp_replace({x}, '\s+$', '')"


def _ltrim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+', '')"


def _lines(view: str, key: str = "run_id", text: str = "log") -> str:
    """``k``, ``t`` and the lines ``l`` of each text."""
    split = f"string_split(replace({text}, chr(13) || {_NL}, {_NL}), {_NL})"
    return f"(SELECT k, t, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT {key} AS k, {text} AS t, {split} AS l FROM {view}))"


def _ended(kept: str) -> str:
    return f"array_to_string(list_transform({kept}, lambda y: y || {_NL}), '')"


def _told(view: str, kept: str, end: str) -> str:
    """A filter over the list of lines, with one of the ends that filters have."""
    if end in ("empty", "blank"):
        out, test = _ended(kept), "o = ''" if end == "empty" else f"{_trim('o')} = ''"
        return f"SELECT k AS run_id, CASE WHEN {test} THEN t ELSE o END AS filtered FROM (SELECT k, t, {out} AS o FROM {_lines(view)})"
    test = "o = ''" if end == "trimmed" else f"o = '' AND {_trim('t')} <> ''"
    return f"SELECT k AS run_id, CASE WHEN {test} THEN t ELSE o || {_NL} END AS filtered FROM (SELECT k, t, {_rtrim(f'array_to_string({kept}, {_NL})')} AS o FROM {_lines(view)})"


def _filtered(keep: str) -> str:
    return f"list_filter(l, lambda x: {keep})"


def _not_null(each: str) -> str:
    return f"list_filter(list_transform(l, lambda x: {each}), lambda x: x IS NOT NULL)"


_X = _trim("x")
_PROBLEM = _pattern(line_filters.LINT_PROBLEM)
_LONG = _pattern(line_filters.LONG_LISTING)
_SIZE = "CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || 'K' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || 'M' ELSE printf('%.1f', n / 1073741824.0) || 'G' END"


def _size(n: str) -> str:
    label = _SIZE.replace("n ", f"{n} ")
    return f"CASE WHEN length({label}) < 6 THEN lpad({label}, 6, ' ') ELSE {label} END"


def _part(p: str, i: int) -> str:
    return f"regexp_extract(x, {p}, {i})"


_LISTED = f"CASE WHEN regexp_matches(x, {_LONG}) THEN concat_ws(' ', {_part(_LONG, 1)}, {_size(f'{_part(_LONG, 5)}::BIGINT')}, {_part(_LONG, 6)}, {_part(_LONG, 7)}) ELSE x END"
_ENTRIES = rf"list_transform(list_filter(list_transform(l, lambda x: {_X}), lambda x: x <> '' AND NOT regexp_matches(x, '^total\s+\d+$')), lambda x: {_LISTED})"
_PS = r"""CASE WHEN len(f) = 7 THEN concat_ws('  ', f[7], f[2], f[5], nullif(f[6], '')) WHEN len(f) = 6 THEN concat_ws('  ', f[6], f[2], f[5]) ELSE x END"""
_PS = _PS.replace("f)", "string_split_regex(r, '\\s{2,}'))").replace("f[", "string_split_regex(r, '\\s{2,}')[").replace("(r,", f"({_rtrim('x')},")
_W = r"string_split_regex(" + _X + r", '\s+')"
_BRANCH = (
    f"CASE WHEN len({_W}) >= 3 THEN (CASE WHEN {_W}[1] = '*' THEN '* ' || {_W}[2] || ' ' || {_W}[3][:7] || ' ' || array_to_string({_W}[4:], ' ') ELSE '  ' || {_W}[1] || ' ' || {_W}[2][:7] || ' ' || array_to_string({_W}[3:], ' ') END) ELSE {_rtrim('x')} END"
)
_MET = "'Requirement already satisfied:'"
_PIP = f"(regexp_matches(x, {_pattern(line_filters.PIP_KEPT)}) AND NOT regexp_matches(x, {_pattern(line_filters.PIP_NOTICE)}))"
_NOTE = "'[' || m || CASE WHEN m = 1 THEN ' requirement' ELSE ' requirements' END || ' already satisfied]'"

FILTERS: dict[str, str] = {
    "cargo_build": _told("log_cargo_build", _filtered(f"NOT {_any_start('x', line_filters.BUILD_PROGRESS)}"), "ended"),
    "cargo_test": _told(
        "log_cargo_test",
        _filtered(f"NOT ({_any_start('x', line_filters.TEST_PROGRESS)} OR (starts_with({_ltrim('x')}, 'test ') AND (ends_with(x, ' ... ok') OR ends_with(x, ' ... ignored'))))"),
        "ended",
    ),
    "docker_build": _told("log_docker_build", _filtered(f"NOT ({_X} = '' OR regexp_matches({_X}, {_pattern(line_filters.LAYER)}) OR regexp_matches({_X}, {_pattern(line_filters.PROGRESS_BAR)}))"), "blank"),
    "go_test": _told("log_go_test", _filtered(f"NOT ({_X} = '' OR regexp_matches({_X}, {_pattern(line_filters.GO_NOISE)}))"), "blank"),
    "gradle": _told("log_gradle", _filtered(f"NOT ({_X} = '' OR regexp_matches({_X}, {_pattern(line_filters.GRADLE_NOISE)}))"), "blank"),
    "docker_ps": "SELECT d.k AS run_id, CASE WHEN starts_with(l[1], 'CONTAINER ID') THEN f.filtered ELSE t END AS filtered FROM "
    + _lines("log_docker_ps")
    + " d JOIN ("
    + _told("log_docker_ps", f"list_prepend('NAMES  IMAGE  STATUS  PORTS', list_transform(list_filter(l[2:], lambda x: {_X} <> ''), lambda x: {_PS}))", "trimmed")
    + ") f ON f.run_id = d.k",
    "eslint": _told("log_eslint", _not_null(rf"CASE WHEN regexp_matches(x, {_PROBLEM}) THEN {_part(_PROBLEM, 1)} || ' ' || {_part(_PROBLEM, 2)} || ' ' || {_part(_PROBLEM, 3)} || ' (' || {_part(_PROBLEM, 4)} || ')' WHEN NOT regexp_matches(x, '^\s') AND {_X} <> '' THEN x END"), "trimmed"),
    "tsc": _told("log_tsc", rf"list_filter(l, lambda x, i: NOT (regexp_matches(x, '^\s*~+\s*$') OR coalesce(regexp_matches(l[i + 1], '^\s*~+\s*$'), false) OR {_X} = ''))", "trimmed"),
    "vitest": _told(
        "log_vitest",
        _not_null(
            rf"CASE WHEN contains(x, '⎯') THEN CASE WHEN NOT ({_trim("replace(x, '⎯', '')")} = '' OR regexp_matches(regexp_replace({_trim("replace(x, '⎯', '')")}, '[\[\]/\s]', '', 'g'), '^[0-9]+$')) THEN {_trim("replace(x, '⎯', '')")} END "
            rf"WHEN NOT (starts_with({_ltrim('x')}, 'RUN ') OR starts_with({_ltrim('x')}, 'Start at') OR regexp_matches(x, '^\s*\d+\|') OR starts_with({_ltrim('x')}, '|') OR {_X} = '') THEN x END"
        ),
        "trimmed",
    ),
    "ls": "SELECT k AS run_id, CASE WHEN o = '' THEN t ELSE o END AS filtered FROM (SELECT k, t, "
    + _ended("CASE WHEN len(e) > 20 THEN e[:12] || ['... and ' || (len(e) - 17) || ' more entries ...'] || e[-5:] ELSE e END")
    + f" AS o FROM (SELECT k, t, {_ENTRIES} AS e FROM {_lines('log_ls')}))",
    "gh_checks": rf"SELECT k AS run_id, CASE WHEN len(list_filter(l, lambda x: regexp_matches(x, '\thttps?://\S+'))) = 0 THEN t WHEN o = '' THEN t ELSE o || {_NL} END AS filtered FROM (SELECT k, t, l, {_rtrim(f"array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '	https?://[^ ]+') THEN {_rtrim("regexp_replace(x, '	https?://[^ 	]+', '', 'g')")} ELSE x END), {_NL})")} AS o FROM {_lines('log_gh_checks')})",
    "git_branch": _told("log_git_branch", f"list_transform(list_filter(l, lambda x: {_X} <> ''), lambda x: {_BRANCH})", "empty"),
    "git_show": f"""SELECT k AS run_id, CASE WHEN o = '' THEN t ELSE o END AS filtered FROM (SELECT k, t, {_ended("list_filter(list_transform(l[:c - 1], lambda x: CASE WHEN starts_with(x, 'commit ') THEN CASE WHEN regexp_matches(regexp_extract(x, '^commit [ ]*([^ ]+)', 1), '^[0-9a-fA-F]{7,}$') THEN regexp_extract(x, '^commit [ ]*([^ ]+)', 1)[:7] END WHEN NOT (" + _any_start('x', ('Author:', 'Date:', 'Merge:', 'Merge-tag:')) + " OR " + _X + " = '') THEN " + _X + " END), lambda x: x IS NOT NULL) || l[c:]")} AS o
      FROM (SELECT *, coalesce(list_position(list_transform(l, lambda x: {_any_start('x', ('diff --git', '--- ', '+++ ', 'index '))}), true), len(l) + 1) AS c FROM {_lines('log_git_show')}))""",
    "pip_install": f"""SELECT k AS run_id, CASE WHEN o = '' THEN t ELSE o END AS filtered FROM (SELECT k, t, {_ended(f"CASE WHEN m > 0 THEN list_filter(l[:p - 1], lambda x: {_PIP}) || [{_NOTE}] || list_filter(l[p:], lambda x: {_PIP}) ELSE list_filter(l, lambda x: {_PIP}) END")} AS o
      FROM (SELECT *, len(list_filter(l, lambda x: starts_with(x, {_MET}))) AS m, coalesce(list_position(list_transform(l, lambda x: starts_with(x, {_MET})), true), 1) AS p FROM {_lines('log_pip_install')}))""",
    "dotnet": f"""SELECT k AS run_id, array_to_string(CASE WHEN len(l) > 5 THEN f || coalesce(list_filter(u, lambda x: {_X} <> '' AND NOT list_contains(f, x)), []) WHEN len(f) = 0 THEN l ELSE f END, {_NL}) AS filtered
      FROM (SELECT *, list_filter(l, lambda x: regexp_matches(x, {_pattern(line_filters.DOTNET_KEPT)})) AS f, list_filter(l[-5:], lambda x, i: list_position(l[-5:], x) = i) AS u FROM {_lines('log_dotnet')})""",
    "plugin": _told(
        "log_cargo_build",
        _filtered(f"NOT {_any_start(_ltrim('x'), ('Compiling', 'Finished'))} AND ({_any_start(_ltrim('x'), ('warning', '-->'))} OR contains(lower(x), 'error') OR contains(lower(x), 'warning') OR contains(lower(x), 'failed'))"),
        "ended",
    ),
}


# Filters with memory: lines as rows, windows over each log.


def _rows(view: str) -> str:
    return f"SELECT k, unnest(l) AS x, unnest(range(len(l)))::BIGINT AS pos FROM {_lines(view)}"


def _sequence(view: str, ctes: str, told: str, end: str) -> str:
    """``told`` selects k, a, b, y: the lines and their places; null lines go."""
    body = f"SELECT k, string_agg(y || {_NL}, '' ORDER BY a, b) AS o FROM ({told}) WHERE y IS NOT NULL GROUP BY k"
    case = {
        "empty": "CASE WHEN o = '' THEN t ELSE o END",
        "blank": f"CASE WHEN {_trim('o')} = '' THEN t ELSE o END",
        "trimmed": f"CASE WHEN {_trim('o')} = '' THEN t ELSE {_rtrim('o')} || {_NL} END",
        "ended": f"CASE WHEN {_trim('o')} = '' AND {_trim('t')} <> '' THEN t ELSE {_rtrim('o')} || {_NL} END",
    }[end]
    return f", r AS ({_rows(view)}){ctes}, told AS ({body}) SELECT d.k AS run_id, {case} AS filtered FROM (SELECT d.k, d.t, coalesce(told.o, '') AS o FROM {_lines(view)} d LEFT JOIN told ON told.k = d.k) d"


def _collapsed(view: str, kind: str, notes: list[tuple[str, int, str]]) -> str:
    nth = ", ".join(f"sum((kind = '{n}')::INT) OVER w AS n_{n}" for n, _, _ in notes)
    shown = " OR ".join(["kind = 'kept'", *[f"(kind = '{n}' AND n_{n} <= {most})" for n, most, _ in notes if most]])
    told = "SELECT k, part AS a, 0 AS b, x AS y FROM p WHERE shown"
    for i, (n, _, note) in enumerate(notes, 1):
        before, after = note.split("{n}")
        told += f" UNION ALL SELECT k, part, {i}, {_quoted(before)} || count(*) || {_quoted(after)} FROM p WHERE NOT shown AND kind = '{n}' GROUP BY k, part"
    ctes = f", c AS (SELECT *, {_X} AS bare FROM r), d0 AS (SELECT *, {kind} AS kind FROM c), e AS (SELECT *, {nth} FROM d0 WHERE kind <> 'dropped' WINDOW w AS (PARTITION BY k ORDER BY pos)), s AS (SELECT *, {shown} AS shown FROM e), p AS (SELECT *, sum(shown::INT) OVER (PARTITION BY k ORDER BY pos) AS part FROM s)"
    return _sequence(view, ctes, told, "ended")


_CUT = "CASE WHEN strlen(x) > 80 THEN x[:79] || '…' ELSE x END"
_DIFF = _pattern(sequence_filters.DIFF_FILE)
_HUNK = _pattern(sequence_filters.DIFF_HUNK)
_SECTIONS = "CASE WHEN starts_with(bare, 'Changes to be committed') THEN 'staged' WHEN starts_with(bare, 'Changes not staged for commit') THEN 'unstaged' WHEN starts_with(bare, 'Untracked files') THEN 'untracked' WHEN starts_with(bare, 'Unmerged paths') THEN 'conflict' END"
FILTERS |= {
    "git_diff": _sequence(
        "log_git_diff",
        f""", c AS (SELECT *, CASE WHEN regexp_matches(x, {_DIFF}) THEN 'file' WHEN regexp_matches(x, {_HUNK}) THEN 'hunk' WHEN {_any_start('x', (*sequence_filters.DIFF_META, ' '))} OR x = '' THEN 'dropped' WHEN starts_with(x, '+') THEN 'added' WHEN starts_with(x, '-') THEN 'removed' ELSE 'other' END AS kind FROM r),
        g AS (SELECT *, kind IN ('added', 'removed') AS change, sum((kind NOT IN ('added', 'removed'))::INT) OVER (PARTITION BY k ORDER BY pos) AS part FROM c WHERE kind <> 'dropped'),
        h AS (SELECT *, sum(change::INT) OVER (PARTITION BY k, part ORDER BY pos) AS nth, max(CASE WHEN kind = 'hunk' THEN '@@ -' || regexp_extract(x, {_HUNK}, 1) || ' +' || regexp_extract(x, {_HUNK}, 2) || ' @@' WHEN NOT change THEN '' END) OVER (PARTITION BY k, part) AS header FROM g),
        q AS (SELECT *, max(nth) OVER (PARTITION BY k, part) AS n, sum((kind = 'added' AND nth > 3)::INT) OVER (PARTITION BY k, part) AS more, sum((kind = 'removed' AND nth > 3)::INT) OVER (PARTITION BY k, part) AS less FROM h)""",
        f"""SELECT k, pos AS a, 0 AS b, CASE WHEN change AND nth = 1 THEN coalesce(header, '') END AS y FROM q
        UNION ALL SELECT k, pos, 1, CASE WHEN change THEN CASE WHEN n <= 8 OR nth <= 3 THEN {_CUT} WHEN nth = 4 THEN '[…' || CASE WHEN more > 0 THEN '+' || more ELSE '' END || CASE WHEN less > 0 THEN ' -' || less ELSE '' END || ' more lines]' END WHEN kind = 'file' THEN '[' || regexp_extract(x, {_DIFF}, 1) || ']' WHEN kind = 'other' THEN x END FROM q""",
        "empty",
    ),
    "git_status": _sequence(
        "log_git_status",
        f""", c AS (SELECT *, {_X} AS bare FROM r), d0 AS (SELECT *, {_SECTIONS} AS title FROM c WHERE NOT (bare = '' OR {_any_start('bare', ('(use ', 'nothing added', 'no changes added'))})),
        e AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos) AS section FROM d0),
        f AS (SELECT *, starts_with(x, chr(9)) AND section IS NOT NULL AND title IS NULL AND bare <> 'nothing to commit, working tree clean' AS entry FROM e),
        g AS (SELECT *, sum((entry AND section = 'untracked')::INT) OVER (PARTITION BY k ORDER BY pos) AS nth FROM f)""",
        """SELECT k, pos AS a, 0 AS b, CASE WHEN title IS NOT NULL THEN NULL WHEN bare = 'nothing to commit, working tree clean' THEN 'clean' WHEN entry THEN CASE WHEN section <> 'untracked' OR nth <= 10 THEN section || ': ' || bare END ELSE bare END AS y FROM g
        UNION ALL SELECT k, 2147483647, 0, '... and ' || (max(nth) - 10) || ' more untracked' FROM g GROUP BY k HAVING max(nth) > 10""",
        "blank",
    ),
    "git_log": _sequence(
        "log_git_log",
        rf""", c AS (SELECT *, {_X} AS bare, regexp_extract(x, '^commit \s*([0-9a-fA-F]{{7,}})(\s|$)', 1)[:7] AS code FROM r), d0 AS (SELECT *, sum((code <> '')::INT) OVER (PARTITION BY k ORDER BY pos) AS n, last_value(nullif(code, '') IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos) AS h FROM c),
        e AS (SELECT *, code = '' AND n > 0 AND bare <> '' AND NOT {_any_start('x', ('Author:', 'Date:', 'Merge:'))} AS body FROM d0), f AS (SELECT *, sum(body::INT) OVER (PARTITION BY k, n ORDER BY pos) AS nth FROM e)""",
        "SELECT k, pos AS a, 0 AS b, h || '  ' || bare AS y FROM f WHERE body AND nth = 1",
        "empty",
    ),
    "npm_install": _collapsed(
        "log_npm_install",
        r"CASE WHEN bare = '' OR regexp_matches(bare, '^Progress: resolved \d+') THEN 'dropped' WHEN starts_with(bare, 'npm ERR!') THEN 'kept' WHEN starts_with(bare, 'npm warn ') THEN 'warning' WHEN regexp_matches(bare, '^added .+') THEN 'added' ELSE 'kept' END",
        [("added", 5, "... {n} packages added (collapsed) ..."), ("warning", 3, "... {n} deprecation warnings collapsed ...")],
    ),
    "yarn_install": _collapsed(
        "log_yarn_install",
        r"CASE WHEN bare = '' THEN 'dropped' WHEN starts_with(bare, 'error ') OR contains(bare, 'ERR!') THEN 'kept' WHEN regexp_matches(bare, '^\[\d+/\d+\]') THEN 'step' WHEN regexp_matches(bare, '^warning .+') THEN 'warning' WHEN regexp_matches(bare, '^(info|warning) .+@(file:|npm:|https?:)') THEN 'package' ELSE 'kept' END",
        [("step", 0, "... {n} yarn steps collapsed ..."), ("package", 5, "... {n} package lines collapsed ..."), ("warning", 3, "... {n} warnings collapsed ...")],
    ),
    "pytest": _sequence(
        "log_pytest",
        rf""", c AS (SELECT *, {_X} AS bare, CASE WHEN regexp_matches({_X}, {_pattern(sequence_filters.RULE)}) THEN {_trim(f'regexp_extract({_X}, {_pattern(sequence_filters.RULE)}, 1)')} END AS title FROM r),
        d0 AS (SELECT *, coalesce(last_value(title = 'WARNINGS' OR starts_with(title, 'warnings summary') IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos), false) AS inw FROM c),
        e AS (SELECT *, lag(inw, 1, false) OVER (PARTITION BY k ORDER BY pos) AS was, sum((inw AND title IS NULL AND contains(bare, 'Warning'))::INT) OVER (PARTITION BY k ORDER BY pos) AS n,
          sum((CASE WHEN title IS NOT NULL THEN NOT contains(title, 'test session starts') ELSE NOT inw AND bare <> '' AND NOT regexp_matches(bare, {_pattern(sequence_filters.PREAMBLE)}) END)::INT) OVER (PARTITION BY k ORDER BY pos) = 0 AS pre FROM d0)""",
        rf"""SELECT k, pos AS a, 0 AS b, CASE WHEN was AND NOT inw AND n > 0 THEN '=== ' || n || ' warnings collapsed (run with -W ignore to suppress) ===' || {_NL} END AS y FROM e
        UNION ALL SELECT k, pos, 1, CASE WHEN NOT inw AND NOT (pre AND (regexp_matches(bare, {_pattern(sequence_filters.PREAMBLE)}) OR bare = '')) THEN x END FROM e
        UNION ALL SELECT k, 2147483647, 0, '=== ' || max(n) || ' warnings collapsed (run with -W ignore to suppress) ===' FROM e GROUP BY k HAVING max_by(inw, pos) AND max(n) > 0""",
        "ended",
    ),
    "ruff_check": _sequence(
        "log_ruff_check",
        rf""", c AS (SELECT *, CASE WHEN regexp_matches(x, {_pattern(sequence_filters.RUFF_LOCATION)}) THEN 'location' WHEN regexp_matches(x, {_pattern(sequence_filters.RUFF_HEADER)}) THEN 'header' WHEN regexp_matches(x, {_pattern(sequence_filters.RUFF_CONCISE)}) OR regexp_matches(x, {_pattern(sequence_filters.RUFF_SUMMARY)}) THEN 'kept' END AS kind FROM r),
        d0 AS (SELECT *, lag(CASE WHEN kind = 'header' THEN regexp_extract(x, {_pattern(sequence_filters.RUFF_HEADER)}, 1) || CASE WHEN regexp_extract(x, {_pattern(sequence_filters.RUFF_HEADER)}, 2) <> '' THEN ' [*]' ELSE '' END || ' ' || {_trim(f"regexp_extract(x, {_pattern(sequence_filters.RUFF_HEADER)}, 3)")} END) OVER (PARTITION BY k ORDER BY pos) AS above FROM c WHERE kind IS NOT NULL)""",
        f"SELECT k, pos AS a, 0 AS b, CASE kind WHEN 'location' THEN regexp_extract(x, {_pattern(sequence_filters.RUFF_LOCATION)}, 1) || ': ' || above WHEN 'kept' THEN x END AS y FROM d0",
        "trimmed",
    ),
    "mypy": _sequence(
        "log_mypy",
        rf""", c AS (SELECT *, {_X} AS bare, regexp_matches(x, {_pattern(sequence_filters.CARET)}) OR coalesce(lead(regexp_matches(x, {_pattern(sequence_filters.CARET)})) OVER (PARTITION BY k ORDER BY pos), false) AS frame FROM r),
        d0 AS (SELECT *, CASE WHEN regexp_matches(x, {_pattern(sequence_filters.MYPY_FOUND)}) THEN 'found' WHEN regexp_matches(x, {_pattern(sequence_filters.MYPY_SUMMARY)}) THEN 'summary' END AS kind FROM c WHERE NOT frame),
        e AS (SELECT *, sum((kind IS NOT NULL)::INT) OVER w AS part, coalesce(last_value(kind IGNORE NULLS) OVER w, 'none') AS under FROM d0 WHERE bare <> '' OR kind IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY pos)),
        f AS (SELECT *, CASE WHEN kind = 'found' THEN regexp_extract(x, {_pattern(sequence_filters.MYPY_FOUND)}, 1) || ' ' || regexp_extract(x, {_pattern(sequence_filters.MYPY_FOUND)}, 2) || ': ' || {_trim(f"regexp_extract(x, {_pattern(sequence_filters.MYPY_FOUND)}, 3)")} WHEN under = 'found' AND kind IS NULL THEN bare ELSE x END AS told FROM e)""",
        "SELECT k, pos AS a, 0 AS b, told AS y FROM f WHERE under <> 'found' UNION ALL SELECT k, min(pos), 0, string_agg(told, ' ' ORDER BY pos) FROM f WHERE under = 'found' GROUP BY k, part",
        "trimmed",
    ),
    "distil": _sequence(
        "log_distil",
        rf""", c AS (SELECT *, {_X} AS bare, count(*) OVER (PARTITION BY k) AS n FROM r),
        d0 AS (SELECT *, pos < 15 OR pos >= greatest(n - 15, 15) OR regexp_matches(bare, {_quoted(sequence_filters.TOLD_ERROR.replace('(?iU)', '(?i)'))}) OR regexp_matches(bare, {_pattern(sequence_filters.TOLD_DIAGNOSTIC)}) AS shown FROM c WHERE n > 80),
        e AS (SELECT *, sum(shown::INT) OVER (PARTITION BY k ORDER BY pos) AS part FROM d0)""",
        "SELECT k, part AS a, 0 AS b, x AS y FROM e WHERE shown UNION ALL SELECT k, part, 1, '... [' || count(*) || ' lines collapsed] ...' FROM e WHERE NOT shown GROUP BY k, part",
        "empty",
    ),
}


def compact(profile: str, most: int) -> str:
    bare = f"list_transform(l, lambda x: CASE WHEN {_X} = '' THEN '' ELSE x END)"
    kept = {
        "strict": _filtered(f"{_X} <> '' AND NOT {_any_start(_X, ('//', '#', '/*', '*'))}"),
        "developer": _filtered("regexp_matches(lower(x), 'error|fail|warn|summary')"),
        "default": f"list_filter({bare}, lambda x, i: x <> '' OR i = 1 OR {bare}[i - 1] <> '')",
    }[profile]
    words = r"len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> ''))"
    return f"SELECT k AS path, CASE WHEN {words} <= {most} THEN t ELSE array_to_string({kept}, {_NL}) END AS content FROM {_lines('files', 'path', 'content')}"


_BARE = f"list_transform(l, lambda x: {_rtrim('x')})"
RULE_FILE = f"SELECT k AS path, array_to_string(list_filter({_BARE}, lambda x, i: x <> '' OR i = 1 OR {_BARE}[i - 1] <> ''), {_NL}) AS content FROM " + _lines(
    f"(SELECT path, regexp_replace(content || {_NL} || '<!-- a' || {_NL} || 'b -->x  ' || {_NL} || {_NL} || {_NL} || {_NL} || 'y', '(?s)<!--.*?-->', '', 'g') AS c FROM files)", "path", "c"
)
HUNKS = rf""", r AS ({_rows('diffs').replace('log', 'text') if False else f"SELECT k, unnest(l) AS x, unnest(range(len(l)))::BIGINT AS pos FROM {_lines('diffs', 'run_id', 'text')}"}),
  f AS (SELECT *, last_value(CASE WHEN starts_with(x, '+++ b/') THEN x[7:] END IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos) AS file_path, regexp_extract(x, '^@@ .*?\+(\d+)(?:,(\d+))?', 1) AS a, regexp_extract(x, '^@@ .*?\+(\d+)(?:,(\d+))?', 2) AS b FROM r)
  SELECT k AS run_id, pos::INTEGER AS pos, file_path, a::INTEGER AS first_line, (a::INTEGER + coalesce(nullif(b, '')::INTEGER, 1) - 1)::INTEGER AS last_line FROM f WHERE a <> '' AND file_path IS NOT NULL AND coalesce(nullif(b, '')::INTEGER, 1) > 0"""
CODE_SEARCH = f"SELECT k AS path, (pos + 1)::INTEGER AS line_number, trim(x) AS content FROM (SELECT k, unnest(l) AS x, unnest(range(len(l))) AS pos FROM {_lines('files', 'path', 'content')}) WHERE contains(lower(x), 'x =') ORDER BY path, line_number LIMIT 100"
STRIPPED = f""", r AS (SELECT k, e, {_X} AS bare, x, pos FROM (SELECT f.path AS k, f.ext AS e, unnest(d.l) AS x, unnest(range(len(d.l)))::BIGINT AS pos FROM files f JOIN {_lines('files', 'path', 'content')} d ON d.k = f.path)),
  s(k, pos, inside) AS (SELECT path, -1::BIGINT, false FROM files UNION ALL SELECT r.k, r.pos, CASE WHEN s.inside THEN NOT (contains(bare, '*/') OR contains(bare, '\"\"\"') OR contains(bare, '-->')) ELSE e = 'rs' AND starts_with(bare, '/*') AND NOT ends_with(bare, '*/') END FROM s JOIN r ON r.k = s.k AND r.pos = s.pos + 1),
  v AS (SELECT r.*, s.inside AS after, coalesce(lag(s.inside) OVER (PARTITION BY r.k ORDER BY r.pos), false) AS before FROM r JOIN s ON s.k = r.k AND s.pos = r.pos),
  kept AS (SELECT *, bare = '' AND coalesce(lag(bare = '') OVER (PARTITION BY k ORDER BY pos), false) AS again FROM v WHERE NOT before AND NOT after AND NOT (e = 'rs' AND (starts_with(bare, '//') OR (starts_with(bare, '/*') AND ends_with(bare, '*/')))) AND NOT (e = 'py' AND starts_with(bare, '#')))
  SELECT f.path, coalesce(o, '') AS content FROM files f LEFT JOIN (SELECT k, string_agg(CASE WHEN bare = '' THEN '' ELSE x END || {_NL}, '' ORDER BY pos) AS o FROM kept WHERE NOT again GROUP BY k) q ON q.k = f.path"""


def _profiled(p: Profile, l: str = "l") -> str:
    if p.json_only:
        l = f"list_filter({l}, lambda x: {_any_start(_X, ('{', '[', chr(34)))} OR contains({_X}, ': {{') OR contains({_X}, ': ['))".replace("{{", "{")
    if p.comments:
        l = f"list_filter(list_transform({l}, lambda x: CASE WHEN starts_with({_ltrim('x')}, '#') THEN '' WHEN contains(x, '//') THEN {_rtrim('string_split(x, chr(47) || chr(47))[1]')} ELSE x END), lambda x: x <> '')"
    if p.line_bytes:
        l = f"list_transform({l}, lambda x: CASE WHEN strlen(x) > {p.line_bytes} THEN x[:{p.line_bytes - 1}] || '…' ELSE x END)"
    if p.minify:
        whole = f"((starts_with({_X}, '{{') AND ends_with({_X}, '}}')) OR (starts_with({_X}, '[') AND ends_with({_X}, ']')))"
        l = f"list_transform({l}, lambda x: CASE WHEN {whole} AND json_valid({_X}) THEN json({_X})::VARCHAR ELSE x END)"
    return f"array_to_string({l}, {_NL})"


def profile(p: Profile) -> str:
    body = _profiled(p)
    ended = "o" if p.minify else f"CASE WHEN ends_with(t, {_NL}) AND o <> '' THEN o || {_NL} ELSE o END"
    return f"SELECT k AS run_id, {ended} AS log FROM (SELECT k, t, {body} AS o FROM {_lines('log_mixed')})"


def post_processed(profiles: list[Profile]) -> str:
    """Rows by turns under each of the profiles."""
    n = len(profiles)
    return " UNION ALL ".join(_post_processed(p, f"(SELECT * FROM log_mixed WHERE run_id % {n} = {i})") for i, p in enumerate(profiles))


def _post_processed(p: Profile, source: str) -> str:
    ruled = "(SELECT run_id, log AS raw, regexp_replace(regexp_replace(log, 'plain line [0-9]+', '[collapsed]', 'g'), 'token internal-[0-9]+ ', '', 'g') AS log FROM " + source + ")"
    shown = "o" if p.minify else f"CASE WHEN ends_with(t, {_NL}) AND o <> '' THEN o || {_NL} ELSE o END"
    tokens = "((strlen({0}) + 3) // 4)::BIGINT"
    return f"""SELECT run_id, shown, {tokens.format('raw')} AS original_tokens, {tokens.format('shown')} AS filtered_tokens, strlen(shown) < strlen(raw) AND {_trim('shown')} <> '' AS cached, {tokens.format('shown')} > 3000 AS saturated
      FROM (SELECT k AS run_id, {shown} AS shown FROM (SELECT k, t, {_profiled(p)} AS o FROM {_lines(ruled)})) JOIN (SELECT run_id, log AS raw FROM log_mixed) USING (run_id)"""


def _stages(x: str, custom: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(label, text before the stage, pattern); the text after each is the next one's."""
    out = []
    for label, pattern, mark in (*dlp.STAGES, *((dlp.CUSTOM[0], p, dlp.CUSTOM[1]) for p in custom)):
        out.append((label, x, pattern))
        x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(mark.replace('$', chr(92)))}, 'g')"
    return [*out, (dlp.RANDOM[0], x, "")]


_WORD = _quoted(r"[\p{L}\p{M}\p{N}_\-/+=]+")
_BYTES = "string_split_regex(hex(encode(w)), '(?=(..)+$)')"
_PAIRS = "list_transform(range(0, strlen(w)), lambda i: hex(encode(w))[2 * i + 1:2 * i + 2])"
_BITS = f"-list_sum(list_transform(list_distinct({_PAIRS}), lambda c: len(list_filter({_PAIRS}, lambda y: y = c))::DOUBLE / strlen(w) * log2(len(list_filter({_PAIRS}, lambda y: y = c))::DOUBLE / strlen(w))))"


def _random(words: str) -> str:
    return f"list_filter({words}, lambda w: CASE WHEN strlen(w) BETWEEN {dlp.LEAST_BYTES} AND {dlp.MOST_BYTES} AND NOT regexp_full_match(w, '[0-9a-fA-F]{{40}}') THEN {_BITS} > {dlp.LEAST_BITS} ELSE false END)"


def redact(view: str, key: str, custom: tuple[str, ...]) -> str:
    """Random words go one by one: each found word stands whole between other characters."""
    _, text, _ = _stages("text", custom)[-1]
    words = f"regexp_extract_all(s, {_WORD})"
    gaps = f"regexp_split_to_array(s, {_WORD})"
    return f"""SELECT {key}, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(w) THEN '' WHEN list_contains(bad, w[i]) THEN '{dlp.RANDOM[1]}' ELSE w[i] END), '') AS text
      FROM (SELECT *, {_random('w')} AS bad FROM (SELECT {key}, {gaps} AS g, {words} AS w FROM (SELECT {key}, {text} AS s FROM {view})))"""


def audit(view: str, custom: tuple[str, ...]) -> str:
    parts = []
    for label, text, pattern in _stages("text", custom):
        found = f"regexp_extract_all({text}, {_quoted(pattern)})" if pattern else _random(f"regexp_extract_all({text}, {_WORD})")
        parts.append(f"SELECT doc_id, {_quoted(label)} AS label, unnest({found}) AS hit FROM {view}")
    return f"SELECT doc_id, 1707523200 AS epoch_s, 'git show' AS source, label, sha256(hit) AS hash FROM ({' UNION ALL '.join(parts)})"


def _router() -> str:
    denied = " OR ".join(f"regexp_matches(s, {_pattern(p)})" for p in (*router.DENIED, *router.DENIED_BY_DEFAULT))
    segments = rf"list_filter(list_transform(string_split_regex(c, '\s*&&\s*|\s*;\s*|\s*\|\|\s*|\s*\|\s*'), lambda x: {_X}), lambda x: x <> '')"

    def first(a: str, b: str) -> str:
        return f"c[:strpos(c, {a}) - 1] || {b} || c[strpos(c, {a}) + length({a}):]"

    cases = ["WHEN w[1] = 'git' AND w[2] = 'status' THEN 'tw git status'"]
    for program, subs in router.SUBCOMMANDS.items():
        test = f"w[2] IN ({', '.join(map(_quoted, subs))})" if subs else "len(w) >= 2"
        cases.append(f"WHEN w[1] = '{program}' AND {test} THEN {first(_quoted(program), _quoted('tw ' + program))}")
    cases += [
        f"WHEN w[1] = 'go' AND w[2] = 'test' AND contains(c, 'go test') THEN {first(_quoted('go test'), _quoted('tw go-test'))}",
        f"WHEN w[1] = 'gh' AND w[2] = 'pr' AND w[3] = 'checks' THEN {first(_quoted('gh'), _quoted('tw gh'))}",
        f"WHEN w[1] IN ('python', 'python3') AND w[2] = '-m' AND w[3] = 'pip' AND w[4] = 'install' THEN {_rtrim("'tw pip install ' || array_to_string(w[5:], ' ')")}",
        f"WHEN w[1] IN ('pip', 'pip3') AND w[2] = 'install' THEN {first('w[1]', _quoted('tw pip'))}",
        *[f"WHEN w[1] = '{p}' THEN {first(_quoted(p), _quoted('tw ' + p))}" for p in router.ALONE],
        f"WHEN w[1] = 'vitest' AND coalesce(w[2], '') <> 'watch' THEN {first(_quoted('vitest'), _quoted('tw vitest'))}",
        f"WHEN w[1] IN ({', '.join(map(_quoted, router.GRADLE))}) THEN {first('w[1]', _quoted('tw gradle'))}",
    ]
    return rf""", q AS (SELECT id, c, list_filter(string_split_regex(c, '\s+'), lambda x: x <> '') AS w, {segments} AS seg FROM (SELECT id, {_trim('cmd')} AS c FROM commands)),
      z AS (SELECT *, CASE {' '.join(cases)} END AS new FROM q),
      v AS (SELECT *, CASE WHEN len(list_filter(CASE WHEN len(seg) = 0 THEN [c] ELSE seg END, lambda s: {denied})) > 0 THEN 2 WHEN regexp_matches(c, {_quoted(router.CHAINED)}) THEN 1 WHEN w[1] = 'git' AND w[2] IN ('push', 'commit') THEN 3 WHEN new IS NOT NULL THEN 0 ELSE 1 END AS code FROM z)
      SELECT id, code::INTEGER AS code, CASE code WHEN 3 THEN 'tw git ' || w[2] WHEN 0 THEN new END AS rewritten FROM v"""


ROUTER = _router()
