"""Queries over the derived views, each with the same result in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.lines import rounded, tokens
from tracewright.functions.storage import new_path, stored
from tracewright.operators import dlp, graph, ledger, ledger_store, line_filters, packing, pricing, profiles, reports, router, search, search_index, sequence_filters, stores
from tracewright.operators.code_index import CodeIndex
from tracewright.plans import log_sql
from tracewright.sources.corpus import CODE, CODE_PARTS, FAMILIES, code_files, view, with_views
from tracewright.streaming import ledger_stream, sessions

Query = Callable[[SparkSession, str], DataFrame]

_NOW = "TIMESTAMP '2024-02-10 00:00:00'"
_MEMORY_NOW = "TIMESTAMP '2024-04-01 00:00:00'"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, *views: str, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = with_views(sql, *views)


def _over(f: Callable[..., DataFrame], *views: str) -> Query:
    return lambda spark, d: f(*(view(spark, d, v) for v in views))


def _pct(saved: str, total: str) -> str:
    return f"round(CASE WHEN {total} > 0 THEN ({saved})::DOUBLE / {total} * 100 ELSE 0.0 END, 6)"


# Ledger.
_SUMS = "count(*) AS n, sum(original_tokens)::BIGINT AS original, sum(filtered_tokens)::BIGINT AS filtered, sum(original_tokens - filtered_tokens)::BIGINT AS saved"
_TOTALS = f"(SELECT n AS commands, coalesce(original, 0)::BIGINT AS original, coalesce(filtered, 0)::BIGINT AS filtered, coalesce(saved, 0)::BIGINT AS saved FROM (SELECT {_SUMS} FROM ledger))"


def _priced(if_null: str) -> str:
    return f""", named AS (SELECT *, coalesce(model, '{if_null}') AS m FROM ledger),
    best AS (SELECT m, min_by(model_id, ord) AS price_id, coalesce(min_by(input_price, ord), {pricing.DEFAULT_INPUT}) AS input_price,
      coalesce(min_by(output_price, ord), {pricing.DEFAULT_OUTPUT}) AS output_price
      FROM (SELECT DISTINCT m FROM named) LEFT JOIN prices ON contains(lower(m), model_id) OR contains(model_id, lower(m)) GROUP BY m),
    priced AS (SELECT * FROM named JOIN best USING (m))
    """


_add("savings_by_command", _over(ledger.by_command, "ledger"), "ledger", sql=f"SELECT cmd, {_SUMS}, {_pct('sum(original_tokens - filtered_tokens)', 'sum(original_tokens)')} AS pct FROM ledger GROUP BY cmd")
_add("savings_totals", lambda s, d: ledger.savings(view(s, d, "ledger"), pricing.price_table(s)), "ledger", "prices", sql=_priced("") + f"SELECT *, {_pct('saved', 'original')} AS pct, (SELECT sum((original_tokens - filtered_tokens) * input_price) / 1e6 FROM priced) AS cost_saved FROM {_TOTALS}")
_add("daily_savings", _over(ledger.by_day, "ledger"), "ledger", sql="SELECT strftime(ts, '%Y-%m-%d') AS day, sum(original_tokens)::BIGINT AS original, sum(filtered_tokens)::BIGINT AS filtered FROM ledger GROUP BY 1")
_add("model_savings", _over(ledger.by_model, "ledger"), "ledger", sql="SELECT coalesce(model, 'Unknown Model') AS model, count(*) AS invocations, sum(original_tokens - filtered_tokens)::BIGINT AS saved FROM ledger GROUP BY 1")
_add("daily_cost_chart", lambda s, d: ledger.cost_chart(view(s, d, "ledger"), pricing.price_table(s)), "ledger", "prices", sql=_priced("") + f""", daily AS (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(filtered_tokens * input_price) / 1e6 AS cost FROM priced GROUP BY 1 ORDER BY day DESC LIMIT {ledger.CHART_DAYS})
    SELECT day, cost, round(cost / (SELECT max(cost) FROM daily) * {ledger.CHART_WIDTH})::INTEGER AS width, repeat('█', round(cost / (SELECT max(cost) FROM daily) * {ledger.CHART_WIDTH})::INTEGER) AS bar FROM daily""")
_add("budget_status", lambda s, d: ledger.budget(view(s, d, "ledger"), pricing.price_table(s)), "ledger", "prices", sql=_priced(ledger.BUDGET_MODEL) + "SELECT 50.0::DOUBLE AS limit_usd, s AS spent, s >= 50 AS exceeded, s / 50 * 100 AS pct FROM (SELECT sum(filtered_tokens * input_price) / 1e6 AS s FROM priced)")
_add("hours_saved", _over(ledger.hours_saved, "ledger"), "ledger", sql=f"SELECT count(*) AS commands, round(count(*) * {ledger.SECONDS_A_COMMAND}::DOUBLE / 3600, 6) AS hours FROM ledger")
_add("top_saver", _over(ledger.top_saver, "ledger"), "ledger", sql=f"SELECT (SELECT cmd FROM (SELECT cmd, {_SUMS} FROM ledger GROUP BY cmd) ORDER BY saved DESC, cmd DESC LIMIT 1) AS top_saver, (SELECT cmd FROM (SELECT cmd, {_SUMS} FROM ledger GROUP BY cmd) ORDER BY n DESC, cmd LIMIT 1) AS most_frequent")
_add("model_projection", _over(ledger.model_projection, "ledger"), "ledger", "prices", sql=f"SELECT model_id, saved, saved * input_price / 1e6 AS worth FROM {_TOTALS}, prices")
_add("recent_logs", _over(ledger.recent, "ledger"), "ledger", sql="SELECT * FROM ledger ORDER BY id DESC LIMIT 50")
_add("telemetry", _over(ledger.telemetry, "ledger"), "ledger", sql="SELECT * EXCLUDE (raw_output) FROM ledger")
_add("raw_log", lambda s, d: ledger.raw_output(view(s, d, "ledger"), 7), "ledger", sql="SELECT raw_output FROM ledger WHERE id = 7 AND raw_output IS NOT NULL")
_add("telemetry_counters", _over(ledger.counters, "ledger"), "ledger", sql=f"SELECT *, 'ledger_commands_total ' || commands || chr(10) || 'ledger_original_total ' || original || chr(10) || 'ledger_filtered_total ' || filtered || chr(10) || 'ledger_saved_total ' || saved AS exposition FROM {_TOTALS}")
_add("benchmark_export", _over(ledger.export, "ledger"), "ledger", sql=f"SELECT id, coalesce(model, 'unknown') AS model, cmd, original_tokens, filtered_tokens, original_tokens - filtered_tokens AS saved, {_pct('original_tokens - filtered_tokens', 'original_tokens')} AS pct FROM ledger ORDER BY id DESC LIMIT 50000")


def _by_day(spark: SparkSession, d: str) -> DataFrame:
    path, now = new_path(spark, "ledger-days"), datetime(2024, 2, 10)
    rows = view(spark, d, "ledger").drop("raw_output")  # no column of the result: it would be dealt and written only to be left out
    ledger_store.save(rows.withColumn("ts", F.col("ts").cast("timestamp")), path)
    ledger_store.expire(spark, path, now)
    return ledger_store.current(spark, path, now).drop("raw_output").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_add("ledger_by_day", _by_day, "ledger", sql=f"SELECT * EXCLUDE (raw_output) FROM ledger WHERE ts >= {_NOW} - INTERVAL 30 DAY")
_add("ledger_ttl", lambda s, d: ledger.kept(view(s, d, "ledger"), F.expr(_NOW)).drop("raw_output"), "ledger", sql=f"SELECT * EXCLUDE (raw_output) FROM ledger WHERE ts >= {_NOW} - INTERVAL 30 DAY")
_add("price_resolution", lambda s, d: pricing.resolve(view(s, d, "ledger"), pricing.price_table(s)), "ledger", "prices", sql=_priced("") + "SELECT m AS model, price_id, input_price, output_price FROM best WHERE m <> ''")
_add("phase_rollup", lambda s, d: ledger.phases(view(s, d, "ledger"), "project", "original_tokens", "filtered_tokens"), "ledger", sql=f"SELECT coalesce(project, 'all') AS project, count(*) AS n, sum(original_tokens)::BIGINT AS before, sum(filtered_tokens)::BIGINT AS after, {_pct('sum(original_tokens) - sum(filtered_tokens)', 'sum(original_tokens)')} AS pct FROM ledger GROUP BY ROLLUP (project)")
_add("run_statistics", lambda s, d: ledger.run_statistics(view(s, d, "ledger"), "cmd", "duration_ms"), "ledger", sql="SELECT cmd, round(avg(duration_ms), 6) AS mean, min(duration_ms) AS least, max(duration_ms) AS most, round(stddev_pop(duration_ms), 6) AS spread FROM ledger GROUP BY cmd")
_add("token_count", lambda s, d: view(s, d, "secrets").select("doc_id", tokens(F.col("text")).alias("n_tokens")), "secrets", sql="SELECT doc_id, ((strlen(text) + 3) // 4)::BIGINT AS n_tokens FROM secrets")

# Stores.
_FOLDED = ", f AS (SELECT *, first_value(key) OVER w AS first_key, first_value(val) OVER w AS first_val FROM memory WINDOW w AS (PARTITION BY project_path, lower(key) ORDER BY key)) SELECT project_path, key, first_key FROM f WHERE key <> first_key"
_add("memory_duplicates", _over(stores.duplicates, "memory"), "memory", sql=_FOLDED)
_add("memory_contradictions", _over(stores.contradictions, "memory"), "memory", sql=_FOLDED + " AND val <> first_val")
_add("memory_stale", lambda s, d: stores.stale(view(s, d, "memory"), F.expr(_MEMORY_NOW)), "memory", sql=f"SELECT project_path, key, last_accessed_at FROM memory WHERE last_accessed_at < {_MEMORY_NOW} - INTERVAL 30 DAY")
_NEW = "SELECT key, project_path, 'new ' || val AS val FROM thoughts UNION ALL SELECT key, project_path, 'new' AS val FROM memory WHERE key LIKE 'user1%'"


def _new(spark: SparkSession, d: str) -> DataFrame:
    known = view(spark, d, "memory").where("key like 'user1%'").select("key", "project_path", F.lit("new").alias("val"))
    return view(spark, d, "thoughts").select("key", "project_path", F.concat(F.lit("new "), "val").alias("val")).union(known)


_add("memory_upsert", lambda s, d: stores.upsert(view(s, d, "memory"), _new(s, d), F.expr(_MEMORY_NOW)), "memory", "thoughts", sql=f""", put AS ({_NEW})
    SELECT coalesce(m.key, n.key) AS key, coalesce(m.project_path, n.project_path) AS project_path, CASE WHEN n.key IS NULL THEN m.val ELSE n.val END AS val, coalesce(created_at, {_MEMORY_NOW}) AS created_at,
    CASE WHEN n.key IS NULL THEN last_accessed_at ELSE {_MEMORY_NOW} END AS last_accessed_at FROM memory m FULL JOIN put n ON m.key = n.key AND m.project_path = n.project_path""")
_add("memory_overwrite", lambda s, d: stores.overwrite(view(s, d, "memory"), _new(s, d), F.expr(_MEMORY_NOW)), "memory", "thoughts", sql=f""", put AS ({_NEW})
    SELECT key, project_path, val, created_at, last_accessed_at FROM memory m WHERE NOT EXISTS (SELECT 1 FROM put n WHERE m.key = n.key AND m.project_path = n.project_path)
    UNION ALL SELECT key, project_path, val, {_MEMORY_NOW}, {_MEMORY_NOW} FROM put""")
_add("thoughts", _over(stores.thoughts, "thoughts"), "thoughts", sql="SELECT project_path, key, val, substr(key, 9)::BIGINT AS epoch_s FROM thoughts")
_add("thoughts_kept", lambda s, d: stores.thoughts(view(s, d, "thoughts"), 1_703_000_000), "thoughts", sql="SELECT project_path, key, val, substr(key, 9)::BIGINT AS epoch_s FROM thoughts WHERE substr(key, 9)::BIGINT >= 1703000000 - 30 * 86400")
_add("session_state", _over(stores.session_json, "session"), "session", sql="""SELECT project_path, '{' || string_agg('"' || key || '":' || val, ',' ORDER BY key) || '}' AS state FROM session GROUP BY project_path""")
_add("artifact_list", lambda s, d: stores.artifacts(view(s, d, "artifacts"), F.expr(_NOW)), "artifacts", sql=f"SELECT id, type, created_at FROM artifacts WHERE created_at >= {_NOW} - INTERVAL 30 DAY")

# Code graph.
_EDGES = """, s AS (SELECT id, name, file_path, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM symbols),
  cand AS (SELECT d.caller_id, d.callee_name, t.id AS callee_id, (t.file_path = c.file_path)::INT AS f, (t.dir = c.dir)::INT AS g
           FROM (SELECT DISTINCT caller_id, callee_name FROM dependencies) d JOIN s c ON c.id = d.caller_id JOIN s t ON t.name = d.callee_name AND t.id <> d.caller_id),
  tiers AS (SELECT *, count(*) OVER w AS n, max(f) OVER w AS mf, max(g) OVER w AS mg FROM cand WINDOW w AS (PARTITION BY caller_id, callee_name)),
  edges AS (SELECT DISTINCT caller_id, callee_id FROM tiers WHERE n <= 1 OR (mf = 1 AND f = 1) OR (mf = 0 AND mg = 1 AND g = 1) OR (mf = 0 AND mg = 0 AND n <= 3))
"""
_TOUCHED = ", changed AS (SELECT * FROM symbols s WHERE EXISTS (SELECT 1 FROM hunks h WHERE h.file_path = s.file_path AND s.line_start <= h.last_line AND s.line_end >= h.first_line))"
_RISK = "CASE WHEN {0} > 10 THEN 'HIGH' WHEN {0} > 3 THEN 'MEDIUM' ELSE 'LOW' END"


def _up(starts: str, upstream: bool = True) -> str:
    a, b = ("callee_id", "caller_id") if upstream else ("caller_id", "callee_id")
    return f", up(source, node) AS (SELECT id, id FROM ({starts}) UNION SELECT up.source, e.{b} FROM up JOIN edges e ON e.{a} = up.node)"


def _graph(f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        symbols, deps = view(spark, d, "symbols"), view(spark, d, "dependencies")
        return f(symbols, deps, graph.resolved_edges(symbols, deps))

    return run


_add("find_symbols", lambda s, d: graph.find_symbols(view(s, d, "symbols"), "F1"), "symbols", sql="SELECT * FROM symbols WHERE name ILIKE '%F1%'")
_add("references", lambda s, d: graph.references(view(s, d, "symbols"), view(s, d, "dependencies"), "f7"), "dependencies", sql="SELECT s.* FROM dependencies d JOIN symbols s ON d.caller_id = s.id WHERE d.callee_name = 'f7'")
_add("file_dependencies", lambda s, d: graph.file_dependencies(view(s, d, "symbols"), view(s, d, "dependencies"), "d3/m3.rs").withColumn("callees", F.array_join("callees", ",")), "dependencies", sql="SELECT s.id, s.name, coalesce(string_agg(DISTINCT callee_name, ',' ORDER BY callee_name), '') AS callees FROM symbols s LEFT JOIN dependencies d ON d.caller_id = s.id WHERE file_path = 'd3/m3.rs' GROUP BY s.id, s.name")
_add("resolved_edges", _graph(lambda s, p, e: e), "dependencies", sql=_EDGES + "SELECT * FROM edges")
_add("impact", _graph(lambda s, p, e: graph.impact(s, e, "f7")), "dependencies", sql=_EDGES + _up("SELECT id FROM symbols WHERE name = 'f7'") + f", hit AS (SELECT DISTINCT node FROM up WHERE source <> node) SELECT id, name, file_path, {_RISK.format('(SELECT count(*) FROM hit)')} AS risk FROM symbols WHERE id IN (SELECT node FROM hit)")
_add("downstream", _graph(lambda s, p, e: graph.closure(e, s.where("name = 'f7'"), upstream=False)), "dependencies", sql=_EDGES + _up("SELECT id FROM symbols WHERE name = 'f7'", False) + "SELECT source, node FROM up WHERE source <> node")
_add("detect_changes", lambda s, d: _graph(lambda x, p, e: graph.detect_changes(x, e, view(s, d, "hunks")))(s, d), "dependencies", "hunks", sql=_EDGES + _TOUCHED + _up("SELECT id FROM changed") + f", n AS (SELECT c.id, c.name, count(up.node) AS impact FROM changed c LEFT JOIN up ON up.source = c.id AND up.node <> c.id GROUP BY c.id, c.name) SELECT id, name, impact, {_RISK.format('impact')} AS risk FROM n")
# A graph query's edges come from names; the traces and plans below come from the code of `files`.
_add("graph_coverage", lambda s, d: graph.coverage(view(s, d, "symbols"), view(s, d, "dependencies")), "dependencies", sql=", linked AS (SELECT caller_id FROM dependencies UNION SELECT id FROM symbols WHERE name IN (SELECT callee_name FROM dependencies)) SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM linked) AS linked, round((SELECT count(*) FROM linked)::DOUBLE / (SELECT count(*) FROM symbols) * 100, 6) AS pct")
_add("parse_hunks", lambda s, d: graph.parse_hunks(view(s, d, "diffs"), "run_id", "text"))
_add("code_search", lambda s, d: graph.code_search(view(s, d, "files"), "X ="))
_add("index_delta", lambda s, d: graph.index_delta(*(view(s, d, "files").where(c).select(F.col("path").alias("file_path"), F.md5(F.concat(x, "content")).alias("hash")) for c, x in (("path not like 'd1/%'", F.lit("")), ("path not like 'd2/%'", F.when(F.col("path").like("d3/%"), "x").otherwise("")))))
     , "files", sql=", a AS (SELECT path AS file_path, md5(content) AS was FROM files WHERE path NOT LIKE 'd1/%'), b AS (SELECT path AS file_path, md5(CASE WHEN path LIKE 'd3/%' THEN 'x' ELSE '' END || content) AS now FROM files WHERE path NOT LIKE 'd2/%') SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'gone' WHEN was <> now THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.file_path = b.file_path")

_add("index_status", lambda s, d: reports.index_status(view(s, d, "symbols"), view(s, d, "dependencies"), view(s, d, "symbols").select(F.lit(1_700_000_000).cast("long").alias("last_indexed")), 1_700_100_000), "dependencies", sql=", linked AS (SELECT caller_id FROM dependencies UNION SELECT id FROM symbols WHERE name IN (SELECT callee_name FROM dependencies)) SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM dependencies) AS edges, 1700000000::BIGINT AS last_indexed, round((SELECT count(*) FROM linked)::DOUBLE / (SELECT count(*) FROM symbols) * 100, 6) AS pct, true AS stale")
_add("vault_notes", lambda s, d: reports.vault_notes(view(s, d, "symbols"), view(s, d, "dependencies")), "dependencies", sql=r""", n AS (SELECT *, name || ' (' || string_split(file_path, '/')[-1] || ')' AS title FROM symbols),
  c AS (SELECT DISTINCT caller_id, callee_name FROM dependencies),
  o AS (SELECT caller_id, string_agg('- [[' || t || ']]' || chr(10), '' ORDER BY callee_name, t) AS x FROM (SELECT DISTINCT c.caller_id, c.callee_name, coalesce(n.title, c.callee_name) AS t FROM c LEFT JOIN n ON n.name = c.callee_name) GROUP BY 1),
  i AS (SELECT callee_name, string_agg('- [[' || n.title || ']]' || chr(10), '' ORDER BY n.id) AS x FROM c JOIN n ON n.id = c.caller_id GROUP BY 1)
  SELECT title, max_by('# Symbol: ' || name || chr(10) || chr(10) || '- **Kind:** ' || kind || chr(10) || '- **Location:** `' || file_path || ':' || line_start || '-' || line_end || '`' || chr(10) || chr(10) || '## Calls (Outgoing)' || chr(10) || coalesce(o.x, '- None' || chr(10)) || chr(10) || '## Referenced By (Incoming)' || chr(10) || coalesce(i.x, '- None' || chr(10)), id) AS body
  FROM n LEFT JOIN o ON o.caller_id = n.id LEFT JOIN i ON i.callee_name = n.name GROUP BY title""")
# What the parts' code holds, by language: (kind, letter, first line, last line), and (owner's kind and letter, callee).
_SYMBOLS = {
    "rs": [("Struct", "S", 3, 3), ("Function", "f", 5, 7)], "py": [("Class", "S", 2, 6), ("Function", "f", 5, 6)], "go": [("Struct", "S", 1, 1), ("Method", "f", 3, 7)],
    "ts": [("Class", "S", 1, 6), ("Method", "f", 3, 5), ("Function", "u", 7, 7)],
}
_CALLS = {
    "rs": [("Function", "f", "'g' || o"), ("Function", "f", "'F' || o"), ("Function", "f", "'m'")],
    "py": [("Function", "f", "'g' || o"), ("Function", "f", "'h' || o"), ("Function", "f", "'i' || o"), ("Function", "f", "CASE WHEN NOT is_last THEN 'wrap' END")],
    "go": [("Method", "f", "'fmt'"), ("Method", "f", "'f' || o"), ("Method", "f", "'g' || o"), ("Method", "f", "'s'")],
    "ts": [("Method", "f", "'console'"), ("Method", "f", "'g' || o"), ("Method", "f", "'f' || o"), ("Function", "u", "'i' || o"), ("Function", "u", "'f' || o")],
}
_KNOWN = f""", parts AS (SELECT k, o, ext, 'd' || file // 5 || '/c' || file || '.' || ext AS path, (row_number() OVER (PARTITION BY file ORDER BY k) - 1) * 8 AS above, lead(k) OVER (PARTITION BY file ORDER BY k) IS NULL AS is_last
    FROM (SELECT *, {list(CODE)}[(file % 4 + 1)::INTEGER] AS ext FROM ({CODE_PARTS}))),
  found AS ({" UNION ALL ".join(f"SELECT path, '{kind}:' || path || ':{x}' || k AS id, '{x}' || k AS name, '{kind}' AS kind, (above + {a})::INTEGER AS line_start, (above + {b})::INTEGER AS line_end FROM parts WHERE ext = '{ext}'" for ext, rows in _SYMBOLS.items() for kind, x, a, b in rows)}),
  called AS ({" UNION ".join(f"SELECT '{kind}:' || path || ':{x}' || k AS caller_id, {callee} AS callee_name FROM parts WHERE ext = '{ext}' AND {callee} <> '{x}' || k" for ext, rows in _CALLS.items() for kind, x, callee in rows)})
"""


def _code(spark: SparkSession, d: str) -> DataFrame:
    """The code view in as many parts as there are cores: its few megabytes would else be one task's."""
    return view(spark, d, "code").repartition(spark.sparkContext.defaultParallelism, "path")


_add("extracted_symbols", lambda s, d: graph.extracted_symbols(_code(s, d)), "code", sql=_KNOWN + "SELECT id, name, kind, path AS file_path, line_start, line_end FROM found")
_add("extracted_calls", lambda s, d: graph.extracted_calls(_code(s, d)), "code", sql=_KNOWN + "SELECT caller_id, callee_name FROM called")


def _from_code(f: Callable[[SparkSession, str, DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        parsed = stored(graph.outlined(_code(spark, d)), "outlined")  # each plan needs it several times
        symbols, calls = graph.symbols_of(parsed), graph.calls_of(parsed).select("caller_id", "callee_name")
        return f(spark, d, stored(symbols, "symbols"), stored(calls, "calls"))

    return run


def _renamed(column: str) -> str:
    return f"CASE WHEN {column} = 85 THEN 'g85' ELSE 'f' || CAST({column} AS STRING) END"


_add("rename_plan", _from_code(lambda s, d, x, y: graph.rename_plan(x, y, _code(s, d), "f85", "g85").drop("places")), "code", sql=_KNOWN + f""", renamed AS ({code_files(_renamed("k"), _renamed("o")).replace("JOINED(line, k)", "string_agg(line, chr(10) ORDER BY k)")}),
  wanted AS (SELECT path FROM found WHERE name = 'f85' UNION SELECT path FROM found JOIN called ON caller_id = id WHERE callee_name = 'f85'),
  counted AS (SELECT path, sum((k = 85)::INT + (o = 85)::INT * CASE ext WHEN 'py' THEN 1 ELSE 2 END)::BIGINT AS sites FROM parts GROUP BY path)
  SELECT path AS file_path, sites, content FROM renamed JOIN counted USING (path) WHERE path IN (FROM wanted)""")
_add("identifier_sites", lambda s, d: graph.identifier_sites(_code(s, d), "f85").drop("byte_start", "byte_end"), "code", sql=_KNOWN + """, sites AS (
    SELECT path, unnest(list_concat(CASE WHEN k = 85 THEN [CASE WHEN ext IN ('rs', 'py') THEN 5 ELSE 3 END] ELSE [] END,
      CASE WHEN o = 85 THEN CASE ext WHEN 'rs' THEN [6, 6] WHEN 'py' THEN [1] WHEN 'go' THEN [1, 5] ELSE [4, 8] END ELSE [] END)) + above AS line FROM parts)
  SELECT path AS file_path, line::INTEGER AS line FROM sites""")
_add("flow_trace", _graph(lambda s, p, e: graph.flow_trace(s, e, ["f7", "f16", "f29"], 4, 50)))


def _replaced(spark: SparkSession, d: str, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    files = view(spark, d, "code").select(F.col("path").alias("file_path"), F.when(F.col("path").like("d1/%"), "gone").when(F.col("path").like("d0/%"), "changed").otherwise("same").alias("state"))
    moved, more = symbols.withColumn("line_end", F.col("line_end") + 1), calls.withColumn("callee_name", F.concat("callee_name", F.lit("_2")))
    new, linked = graph.replaced_index(symbols, calls, files, moved, more)
    none, zero = F.lit("").alias, F.lit(0).alias
    calls = linked.select(F.col("caller_id").alias("id"), none("name"), none("kind"), none("file_path"), zero("line_start"), zero("line_end"), "callee_name")
    return new.withColumn("callee_name", F.lit("")).unionByName(calls)


_add("index_replaced", _from_code(_replaced), "code", sql=_KNOWN + """SELECT id, name, kind, path AS file_path, line_start, (line_end + (path LIKE 'd0/%')::INT)::INTEGER AS line_end, '' AS callee_name FROM found WHERE path NOT LIKE 'd1/%'
  UNION ALL SELECT caller_id, '', '', '', 0, 0, callee_name || CASE WHEN caller_id LIKE '%:d0/%' THEN '_2' ELSE '' END FROM called WHERE caller_id NOT LIKE '%:d1/%'""")


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """An index of other files first, then brought to the state of these."""
    files = _code(spark, d)
    index = CodeIndex(spark, new_path(spark, "code-index"))
    other = files.where("path not like 'd0/%'").withColumn("content", F.when(F.col("path").like("d1/%"), F.concat(F.lit("x = f(1)\n"), "content")).otherwise(F.col("content")))
    index.refresh(other.unionByName(files.limit(1).select(F.lit("gone.rs").alias("path"), F.lit("rs").alias("ext"), F.lit("fn x() { y(); }").alias("content"))), 1)
    index.refresh(files, 2)
    symbols = index.symbols.select(F.lit("symbol").alias("kind"), "file_path", F.col("id").alias("a"), F.concat_ws("-", "line_start", "line_end").alias("b"))
    calls = index.calls.select(F.lit("call").alias("kind"), "file_path", F.col("caller_id").alias("a"), F.col("callee_name").alias("b"))
    return symbols.unionByName(calls).unionByName(index.hashes.select(F.lit("hash").alias("kind"), "file_path", F.col("hash").alias("a"), F.col("last_indexed").cast("string").alias("b")))


_add("code_index", _indexed, "code", sql=_KNOWN + """SELECT 'symbol' AS kind, path AS file_path, id AS a, line_start || '-' || line_end AS b FROM found
  UNION ALL SELECT 'call', split_part(caller_id, ':', 2), caller_id, callee_name FROM called UNION ALL SELECT 'hash', path, md5(content), CASE WHEN path LIKE 'd0/%' OR path LIKE 'd1/%' THEN '2' ELSE '1' END FROM code""")
_VECTOR = [(i * 37 % 21 - 10) / 100 for i in range(64)]
_add("hybrid_search", lambda s, d: graph.hybrid_search(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding"), view(s, d, "symbols").select(F.substring_index("name", "f", -1).try_cast("long").alias("id"), "name").groupBy("id").agg(F.max("name").alias("name")), "f1", _VECTOR), "symbols", sql=f", n AS (SELECT substr(name, 2)::BIGINT AS id, max(name) AS name FROM symbols GROUP BY 1), v AS (SELECT vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: coalesce(embedding[i]::DOUBLE * {_VECTOR}[i], 0.0))) AS dot FROM embeddings) SELECT id, name, round(0.5 * contains(name, 'f1')::INT + 0.5 * coalesce(dot, 0.0), 4) AS score FROM n JOIN v USING (id) ORDER BY score DESC, id LIMIT 10")

# Stores, search and reports.
_SEARCHED = """, w AS (SELECT key, val, project_path, regexp_extract_all(lower(key || ' ' || coalesce(val, '')), '[\\p{L}\\p{N}]+') AS t FROM memory),
  h AS (SELECT *, len(t) AS n, [len(list_filter(t, lambda x: starts_with(x, 'tion'))), len(list_filter(t, lambda x: starts_with(x, 'whon'))), len(list_filter(t, lambda x: starts_with(x, 'er')))] AS f FROM w),
  c AS (SELECT count(*) AS rows, avg(n) AS mean, [count(*) FILTER (f[1] > 0), count(*) FILTER (f[2] > 0), count(*) FILTER (f[3] > 0)] AS df FROM h)
  SELECT key, val, round(list_sum(list_transform([1, 2, 3], lambda i: greatest(ln((rows - df[i] + 0.5) / (df[i] + 0.5)), 1e-6) * f[i] * 2.2 / (f[i] + 1.2 * (0.25 + 0.75 * n / mean)))), 6) AS score FROM h, c WHERE project_path = 'p1' AND (f[1] > 0 OR f[2] > 0 OR f[3] > 0) ORDER BY score DESC, key LIMIT 5"""
_add("memory_search", lambda s, d: search.ranked(view(s, d, "memory"), "tion whon er", "p1"), "memory", sql=_SEARCHED)


def _index_searched(spark: SparkSession, d: str) -> DataFrame:
    notes = view(spark, d, "memory").select("key", "project_path", "val")
    index = search_index.Index(spark, new_path(spark, "search-index")).build(notes.withColumn("val", F.when(F.col("key").like("user%"), F.lit("other words")).otherwise(F.col("val"))))
    return index.upsert(notes.where("key like 'user%'")).search("tion whon er", "p1")


_add("memory_index_search", _index_searched, "memory", sql=_SEARCHED.replace("lower(key || ' ' || coalesce(val, ''))", "strip_accents(lower(key || ' ' || coalesce(val, '')))"))
_add("memory_get", lambda s, d: stores.get(view(s, d, "memory"), "user1_0", "p1"), "memory", sql="SELECT key, val FROM memory WHERE key = 'user1_0' AND project_path = 'p1'")
_add("memory_list", lambda s, d: stores.listed(view(s, d, "memory"), "p2"), "memory", sql="SELECT key, val FROM memory WHERE project_path = 'p2'")
_add("memory_touched", lambda s, d: stores.touched(view(s, d, "memory"), view(s, d, "memory").where("key like 'user%'"), F.expr(_MEMORY_NOW)), "memory", sql=f"SELECT * REPLACE (CASE WHEN key LIKE 'user%' THEN {_MEMORY_NOW} ELSE last_accessed_at END AS last_accessed_at) FROM memory")
_add("think", lambda s, d: stores.thought(view(s, d, "memory"), view(s, d, "thoughts").select("project_path", F.concat(F.lit("  "), "val").alias("said"), F.substring("key", 9, 20).cast("long").alias("epoch_s")), F.expr(_MEMORY_NOW)), "memory", "thoughts", sql=f"SELECT key, project_path, val, created_at, last_accessed_at FROM memory UNION ALL SELECT key, project_path, max(trim(val, ' ' || chr(10) || chr(9) || chr(13))), {_MEMORY_NOW}, {_MEMORY_NOW} FROM thoughts GROUP BY key, project_path HAVING max(trim(val, ' ' || chr(10) || chr(9) || chr(13))) <> ''")
_add("session_init", lambda s, d: stores.session_init(view(s, d, "session"), view(s, d, "memory")), "session", "memory", sql="SELECT project_path, key, val FROM session UNION ALL SELECT p.project_path, k.key, '[]' FROM (SELECT DISTINCT project_path FROM memory) p, (SELECT unnest(['decisions', 'active_tasks', 'context_files', 'warnings']) AS key) k WHERE NOT EXISTS (SELECT 1 FROM session s WHERE s.project_path = p.project_path AND s.key = k.key)")
_SAID = "CASE WHEN key = 'notes' THEN 'said \"' || project_path || '\"' ELSE '[1, \"x\"]' END"
_add("session_update", lambda s, d: stores.session_update(view(s, d, "session"), view(s, d, "session").where("key in ('notes', 'tasks')").selectExpr("project_path", "key", """CASE WHEN key = 'notes' THEN 'said "' || project_path || '"' ELSE '[1, "x"]' END AS val""")), "session", sql="""SELECT project_path, key, CASE key WHEN 'notes' THEN '"said \\"' || project_path || '\\""' WHEN 'tasks' THEN '[1, "x"]' ELSE val END AS val FROM session""")
_add("session_export", lambda s, d: stores.session_export(view(s, d, "session").withColumn("key", F.when(F.col("key") == "tasks", "active_tasks").when(F.col("key") == "notes", "warnings").otherwise(F.col("key")))), "session", sql="""SELECT project_path, '# Session state' || chr(10) || chr(10) || 'Project: `' || project_path || '`' || chr(10) || chr(10)
  || '## Active tasks' || chr(10) || coalesce(max(CASE key WHEN 'tasks' THEN t1 END), '- None' || chr(10)) || chr(10) || '## Decisions' || chr(10) || coalesce(max(CASE key WHEN 'decisions' THEN t2 END), '- None' || chr(10)) || chr(10)
  || '## Context files' || chr(10) || '- None' || chr(10) || chr(10) || '## Warnings' || chr(10) || coalesce(max(CASE key WHEN 'notes' THEN t2 END), '- None' || chr(10)) || chr(10) AS note
  FROM (SELECT *, list_reduce(list_transform(json_extract_string(val, '$[*]'), lambda x: '- [ ] ' || x || chr(10)), lambda a, b: a || b) AS t1, list_reduce(list_transform(json_extract_string(val, '$[*]'), lambda x: '- ' || x || chr(10)), lambda a, b: a || b) AS t2 FROM session) GROUP BY project_path""")
_add("artifact_put", lambda s, d: stores.put_artifacts(view(s, d, "artifacts"), view(s, d, "artifacts").where("id like 'a1%'").select("id", F.lit("note").alias("type"), F.lit("new").alias("content")), F.expr(_NOW)), "artifacts", sql=f"SELECT id, CASE WHEN id LIKE 'a1%' THEN 'note' ELSE type END AS type, CASE WHEN id LIKE 'a1%' THEN 'new' ELSE content END AS content, CASE WHEN id LIKE 'a1%' THEN {_NOW} ELSE created_at END AS created_at FROM artifacts")
_add("artifact_get", lambda s, d: stores.artifact(view(s, d, "artifacts"), "a7"), "artifacts", sql="SELECT id, type, content, created_at FROM artifacts WHERE id = 'a7'")
_add("audit_report", lambda s, d: reports.audit(view(s, d, "ledger"), pricing.price_table(s), F.expr(_NOW)), "ledger", "prices", sql=_priced("") + f""", t AS (SELECT *, {_pct('saved', 'original')} AS pct, (SELECT sum((original_tokens - filtered_tokens) * input_price) / 1e6 FROM priced) AS cost FROM {_TOTALS})
  SELECT 1 AS part, i::INTEGER AS place, l AS line FROM (SELECT unnest(x) AS l, unnest(range(len(x))) AS i FROM (SELECT ['# Token audit', 'Made at ' || strftime({_NOW}, '%Y-%m-%d %H:%M:%S'), '| Metric | Value |', '| :--- | :--- |', '| Commands | ' || commands || ' |', '| Original tokens | ' || original || ' |', '| Filtered tokens | ' || filtered || ' |', '| Saved tokens | ' || saved || ' (' || printf('%.1f', pct) || '%) |', '| Saved cost | $' || printf('%.4f', cost) || ' |', '| Saved hours | ' || printf('%.2f', round(commands * {ledger.SECONDS_A_COMMAND} / 3600, 6)) || ' |'] AS x FROM t))
  UNION ALL SELECT 2, ord, '| ' || display_name || ' | $' || printf('%.2f', input_price) || ' | $' || printf('%.4f', saved * input_price / 1e6) || ' |' FROM t, prices
  UNION ALL SELECT 3, -n::INTEGER, '| `' || cmd || '` | ' || n || ' | ' || original || ' | ' || filtered || ' | ' || saved || ' | ' || printf('%.1f', {_pct('saved', 'original')}) || '% |' FROM (SELECT cmd, {_SUMS} FROM ledger GROUP BY cmd)""")
_add("benchmark_csv", lambda s, d: reports.csv_lines(view(s, d, "ledger"), pricing.price_table(s)), "ledger", "prices", sql=_priced("unknown") + """SELECT id, concat_ws(',', id, strftime(ts, '%Y-%m-%d %H:%M:%S'), '"' || replace(cmd, '"', '""') || '"', m, original_tokens, filtered_tokens, original_tokens - filtered_tokens, printf('%.2f', CASE WHEN original_tokens > 0 THEN (original_tokens - filtered_tokens)::DOUBLE / original_tokens * 100 ELSE 0 END), printf('%.6f', (original_tokens - filtered_tokens) * input_price / 1e6), coalesce(duration_ms, 0)) AS line FROM priced ORDER BY id DESC LIMIT 50000""")
_add("diff_estimate", lambda s, d: reports.diff_estimate(view(s, d, "diffs"), "run_id", "text"))
_add("price_overrides", lambda s, d: pricing.resolve(view(s, d, "ledger"), pricing.price_table(s, [[{"model_id": "Local-LLM", "input_price_per_mtok": 0.5}], [{"model_id": "gpt-5", "output_price_per_mtok": 7.0}]])), "ledger", "prices", sql=_priced("") + ", own(m, price_id, i, o) AS (VALUES ('local-llm', 'Local-LLM', 0.5::DOUBLE, 15.0::DOUBLE), ('gpt-5', 'gpt-5', 5.0::DOUBLE, 7.0::DOUBLE)) SELECT best.m AS model, coalesce(own.price_id, best.price_id) AS price_id, coalesce(i, input_price) AS input_price, coalesce(o, output_price) AS output_price FROM best LEFT JOIN own ON own.m = best.m WHERE best.m <> ''")
_add("ledger_append", lambda s, d: ledger.append(view(s, d, "ledger"), view(s, d, "commands").select("cmd", F.col("cmd").alias("raw_output"), F.upper("cmd").alias("filtered"), F.expr(_NOW).alias("ts"), F.col("id").alias("source_row"))).select("id", "cmd", "original_tokens", "filtered_tokens", "ts", F.coalesce("model", F.lit("none")).alias("model")), "ledger", "commands", sql=f"SELECT id, cmd, original_tokens, filtered_tokens, ts, coalesce(model, 'none') AS model FROM ledger UNION ALL SELECT (SELECT max(id) FROM ledger) + row_number() OVER (ORDER BY c.id), cmd, ((strlen(cmd) + 3) // 4)::BIGINT, ((strlen(cmd) + 3) // 4)::BIGINT, {_NOW}, 'Unknown Model' FROM commands c")


def _ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    # A stream reads a folder: the table may be one file in it or a folder of files.
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    return view(spark, d, "ledger", events=events).select("id", "project", F.col("ts").cast("timestamp").alias("ts"), "original_tokens", "filtered_tokens")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    return ledger_stream.run_available(ledger_stream.daily(ledger_stream.once_each(_ledger_stream(spark, d))), spark, "daily")


def _stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = sessions.run_appended(sessions.sessions(_ledger_stream(spark, d)), spark, new_path(spark, "sessions"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("started", "ended")})


def _stream_due(spark: SparkSession, d: str) -> DataFrame:
    out = sessions.run_appended(sessions.due_times(_ledger_stream(spark, d)), spark, new_path(spark, "due"))
    return out.withColumn("due", F.date_format("due", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_add("ledger_stream_daily", _streamed, "ledger", sql="SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(original_tokens)::BIGINT AS original, sum(filtered_tokens)::BIGINT AS filtered FROM ledger GROUP BY 1")
_SESSIONS_SQL = """, starts AS (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY project ORDER BY ts) > INTERVAL 30 MINUTE, true)::INT AS new FROM ledger
), numbered AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY ts) AS nth FROM starts)
SELECT project, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended, count(*) AS n,
       sum(original_tokens)::BIGINT AS original, sum(filtered_tokens)::BIGINT AS filtered
FROM numbered GROUP BY project, nth HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM ledger) - INTERVAL 2 HOUR"""
_add("ledger_stream_sessions", _stream_sessions, "ledger", sql=_SESSIONS_SQL)
_add("ledger_stream_due", _stream_due, "ledger", sql=""", due AS (
  SELECT project, min(ts) AS ts FROM ledger GROUP BY project
  UNION ALL SELECT d.project, min(l.ts) FROM due d JOIN ledger l ON l.project = d.project AND l.ts >= d.ts + INTERVAL 1 DAY GROUP BY d.project
) SELECT project, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS due FROM due""")

# Profiles and packing.
_RULES = (("plain line [0-9]+", "collapse"), ("token internal-[0-9]+ ", "strip"), ("(", "strip"))
for _name in profiles.PROFILES:
    _add(f"profile_{_name.replace('-', '_')}", lambda s, d, n=_name: view(s, d, "log_mixed").select("run_id", profiles.apply_profile(F.col("log"), profiles.PROFILES[n]).alias("log")), "log_mixed", sql=log_sql.profile(profiles.PROFILES[_name]))
_add("rules_applied", lambda s, d: view(s, d, "log_mixed").select("run_id", profiles.apply_rules(F.col("log"), _RULES).alias("log")), "log_mixed", sql="SELECT run_id, regexp_replace(regexp_replace(log, 'plain line [0-9]+', '[collapsed]', 'g'), 'token internal-[0-9]+ ', '', 'g') AS log FROM log_mixed")
_add("profile_names", lambda s, d: view(s, d, "commands").select("id", profiles.profile_name(F.col("cmd"), {"git": "audit", "git diff": "balanced", "cargo": "developer", "npm": "nothing"}).alias("profile")), "commands", sql="SELECT id, CASE WHEN contains(cmd, 'git diff') THEN 'balanced' WHEN contains(cmd, 'cargo') THEN 'developer' WHEN contains(cmd, 'git') THEN 'audit' ELSE 'strict' END AS profile FROM commands")
# Commands by turns; two parts of the same length meet in the fifth, where the first by name counts.
_COMMANDS_OF = {"git diff": "balanced", "cargo b": "developer", "npm audit": "audit", "pytest -q": "json-only", "ab cd": "balanced", "ls": "strict"}
_OVERRIDES = {"git": "audit", "git diff": "balanced", "cargo": "developer", "npm": "audit", "pytest": "json-only", "ab": "balanced", "cd": "developer"}


def _post_processed(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("run_id") % len(_COMMANDS_OF) + 1
    cmd = F.element_at(F.array(*[F.lit(c) for c in _COMMANDS_OF]), turn.cast("int"))
    rows = view(spark, d, "log_mixed").select("run_id", cmd.alias("cmd"), F.col("log").alias("raw"), F.col("log").alias("filtered"))
    return profiles.post_processed(rows, rules=_RULES, overrides=_OVERRIDES).select("run_id", "shown", "original_tokens", "filtered_tokens", "cached", "saturated")


_add("post_processed", _post_processed, "log_mixed", sql=log_sql.post_processed([profiles.PROFILES[p] for p in _COMMANDS_OF.values()]))
_add("filter_plugin", lambda s, d: view(s, d, "log_cargo_build").select("run_id", line_filters.plugin(F.col("log"), ("Compiling", "Finished"), ("warning", "-->")).alias("filtered")), "log_cargo_build", sql=log_sql.FILTERS["plugin"])
_add("rule_file", lambda s, d: view(s, d, "files").select("path", line_filters.rule_file(F.concat("content", F.lit("\n<!-- a\nb -->x  \n\n\n\ny"))).alias("content")), "files", sql=log_sql.RULE_FILE)
_add("model_suggestions", lambda s, d: view(s, d, "commands").select("id", pricing.suggested_model(F.element_at(F.array(*[F.lit(x) for x in ("Simple", "audit", "review", "other")]), (F.col("id") % 4 + 1).cast("int"))).alias("model_id")), "commands", sql="SELECT id, CASE id % 4 WHEN 0 THEN 'gemini-3.5-flash' WHEN 3 THEN 'claude-4.6-sonnet' ELSE 'gemini-3.1-pro-preview' END AS model_id FROM commands")
_IGNORED_SQL = " OR ".join(f"list_contains(string_split(path, '/'), '{p}') OR starts_with(path, '{p}') OR contains(path, '/{p}')" for p in packing.IGNORED)
_add("pack_ignored", lambda s, d: view(s, d, "files").select("path", packing.is_ignored(F.col("path")).alias("ignored"), packing.is_binary(F.col("content")).alias("is_binary"), packing.is_code(F.col("path")).alias("code")), "files", sql=f"SELECT path, {_IGNORED_SQL} AS ignored, false AS is_binary, true AS code FROM files")
_add("pack_stripped", lambda s, d: packing.strip_content(view(s, d, "files")), "files", sql=log_sql.STRIPPED)
_add("pack_skeleton", lambda s, d: _code(s, d).select("path", packing.skeleton(F.col("content"), F.col("ext")).alias("content")), "code", sql=f"SELECT path, content FROM ({code_files(collapsed=True).replace('JOINED(line, k)', 'string_agg(line, chr(10) ORDER BY k)')})")
_add("pack_documents", lambda s, d: packing.documents(packing.packed(view(s, d, "files")), F.substring_index("path", "/", 1)), "files", sql=f"""SELECT project, document, ((strlen(document) + 3) // 4)::BIGINT AS n_tokens FROM (SELECT string_split(path, '/')[1] AS project, '<repository>' || chr(10) || string_agg('  <file path="' || path || '">' || chr(10) || '    <![CDATA[' || chr(10) || content || CASE WHEN content LIKE '%' || chr(10) THEN '' ELSE chr(10) END || '    ]]>' || chr(10) || '  </file>' || chr(10), '' ORDER BY path) || '</repository>' || chr(10) AS document FROM files WHERE NOT ({_IGNORED_SQL}) GROUP BY 1)""")
_add("pack_collapsed", lambda s, d: packing.packed(view(s, d, "files"), strip_comments=True, bodies=False))

_add("telemetry_json", _over(ledger.telemetry_json, "ledger"), "ledger", sql="SELECT id, json_object('id', id, 'cmd', cmd, 'original_tokens', original_tokens, 'filtered_tokens', filtered_tokens, 'ts', strftime(ts, '%Y-%m-%d %H:%M:%S'), 'model', model, 'project', project, 'branch', branch, 'duration_ms', duration_ms)::VARCHAR AS line FROM ledger")
_add("gc_due", lambda s, d: stores.gc_due(view(s, d, "memory").select(F.lit("last_gc").alias("key"), F.unix_timestamp(F.col("created_at").cast("timestamp")).cast("string").alias("value")), 1_709_200_000), "memory", sql="SELECT 1709200000 - coalesce(max(epoch(created_at)::BIGINT), 0) >= 86400 AS due FROM memory")
_add("commands_filtered", lambda s, d: view(s, d, "commands").select("id", router.is_filtered(F.col("cmd")).alias("filtered")), "commands", sql="SELECT id, NOT (starts_with(cmd, 'git status') AND contains(cmd, '-s')) AS filtered FROM commands")
_add("rule_findings", lambda s, d: stores.rule_file_findings(view(s, d, "files").select("path", F.concat("content", F.lit("see file:///x/y and file:///"), "path").alias("content")), view(s, d, "files").select(F.concat(F.lit("/"), "path").alias("path")), 8), "files", sql="SELECT path, 'points to missing /x/y' AS finding FROM files UNION ALL SELECT path, 'has ' || n || ' lines' FROM (SELECT path, len(string_split(content || 'see', chr(10))) AS n FROM files) WHERE n > 8")



def _benchmark_json(spark: SparkSession, d: str) -> DataFrame:
    out = reports.benchmark_json(view(spark, d, "ledger"), pricing.price_table(spark), F.expr(_NOW), "abc")
    schema = "metadata struct<timestamp string, commit_sha string>, saved_tokens long, savings_pct double, cost_saved_usd double, duration_ms long, model string, timestamp string"
    x = out.select("part", "place", F.from_json("line", schema).alias("x"))
    facts = [F.coalesce("x.model", "x.metadata.commit_sha").alias("name"), F.coalesce("x.timestamp", "x.metadata.timestamp").alias("at")]
    sums = [F.coalesce(f"x.{c}", F.lit(0)).alias(c) for c in ("saved_tokens", "duration_ms")]
    return x.select("part", "place", *facts, *sums, *[rounded(F.coalesce(f"x.{c}", F.lit(0.0)), 6).alias(c) for c in ("savings_pct", "cost_saved_usd")])


_add("benchmark_json", _benchmark_json, "ledger", "prices", sql=_priced("unknown") + f"""(SELECT 2 AS part, -id AS place, m AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, original_tokens - filtered_tokens AS saved_tokens, coalesce(duration_ms, 0) AS duration_ms,
  {_pct('original_tokens - filtered_tokens', 'original_tokens')} AS savings_pct, round((original_tokens - filtered_tokens) * input_price / 1e6, 6) AS cost_saved_usd FROM priced ORDER BY id DESC LIMIT 50000)
  UNION ALL SELECT 1, 0, 'abc', '1707523200', 0, 0, 0.0, 0.0""")
_add("rule_files", lambda s, d: line_filters.compacted_rule_files(view(s, d, "files").select("path", F.when(F.col("path").endswith("py"), F.concat("content", F.lit("\n<!-- a\nb -->x  \n\n\n\ny"))).otherwise(F.lit("short")).alias("content"))), "files", sql=f"""SELECT path, CASE WHEN path LIKE '%py' THEN content ELSE 'short' END AS content, CASE WHEN path LIKE '%py' THEN old END AS backup,
  CASE WHEN path LIKE '%py' THEN strlen(old) - strlen(content) ELSE 0 END::BIGINT AS saved_bytes, CASE WHEN path LIKE '%py' THEN (strlen(old) - strlen(content)) // 4 ELSE 0 END::BIGINT AS saved_tokens
  FROM ({log_sql.RULE_FILE}) r JOIN (SELECT path, content || chr(10) || '<!-- a' || chr(10) || 'b -->x  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'y' AS old FROM files) USING (path)""")
_add("vault_index", lambda s, d: reports.vault_index(view(s, d, "symbols"), view(s, d, "dependencies"), view(s, d, "symbols").select("file_path", F.lit(1_707_400_000).cast("long").alias("last_indexed")), 1_707_523_200), "symbols", "dependencies", sql="""SELECT 'index' AS title, concat_ws(chr(10), '# Code graph' || chr(10), '- Symbols: ' || n, '- Edges: ' || e, '- Graph coverage: ' || printf('%.1f', 100.0 * linked / n) || '%', '- Notes exported: ' || notes, '- Index stale: yes', chr(10) || 'Each symbol''s note holds its links.' || chr(10)) AS body
  FROM (SELECT count(*) AS n, count(DISTINCT name || ' ' || string_split(file_path, '/')[-1]) AS notes FROM symbols), (SELECT count(*) AS e FROM dependencies),
       (SELECT count(*) AS linked FROM (SELECT id FROM symbols WHERE name IN (SELECT callee_name FROM dependencies) UNION SELECT caller_id FROM dependencies))""")
_add("think_logs", lambda s, d: ledger.append(view(s, d, "ledger"), stores.thought_logs(view(s, d, "thoughts").select("project_path", F.concat(F.lit(" "), "val", F.lit("\n")).alias("said")), F.expr(_NOW))).groupBy("cmd", "project").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("original_tokens").alias("original"), F.sum("filtered_tokens").alias("filtered")), "ledger", "thoughts", sql="""SELECT cmd, project, count(*) AS n, count(*) AS ids, sum(o)::BIGINT AS original, sum(f)::BIGINT AS filtered FROM
  (SELECT cmd, project, original_tokens AS o, filtered_tokens AS f FROM ledger UNION ALL SELECT 'think', project_path, (strlen(trim(val, ' ' || chr(10))) + 3) // 4, 4 FROM thoughts WHERE trim(val, ' ' || chr(10)) <> '') GROUP BY 1, 2""")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Of each top folder itself, then its first file."""
    top = F.substring_index("path", "/", 1)
    first = view(spark, d, "files").groupBy(top.alias("request")).agg(F.min("path").alias("path"))
    return first.select("request", F.inline(F.array(F.struct(F.lit(0).alias("place"), F.concat("request", F.lit("/")).alias("path")), F.struct(F.lit(1).alias("place"), F.col("path")))))


_add("pack_paths", lambda s, d: packing.documents(packing.packed_paths(view(s, d, "files"), _asked(s, d)), F.col("request"), order=("place", "path")), "files", sql=f""", below AS (
  SELECT string_split(path, '/')[1] AS project, path AS whole, path[strpos(path, '/') + 1:] AS path, content FROM files), parts AS (
  SELECT project, 0 AS place, path, '  <file path="' || path || '">' || chr(10) || '    <![CDATA[' || chr(10) || content || CASE WHEN content LIKE '%' || chr(10) THEN '' ELSE chr(10) END || '    ]]>' || chr(10) || '  </file>' || chr(10) AS entry FROM below WHERE NOT ({_IGNORED_SQL})
  UNION ALL SELECT project, 1, min(whole), '<file path="' || min(whole) || '">' || chr(10) || arg_min(content, whole) || chr(10) || '</file>' || chr(10) FROM below GROUP BY project
) SELECT project, document, ((strlen(document) + 3) // 4)::BIGINT AS n_tokens FROM (SELECT project, '<repository>' || chr(10) || string_agg(entry, '' ORDER BY place, path) || '</repository>' || chr(10) AS document FROM parts GROUP BY project)""")

# Redaction and routing.
_add("dlp_redact", lambda s, d: view(s, d, "secrets").select("doc_id", dlp.redact(F.col("text"), ("internal-[0-9]+",)).alias("text")))
_add("dlp_audit", lambda s, d: dlp.audit(view(s, d, "secrets"), "doc_id", "text", ("internal-[0-9]+",), F.expr(_NOW), F.lit("git show")))
_PATTERNS = {"pem": 0, "uri": 1, "jwt": 2}
for _name, _at in _PATTERNS.items():
    _label, _pattern, _mark = dlp.STAGES[_at]
    _add(f"dlp_{_name}", lambda s, d, p=_pattern, m=_mark: view(s, d, "secrets").select("doc_id", F.regexp_replace("text", p, m).alias("text")), "secrets",
         sql="SELECT doc_id, regexp_replace(text, '" + _pattern.replace("'", "''") + "', '" + _mark.replace("$", "\\") + "', 'g') AS text FROM secrets")
_add("router_decision", lambda s, d: view(s, d, "commands").select("id", router.decision(F.col("cmd")).alias("x")).select("id", "x.code", "x.rewritten"))

# Log filters.
for _family in FAMILIES:
    if _family in line_filters.BY_NAME:
        _add(f"filter_{_family}", lambda s, d, f=_family: view(s, d, f"log_{f}").select("run_id", line_filters.BY_NAME[f](F.col("log")).alias("filtered")))
    elif _family in sequence_filters.BY_NAME:
        _add(f"filter_{_family}", lambda s, d, f=_family: sequence_filters.BY_NAME[f](view(s, d, f"log_{f}"), "run_id", "log"))
for _profile in ("strict", "developer", "default"):
    _add(f"compact_{_profile}", lambda s, d, p=_profile: view(s, d, "files").select("path", line_filters.compact(F.col("content"), 20, p).alias("content")))


for _family in FAMILIES:
    if f"filter_{_family}" in QUERIES and _family in log_sql.FILTERS:
        ORACLES[f"filter_{_family}"] = with_views(log_sql.FILTERS[_family], f"log_{_family}")
for _profile in ("strict", "developer", "default"):
    ORACLES[f"compact_{_profile}"] = with_views(log_sql.compact(_profile, 20), "files")
ORACLES["parse_hunks"] = with_views(log_sql.HUNKS, "diffs")
ORACLES["code_search"] = with_views(log_sql.CODE_SEARCH, "files")
ORACLES["router_decision"] = with_views(log_sql.ROUTER, "commands")
ORACLES["dlp_redact"] = with_views(log_sql.redact("secrets", "doc_id", ("internal-[0-9]+",)), "secrets")
ORACLES["dlp_audit"] = with_views(log_sql.audit("secrets", ("internal-[0-9]+",)), "secrets")
