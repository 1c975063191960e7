"""Reports over the ledger and the index: Markdown lines, CSV rows, notes, estimates and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.lines import lines, tokens
from tracewright.functions.storage import by_shuffle
from tracewright.operators import graph, ledger
from tracewright.operators.pricing import DEFAULT_INPUT, cost, with_price
from tracewright.operators.sequence_filters import git_diff
from tracewright.sources.corpus import PRICES

#: The models of an estimate, the age in seconds from which an index is stale.
ESTIMATED = ("claude-4.8-opus", "claude-4.6-sonnet", "gpt-5.5", "gpt-5.4", "gemini-3.5-flash")
STALE_SECONDS = 86_400


def _fixed(x: Column, places: int) -> Column:
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def audit(rows: DataFrame, prices: DataFrame, now: Column) -> DataFrame:
    """``part``, ``place``, ``line``: the ledger's report as Markdown lines, to be written in the order of part and place.

    Commands are rows, one a line, most frequent first, so no text grows with
    their number.
    """
    total = ledger.savings(rows, prices).join(ledger.hours_saved(rows).select("hours"))
    head = F.array(
        F.lit("# Token audit"),
        F.concat(F.lit("Made at "), F.date_format(now, "yyyy-MM-dd HH:mm:ss")),
        F.lit("| Metric | Value |"),
        F.lit("| :--- | :--- |"),
        F.concat(F.lit("| Commands | "), F.col("commands").cast("string"), F.lit(" |")),
        F.concat(F.lit("| Original tokens | "), F.col("original").cast("string"), F.lit(" |")),
        F.concat(F.lit("| Filtered tokens | "), F.col("filtered").cast("string"), F.lit(" |")),
        F.concat(F.lit("| Saved tokens | "), F.col("saved").cast("string"), F.lit(" ("), _fixed("pct", 1), F.lit("%) |")),
        F.concat(F.lit("| Saved cost | $"), _fixed("cost_saved", 4), F.lit(" |")),
        F.concat(F.lit("| Saved hours | "), _fixed("hours", 2), F.lit(" |")),
    )
    out = total.select(F.lit(1).alias("part"), F.posexplode(head).alias("place", "line"))
    models = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p[2]).alias("name"), F.lit(p[3]).alias("price")) for i, p in enumerate(PRICES)])
    worth = total.select("saved", F.inline(models))
    told = F.concat(F.lit("| "), F.col("name"), F.lit(" | $"), _fixed("price", 2), F.lit(" | $"), _fixed(cost(F.col("saved"), F.col("price")), 4), F.lit(" |"))
    out = out.union(worth.select(F.lit(2), F.col("i"), told))
    commands = ledger.by_command(rows)
    told = F.concat(
        F.lit("| `"), F.col("cmd"), F.lit("` | "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in ("n", "original", "filtered", "saved")]), F.lit(" | "), _fixed("pct", 1), F.lit("% |")
    )
    return out.union(commands.select(F.lit(3), (-F.col("n")).cast("int"), told))


def csv_lines(rows: DataFrame, prices: DataFrame, most: int = 50_000) -> DataFrame:
    """``id``, ``line``: the newest rows as CSV, commands quoted; a null model is told as unknown and priced by default."""
    newest = ledger.recent(rows, most)
    saved = F.col("original_tokens") - F.col("filtered_tokens")
    priced = with_price(newest, prices, "unknown")
    line = F.concat_ws(
        ",",
        F.col("id").cast("string"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.concat(F.lit('"'), F.replace(F.col("cmd"), F.lit('"'), F.lit('""')), F.lit('"')),
        F.col("model"),
        F.col("original_tokens").cast("string"),
        F.col("filtered_tokens").cast("string"),
        saved.cast("string"),
        _fixed(ledger.percent(saved, F.col("original_tokens")), 2),
        _fixed(cost(saved, F.col("input_price")), 6),
        F.coalesce("duration_ms", F.lit(0).cast("long")).cast("string"),
    )
    return priced.select("id", line.alias("line"))


def benchmark_json(rows: DataFrame, prices: DataFrame, now: Column, commit: str = "unknown", version: str = "", revision: str = "", most: int = 50_000) -> DataFrame:
    """``part``, ``place``, ``line``: JSON lines, to be written in the order of part and place.

    The first tells when, from which commit and with which prices; then come the
    newest ledger rows, newest first, with what they saved.
    """
    facts = F.struct(F.unix_timestamp(now).cast("string").alias("timestamp"), F.lit(commit).alias("commit_sha"), F.lit(version).alias("version"), F.lit(revision).alias("pricing_revision"))
    head = rows.sparkSession.range(1).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), F.to_json(F.struct(facts.alias("metadata"))).alias("line"))
    saved = F.col("original_tokens") - F.col("filtered_tokens")
    told = F.struct(
        "id", "cmd", "original_tokens", "filtered_tokens", saved.alias("saved_tokens"), ledger.percent(saved, F.col("original_tokens")).alias("savings_pct"),
        cost(saved, F.col("input_price")).alias("cost_saved_usd"), F.coalesce("duration_ms", F.lit(0).cast("long")).alias("duration_ms"), "model",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )
    priced = with_price(ledger.recent(rows, most), prices, "unknown")
    return head.union(priced.select(F.lit(2), -F.col("id"), F.to_json(told, {"ignoreNullFields": "false"})))


def diff_estimate(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """For each diff and model: files, bytes, tokens before and after the filter, and their costs."""
    c = F.col(text)
    rows = diffs.select(
        F.col(key).alias("key"), tokens(c).alias("original"), F.octet_length(c).cast("long").alias("bytes"),
        F.size(F.filter(lines(c), lambda x: x.startswith("diff --git "))).cast("long").alias("files"),
    )
    short = git_diff(diffs, key, text).select(F.col(key).alias("key"), tokens(F.col("filtered")).alias("filtered"))
    price = {p[0]: p[3] for p in PRICES}
    models = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(price.get(m, DEFAULT_INPUT)).alias("price")) for m in ESTIMATED])
    rows = rows.join(short, "key").select("*", F.inline(models))
    return rows.select(
        F.col("key").alias(key), "files", "bytes", "original", "filtered", "model_id",
        cost(F.col("original"), F.col("price")).alias("cost"), cost(F.col("original") - F.col("filtered"), F.col("price")).alias("saved_cost"),
    )


def index_status(symbols: DataFrame, deps: DataFrame, hashes: DataFrame, now_s: int) -> DataFrame:
    """One row: counts, the last index time, coverage, and whether the index is stale (empty, never made, or too old)."""
    last = hashes.agg(F.max("last_indexed").alias("last_indexed"))
    edges = deps.agg(F.count("*").alias("edges"))
    rows = graph.coverage(symbols, deps).join(edges).join(last)
    never = F.col("last_indexed").isNull() | (F.col("last_indexed") == 0)
    stale = (F.col("symbols") == 0) | never | (F.lit(now_s) - F.col("last_indexed") > STALE_SECONDS)
    return rows.select("symbols", "edges", "last_indexed", "pct", F.coalesce(stale, F.lit(True)).alias("stale"))


def vault_index(symbols: DataFrame, deps: DataFrame, hashes: DataFrame, now_s: int) -> DataFrame:
    """``title``, ``body``: the note that begins a vault: the index's counts and state, and how many notes there are (one a different title)."""
    base = F.element_at(F.split("file_path", "/"), -1)
    notes = symbols.agg(F.count_distinct("name", base).alias("notes"))
    state = index_status(symbols, deps, hashes, now_s).join(notes)
    lines_ = [
        F.concat(F.lit("- Symbols: "), F.col("symbols").cast("string")), F.concat(F.lit("- Edges: "), F.col("edges").cast("string")),
        F.concat(F.lit("- Graph coverage: "), _fixed("pct", 1), F.lit("%")), F.concat(F.lit("- Notes exported: "), F.col("notes").cast("string")),
        F.concat(F.lit("- Index stale: "), F.when(F.col("stale"), "yes").otherwise("no")),
    ]
    body = F.concat_ws("\n", F.lit("# Code graph\n"), *lines_, F.lit("\nEach symbol's note holds its links.\n"))
    return state.select(F.lit("index").alias("title"), body.alias("body"))


def vault_notes(symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """``title``, ``body``: a Markdown note for each symbol with links to what it calls and what calls it.

    A title is the name and the file's name; of equal ones the last symbol by
    id stays, and only that one meets links. A called name meets its different
    titles and not its bearers, and links are made distinct and told as text
    before they meet the notes, so that a name with many callers and bearers
    takes no more than its links.
    """
    base = F.element_at(F.split("file_path", "/"), -1)
    nodes = symbols.select("id", "name", "kind", "file_path", "line_start", "line_end", F.concat("name", F.lit(" ("), base, F.lit(")")).alias("title"))
    calls = deps.select(F.col("caller_id").alias("id"), F.col("callee_name").alias("name")).distinct()
    titles = by_shuffle(nodes.select("name", F.col("title").alias("to")).distinct())
    targets = calls.join(titles, "name", "left").select("id", "name", F.coalesce("to", "name").alias("to")).distinct()
    callers = calls.select("name", F.col("id").alias("from_id")).join(by_shuffle(nodes.select(F.col("id").alias("from_id"), F.col("title").alias("from"))), "from_id")

    def listed(items: Column) -> Column:
        body = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- [["), x, F.lit("]]\n"))), "")
        return F.nullif(body, F.lit(""))

    none = F.lit("- None\n")
    outgoing = targets.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", "to"))).alias("out"))
    outgoing = outgoing.select("id", listed(F.transform("out", lambda x: x.to)).alias("out"))
    incoming = callers.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("from_id", "from"))).alias("inc"))
    incoming = incoming.select("name", listed(F.transform("inc", lambda x: x["from"])).alias("inc"))
    body = F.concat(
        F.lit("# Symbol: "), F.col("name"), F.lit("\n\n- **Kind:** "), F.col("kind"), F.lit("\n- **Location:** `"), F.col("file_path"), F.lit(":"),
        F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("`\n\n## Calls (Outgoing)\n"), F.coalesce("out", none),
        F.lit("\n## Referenced By (Incoming)\n"), F.coalesce("inc", none),
    )
    told = nodes.groupBy("title").agg(F.max_by(F.struct(*[c for c in nodes.columns if c != "title"]), "id").alias("last")).select("title", "last.*")
    return told.join(by_shuffle(outgoing), "id", "left").join(by_shuffle(incoming), "name", "left").select("title", body.alias("body"))
