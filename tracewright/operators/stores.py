"""Notes, thoughts, sessions and artifacts: upserts, lists, checks and expiry over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THOUGHT = "thought_"


def upsert(notes: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Values of ``new`` (key, project_path, val) win; a known note keeps its creation time."""
    put = new.select("key", "project_path", F.col("val").alias("_val"), F.lit(True).alias("_put"))
    both = notes.join(put, ["key", "project_path"], "full")
    fresh = F.col("_put").isNotNull()
    return both.select(
        "key", "project_path", F.when(fresh, F.col("_val")).otherwise(F.col("val")).alias("val"), F.coalesce("created_at", now).alias("created_at"),
        F.when(fresh, now).otherwise(F.col("last_accessed_at")).alias("last_accessed_at"),
    )


def overwrite(notes: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """As ``upsert``, but the creation time starts anew."""
    put = new.select("key", "project_path", "val", now.alias("created_at"), now.alias("last_accessed_at"))
    return notes.join(put, ["key", "project_path"], "left_anti").select(put.columns).unionByName(put)


def _folded(notes: DataFrame) -> DataFrame:
    w = Window.partitionBy("project_path", F.lower("key")).orderBy("key")
    return notes.withColumn("first_key", F.first("key").over(w)).withColumn("first_val", F.first("val").over(w))


def duplicates(notes: DataFrame) -> DataFrame:
    """Keys that differ from an earlier key of their project in case only."""
    return _folded(notes).where("key <> first_key").select("project_path", "key", "first_key")


def contradictions(notes: DataFrame) -> DataFrame:
    """Those of them whose values differ as well."""
    return _folded(notes).where("key <> first_key and val <> first_val").select("project_path", "key", "first_key")


def stale(notes: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return notes.where(F.col("last_accessed_at") < now - F.expr(f"interval {days} days")).select("project_path", "key", "last_accessed_at")


def thoughts(notes: DataFrame, now_s: int | None = None, days: int = 30) -> DataFrame:
    """Thoughts, latest key first, with the time in their keys; with ``now_s`` only those not older than ``days``."""
    second = F.coalesce(F.substring("key", len(THOUGHT) + 1, 32).try_cast("long"), F.lit(0).cast("long"))
    rows = notes.where(F.col("key").like(f"{THOUGHT}%")).select("project_path", "key", "val", second.alias("epoch_s"))
    rows = rows if now_s is None else rows.where(F.col("epoch_s") >= now_s - days * 86_400)
    return rows.orderBy(F.desc("key"), "project_path")


def session_json(session: DataFrame) -> DataFrame:
    """Each project's state as one JSON object, keys sorted; values that are no JSON become strings."""
    value = F.when(F.try_parse_json("val").isNotNull(), F.col("val")).otherwise(F.to_json(F.struct(F.col("val").alias("v"))).substr(6, 1 << 30))
    pair = F.concat(F.lit('"'), F.col("key"), F.lit('":'), value)
    rows = session.groupBy("project_path").agg(F.array_sort(F.collect_list(F.struct(F.col("key"), pair.alias("pair")))).alias("x"))
    return rows.select("project_path", F.concat(F.lit("{"), F.array_join(F.transform("x", lambda x: x.pair), ","), F.lit("}")).alias("state"))


def artifacts(rows: DataFrame, now: Column | None = None, days: int = 30) -> DataFrame:
    """Artifacts, newest first, ties by id; with ``now`` without expired ones."""
    kept = rows if now is None else rows.where(F.col("created_at") >= now - F.expr(f"interval {days} days"))
    return kept.select("id", "type", "created_at").orderBy(F.desc("created_at"), F.desc("id"))


def get(notes: DataFrame, key: str, project: str) -> DataFrame:
    return notes.where((F.col("key") == key) & (F.col("project_path") == project)).select("key", "val")


def listed(notes: DataFrame, project: str) -> DataFrame:
    return notes.where(F.col("project_path") == project).select("key", "val").orderBy("key")


def touched(notes: DataFrame, read: DataFrame, now: Column) -> DataFrame:
    """The notes after those of ``read`` (key, project_path) were read: their access time is now."""
    seen = read.select("key", "project_path", F.lit(True).alias("_seen")).distinct()
    rows = notes.join(seen, ["key", "project_path"], "left")
    return rows.withColumn("last_accessed_at", F.when(F.col("_seen"), now).otherwise(F.col("last_accessed_at"))).drop("_seen").select(notes.columns)


def thought(notes: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Notes with new thoughts (project_path, said, epoch_s): trimmed, blank ones left out, the last of a second wins."""
    said = F.regexp_replace("said", r"(?U)^\s+|\s+$", "")
    rows = new.select("project_path", F.concat(F.lit(THOUGHT), F.col("epoch_s").cast("string")).alias("key"), said.alias("val")).where("val <> ''")
    return overwrite(notes, rows.groupBy("key", "project_path").agg(F.max("val").alias("val")), now)


# How a thought stands in the ledger.
THOUGHT_COMMAND, THOUGHT_STORED = "think", "[Thought Stored]"


def thought_logs(new: DataFrame, now: Column) -> DataFrame:
    """The rows that new thoughts (project_path, said) add to the ledger by ``ledger.append``: what was said against the note that it is stored."""
    said = F.regexp_replace("said", r"(?U)^\s+|\s+$", "")
    rows = new.select(F.lit(THOUGHT_COMMAND).alias("cmd"), said.alias("raw_output"), F.lit(THOUGHT_STORED).alias("filtered"), now.alias("ts"), F.col("project_path").alias("project"))
    return rows.where("raw_output <> ''")


# The keys that a session begins with.
SESSION_KEYS = ("decisions", "active_tasks", "context_files", "warnings")


def session_init(session: DataFrame, projects: DataFrame) -> DataFrame:
    """The sessions with an empty list for each first key that a project (``project_path``) lacks."""
    keys = F.explode(F.array(*[F.lit(k) for k in SESSION_KEYS])).alias("key")
    first = projects.select("project_path").distinct().select("project_path", keys, F.lit("[]").alias("val"))
    return session.select("project_path", "key", "val").unionByName(first.join(session, ["project_path", "key"], "left_anti"))


def _as_json(val: Column) -> Column:
    return F.when(F.try_parse_json(val).isNotNull(), val).otherwise(F.to_json(F.struct(val.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(val.alias("v")))) - 6))


def session_update(session: DataFrame, new: DataFrame) -> DataFrame:
    """The sessions after ``new`` (project_path, key, val): what is no JSON is stored as a JSON string."""
    put = new.select("project_path", "key", _as_json(F.col("val")).alias("val"))
    return session.select("project_path", "key", "val").join(put, ["project_path", "key"], "left_anti").unionByName(put)


def session_export(session: DataFrame) -> DataFrame:
    """``project_path``, ``note``: each project's state as Markdown. Only texts of lists are told; other keys are left out."""
    rows = session.where(F.col("key").isin(*SESSION_KEYS)).select("project_path", "key", F.try_parse_json("val").alias("v"))
    items = F.filter(F.try_variant_get("v", "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    rows = rows.select("project_path", "key", F.transform(items, lambda x: F.try_variant_get(x, "$", "string")).alias("items"))
    state = session.select("project_path").distinct().join(
        rows.groupBy("project_path").agg(F.map_from_entries(F.collect_list(F.struct("key", "items"))).alias("of")), "project_path", "left"
    )

    def section(title: str, key: str, before: str, after: str = "") -> Column:
        told = F.transform(F.coalesce(F.try_element_at("of", F.lit(key)), F.expr("cast(array() as array<string>)")), lambda x: F.concat(F.lit(before), x, F.lit(f"{after}\n")))
        body = F.array_join(told, "")
        return F.concat(F.lit(f"## {title}\n"), F.when(body == "", "- None\n").otherwise(body), F.lit("\n"))

    note = F.concat(
        F.lit("# Session state\n\nProject: `"), F.col("project_path"), F.lit("`\n\n"),
        section("Active tasks", "active_tasks", "- [ ] "), section("Decisions", "decisions", "- "), section("Context files", "context_files", "- `", "`"), section("Warnings", "warnings", "- "),
    )
    return state.select("project_path", note.alias("note"))


def put_artifacts(rows: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Artifacts after ``new`` (id, type, content): an id that is known is replaced and its time starts anew."""
    put = new.select("id", "type", "content", now.alias("created_at"))
    return rows.select(put.columns).join(put, "id", "left_anti").unionByName(put)


def artifact(rows: DataFrame, artifact_id: str) -> DataFrame:
    return rows.where(F.col("id") == artifact_id).select("id", "type", "content", "created_at")


#: Fixed value: seconds after which old rows are due to be deleted again.
GC_SECONDS = 86_400


def gc_due(meta: DataFrame, now_s: int) -> DataFrame:
    """One row, ``due``: whether a day has passed since ``last_gc`` of the table (key, value); never or no number counts as 0."""
    last = F.coalesce(F.max(F.when(F.col("key") == "last_gc", F.col("value").try_cast("long"))), F.lit(0).cast("long"))
    return meta.agg((F.lit(now_s) - last >= GC_SECONDS).alias("due"))


def rule_file_findings(files: DataFrame, known: DataFrame, most_lines: int = 300) -> DataFrame:
    """``path``, ``finding``: rule files (path, content) of too many lines, and references in them to files that aren't among ``known`` (path)."""
    n = F.size(F.split(F.regexp_replace("content", "\n$", ""), "\n", -1))
    long = files.where(n > most_lines).select("path", F.concat(F.lit("has "), n.cast("string"), F.lit(" lines")).alias("finding"))
    links = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"file://(/[^\s)\"'>]+)"), F.lit(1)))).alias("to"))
    broken = links.join(known.select(F.col("path").alias("to")).distinct(), "to", "left_anti")
    return long.unionByName(broken.select("path", F.concat(F.lit("points to missing "), F.col("to")).alias("finding")))
