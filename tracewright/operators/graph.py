"""The call graph: edges from names, closures over them, and which symbols a change touches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.code import LANGUAGES, SYMBOLS, Code
from tracewright.functions.lines import lines
from tracewright.functions.storage import by_shuffle, in_small_tasks, stored

# A name with more definitions elsewhere stays unresolved; bounds of the risk classes.
MOST_CANDIDATES, HIGH, MEDIUM = 3, 10, 3
#: Rounds of a closure after which what it has seen becomes one table.
COMPACTED = 4
#: Lines of a bin in which symbols and hunks meet.
BIN_LINES = 64


def dir_of(path: Column) -> Column:
    """What stands before the last slash."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def risk(n: Column) -> Column:
    return F.when(n > HIGH, "HIGH").when(n > MEDIUM, "MEDIUM").otherwise("LOW")


def find_symbols(symbols: DataFrame, part: str) -> DataFrame:
    """Symbols whose name holds ``part``, in any case; ``%`` and ``_`` are wildcards."""
    return symbols.where(F.col("name").ilike(f"%{part}%"))


def references(symbols: DataFrame, deps: DataFrame, name: str) -> DataFrame:
    """Symbols that call a name, whoever bears it."""
    return deps.where(F.col("callee_name") == name).join(symbols, deps.caller_id == symbols.id).select(symbols["*"])


def file_dependencies(symbols: DataFrame, deps: DataFrame, path: str) -> DataFrame:
    """Each symbol of a file with the names it calls, sorted; none: an empty array."""
    own = symbols.where(F.col("file_path") == path)
    rows = own.join(deps, own.id == deps.caller_id, "left")
    return rows.groupBy("id", "name").agg(F.array_sort(F.collect_set("callee_name")).alias("callees"))


@in_small_tasks
def resolved_edges(symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """``caller_id``, ``callee_id``: the only other bearer of the called name, else those in the same file, else in the same folder, else all if few.

    Bearers are counted by name, file and folder first, so that a name with many
    bearers never meets all its callers. All joins are by shuffles: symbols are
    computed from small columns, and by such estimates the whole of them would
    be sent through the driver. Symbols are stored once, so that no task sorts
    them for their own computation and for a join at the same time.
    """
    nodes = stored(symbols.select("id", "name", "file_path", dir_of(F.col("file_path")).alias("dir")), "nodes")
    callers = nodes.select(F.col("id").alias("caller_id"), F.col("name").alias("own"), "file_path", "dir")
    calls = deps.select("caller_id", F.col("callee_name").alias("name")).distinct().join(by_shuffle(callers), "caller_id")

    def counted(*by: str) -> DataFrame:
        return nodes.groupBy(*by).agg(F.count("*").alias("n_" + by[-1]))

    for by in (("name",), ("name", "file_path"), ("name", "dir")):
        calls = calls.join(by_shuffle(counted(*by)), list(by), "left")
    itself = (F.col("own") == F.col("name")).cast("int")
    n = {k: F.coalesce(F.col(f"n_{k}"), F.lit(0)) - itself for k in ("name", "file_path", "dir")}
    tier = (
        F.when(n["name"] <= 1, "name").when(n["file_path"] > 0, "file_path").when(n["dir"] > 0, "dir").when(n["name"] <= MOST_CANDIDATES, "name")
    )
    calls = stored(calls.select("caller_id", "name", "file_path", "dir", tier.alias("tier")).where("tier is not null"), "calls")
    out = None
    for by in (["name"], ["name", "file_path"], ["name", "dir"]):
        found = calls.where(F.col("tier") == by[-1]).select("caller_id", *by).join(by_shuffle(nodes.select(F.col("id").alias("callee_id"), *by)), by)
        found = found.where("caller_id <> callee_id").select("caller_id", "callee_id")
        out = found if out is None else out.unionByName(found)
    return stored(out.distinct(), "resolved")


@in_small_tasks
def closure(edges: DataFrame, starts: DataFrame, upstream: bool = True, most_steps: int | None = None) -> DataFrame:
    """``source``, ``node``: what reaches each start (``id``), or what it reaches; starts themselves are left out.

    Breadth first from all starts at once. Each round is stored and only new
    pairs go on, so cycles end it.
    """
    a, b = ("callee_id", "caller_id") if upstream else ("caller_id", "callee_id")
    steps = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct(), "edges")
    front = stored(starts.select(F.col("id").alias("source"), F.col("id").alias("node")).distinct(), "front")
    seen, n = front, 0
    while not front.isEmpty() and (most_steps is None or n < most_steps):
        new = front.join(steps, "node").select("source", F.col("next").alias("node")).distinct()
        front = stored(new.join(seen, ["source", "node"], "left_anti"), "front")
        seen, n = seen.unionByName(front), n + 1
        if n % COMPACTED == 0:  # else a scan more each round
            seen = stored(seen, "seen")
    return seen.where("source <> node")


@in_small_tasks
def reached(edges: DataFrame, starts: DataFrame, upstream: bool = True) -> DataFrame:
    """``id`` of all that reaches any start, or that any start reaches; a start itself only if another one reaches it.

    Each node keeps at most two starts that reach it, of which one is another
    than itself: enough to tell, and linear where all pairs would not be.
    """
    a, b = ("callee_id", "caller_id") if upstream else ("caller_id", "callee_id")
    steps = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node <> next").distinct(), "edges")
    front = stored(starts.select(F.col("id").alias("node"), F.col("id").alias("source")).distinct(), "front")
    seen, n = front, 0
    while not front.isEmpty():
        met = front.join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
        known = seen.groupBy("node").agg(F.min("source").alias("a"), F.max("source").alias("b"))
        two = F.array_distinct(F.array("lo", "hi"))
        fresh = F.when(F.col("a").isNull(), two).when(F.col("a") == F.col("b"), F.slice(F.array_except(two, F.array("a")), 1, 1))
        front = stored(met.join(known, "node", "left").select("node", F.explode(fresh).alias("source")), "front")
        seen, n = seen.unionByName(front), n + 1
        if n % COMPACTED == 0:
            seen = stored(seen, "seen")
    return seen.where("node <> source").select(F.col("node").alias("id")).distinct()


@in_small_tasks
def reach_counts(edges: DataFrame, starts: DataFrame, upstream: bool = True) -> DataFrame:
    """``id``, ``n``: for each start the number of nodes that reach it, or that it reaches, itself left out; cycles are fine.

    64 starts that follow each other by id share a word, and a node holds a bit
    for each of them: rows are (node, word) and never (start, node). Each round
    passes on only bits that a node didn't hold. Bits are counted by word, first
    within each task.
    """
    a, b = ("callee_id", "caller_id") if upstream else ("caller_id", "callee_id")
    steps = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node <> next").distinct(), "edges")
    ids = starts.select("id").where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
    at = F.monotonically_increasing_id()
    ids = stored(ids.select("id", F.shiftright(at, 6).alias("word"), at.bitwiseAND(63).cast("int").alias("bit")), "starts")
    front = stored(ids.select(F.col("id").alias("node"), "word", F.expr("shiftleft(1L, bit)").alias("mask")), "front")
    seen, rounds = front, 0
    while not front.isEmpty():
        met = front.join(steps, "node").groupBy(F.col("next").alias("node"), "word").agg(F.bit_or("mask").alias("met"))
        known = seen.groupBy("node", "word").agg(F.bit_or("mask").alias("known"))
        fresh = F.col("met").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        front = stored(met.join(known, ["node", "word"], "left").select("node", "word", fresh.alias("mask")).where("mask <> 0"), "front")
        seen, rounds = seen.unionByName(front), rounds + 1
        if rounds % COMPACTED == 0:
            seen = stored(seen.groupBy("node", "word").agg(F.bit_or("mask").alias("mask")), "seen")
    # A bit of a node is in one round's rows only, so that sums count each once.
    sums = [F.sum(F.shiftrightunsigned("mask", i).bitwiseAND(1)).alias(str(i)) for i in range(64)]
    counts = seen.groupBy("word").agg(*sums).select("word", F.posexplode(F.array(*[str(i) for i in range(64)])).alias("bit", "n"))
    return stored(ids.join(counts, ["word", "bit"]).select("id", (F.col("n") - 1).alias("n")), "counts")


def impact(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Symbols upstream of any bearer of a name, with the risk that their number means."""
    found = stored(reached(edges, symbols.where(F.col("name") == name)), "reached")
    total = found.agg(F.count("*").alias("n"))
    return symbols.join(found, "id", "left_semi").join(total).select("id", "name", "file_path", risk(F.col("n")).alias("risk"))


def parse_hunks(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """File and changed lines of the new side of each hunk; hunks without lines there don't count."""
    rows = diffs.select(F.col(key).alias("key"), F.posexplode(lines(F.col(text))).alias("pos", "line"))
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    path = F.last(F.when(F.col("line").startswith("+++ b/"), F.substring("line", 7, 1 << 20)), ignorenulls=True).over(w)
    head = r"^@@ .*?\+(\d+)(?:,(\d+))?"
    first = F.regexp_extract("line", head, 1).try_cast("int")
    size = F.coalesce(F.regexp_extract("line", head, 2).try_cast("int"), F.lit(1))
    rows = rows.select(F.col("key").alias(key), "pos", path.alias("file_path"), first.alias("first_line"), (first + size - 1).alias("last_line"))
    return rows.where("file_path is not null and first_line is not null and last_line >= first_line")


def touched(symbols: DataFrame, hunks: DataFrame, bin_lines: int = BIN_LINES) -> DataFrame:
    """Symbols whose lines overlap a hunk of their file.

    Both are cut into bins of lines and meet by file and bin, so that a file
    with any number of symbols and hunks spreads over tasks. Hunks of a bin are
    first reduced to different ranges; a symbol comes once, whatever it meets.
    """

    def binned(rows: DataFrame, first: str, last: str) -> DataFrame:
        return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / bin_lines), F.floor(F.col(last) / bin_lines))))

    ranges = hunks.where("last_line >= first_line").select("file_path", "first_line", "last_line").distinct()
    own = symbols.where("line_end >= line_start").select("id", "file_path", "line_start", "line_end")
    x, y = binned(own, "line_start", "line_end"), binned(ranges, "first_line", "last_line")
    on = (x.file_path == y.file_path) & (x._bin == y._bin) & (x.line_start <= y.last_line) & (x.line_end >= y.first_line)
    return symbols.join(by_shuffle(x.join(by_shuffle(y), on, "left_semi").select("id").distinct()), "id", "left_semi").select(symbols.columns)


@in_small_tasks
def detect_changes(symbols: DataFrame, edges: DataFrame, hunks: DataFrame) -> DataFrame:
    """Touched symbols with the number of symbols upstream of each, most first; ties by id."""
    changed = stored(touched(symbols, hunks), "changed")
    counts = reach_counts(edges, changed).select("id", F.col("n").alias("impact"))
    n = F.coalesce("impact", F.lit(0).cast("long"))
    told = changed.join(by_shuffle(counts), "id", "left").select("id", "name", n.alias("impact"), risk(n).alias("risk"))
    return stored(told, "told").orderBy(F.desc("impact"), "id")


def coverage(symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """The share of symbols that call or are called by name, in percent; unknown callers count too."""
    named = symbols.join(deps, symbols.name == deps.callee_name, "left_semi").select("id")
    linked = named.union(deps.select("caller_id")).distinct().agg(F.count("*").alias("linked"))
    total = symbols.agg(F.count("*").alias("symbols"))
    pct = F.when(F.col("symbols") > 0, F.col("linked") / F.col("symbols") * 100).otherwise(0.0)
    return linked.join(total).select("symbols", "linked", F.round(pct, 6).alias("pct"))


def index_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What an incremental index has to do with each file: ``added``, ``changed``, ``gone`` or ``same``."""
    both = old.select("file_path", F.col("hash").alias("was")).join(new.select("file_path", F.col("hash").alias("now")), "file_path", "full")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return both.select("file_path", state.alias("state"))


def code_search(files: DataFrame, query: str, most: int = 100) -> DataFrame:
    """The first lines, by path and number, that hold the query in any case."""
    rows = files.select("path", F.posexplode(lines(F.col("content"))).alias("pos", "line"))
    found = rows.where(F.contains(F.lower("line"), F.lit(query.lower())))
    return found.select("path", (F.col("pos") + 1).alias("line_number"), F.trim("line").alias("content")).orderBy("path", "line_number").limit(most)


def hybrid_search(vectors: DataFrame, names: DataFrame, query: str, vector: list[float], alpha: float = 0.5, most: int = 10) -> DataFrame:
    """Names by a mix of text match and dot product, best first; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    dot = F.aggregate(F.zip_with(F.col("embedding"), q, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    has = F.contains(F.lower("name"), F.lit(query.lower())).cast("double")
    rows = names.join(vectors, "id").select("id", "name", F.round(alpha * has + (1 - alpha) * dot, 4).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(most)


def outlined(files: DataFrame) -> DataFrame:
    """``path``, ``nth``, ``kind``, ``name``, ``line_start``, ``line_end``, ``calls`` of each symbol of code files, a file at a time."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"], strict=True):
                code = Code(content, ext)
                calls: dict[int, list[str]] = {}
                for symbol, name in code.calls():
                    calls.setdefault(symbol.first, []).append(name)
                out += [(path, nth, x.kind, x.name, x.line_start, x.line_end, calls.get(x.first, [])) for nth, x in enumerate(code.symbols)]
            yield pd.DataFrame(out, columns=["path", "nth", "kind", "name", "line_start", "line_end", "calls"])

    known = [ext for ext, lang in LANGUAGES.items() if lang in SYMBOLS]
    rows = files.where(F.lower("ext").isin(known) & F.col("content").isNotNull()).select("path", "ext", "content")
    found = rows.mapInPandas(scan, "path string, nth int, kind string, name string, line_start int, line_end int, calls array<string>")
    return found.withColumn("id", F.concat_ws(":", "kind", "path", "name"))


def extracted_symbols(files: DataFrame) -> DataFrame:
    """Symbols of code files (path, ext, content): what defines them outside quotes and comments, to their own end.

    Kinds are functions, methods, classes, structs, enums and traits of Rust,
    Python, Go and JavaScript or TypeScript. Lines count from 1, both ends
    included. Of equal ids (kind, file and name) the last one stays.
    """
    return symbols_of(outlined(files))


def symbols_of(outlined: DataFrame) -> DataFrame:
    found = outlined.groupBy("id", "name", "kind", F.col("path").alias("file_path"))
    return found.agg(F.max_by(F.struct("line_start", "line_end"), "nth").alias("at")).select("id", "name", "kind", "file_path", "at.*")


def extracted_calls(files: DataFrame) -> DataFrame:
    """``caller_id``, ``callee_name`` of each call, for the symbol opened last before it; not its own name.

    The callee is the attribute in Python and the field in Rust, else the first
    name of its path (``fmt`` of ``fmt.Println(x)``). Arguments of Rust macros
    hold no calls.
    """
    return calls_of(outlined(files)).select("caller_id", "callee_name")


def calls_of(outlined: DataFrame) -> DataFrame:
    return outlined.select(F.col("id").alias("caller_id"), F.col("path").alias("file_path"), F.explode("calls").alias("callee_name")).distinct()


def replaced_index(symbols: DataFrame, deps: DataFrame, delta: DataFrame, new_symbols: DataFrame, new_deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index after a change: rows of changed, added and vanished files (``file_path``, ``state``) go, the new ones' come."""
    gone = delta.where("state <> 'same'").select("file_path")
    fresh = delta.where("state in ('added', 'changed')").select("file_path")
    left = symbols.join(gone, "file_path", "left_anti").select(symbols.columns)
    old_ids = symbols.join(gone, "file_path", "left_semi").select(F.col("id").alias("caller_id"))
    came = new_symbols.join(fresh, "file_path", "left_semi").select(symbols.columns)
    calls = deps.join(old_ids, "caller_id", "left_anti").select("caller_id", "callee_name")
    added = new_deps.join(came.select(F.col("id").alias("caller_id")), "caller_id", "left_semi").select("caller_id", "callee_name")
    return left.unionByName(came), calls.unionByName(added).distinct()


def _sites(files: DataFrame, name: str, new_name: str | None) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"], strict=True):
                sites, renamed, at, far = [], [], 0, 0
                for line, a, b in Code(content, ext).sites(name):
                    start = far + len(content[at:a].encode())
                    far = start + len(name.encode())
                    sites.append({"line": line, "byte_start": start, "byte_end": far})
                    renamed += [content[at:a], new_name or ""]
                    at = b
                if sites:
                    out.append((path, sites, "".join(renamed) + content[at:] if new_name else None))
            yield pd.DataFrame(out, columns=["file_path", "sites", "content"])

    rows = files.where(F.lower("ext").isin(*LANGUAGES) & F.col("content").isNotNull()).select("path", "ext", "content")
    return rows.mapInPandas(scan, "file_path string, sites array<struct<line: int, byte_start: long, byte_end: long>>, content string")


def identifier_sites(files: DataFrame, name: str) -> DataFrame:
    """``file_path``, ``line``, ``byte_start``, ``byte_end`` of each place where a name stands as one, not in quotes or comments."""
    return _sites(files, name, None).select("file_path", F.inline("sites"))


def rename_plan(symbols: DataFrame, deps: DataFrame, files: DataFrame, name: str, new_name: str) -> DataFrame:
    """``file_path``, ``sites``, ``places``, ``content``: the files that define or call a name, with all its places renamed.

    ``places`` are the lines and the ranges of UTF-8 bytes that the old name
    takes. Only files that the index names are read.
    """
    if not new_name.isidentifier():
        raise ValueError("the new name must be an identifier")
    defined = symbols.where(F.col("name") == name).select("file_path")
    wanted = defined.union(references(symbols, deps, name).select("file_path")).distinct()
    found = _sites(files.join(wanted, files.path == wanted.file_path, "left_semi"), name, new_name)
    return found.select("file_path", F.size("sites").cast("long").alias("sites"), F.col("sites").alias("places"), "content")


def flow_trace(symbols: DataFrame, edges: DataFrame, names: list[str], max_depth: int = 6, max_nodes: int = 200) -> DataFrame:
    """The call tree below the first symbol (by id) of each name: ``entry``, ``place``, ``depth``, ``id``, ``truncated``, in pre-order.

    Only edges within ``max_depth`` steps of an entry reach its task. Children
    go by id; one met again is a leaf that is cut off and doesn't count; a tree
    ends at ``max_nodes`` symbols.
    """
    starts = symbols.where(F.col("name").isin(names)).groupBy("name").agg(F.min("id").alias("id")).select("id")
    steps = stored(edges.select("caller_id", "callee_id").distinct(), "steps")
    seen = stored(starts.select(F.col("id").alias("entry"), F.col("id").alias("node")), "seen")
    front = seen
    for _ in range(max_depth):
        new = front.join(steps, front.node == steps.caller_id).select("entry", F.col("callee_id").alias("node")).distinct()
        front = stored(new.join(seen, ["entry", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front), "seen")
    near = seen.join(steps, seen.node == steps.caller_id, "left").select("entry", "node", "callee_id")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        entry = rows["entry"].iloc[0]
        below = rows.dropna().groupby("node")["callee_id"].apply(sorted).to_dict()
        out, met, todo = [], set(), [(entry, 0, 0)]
        while todo:
            node, depth, above = todo.pop()
            if len(met) >= max_nodes:
                out[above][4] = True
                continue
            if node in met:
                out.append([entry, len(out), depth, node, True])
                continue
            met.add(node)
            children = below.get(node, [])
            out.append([entry, len(out), depth, node, depth >= max_depth and bool(children)])
            if depth < max_depth:
                todo += [(c, depth + 1, len(out) - 1) for c in reversed(children)]
        return pd.DataFrame(out, columns=["entry", "place", "depth", "id", "truncated"])

    return near.groupBy("entry").applyInPandas(walk, "entry string, place int, depth int, id string, truncated boolean")
