"""Repeated passages by a depth-limited radix sort of all suffixes of all texts.

Suffixes are told apart through ``depth`` bytes only, most significant digit
first, and a suffix that stands alone in its group is dropped. The first digit
is not the first bytes but the least hashed gram of the suffix's window: equal
windows have the same, and neighbouring suffixes share it, so that a run of
them (a block) is one record. Blocks of one first digit with the same 128 bits
of BLAKE2 of their bytes are one kind: they repeat each other as a whole. Only
different kinds under the same first digit are sorted on, suffix by suffix, by
passes over their bytes, eight a pass, in a task. Where a group is too large
for one, shuffles sort its blocks first, by the bytes around the gram that all
windows of a half of them share, until the groups are small enough. Groups left
at full depth are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.storage import in_small_batches
from tracewright.llm.common import stored
from tracewright.llm.words import mixed, powers

GRAM = 40
#: Bytes of the digest by which blocks under the same first digit count as equal: built texts cannot make it collide, as they can a sum.
DIGEST_BYTES = 16
#: Different kinds of blocks of one first digit that one task sorts; larger groups are sorted by shuffles, by the same passes.
TASK_KINDS = 4000
#: Blocks or removed runs (some forty bytes each) up to which they are sent to the scan of texts; more meet it in a shuffle.
SENT_BLOCKS = 1_000_000
#: Bytes of windows' blocks that one call sorts together.
SORT_BYTES = 2 << 20

_BYTE = np.random.default_rng(3).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_up, _down = powers(_BASE, 1 << 16), powers(_BACK, 1 << 16)


def _grown(n: int) -> None:
    global _up, _down
    if n > len(_up):
        _up, _down = powers(_BASE, 2 * n), powers(_BACK, 2 * n)


def grams_of(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of each gram, by its bytes alone."""
    n = len(raw)
    _grown(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _up[:n], out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * _down[: n - gram + 1])


def blocks_of(raw: np.ndarray, depth: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with the same least gram: its hash, the digest of the run's bytes, first and last start."""
    n = len(raw)
    if n < depth:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, object), none, none
    grams = grams_of(raw, gram)
    width = depth - gram + 1
    least, s = grams, 1
    while 2 * s <= width:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    starts = n - depth + 1
    least = np.minimum(least[:starts], least[width - s : width - s + starts])
    # A new run begins where the least gram changes, or the window leaves it behind for an equal one.
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (grams[: starts - 1] == least[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [starts])) - 1
    view, content = memoryview(raw), np.empty(len(first), object)
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        content[i] = hashlib.blake2b(view[a : b + depth], digest_size=DIGEST_BYTES).digest()
    return least[first].view(np.int64), content, first, last


def _blocks(texts: DataFrame, depth: int) -> DataFrame:
    """The blocks of every text. Equal texts of a batch are one, with their number as ``copies``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch.groupby(["k1", "k2"], sort=False)["body"].agg(["first", "size"])
            for at in range(0, len(size), 500):
                out = []
                for (k1, k2), body, copies in size[at : at + 500].itertuples(name=None):
                    h, c, a, b = blocks_of(np.frombuffer(body.encode("utf-8", "surrogatepass"), np.uint8), depth)
                    out.append((h, c, np.full(len(h), k1), np.full(len(h), k2), a, b, np.full(len(h), copies)))
                yield pd.DataFrame({x: np.concatenate([o[i] for o in out]) for i, x in enumerate(("h", "c", "k1", "k2", "a", "b", "copies"))})

    return texts.mapInPandas(scan, "h long, c binary, k1 long, k2 long, a int, b int, copies int")


def equal_windows(buffer: np.ndarray, group: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the windows of ``depth`` bytes that are equal to another one of the same group: the radix passes."""
    # The eight bytes from each place on, seen in the buffer itself.
    eight = np.ndarray(len(buffer), ">u8", np.concatenate((buffer, np.zeros(8, np.uint8))), strides=(1,))
    left, group = np.arange(len(start), dtype=np.int32), group.astype(np.int32)
    for d in range(0, depth, 8):
        if not len(left):
            break
        digit = eight[start[left] + d].astype(np.uint64)
        if depth - d < 8:
            digit = digit >> np.uint64(8 * (8 - depth + d))
        order = np.lexsort((digit, group)).astype(np.int32)
        left, digit, group = left[order], digit[order], group[order]
        new = np.concatenate(([True], (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])))
        alone = new & np.concatenate((new[1:], [True]))
        group = np.cumsum(new, dtype=np.int32)[~alone]
        left = left[~alone]
    return left


def _sorted_in_tasks(kinds: DataFrame, depth: int) -> DataFrame:
    """``h``, ``c``, ``at``: which windows of each block are equal to one of another block with the same first digit."""

    def sort(rows: list) -> pd.DataFrame:
        bodies = [np.frombuffer(r.body, np.uint8) for r in rows]
        offset = np.cumsum([0] + [len(b) for b in bodies], dtype=np.int32)[:-1]
        size = np.array([len(b) - depth + 1 for b in bodies], np.int32)
        block = np.repeat(np.arange(len(rows), dtype=np.int32), size)
        inside = np.arange(len(block), dtype=np.int32) - np.repeat(np.cumsum(size, dtype=np.int32) - size, size)
        names = np.unique([r.h for r in rows], return_inverse=True)[1].astype(np.int32)
        found = equal_windows(np.concatenate(bodies), names[block], offset[block] + inside, depth)
        found.sort()
        cut = np.searchsorted(block[found], np.arange(len(rows) + 1))
        at = [inside[found[cut[i] : cut[i + 1]]] for i in range(len(rows))]
        some = [i for i in range(len(rows)) if len(at[i])]
        # Without a type, columns of no rows are doubles, which Arrow can't make lists of.
        return pd.DataFrame({"h": [rows[i].h for i in some], "c": [rows[i].c for i in some], "at": [at[i] for i in some]}, dtype=object)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        whole = weight = 0  # rows of groups that are complete, bytes in all
        for batch in batches:
            for row in batch.itertuples(index=False):
                if rows and (row.h, row.c) == (rows[-1].h, rows[-1].c):
                    continue  # another copy of the same block
                if rows and row.h != rows[-1].h:
                    whole = len(rows)
                    if weight > SORT_BYTES:
                        yield sort(rows)
                        rows, weight = [], 0
                rows.append(row)
                weight += len(row.body)
        if rows:
            yield sort(rows)

    return kinds.mapInPandas(walk, "h long, c binary, at array<int>")


_HALF = "h long, c binary, k long, s binary, shift int, size int, body binary, lo int, hi int, anchor int"


def _halves(blocks: DataFrame, depth: int) -> DataFrame:
    """Each block in two: the windows in which the gram stands further left, and those in which it stands further right.

    A block's windows hold the gram at ``lo`` to ``hi`` bytes from their start,
    so each holds the bytes from ``lo`` before it on, ``depth - hi + lo`` in all.
    A half has more such bytes, and these are its next digit: ``k`` names the
    half and its digit, ``s`` the half's own bytes. Equal windows have the gram
    at the same place, so that they have the same ``k``. ``anchor`` is the
    gram's place in the block; where it is below 0, it is looked for.
    """

    def halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                anchor = row.anchor
                if anchor < 0:
                    anchor = int(np.argmax(grams_of(np.frombuffer(row.body, np.uint8)).view(np.int64) == row.h))
                mid = (row.lo + row.hi) // 2
                for lo, hi in ((row.lo, mid), (mid + 1, row.hi)):
                    first, last = max(lo, anchor - len(row.body) + depth), min(hi, anchor)
                    if first > last:
                        continue  # the block has none of these windows
                    shift = anchor - last
                    body = row.body[shift : anchor - first + depth]
                    digit = b"%d %d " % (row.h, lo) + row.body[anchor - lo : anchor + depth - hi]
                    k = int.from_bytes(hashlib.blake2b(digit, digest_size=8).digest(), "little", signed=True)
                    s = hashlib.blake2b(body, digest_size=DIGEST_BYTES).digest()
                    out.append((row.h, row.c, k, s, shift, last - first + 1, body, lo, hi, last))
            yield pd.DataFrame(out, columns=["h", "c", "k", "s", "shift", "size", "body", "lo", "hi", "anchor"])

    return blocks.mapInPandas(halve, _HALF)


def _sorted_by_shuffle(kinds: DataFrame, depth: int) -> DataFrame:
    """The same for groups of any size: most-significant-digit passes by shuffles over the blocks' halves.

    A pass halves the places that the gram may have in a block's windows, so
    that its halves share ever longer digits around the gram; equal halves are
    one, and one that stands alone in its group is dropped. Groups that are
    small enough then are sorted in tasks, the others by the next pass; where one
    place is left, the digit is the whole window, so the eighth pass is the last
    at 200 bytes. Rows are blocks and halves, never their windows.
    """

    # The halving task itself looks for the grams: a second function here would be a second Python worker of each task.
    whole = [F.lit(0).alias("lo"), F.lit(depth - GRAM).alias("hi"), F.lit(-1).alias("anchor")]
    return _passed(_dealt(kinds, "h", "c").dropDuplicates(["h", "c"]).select("h", "c", "body", *whole), depth)


def _passed(blocks: DataFrame, depth: int) -> DataFrame:
    """``h``, ``c``, ``at`` of ``blocks``, by one pass and, where groups stay large, by those after it."""
    halves = stored(_halves(blocks, depth), "halves")
    kinds = halves.groupBy("k", "s", "body", "lo", "hi", "anchor").agg(F.count("*").alias("n"))
    met = kinds.join(kinds.groupBy("k").agg(F.count("*").alias("kinds")), "k").where("n > 1 or kinds > 1")
    met = stored(met.select(F.col("k").alias("h"), F.col("s").alias("c"), "body", "lo", "hi", "anchor", "n", "kinds"), "met")
    single = _sorted_in_tasks(_dealt(met.where(F.col("kinds").between(2, TASK_KINDS)).select("h", "c", "body"), "h").sortWithinPartitions("h", "c"), depth)
    more = met.where(F.col("kinds") > max(1, TASK_KINDS))
    if not more.isEmpty():
        single = single.union(_passed(_dealt(more.select("h", "c", "body", "lo", "hi", "anchor"), "h", "c"), depth))
    # A half of two blocks is repeated as a whole, whatever else its group holds.
    single = met.where("n > 1").select("h", "c", F.lit(None).cast("array<int>").alias("at")).union(single)
    told = single.groupBy(F.col("h").alias("k"), F.col("c").alias("s")).agg(F.max(F.col("at").isNull()).alias("whole"), F.first("at", ignorenulls=True).alias("at"))
    inside = F.when(F.col("whole"), F.expr("sequence(shift, shift + size - 1)")).otherwise(F.expr("transform(at, x -> x + shift)"))
    found = halves.select("h", "c", "k", "s", "shift", "size").join(told, ["k", "s"]).select("h", "c", inside.alias("at"))
    return stored(found.groupBy("h", "c").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at")), "passed")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """In as many tasks as a shuffle has: by bytes, rows that take long to work on would end in a few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _covered(runs: list, depth: int) -> list[tuple[int, int]]:
    """Maximal ranges of bytes covered by the windows of (first start, last start, single starts or None for all)."""
    parts = []
    for r in runs:
        if r["at"] is None:
            parts.append((r["a"], r["b"] + depth))
        else:
            at = np.asarray(r["at"]) + r["a"]
            gap = np.flatnonzero(np.diff(at) > depth)
            parts += zip(at[np.concatenate(([0], gap + 1))].tolist(), (at[np.concatenate((gap, [len(at) - 1]))] + depth).tolist(), strict=True)
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keys(body: Column) -> list[Column]:
    """A text's 128-bit name by its content: the same whenever and wherever it is computed."""
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(3), body).alias("k2")]


@in_small_batches
def remove_repeats(docs: DataFrame, depth: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's bytes outside all passages of ``depth`` bytes that also start anywhere else.

    Gives ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs), ``kept_sha256`` and the runs as ``removed`` (start, end, in bytes).
    Texts are UTF-8 bytes, a null one is empty; windows never cross texts; a
    window may repeat in its own text, overlapping itself. Texts of fewer bytes
    have no window. Every copy of a repeated row loses all its windows. An empty
    table gives no rows.

    Texts are named by content, so nothing depends on the order of rows. Groups
    are counted before they are shuffled; only counts, blocks' hashes and the
    blocks that need sorting move, and texts stay where they are read unless
    more of them are hit than may be sent.
    """
    if depth < 2 * GRAM:
        raise ValueError(f"depth must be at least {2 * GRAM}")
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(*_keys(body), F.col(key).cast("long").alias("doc_id"), body.alias("body"))
    blocks = _blocks(texts.where(F.octet_length("body") >= depth), depth)

    first = blocks.groupBy("h").agg(F.sum("copies").alias("n"), (F.min("c") == F.max("c")).alias("same")).where("n > 1")
    first = stored(first.select("h", "same"), "first")
    again = stored(blocks.join(first, "h"), "again")

    second = again.where("not same").groupBy("h", "c").agg(F.sum("copies").alias("n"), F.min(F.struct("k1", "k2", "a", "b")).alias("r"))
    second = stored(second.select("h", "c", "n", "r.*"), "second")
    many = second.groupBy("h").agg((F.count("*") > TASK_KINDS).alias("many"))
    wanted = stored(
        second.join(many, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "many", "a", "b")).alias("wanted"), F.count("*").alias("m")), "wanted"
    )
    few = (wanted.agg(F.sum("m")).first()[0] or 0) <= SENT_BLOCKS
    found = texts.select("k1", "k2", "body").join(F.broadcast(wanted) if few else wanted, ["k1", "k2"])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = set()  # copies in one task give their blocks once
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.k1, row.k2) not in done:
                    done.add((row.k1, row.k2))
                    raw = row.body.encode("utf-8", "surrogatepass")
                    out += [(w["h"], w["c"], w["many"], raw[w["a"] : w["b"] + depth]) for w in row.wanted]
            yield pd.DataFrame(out, columns=["h", "c", "many", "body"])

    kinds = stored(found.select("k1", "k2", "body", "wanted").mapInPandas(fetch, "h long, c binary, many boolean, body binary"), "kinds")
    dealt = _dealt(kinds.where("not many").select("h", "c", "body"), "h").sortWithinPartitions("h", "c")
    single, large = _sorted_in_tasks(dealt, depth), kinds.where("many").select("h", "c", "body")
    if not large.isEmpty():
        single = single.union(_sorted_by_shuffle(large, depth))
    # A block that occurs twice is repeated as a whole; of others only some windows may be.
    at = second.select("h", "c", "n").join(single, ["h", "c"], "left").where("n > 1 or at is not null")
    at = stored(at.select("h", "c", F.when(F.col("n") == 1, F.col("at")).alias("at")), "at")
    hits = again.where("same").select("k1", "k2", "a", "b", F.lit(None).cast("array<int>").alias("at")).union(
        again.where("not same").join(at, ["h", "c"]).select("k1", "k2", "a", "b", "at")
    )
    hits = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b", "at")).alias("runs"))

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = [[{"start": a, "end": b} for a, b in _covered(r, depth)] for r in batch["runs"]]
            yield batch[["k1", "k2"]].assign(removed=runs)

    hits = stored(hits.mapInPandas(cover, "k1 long, k2 long, removed array<struct<start:int,end:int>>"), "hits")
    few = (hits.agg(F.sum(F.size("removed") + 1)).first()[0] or 0) <= SENT_BLOCKS

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                raw = row.body.encode("utf-8", "surrogatepass")
                spans = [(x["start"], x["end"]) for x in row.removed] if row.removed is not None else []
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((row.doc_id, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]).astype({"doc_id": "Int64"})

    told = texts.join(F.broadcast(hits) if few else hits, ["k1", "k2"], "left").select("doc_id", "body", "removed")
    told = told.mapInPandas(judge, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>")
    return stored(told, "told")  # here, so that texts come in small batches too


def op3_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
