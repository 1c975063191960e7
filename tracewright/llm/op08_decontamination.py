"""Benchmark decontamination: a prefix-filtered set join of documents with item windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import row_key, stored
from tracewright.llm.words import STEP, powers, split_words, words_of

_FOUND = "doc_id long, n_words long, n_hit long, items array<string>"
#: Bits of the filter of word hashes that is sent to all executors, whatever the number of words in it.
FILTER_BITS = 20


def _filter_place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def item_windows(benchmark: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """``item``, ``words`` (space-joined) and ``n`` of each different window of each item."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item_id, body in zip(batch["item"], batch["body"], strict=True):
                words = split_words(body) if body is not None else []
                n = min(size, len(words))
                out += [(None if pd.isna(item_id) else str(item_id), b" ".join(words[i : i + n]), n) for i in range(len(words) - n + 1 if n else 0)]
            yield pd.DataFrame(out, columns=["item", "words", "n"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("body"))
    return rows.mapInPandas(cut, "item string, words binary, n int").distinct()


class _Index:
    """The windows (words, items) by their rarest word (the prefix token of a full containment)."""

    def __init__(self, windows: list[tuple[bytes, list[str]]], counts: dict[int, int]) -> None:
        self.items = [items for _, items in windows]
        split = [(i, w.split(b" ")) for i, (w, _) in enumerate(windows)]
        known = {w: _word_hash(w) for _, ws in split for w in set(ws)}
        rows = []
        for i, ws in split:
            at = min(range(len(ws)), key=lambda k: (counts.get(known[ws[k]], 0), known[ws[k]], k))
            rows.append((known[ws[at]], i, at, len(ws), ws))
        rows.sort(key=lambda r: (r[0], r[1]))
        self.token = np.array([r[0] for r in rows], np.uint64)
        self.id = np.array([r[1] for r in rows], np.int64)
        self.at = np.array([r[2] for r in rows], np.int64)
        self.n = np.array([r[3] for r in rows], np.int64)
        self.words = [b" ".join(r[4]) for r in rows]
        self.sums = np.array([int(_window_sum(np.array([known[w] for w in r[4]], np.uint64))) for r in rows], np.uint64)
        self.some = np.zeros(1 << FILTER_BITS, bool)
        self.some[_filter_place(self.token)] = True

    def find(self, text: str) -> tuple[int, int, list[str]]:
        """Number of words, of words inside any window's occurrence, and the items whose windows occur."""
        hashes, start, end, low = words_of(text)
        total = len(hashes)
        place = np.flatnonzero(self.some[_filter_place(hashes)]) if len(self.token) else np.zeros(0, np.int64)
        first = np.searchsorted(self.token, hashes[place], "left")
        reps = np.searchsorted(self.token, hashes[place], "right") - first
        if not reps.sum():
            return total, 0, []
        row = np.repeat(first - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
        begin = np.repeat(place, reps) - self.at[row]
        fits = (begin >= 0) & (begin + self.n[row] <= total)  # positional and length bounds
        row, begin = row[fits], begin[fits]
        # The hash of the whole window, from prefix sums, before the words themselves are compared.
        power = powers(STEP, total)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * power, dtype=np.uint64)))
        same = sums[begin + self.n[row]] - sums[begin] == self.sums[row] * power[begin]
        row, begin = row[same], begin[same]
        cover, found = np.zeros(total + 1, np.int64), set()
        for r, b in zip(row.tolist(), begin.tolist(), strict=True):
            n = int(self.n[r])
            if b" ".join(low[start[k] : end[k]] for k in range(b, b + n)) == self.words[r]:
                found.add(int(self.id[r]))
                cover[b] += 1
                cover[b + n] -= 1
        return total, int((np.cumsum(cover)[:total] > 0).sum()), sorted({x for i in found for x in self.items[i]})


def _word_hash(word: bytes) -> int:
    return int(words_of(word.decode("utf-8", "surrogatepass"))[0][0])


def _window_sum(hashes: np.ndarray) -> np.uint64:
    return (hashes * powers(STEP, len(hashes))).sum(dtype=np.uint64)


def _word_counts(docs: DataFrame, some: np.ndarray, text: str, known: np.ndarray | None = None) -> DataFrame:
    """``token``, ``count`` of the words in all documents that pass the filter: the rarity that orders each window's words.

    With ``known`` (sorted hashes) no other word is counted, so that there are
    at most as many rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((some, known))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            some, known = sent.value
            for body in batch["body"]:
                if body is not None:
                    h = words_of(body)[0]
                    found.append(h[some[_filter_place(h)]])
            token, n = np.unique(np.concatenate(found), return_counts=True)
            if known is not None:
                mine = np.isin(token, known, assume_unique=True)
                token, n = token[mine], n[mine]
            yield pd.DataFrame({"token": token.view(np.int64), "n": n})

    rows = docs.select(F.col(text).alias("body")).mapInPandas(count, "token long, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("count"))


def _sent_filter(hashes: np.ndarray) -> np.ndarray:
    some = np.zeros(1 << FILTER_BITS, bool)
    some[_filter_place(hashes)] = True
    return some


def _indexed(docs: DataFrame, windows: list[tuple[bytes, list[str]]], counts: dict[int, int], key: str, text: str) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((windows, counts))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index(*shipped.value)
        for batch in batches:
            got = [index.find(body) if body is not None else (0, 0, []) for body in batch["body"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [g[0] for g in got], "n_hit": [g[1] for g in got], "items": [g[2] for g in got]})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body")).mapInPandas(scan, _FOUND)


def _prefixed(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """Each window (``window``, ``words``, ``n``) with its prefix ``token``, the rarest of its words, and the token's place ``at`` in it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(w, at, _word_hash(x)) for w, words in zip(batch["window"], batch["words"], strict=True) for at, x in enumerate(words.split(b" "))]
            got = pd.DataFrame(out, columns=["window", "at", "token"])
            yield got.assign(token=got["token"].to_numpy(np.uint64).view(np.int64))

    words = stored(windows.select("window", "words").mapInPandas(cut, "window long, at int, token long"), "words")
    counts = _word_counts(docs, _places(words), text)
    first = F.min(F.struct(F.coalesce("count", F.lit(0).cast("long")).alias("count"), "token", "at")).alias("p")
    return words.join(counts, "token", "left").groupBy("window").agg(first).select("window", "p.token", "p.at").join(windows, "window")


def _places(tokens: DataFrame) -> np.ndarray:
    """The filter of the tokens; at most ``2 ** FILTER_BITS`` places reach the driver."""
    place = F.shiftrightunsigned("token", 64 - FILTER_BITS).cast("int").alias("place")
    some = np.zeros(1 << FILTER_BITS, bool)
    some[[r.place for r in tokens.select(place).distinct().collect()]] = True
    return some


def _shuffled(docs: DataFrame, holders: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """The same rows by a shuffle join on prefix tokens.

    A document sends a row only for a word that passes the filter of prefix
    tokens, with the ``size - 1`` words on each side of it.
    """
    windows = stored(holders.select("words", "n").distinct().select(row_key().alias("window"), "words", "n"), "windows")
    prefixed = stored(_prefixed(docs, windows, text), "prefixed")
    sent = docs.sparkSession.sparkContext.broadcast(_places(prefixed))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, doc, body in zip(batch["_row"], batch["doc_id"], batch["body"], strict=True):
                hashes, start, end, low = words_of(body) if body is not None else words_of("")
                n = len(hashes)
                out.append((row, None if pd.isna(doc) else int(doc), n, -1, 0, 0, []))
                for pos in np.flatnonzero(sent.value[_filter_place(hashes)]).tolist():
                    a = max(0, pos - size + 1)
                    near = [low[start[k] : end[k]] for k in range(a, min(n, pos + size))]
                    out.append((row, None, 0, pos, pos - a, int(hashes[pos].view(np.int64)), near))
            yield pd.DataFrame(out, columns=["_row", "doc_id", "n_words", "pos", "k", "token", "near"]).astype({"doc_id": "Int64"})

    rows = docs.select(row_key().alias("_row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))
    rows = stored(rows.mapInPandas(cut, "_row long, doc_id long, n_words long, pos int, k int, token long, near array<binary>"), "places")
    begin = F.col("k") - F.col("at")
    fits = (begin >= 0) & (begin + F.col("n") <= F.size("near"))  # positional and length bounds
    met = rows.where("pos >= 0").join(prefixed, "token").where(fits)
    same = F.transform(F.slice("near", begin + 1, F.col("n")), lambda x: F.hex(x))
    met = met.where(F.array_join(same, "20") == F.hex("words"))
    hits = stored(met.select("_row", (F.col("pos") - F.col("at")).alias("at"), "n", "window"), "hits")
    w = Window.partitionBy("_row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("at"), F.coalesce(F.max(F.col("at") + F.col("n")).over(w), F.lit(0)))
    covered = hits.withColumn("new", F.greatest(F.lit(0), F.col("at") + F.col("n") - reached)).groupBy("_row").agg(F.sum("new").alias("n_hit"))
    named = holders.where("item is not null").join(windows, ["words", "n"]).select("window", "item")
    items = hits.select("_row", "window").distinct().join(named, "window").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Only rows that are hit meet their hits: all others have none, and need no key there.
    told = stored(covered.join(items, "_row", "left"), "told")
    out = rows.where("pos < 0").select("_row", "doc_id", "n_words").join(told, "_row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _weight(holders: DataFrame) -> int:
    """Bytes of all windows and of the names of the items that hold them."""
    return holders.agg(F.coalesce(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0))).first()[0]


def _local(docs: DataFrame, holders: DataFrame, text: str) -> tuple[list[tuple[bytes, list[str]]], dict[int, int]]:
    """The windows with their items on the driver, which ``index_bytes`` bounds, and counts of their words in all documents."""
    items: dict[bytes, list[str]] = {}
    for r in holders.collect():
        items.setdefault(bytes(r.words), []).extend([] if r["item"] is None else [r["item"]])
    known = np.array(sorted({_word_hash(w) for body in items for w in set(body.split(b" "))}), np.uint64)
    counts = _word_counts(docs, _sent_filter(known), text, known)  # a row for each word of the windows at most
    return sorted(items.items()), {r.token % 2**64: r["count"] for r in counts.collect()} if len(known) else {}


def _is_contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def uncontaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text", item: str = "item_id", item_text: str = "text", index_bytes: int = 64 << 20
) -> DataFrame:
    """``docs`` without the contaminated rows, with all their columns.

    With the index in memory a row is judged where it is read and nothing is
    shuffled; beyond ``index_bytes`` the rows are numbered, stored and met by
    the verdicts of the shuffle join.
    """
    holders = stored(item_windows(benchmark, size, item, item_text), "items")
    if _weight(holders) <= index_bytes:
        shipped = docs.sparkSession.sparkContext.broadcast(_local(docs, holders, text))

        @F.pandas_udf("boolean")
        def contaminated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = _Index(*shipped.value)
            for batch in batches:
                got = [index.find(body)[:2] if body is not None else (0, 0) for body in batch]
                yield pd.Series([hit > 0 and 20 * hit >= words for words, hit in got], dtype=bool)

        return docs.where(~contaminated(F.col(text)))
    whole = stored(docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "documents")
    judged = decontaminate(whole.select("key", F.col(f"doc.`{text}`").alias("text")), benchmark, size, "key", "text", item, item_text, index_bytes)
    gone = judged.where("contaminated").select(F.col("doc_id").alias("key"))
    return whole.join(gone, "key", "left_anti").select("doc.*")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    index_bytes: int = 64 << 20,
) -> DataFrame:
    """Each document's words, those inside a benchmark window's occurrence, and the ``items`` found, sorted.

    A window is ``size`` consecutive item words; a shorter item is one window.
    Full containment needs every word of a window, so its prefix is one token:
    the rarest by counts over all documents (ties: the smaller hash, then the
    first place). Where that token stands in a document, position and length
    bounds apply, then the words are compared.

    The index of windows is sent to all executors only if their words and the
    items' names take at most ``index_bytes``; beyond that, the same prefix
    tokens are the key of a shuffle join with the same result. Null and empty
    texts have no words; texts of any length are read whole; an item without
    words has no window; windows of an item whose id is null count as hits but
    name no item. Repeated rows are each judged for themselves, repeated items
    are one. Only the four named columns are read, so others may have any name.
    Empty tables are fine.
    """
    holders = stored(item_windows(benchmark, size, item, item_text), "items")
    if _weight(holders) <= index_bytes:
        found = _indexed(docs, *_local(docs, holders, text), key, text)
    else:
        found = _shuffled(docs, holders, size, key, text)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", _is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 11, 2))) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM win),
at AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)
),
hit AS (SELECT r, i, n, item_id FROM at JOIN win USING (n, g)),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
item AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)
""".replace("at AS (", "placed AS (").replace("FROM at JOIN", "FROM placed JOIN")
