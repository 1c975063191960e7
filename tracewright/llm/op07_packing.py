"""Best-fit packing of tokenised documents after a Martello-Toth dominance reduction, planned on a histogram of lengths."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import numbered, stored

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part long, _nth long"
#: Words whose ids a worker remembers; later words are looked up each time.
REMEMBERED_WORDS = 100_000

_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾", "\t-\r \u0085\u00a0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_FAR = re.compile("[İƀ-\U0010ffff]")


class Ids(dict):
    """A word's ids as little-endian bytes, by the vocabulary's own merges; words met again are remembered.

    Below U+0180 without the dotted I, NFC changes nothing, lower-casing is by
    character, and the pre-tokenizer's classes are the ones above. Other texts,
    and those that may hold a special token, go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model.tokenize
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The character that stands for each byte of a word; bytes from 0xC0 on are alike in every character.
        self.stands = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(128)}
        for c in range(0x80, 0x180):
            pair = byte_level.pre_tokenize_str(chr(c))[0][0]
            self.stands.update(zip(chr(c).encode(), pair, strict=True))

    def __missing__(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.stands)
        ids = array("I", [x.id for x in self.merges(mapped)])
        if sys.byteorder != "little":
            ids.byteswap()
        ids = ids.tobytes()
        if len(self) < REMEMBERED_WORDS:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            near = True
        except UnicodeEncodeError:
            near = not _FAR.search(text)
        if near and "<|" not in text:
            return b"".join(map(self.__getitem__, _WORDS.findall(text.lower())))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_loaded: dict[str, Ids] = {}


def pieces(docs: DataFrame, path: str, size: int, key: str, text: str) -> DataFrame:
    """Each document's pieces, with a count of earlier pieces of the same length in the same partition."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _loaded.get(path) or _loaded.setdefault(path, Ids(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            out = []
            for doc, body in zip(batch["doc_id"].tolist(), batch["body"], strict=True):
                raw = (ids.of(body) if body else b"") + bytes(4)
                for k, a in enumerate(range(0, len(raw), 4 * size)):
                    one = raw[a : a + 4 * size]
                    n = len(one) // 4
                    out.append((doc, k, a // 4, n, zlib.crc32(one), part, seen[n]))
                    seen[n] += 1
            got = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth"])
            yield got.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInPandas(cut, _PIECES)


class _Plan:
    """Which ranks of each length go to which sequences: rows of (length, first, last, sequence, each, offset).

    Ranks ``first`` to ``last`` (exclusive) of a length fill sequences from
    ``sequence`` on, ``each`` of them in one sequence, from ``offset`` on.
    """

    def __init__(self, counts: dict[int, int], size: int) -> None:
        self.left = dict(sorted((n, c) for n, c in counts.items() if c))
        self.lengths = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)
        self.size, self.next, self.rows = size, 0, []

    def take(self, length: int, bins: int, each: int, sequence: int, offset: int) -> None:
        n, first = bins * each, self.used[length]
        self.rows.append((length, first, first + n, sequence, each, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.remove(length)

    def fix(self, a: int, b: int | None, bins: int) -> None:
        """Close ``bins`` sequences that hold one piece of length a and, if given, one of length b."""
        sequence, self.next = self.next, self.next + bins
        if b == a:
            self.take(a, bins, 2, sequence, 0)
            return
        self.take(a, bins, 1, sequence, 0)
        if b:
            self.take(b, bins, 1, sequence, a)

    def reduce(self) -> None:
        """Martello and Toth's reduction: fix sets that dominate every other set with the same largest piece.

        For the piece j: alone, if nothing fits beside it; with the largest k
        that fits, if k fills the rest, or no two others fit, or at most two do
        and no pair of them is longer than k. Then whatever stood beside j could
        stand in k's place, so the set can be fixed for all pieces of these
        lengths at once. Passes go on until one fixes nothing.
        """
        again = True
        while again:
            again = False
            for j in sorted(self.lengths, reverse=True):
                while self.left.get(j):
                    k = self._beside(j)
                    if k is None:
                        self.fix(j, None, self.left[j])
                    elif k and self._dominates(j, k):
                        self.fix(j, k, self.left[j] // 2 if k == j else min(self.left[j], self.left[k]))
                    else:
                        break
                    again = True

    def _beside(self, j: int) -> int | None:
        """The longest piece that fits beside j."""
        at = bisect_left(self.lengths, self.size - j + 1) - 1
        if at >= 0 and self.lengths[at] == j and self.left[j] < 2:
            at -= 1
        return self.lengths[at] if at >= 0 else None

    def _dominates(self, j: int, k: int) -> bool:
        rest = self.size - j
        if k == rest:
            return True
        least: list[int] = []
        for n in self.lengths:
            least += [n] * min(3 - len(least), self.left[n] - (n == j))
            if len(least) == 3:
                break
        if len(least) < 2 or least[0] + least[1] > rest:
            return True
        if len(least) == 3 and sum(least) <= rest:
            return False
        best, a, b = 0, 0, len(self.lengths) - 1
        while a <= b:  # the longest pair that fits, from both ends
            x, y = self.lengths[a], self.lengths[b]
            enough = self.left[x] - (x == j) - (a == b) > 0 and self.left[y] - (y == j) > 0
            if x + y > rest:
                b -= 1
            elif enough:
                best = max(best, x + y)
                a += 1
            elif self.left[x] - (x == j) > 0 and a < b:
                b -= 1
            else:
                a += 1
        return best <= k

    def best_fit(self) -> None:
        """Best fit, longest pieces first; sequences with the same content and room are one group."""
        rooms: list[int] = []  # sorted, each once
        groups: dict[int, list[tuple[int, int]]] = {}  # room to (first sequence, sequences)

        def put(room: int, sequence: int, bins: int) -> None:
            if bins and room:
                if room not in groups:
                    insort(rooms, room)
                groups.setdefault(room, []).append((sequence, bins))

        for length in sorted(self.lengths, reverse=True):
            while self.left[length]:
                at, count = bisect_left(rooms, length), self.left[length]
                if at < len(rooms):
                    room = rooms[at]
                    sequence, bins = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[at]
                else:
                    room, sequence = self.size, self.next
                    bins = -(-count // (room // length))
                    self.next += bins
                each = min(room // length, count)
                full = min(bins, count // each)
                self.take(length, full, each, sequence, self.size - room)
                put(room - each * length, sequence, full)
                put(room, sequence + full, bins - full)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """The whole plan for a histogram of lengths; as long as there are different lengths, times a small factor."""
    made = _Plan(counts, size)
    made.reduce()
    made.best_fit()
    return made.rows


def pack(docs: DataFrame, path: str, size: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's pieces and their places in sequences of at most ``size`` tokens.

    A document is its token ids and a final id 0; only one longer than ``size``
    is cut. Null and empty texts are the id 0 alone. Repeated rows are packed
    each for itself; an empty table gives no rows.

    Texts are tokenised once and stored as lengths and checksums. The plan is
    made from the number of pieces of each length, at most ``size`` numbers
    whatever the corpus, and says which ranks of a length go where. A piece's
    rank comes from its place in its partition and counts of earlier partitions.
    """
    rows = stored(pieces(docs, path, size, key, text), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = docs.sparkSession.createDataFrame(
        plan(counts, size), "length long, first long, last long, sequence long, each long, off long"
    )
    ranked = numbered(rows, ["length"], "_part", "_nth", "rank")
    here = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(made), "length")
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("sequence") + F.floor(here / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("off") + here % F.col("each") * F.col("length")).cast("long").alias("offset"),
        )
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
