"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bounded training sample: so many rows of a language, so much of each text, and of all this so many bytes as dictionary.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 1500, 160_000
#: Bytes of text encoded at a time, each time with the dictionary alone before it.
BLOCK_BYTES = 4096
LEVEL = 6
#: Every block is encoded so many times in a row: the first costs what the dictionary leaves, the others next to nothing, and
#: the few bytes of a short one are not stored as they are, so that its matches in the dictionary count.
REPEATS = 4
#: A prediction is accepted if the best size is smaller than the next by this share of the next.
MARGIN = 0.002
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, most frequent language first, so that ties go to it."""

    dictionaries: tuple[tuple[str, bytes], ...]


_compressors: dict[Model, list[tuple[str, zstandard.ZstdCompressor]]] = {}


def _letters(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def _compressors_of(model: Model) -> list[tuple[str, zstandard.ZstdCompressor]]:
    if model not in _compressors:
        _compressors.clear()  # a worker outlives a model
        made = []
        for lang, body in model.dictionaries:
            d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **options)))
        _compressors[model] = made
    return _compressors[model]


def predict(text: str | None, model: Model, margin: float = MARGIN) -> tuple[str, float, bool]:
    """(language, score, accepted). The whole text counts, in blocks, so that a long text can't become its own dictionary."""
    body = _letters(text or "")
    if not any(c.isalpha() for c in body) or not model.dictionaries:
        return UNKNOWN, 0.0, False
    raw = body.encode("utf-8", "surrogatepass")
    blocks = [b" ".join([raw[a : a + BLOCK_BYTES]] * REPEATS) for a in range(0, len(raw), BLOCK_BYTES)]
    sizes = [(sum(len(z.compress(b)) for b in blocks), i, lang) for i, (lang, z) in enumerate(_compressors_of(model))]
    sizes.sort()
    best = sizes[0][0]
    scale = max(2.0, 0.02 * best)
    score = 1 / sum(math.exp((best - n) / scale) for n, _, _ in sizes)
    apart = 1.0 if len(sizes) < 2 else (sizes[1][0] - best) / sizes[1][0]
    return sizes[0][2], score, apart >= margin


def is_held_out(key: Column) -> Column:
    """True for the quarter of the documents, by CRC-32 of the id's text, from which nothing is learned."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Dictionaries from labelled documents that aren't held out: the ``SAMPLE_ROWS`` of each language with the least hashes.

    Each language's rows are counted first, so that a bound on the hash leaves
    about twice as many as wanted where they are read. Only these are made
    distinct and reach the driver, a few hundred of a language whatever the
    size of the corpus; where copies leave too few, the bound is raised.
    A dictionary is the last ``DICTIONARY_BYTES`` of the sample's texts.
    """
    known = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull() & ~is_held_out(F.col(key)))
    rows = known.select(
        F.col(lang).alias("lang"), F.substring(text, 1, SAMPLE_CHARS).alias("body"), F.xxhash64(F.col(key), F.col(text)).alias("h")
    )
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    rates = {r.lang: min(1.0, 2 * SAMPLE_ROWS / r["count"]) for r in counts}
    bodies: dict[str, dict[str, None]] = {r.lang: {} for r in counts}
    todo = set(rates)
    while todo:
        bounds = docs.sparkSession.createDataFrame([(x, min(2**63 - 1, int(rates[x] * 2**64) - 2**63)) for x in sorted(todo)], "lang string, most long")
        found: dict[str, list[tuple[int, str]]] = {x: [] for x in todo}
        for r in rows.join(F.broadcast(bounds), "lang").where("h <= most").select("lang", "h", "body").distinct().collect():
            found[r.lang].append((r.h, r.body))
        for x, sample in found.items():
            if len(sample) >= SAMPLE_ROWS or rates[x] == 1:
                todo.discard(x)
                bodies[x] = {_letters(body): None for _, body in sorted(sample)[:SAMPLE_ROWS]}  # copies count once
            rates[x] = min(1.0, 8 * rates[x])
    packed = {k: " ".join(v).encode("utf-8", "surrogatepass")[-DICTIONARY_BYTES:] for k, v in bodies.items()}
    return Model(tuple((k, v) for k, v in packed.items() if len(v) >= 8))


def predicted(text: Column, model: Model, spark: SparkSession, margin: float = MARGIN) -> Column:
    """``struct<lang_pred, score, accepted>`` of a text column."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([predict(x, sent.value, margin) for x in batch], columns=["lang_pred", "score", "accepted"])

    return judge(text)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", margin: float = MARGIN) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``accepted`` for every document.

    Null texts and texts without a letter are ``und`` with score 0 and not
    accepted; so is every text if nothing could be learned. Upper case, digits
    and marks don't count. A text of any length counts whole, in blocks, all of
    them encoded the same way. Ties go to the more frequent language and are not
    accepted. A null id is not held out and nothing is learned from it.
    Repeated rows get the same answer; only the named columns are read, so
    others may have any name; an empty table gives no rows.
    """
    model = fit(docs, key, text, lang)
    out = docs.select(F.col(key).alias("doc_id"), is_held_out(F.col(key)).alias("held_out"), predicted(F.col(text), model, docs.sparkSession, margin).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")


def op5_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
