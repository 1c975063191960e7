"""Personal data: exact patterns, and terms that reveal them by corpus co-occurrence. SQL functions only.

The terms follow information-theoretic sanitisation (Sanchez and Batet, 2016):
a term discloses an entity as far as their pointwise mutual information reaches
the entity's information content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import bounded, row_key, stored
from tracewright.llm.spans import matches, replaced, told

#: The contract's patterns. Possessive forms and anchors at the start of a run
#: change no match; they keep long runs linear and off the matcher's stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: A character that every match holds, to spare other texts the search.
_HOLDS = {"email": "@", "phone": "+"}
_BYTE_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
TERM = r"\p{L}++"
_SPAN = "\u0003"
_NO_SPANS = "cast(array() as array<struct<s:int,n:int,e:int,k:string>>)"

#: Standard deviations below the observed rate at which a term is taken to tell its entity: one error in twenty.
DEVIATIONS = 1.645
#: Chances of the entity, given the term, from which terms are generalised (1.32 bits of its information are left open) and removed (0.42 bits).
GENERALISED, REMOVED = 0.4, 0.75
#: Share of the entity's information that a term must disclose in any case, so that entities of very many texts aren't told by all words.
SHARE = 0.5
#: Texts that a pair needs at least: b of b texts prove b / (b + DEVIATIONS ** 2).
_LEAST = DEVIATIONS**2 * GENERALISED / (1 - GENERALISED)
#: Bytes of revealing terms, of what is sought in texts and of what was found there, and keys of repeated texts and of such terms, up to which they are sent to all executors; beyond, a shuffle.
SENT_BYTES, SENT_KEYS = 32 << 20, 2_000_000
#: Revealing words of a text up to which it is searched for them alone; of texts with more, all words are looked up in a join.
SOUGHT = 32


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _kept(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(_BYTE_PARTS)
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _spans(body: Column, kind: str) -> Column:
    """array<struct<n, s, e, k, m>>: the kind's place, the span, the kind, and the entity it names."""
    return F.transform(
        F.filter(matches(body, PATTERNS[kind], F.contains(body, F.lit(_HOLDS[kind])) if kind in _HOLDS else None), lambda x: _kept(kind, x.m)),
        lambda x: F.struct(
            F.lit(KINDS.index(kind)).alias("n"),
            x.s.alias("s"),
            x.e.alias("e"),
            F.lit(kind).alias("k"),
            F.concat(F.lit(f"{kind}:"), F.lower(x.m)).alias("m"),
        ),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x.k == kind)).cast("long").alias(f"n_{kind}")


def _masked(body: Column, base: Column) -> Column:
    """The text with each character of a base span as a mark, so that places stay and only words outside spans are left."""
    plain = F.replace(body, F.lit(_SPAN), F.lit(" "))
    return replaced(plain, F.array_sort(F.transform(base, _plain)), lambda x, done: F.repeat(F.lit(_SPAN), F.greatest(x.e - F.greatest(x.s, done), F.lit(0))))


def _read(docs: DataFrame, key: str, text: str, whole: bool) -> DataFrame:
    """Each row's text, spans and words outside them; with ``whole`` also the row itself. Stored but for the words."""
    body = F.coalesce(F.col(text), F.lit(""))
    spans = [_spans(body, kind) for kind in KINDS]
    rows = docs.select(
        row_key().alias("_row"),
        F.col(key).alias("doc_id"),
        body.alias("body"),
        F.concat(*spans).alias("base"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []),
    )
    rows = stored(rows.select("_row", "doc_id", "base", F.xxhash64("body").alias("copy"), "doc" if whole else "body"), "personal")
    if whole:
        rows = rows.withColumn("body", F.coalesce(F.col(f"doc.`{text}`"), F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(_masked(F.col("body"), F.col("base")), F.lit(TERM), F.lit(0)))
    return rows.withColumn("words", words)


def _different(rows: DataFrame) -> DataFrame:
    """The first row of each text. Only keys meet, so that texts stay in place."""
    firsts = rows.groupBy("copy").agg(F.min("_row").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.select("_row", "copy").join(firsts, "copy").where("_row <> first").select("_row")
    return rows.join(bounded(again, "again", SENT_KEYS), "_row", "left_anti")


def _judged(rows: DataFrame) -> DataFrame:
    """``entity``, ``term``, ``given``, ``share``: the pairs that meet in a text and can reveal, by counts over all different texts.

    By the bound, no pair of fewer than ``_LEAST`` texts and no term of more
    than 1 / ``GENERALISED`` times an entity's texts can reach a threshold.
    Such entities and terms are left out before anything meets, and only words
    beside the entities that are left are counted.
    """
    terms = F.explode(F.array_distinct(F.transform("words", F.lower))).alias("term")
    texts = _different(rows)
    n = F.lit(float(max(1, texts.count())))
    seen = texts.where("size(base) > 0").select("copy", F.explode(F.array_distinct("base.m")).alias("entity"))
    entities = seen.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= _LEAST)
    seen = stored(seen.join(entities, "entity"), "entities")
    most = seen.groupBy("copy").agg((F.max("n_entity") / GENERALISED).alias("most"))
    top = most.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]
    beside = texts.where("size(base) > 0").join(most, "copy").select("copy", "most", terms)
    beside = stored(beside.withColumn("hash", F.xxhash64("term")), "beside")
    # Hashes take less room than terms: most words go before any shuffle.
    hashes = bounded(beside.select("hash").distinct(), "hashes", SENT_KEYS)
    counts = texts.select(terms).withColumn("hash", F.xxhash64("term")).join(hashes, "hash", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    counts = bounded(counts.where(F.col("n_term").between(_LEAST, top)), "counts", SENT_BYTES, F.octet_length("term") + 32)
    near = beside.join(counts, "term").where("n_term <= most").select("copy", "term", "n_term")
    met = seen.join(near, "copy").where(F.col("n_term") * GENERALISED <= F.col("n_entity"))
    pairs = met.groupBy("entity", "n_entity", "term", "n_term").agg(F.count("*").alias("both")).withColumn("given", _given())
    known = -F.log2(F.col("n_entity") / n)
    return pairs.select("entity", "term", "given", ((F.log2("given") + known) / F.nullif(known, F.lit(0.0))).alias("share"))


def _given() -> Column:
    """Wilson's lower bound of the rate at which texts with the term hold the entity: few texts prove less than many."""
    m, rate, z = F.col("n_term"), F.col("both") / F.col("n_term"), F.lit(DEVIATIONS)
    spread = F.sqrt(rate * (1 - rate) / m + z * z / (4 * m * m))
    return (rate + z * z / (2 * m) - z * spread) / (1 + z * z / m)


def _revealing(rows: DataFrame) -> DataFrame:
    """``entity``, ``term``, ``k``: pairs whose disclosure reaches a threshold."""
    k = F.when(F.col("given") >= REMOVED, "removed").when(F.col("given") >= GENERALISED, "generalised")
    return _judged(rows).where(F.col("share") >= SHARE).select("entity", "term", k.alias("k")).where("k is not null")


def _added(rows: DataFrame) -> DataFrame:
    """The rows with ``added``: spans of terms that reveal any entity of the corpus, in every text."""
    risky = stored(_revealing(rows).groupBy("term").agg(F.max("k").alias("k")), "risky")  # of several entities the strongest measure
    words = rows.select("_row", F.explode("words").alias("word")).withColumn("term", F.lower("word")).withColumn("hash", F.xxhash64("term"))
    # Hashes take less room than terms: most words go before any shuffle.
    hashes = bounded(risky.select(F.xxhash64("term").alias("hash")).distinct(), "hashes", SENT_KEYS)
    found = words.join(hashes, "hash", "left_semi").join(bounded(risky, "risky", SENT_BYTES, F.octet_length("term") + 32), "term")
    found = stored(found.select("_row", "word", "term", "k"), "found")
    # The class that a term is generalised to: a name, if most texts write it with a capital.
    names = found.where("k = 'generalised'").groupBy("term").agg((2 * F.count_if(F.col("word").rlike(r"^\p{Lu}")) >= F.count("*")).alias("name"))
    names = bounded(names.where("name"), "names", SENT_BYTES, F.octet_length("term") + 32)
    found = found.join(names, "term", "left").select("_row", "word", F.when(F.col("name"), "generalised_name").otherwise(F.col("k")).alias("k"))
    # Most texts hold few such words, and only these are sought; words are letters alone, so nothing is quoted.
    listed = found.groupBy("_row").agg(F.collect_list("word").alias("listed"))
    few = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("listed", "|"), F.lit(r")(?!\p{L})"))
    pattern = F.when(F.size("listed") <= SOUGHT, few).otherwise(F.lit(TERM))
    held = rows.join(bounded(listed.select("_row", pattern.alias("pattern")), "listed", SENT_BYTES, F.octet_length("pattern") + 32), "_row")
    spots = held.select("_row", F.explode(matches(_masked(F.col("body"), F.col("base")), F.col("pattern"))).alias("x"))
    added = spots.select("_row", "x.s", "x.e", F.col("x.m").alias("word")).join(found, ["_row", "word"]).groupBy("_row")
    added = added.agg(F.array_sort(F.collect_list(F.struct("s", F.lit(len(KINDS)).alias("n"), "e", "k"))).alias("added"))
    return rows.join(bounded(added, "added", SENT_BYTES, F.size("added") * 48 + 32), "_row", "left").withColumn("added", F.coalesce("added", F.expr(_NO_SPANS)))


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """Personal data in every whole text, as code point spans; with ``whole`` also the row as ``doc`` and its ``clean`` text.

    Base spans are emails, IP addresses, cards and phones; the matched string is
    an entity. Its terms are the words (runs of letters) outside base spans of
    all texts that hold it. Each such pair is judged, over all different texts,
    by Wilson's lower bound of the entity's rate among the term's texts: the
    pointwise mutual information that is proven is the entity's information
    less what this chance leaves open. It counts from ``SHARE`` of that
    information on. From a chance of ``GENERALISED`` it adds a span
    ``generalised``, or ``generalised_name`` for a term that at least half of
    its texts write with a capital, from ``REMOVED`` on ``removed``, wherever
    the term occurs, also in texts without the entity. What is proven depends
    on the texts of the pair, not on the corpus's size: a word of one text
    alone reveals nothing, a name beside its entity in two texts and in no
    other does.

    In ``clean`` a base span is replaced by its kind in angle brackets, a
    generalised term by its class, ``<name>`` or ``<term>``; removed terms go. Null texts count as empty
    (``clean`` stays null). Repeated rows are judged each for itself; copies of
    a text are no further support. Ties of two measures go to ``removed``. The
    work grows with a text's length and with its spans, not with their product;
    only recurring entities and rare terms of a text meet as pairs, in a join
    that is counted as it goes. Nothing is cut. Only the named columns are read, so others may have any
    name. An empty table gives no rows.
    """
    rows = _added(_read(docs, key, text, whole))
    base = F.array_sort("base")
    out = rows.select(
        "doc_id",
        *[_count(kind) for kind in KINDS],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.concat(F.transform(base, _plain), "added")).alias("spans"),
        F.size("added").cast("long").alias("n_terms"),
        *(["doc", _cleaned(F.col("body"), F.array_sort(F.concat(F.transform("base", _plain), "added"))).alias("clean")] if whole else []),
    )
    return out.withColumn("clean", F.when(F.col(f"doc.`{text}`").isNotNull(), F.col("clean"))) if whole else out


def _plain(x: Column) -> Column:
    return F.struct(x.s.alias("s"), x.n.alias("n"), x.e.alias("e"), x.k.alias("k"))


def _mark(k: Column) -> Column:
    return F.when(k == "removed", F.lit("")).when(k == "generalised_name", F.lit("<name>")).when(k == "generalised", F.lit("<term>")).otherwise(F.concat(F.lit("<"), k, F.lit(">")))


def _cleaned(text: Column, spans: Column) -> Column:
    return replaced(text, spans, lambda x, done: F.when(x.s >= done, _mark(x.k)).otherwise(F.lit("")))


def op4_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
