"""The corpus pipeline: language, near duplicates, contamination, personal data, packing.

Each stage takes (spark, docs, folder of the tables). All but the last return
the columns of ``documents``; what a stage decides takes effect in its rows.

All stages read whole texts of any length, judge repeated rows each for itself
(but for near duplicates, where that is the feature), keep further columns
whatever their names, and give no rows for an empty table. Stages with Python
workers set the session's Arrow batches to ``BATCH_ROWS`` and leave it so, as
their rows are computed only when they are written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import stored
from tracewright.llm.op04_pii import find_personal
from tracewright.llm.op05_language_id import fit, predicted
from tracewright.llm.op07_packing import pack
from tracewright.llm.op08_decontamination import uncontaminated
from tracewright.llm.op10_jaccard_join import one_of_each

#: Rows that go to a Python worker at once: with texts of megabytes, Spark's ten thousand would fill its memory.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin; null and empty texts and texts without letters go, as do ties."""
    _small_batches(spark)
    judged = docs.withColumn("_judged", predicted(F.col("text"), fit(docs), spark))
    return judged.where("_judged.accepted").drop("_judged")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, in the order of the stored rows, of each group of near duplicates.

    Repeated rows and copies are one group; null texts and texts without words
    are no duplicates of each other and all stay.
    """
    _small_batches(spark)
    return one_of_each(docs)


def without_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages beyond the contract's share; exactly that share goes.

    Null and empty texts hold none and stay; an empty benchmark leaves all.
    """
    _small_batches(spark)
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and revealing terms replaced in their texts; null texts stay null, ``n_chars`` is counted anew."""
    found = find_personal(docs, whole=True)
    columns = [
        F.col("clean").alias("text")
        if c == "text"
        else F.length("clean").cast("long").alias("n_chars")
        if c == "n_chars"
        else F.col(f"doc.`{c}`").alias(c)
        for c in docs.columns
    ]
    return found.select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left; null and empty texts are the end token alone."""
    _small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_contamination),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Compression sizes, full-set Jaccard components and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
