"""A corpus pipeline of the operators in ``lotline.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner writes
it as Parquet and reads it again as the next stage's docs. All stages but the
last return the columns of ``documents``; ``n_chars`` follows the text.

Null texts count as empty in every stage. An empty table stays empty.

The pipeline's session hands Python workers ``BATCH_ROWS`` rows at once at most
(whole texts: a batch of Spark's 10,000 rows is held by the executor and by its
worker). A lower setting of the session stays. Results don't depend on it.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm import bpe, jaccard, lines, mixing, quality
from lotline.llm.common import read

BATCH_ROWS = 2_000


def small_batches(stage):
    """A stage in a session that hands few rows at once to Python workers."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:  # 0 or less: no bound
            spark.conf.set(name, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.5) go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


@small_batches
def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go from all documents but the first; so do
    documents of which nothing but white space is left by that."""
    gone = F.col(lines.number_names(docs)[1])
    made = lines.drop_repeated(docs).where((gone == 0) | (F.btrim("text", F.lit(" \t\n\r")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made = made.withColumn("n_chars", F.when(gone > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])


@small_batches
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more of their
    5-word shingles, the first stays."""
    return jaccard.keep_one(docs)


@small_batches
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that expected tokens match tempered shares of
    the languages; no rate is below one, so every document stays."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return mixing.resample(docs, labelled, least=1.0)


@small_batches
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every document."""
    coded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("jaccard", jaccard_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]
ORACLE_SQL = None  # SQL expresses neither the classifier nor the encoding


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
