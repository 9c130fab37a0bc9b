"""Columns of any name pass through the operators that keep all columns."""

import pytest
from pyspark.sql import functions as F

from lotline.llm import jaccard, mixing, quality, suffixes
from lotline.llm.common import first_by_hash

NAMES = ["__id", "__key", "__gone", "__i", "__k", "__n", "__text", "__quality_score", "__tokens", "__p", "__copies", "__copy", "row", "id", "key", "n", "copies", "copy", "mark"]


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(d, f"{base} {d}" if d < 4 else f"other text number {d} " * 5, "en" if d % 2 else "de") for d in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *[(F.col("doc_id") * 100 + i).alias(c) for i, c in enumerate(NAMES)]).cache()


def kept(rows, replaced=()):
    assert rows
    for r in rows:
        assert all(r[c] == r.doc_id * 100 + i for i, c in enumerate(NAMES) if c not in replaced)


def test_jaccard_keeps_columns(docs):
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    kept(rows)
    assert sorted(r.doc_id for r in rows if r.doc_id < 4) == [0]


def test_quality_keeps_columns(docs, spark):
    labels = spark.createDataFrame([(d, d % 2) for d in range(12)], "doc_id long, quality int")
    out = quality.keep_good(docs, labels, least=0.0)
    assert out.columns == docs.columns and out.count() == 12
    kept(out.collect())


def test_mixing_keeps_columns(docs):
    out = mixing.resample(docs, docs.select("doc_id", F.col("lang").alias("domain")), least=1.0)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 12
    kept(out.collect())


def test_suffixes_keep_columns(docs):
    rows = suffixes.drop_repeated(docs).collect()
    kept(rows)
    assert sum(len(r.gone) for r in rows) >= 3 and all(r.n_bytes >= len(r.kept) for r in rows)


def test_first_by_hash_is_the_head_of_the_order(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 7)
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(600).collect()]
    assert sorted(r.id for r in first_by_hash(df, 600, "id").collect()) == sorted(want)
    assert first_by_hash(df, 10_000, "id").count() == 5000 and first_by_hash(df.limit(0), 5, "id").count() == 0
