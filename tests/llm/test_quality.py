"""Random-indexing sums against a plain loop; accuracy on held-out labels."""

import zlib

import numpy as np

from conftest import SF_SMALL
from lotline.llm import quality, queries

SF = SF_SMALL.replace("sf0.001", "sf0.01")


def test_context_vectors_equal_a_plain_loop(spark):
    docs = ["a b c a", "b  c\nd!! e", "", "ü"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = quality.context_vectors(df)
    places, signs = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIMS))
    for t in docs:
        w, _ = quality.words_of([t])
        for i, a in enumerate(w):
            for j in range(max(0, i - quality.WINDOW), min(len(w), i + quality.WINDOW + 1)):
                if i != j:
                    want[a, places[w[j]]] += signs[w[j]]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(norm > 0, norm, 1), atol=1e-6)


def test_words_split_by_kind_of_sign():
    w, doc = quality.words_of(["the cat!! 12", "", "the", "12 !!"])
    assert doc.tolist() == [0, 0, 0, 0, 2, 3, 3]
    assert w[0] == w[4] and w[2] == w[6] and w[3] == w[5]


def test_query_scores_held_out_labels(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op9_quality"](spark, SF).collect()}
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == n
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    held = [(rows[x.doc_id], x.quality) for x in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[x.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.93


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    from pyspark.sql import functions as F
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = (quality.fit(docs, x)[1].score(np.ones((1, 2 * quality.DIMS)))[0] for x in (labels, other))
    assert a == b


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, None, 3.0), (2, "", 4.0), (2, "x", None), (None, "x", 1.0)], "doc_id long, text string, score double")
    model = quality.fit(df, labels)
    rows = quality.score(df, model).collect()
    assert len(rows) == 4 and all(r.score == 1.0 for r in rows)
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.keep_good(df.limit(0), labels).count() == 0
    assert quality.score(df, quality.fit(df, labels.limit(0))).first().score == 0.5
