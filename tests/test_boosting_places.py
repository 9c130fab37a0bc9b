"""Every model is grown in a task of its own, the longest ones first."""

import io
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from lotline.operators import boosting
from lotline.operators.boosting import Model, Trees

SMALL = Trees(2, 0.3, 2, 1.0, 0.8, 0.8)


def _blocks(spark):
    rows = spark.range(900).select(
        F.when(F.col("id") < 600, "long").otherwise("short").alias("dataset"), F.lit("train").alias("role"), "id",
        (F.col("id") % 17).cast("double").alias("label"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"))
    specs = boosting.layouts(rows, ["x", "z"], [])
    return boosting.blocks(rows, specs, 100).localCheckpoint(), specs


def test_one_model_a_task_longest_first(spark, monkeypatch):
    made, specs = _blocks(spark)
    models = [Model(f"{d}#{k}", d, replace(SMALL, n_estimators=k, seed=k)) for k in range(1, 9) for d in ("short", "long")]
    kept = []
    monkeypatch.setattr(boosting, "materialize", lambda df, name: kept.append(df.withColumn("task", F.spark_partition_id()).localCheckpoint()) or kept[-1].drop("task"))
    forests = boosting.fit(made, specs, models)
    task = {r.model: r.task for r in kept[0].select("model", "task").collect()}
    assert sorted(task.values()) == list(range(len(models)))
    work = {m.name: (600 if m.dataset == "long" else 300) * m.trees.n_estimators for m in models}
    assert [work[m] for m in sorted(task, key=task.get)] == sorted(work.values(), reverse=True)
    # the same trees as from the rows themselves
    for r in forests.collect():
        m = next(m for m in models if m.name == r.model)
        layout, at = boosting.layout_of(specs[m.dataset], None)
        got = made.where(F.col("dataset") == m.dataset).toPandas()
        cells = np.concatenate([boosting._cells_of(b, n, at, layout) for b, n in zip(got["bins"], got["n"], strict=True)])
        base, trees = boosting.grow(cells, np.frombuffer(b"".join(got["y"])), np.frombuffer(b"".join(got["ids"]), dtype=np.int64), layout, m.trees)
        assert bytes(r.forest) == boosting.pack_forest(base, trees) and r.n_trees == m.trees.n_estimators


def test_no_models(spark):
    made, specs = _blocks(spark)
    assert boosting.fit(made, specs, []).count() == 0


def test_models_of_a_block_are_scored_in_several_tasks(spark):
    made, specs = _blocks(spark)
    one = made.where("dataset = 'short' and block = 0")
    models = [Model(f"short#{k}", "short", replace(SMALL, seed=k)) for k in range(12)]
    forests = boosting.fit(made, specs, models)
    got = boosting.score(one, specs, forests).withColumn("task", F.spark_partition_id()).toPandas()
    assert got.groupby("task")["model"].nunique().max() < 12 and got["task"].nunique() > 2
    n = one.first()["n"]
    assert len(got) == 12 * n and not got.duplicated(["model", "id"]).any()
    # as one model after the other gives them
    r = one.first()
    for f in forests.collect():
        layout, at = boosting.layout_of(specs["short"], None)
        want = boosting.margins(np.load(io.BytesIO(bytes(f.forest))), boosting._cells_of(r.bins, r.n, at, layout), layout)
        mine = got[got["model"] == f.model].set_index("id")["log_pred"]
        assert np.array_equal(mine.loc[np.frombuffer(r.ids, dtype=np.int64)].to_numpy(), want)
