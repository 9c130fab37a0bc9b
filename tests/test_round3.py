"""Merged as-of joins, window medians by counting, comps in dense blocks, the composed
spine, versioned tables, split CSV files, documents as VARIANT."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lotline.operators import asof, score, spatial, trends
from lotline.sources import readers, sinks

D = dt.date


def test_asof_many_equals_a_plain_scan(spark):
    rng = random.Random(2)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 60))
    a = [(rng.randint(0, 5), day(), i, rng.choice([None, 1.0, 2.5])) for i in range(200)]
    b = [(rng.choice([0, 1, None]), day(), i, float(i)) for i in range(40)]
    spine = [(rng.randint(0, 7), day()) for _ in range(120)] + [(None, D(2020, 1, 1)), (1, None)]
    fa, fb = (spark.createDataFrame(x, "bbl int, day date, id int, v double") for x in (a, b))
    sides = [asof.Side("a", fa, F.date_add("day", 1), {"id": F.col("id"), "v": F.col("v")}, sums=("v",), mins=("id",)), asof.Side("b", fb, F.col("day"), {"id": F.col("id")})]
    got = {(r.bbl, r.as_of_date): r for r in asof.asof_many(spark.createDataFrame(spine, "bbl int, as_of_date date"), sides).collect()}
    assert set(got) == {x for x in spine if None not in x}
    for (k, d), r in got.items():
        before = [x for x in a if x[0] == k and x[1] < d]
        upto = [x for x in b if x[0] == k and x[1] <= d]
        assert (r.a_cnt, r.b_cnt) == (len(before), len(upto))
        newest = max(before, key=lambda x: (x[1], x[2]), default=None)
        assert (r.a and (r.a.id, r.a.v)) == (newest and (newest[2], newest[3])) and r.a_min_id == min((x[2] for x in before), default=None)
        assert r.a_sum_v == (pytest.approx(sum(x[3] or 0 for x in before)) if before else None)
        assert (r.b and r.b.id) == max(((x[1], x[2]) for x in upto), default=(None, None))[1]


def test_asof_many_takes_two_shuffles(spark):
    facts = spark.createDataFrame([(1, D(2020, 1, 1), 1.0)], "bbl int, day date, v double")
    sides = [asof.Side(n, facts, F.col("day"), {"v": F.col("v")}) for n in "abcd"]
    m = asof.asof_many(spark.createDataFrame([(1, D(2020, 2, 1))], "bbl int, as_of_date date"), sides)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bbl") <= 3 and "Join" not in plan  # the distinct keys have one of their own


@pytest.mark.parametrize("task_rows", [0, trends.TASK_ROWS])
def test_window_medians_equal_sorting(spark, task_rows, monkeypatch):
    monkeypatch.setattr(trends, "CELLS", 4)
    rng = random.Random(4)
    d0 = D(2020, 1, 1)
    rows = [(rng.choice(["a", "b", None]), d0 + dt.timedelta(days=rng.randint(0, 900)), rng.choice([5.0, 5.0, 7.25, rng.uniform(0, 1e6), -rng.random()])) for _ in range(900)]
    rows += [("a", d0 + dt.timedelta(days=400), 5.0)] * 50 + [("c", d0, 1.0), ("c", d0, None)]
    targets = [(g, d0 + dt.timedelta(days=rng.randint(0, 1300))) for g in ("a", "b", "c", None, "none") for _ in range(25)]
    sales = spark.createDataFrame(rows, "g string, day date, v double")
    asked = spark.createDataFrame(targets, "g string, t date")
    out = trends.rolling_quantiles(sales, asked, ["g"], "day", "v", "t", {"cur": (-365, -1), "prev": (-730, -366)}, task_rows=task_rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("Pandas" in plan) == (task_rows > 0) and (task_rows or "collect_list" not in plan)
    got = {(r.g, r.t): r for r in out.collect()}
    assert set(got) == set(targets)
    for (g, t), r in got.items():
        for name, lo, hi in (("cur", -365, -1), ("prev", -730, -366)):
            inside = [v for x, d, v in rows if x == g and v is not None and lo <= (d - t).days <= hi]
            assert r[f"{name}_count"] == len(inside)
            assert r[f"{name}_median"] == (pytest.approx(statistics.median(inside), rel=1e-12) if inside else None)


def comps_of(sales, target, k=5):
    lat, lon, day = target
    from math import asin, cos, radians, sin, sqrt

    def far(a, b, c, d):
        x = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
        return 12742.0 * asin(sqrt(x))

    near = sorted((far(lat, lon, la, lo), i, p, d) for i, d, la, lo, p in sales if p >= 100_000 and 1 <= (day - d).days <= 365)
    return [x for x in near if x[0] <= 5.0][:k]


def test_comps_in_a_dense_block_and_in_the_country(spark):
    rng = random.Random(9)
    d0 = D(2020, 1, 1)
    place = lambda: (40.7 + rng.random() * 1e-3, -73.9 + rng.random() * 1e-3) if rng.random() < 0.9 else (40.7 + rng.uniform(-0.3, 0.3), -73.9 + rng.uniform(-0.3, 0.3))
    sales = [(i, d0 + dt.timedelta(days=rng.randint(0, 800)), *place(), float(rng.choice([50_000, rng.randint(100_000, 900_000)]))) for i in range(1500)]
    df = spark.createDataFrame(sales, "sale_id long, sale_date date, latitude double, longitude double, sales_price double")
    df = df.withColumn("gross_sqft", F.lit(1000.0)).withColumn("as_of_date", F.date_sub("sale_date", 1)).withColumn("bbl", F.col("sale_id")).withColumn("comp_segment", F.lit("x"))
    got = {r.bbl: r for r in spatial.knn_temporal_comps(df, dense=0).collect()}
    assert got == {r.bbl: r for r in spatial.knn_temporal_comps(df, dense=10**9).collect()}
    for i, d, la, lo, _ in rng.sample(sales, 250):
        want = comps_of(sales, (la, lo, d - dt.timedelta(days=1)))
        if not want:
            assert i not in got
            continue
        r = got[i]
        assert r.comp_count == len(want) and r.comp_median_price == pytest.approx(statistics.median(x[2] for x in want))
        assert r.comp_search_dist_km == pytest.approx(want[-1][0], abs=1e-9) and r.comp_recency_days == min((d - dt.timedelta(days=1) - x[3]).days for x in want)


def test_comps_meet_few_candidates_in_a_block(spark):
    """20 000 sales in one block: the join yields some tens of candidates a target."""
    d0 = D(2020, 1, 1)
    k = F.col("id")
    df = spark.range(20_000).select(k.alias("sale_id"), F.date_add(F.lit(d0), (k % 700).cast("int")).alias("sale_date"), (F.lit(40.7) + F.rand(1) * 0.001).alias("latitude"),
                                    (F.lit(-73.9) + F.rand(2) * 0.001).alias("longitude"), F.lit(200_000.0).alias("sales_price"), F.lit(1000.0).alias("gross_sqft"), k.alias("bbl"), F.lit("x").alias("comp_segment"))
    df = df.withColumn("as_of_date", F.date_sub("sale_date", 1))
    made = spatial.knn_temporal_comps(df)
    assert made.where("comp_count = 5").count() > 19_000
    made.collect()
    rows = joined_rows(made)
    assert rows and max(rows) < 20_000 * 150


def joined_rows(df):
    """Output rows of all joins of an executed plan."""
    out = []

    def walk(p):
        name = p.nodeName()
        if "Join" in name and p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            walk(p.executedPlan())
        elif "QueryStage" in name:
            walk(p.plan())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_spine_is_counted_on_the_way(spark):
    from lotline.operators.spine import STEPS, build_spine

    rows = [("1", "1", "01 one family dwellings", "500000", "1950", "2020-01-05", "current"), ("1", "1", "01 ONE FAMILY DWELLINGS ", "500000.0", "1950", "2020-01-05", "historical"),
            ("1", "2", "21 OFFICE BUILDINGS", "500000", "1950", "2020-01-05", "current"), ("1", "x", "02 TWO FAMILY DWELLINGS", "n/a", "1950", "2020-01-05", "current"),
            ("1", "4", "02 TWO FAMILY DWELLINGS", "600000", "1700", "2020-01-05", "current"), ("1", "5", "07 RENTALS - WALKUP APARTMENTS", "90000", "1950", "2020-02-05", "current"),
            ("1", "6", "07 RENTALS - WALKUP APARTMENTS", "400000", "1950", "2020-02-06", "current"), ("2", "none", "03 THREE FAMILY DWELLINGS", "700000", "1950", "2020-02-06", "historical")]
    raw = spark.createDataFrame(rows, "block string, lot string, building_class string, sales_price string, year_built string, sale_date string, file_type string")
    raw = raw.withColumn("borough", F.lit(3)).withColumn("neighborhood", F.lit("N")).withColumn("total_units", F.lit("4")).withColumn("gross_sqft", F.lit("1,0")).withColumn("land_sqft", F.lit(None).cast("string")).withColumn("residential_units", F.lit("4"))
    spine, funnel = build_spine(raw)
    counts = {r.stage: r["rows"] for r in funnel.collect()}
    assert list(counts) == list(STEPS)
    assert [counts[s] for s in STEPS] == [8, 7, 5, 4, 3, 3, 2]
    got = {r.bbl: r for r in spine.collect()}
    assert set(got) == {"3000010001", "3000010006"} and got["3000010001"].file_type == "current" and got["3000010006"].segment == "rental_walkup"
    assert got["3000010001"].as_of_date == D(2020, 1, 4) and got["3000010001"].gross_sqft is None


def test_published_tables_survive_a_killed_writer(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, base)
    sinks.publish_parquet(spark.range(3), base)
    # a writer that died before it published
    spark.range(99).write.parquet(f"{base}/v-dead")
    assert sinks.read_published(spark, base).count() == 3

    bad = spark.range(10).select(F.raise_error(F.lit("died")).cast("long").alias("id"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish_parquet(bad, base)
    assert sinks.read_published(spark, base).count() == 3
    reader = sinks.read_published(spark, base)
    sinks.publish_parquet(spark.range(5), base)
    assert reader.count() == 3 and sinks.read_published(spark, base).count() == 5 and sinks.read_published(spark, base, 1).count() == 3
    left = sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v-"))
    assert len(left) == 2 and "v-dead" not in left


def test_bucketed_tables_join_without_a_shuffle(spark):
    from lotline.plans import source_queries

    plan = source_queries.q_sink_bucketed(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_files_are_split_inside_quotes(spark, tmp_path):
    import csv

    rng = random.Random(6)
    folder = tmp_path / "many"
    folder.mkdir()
    want = []
    for f in range(12):
        with open(folder / f"part-{f:02}.csv", "w", newline="") as out:
            out.write('a "preamble\n\nof three lines\n')
            names = ["id", "text", "n"] if f % 2 else ["n", "id", "text"]
            w = csv.writer(out, lineterminator="\r\n" if f % 3 == 0 else "\n")
            w.writerow(names)
            for i in range(rng.randint(0, 120) if f else 0):
                row = {"id": f"{f}-{i}", "n": rng.choice(["", "7"]), "text": rng.choice(["plain", 'a "quoted" word', "two\nlines", "x,y\n\n" * rng.randint(1, 40), '"', ""])}
                w.writerow([row[c] for c in names])
                want.append((row["id"], row["n"] or None, row["text"] or None))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "700", "64"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = readers.read_csv_skipping(spark, str(folder), 3)
            assert sorted(df.columns) == ["id", "n", "text"]
            assert sorted(((r.id, r.n, r.text) for r in df.collect()), key=lambda x: x[0]) == sorted(want, key=lambda x: x[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_documents_of_any_version_are_read(spark):
    rows = [(1, '{"a": {"b": 3}}'), (2, '{"a": {"b": "x"}}'), (3, '{"a": null}'), (4, "{broken"), (5, None), (6, '{"a": {"b": 2.75}, "z": []}')]
    v = spark.createDataFrame(rows, "id int, doc string").withColumn("v", F.try_parse_json("doc"))
    got = {r.id: r.b for r in v.select("id", score.document_field(F.col("v"), "$.a.b", "double", -1.0).alias("b")).collect()}
    assert got == {1: 3.0, 2: -1.0, 3: -1.0, 4: -1.0, 5: -1.0, 6: 2.75}


def test_document_blocks_and_explanations(spark):
    df = spark.createDataFrame([(1, 120_000.0, 100_000.0), (2, 90_000.4, 100_000.0)], "id int, predicted_price double, market_price double")
    df = score.score_predictions(df).withColumn("price_low", F.lit(None).cast("double")).withColumn("price_high", F.lit(None).cast("double")).withColumn("top_drivers", F.array(F.lit("x")))
    a, b = (r.analysis for r in score.analysis_document(df).orderBy("id").collect())
    assert a.investment_analysis.analysis_summary == "Property appears undervalued by approximately $20,000 based on model analysis."
    assert b.investment_analysis.analysis_summary == "Property may be overpriced by approximately $10,000 based on model analysis."
    assert a.explanation_status == "unavailable" and a.investment_analysis.recommendation == "Hold" and a.explanation.summary == "AI explanation unavailable"
    assert len(a.drivers.global_context) == 2 and [(f.factor, f.value) for f in a.drivers.explanation_factors] == [("predicted_price", 120_000.0), ("market_price", 100_000.0)]


def test_a_user_whose_role_changes_keeps_one_counter():
    import pandas as pd

    from lotline.streaming.counters import _admission

    class State:
        exists = hasTimedOut = False

        def update(self, x):
            self.kept = x

        def setTimeoutTimestamp(self, _):
            pass

        def getCurrentWatermarkMs(self):
            return 0

    t = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"user_id": 1, "event_id": range(30), "ts": [t + pd.Timedelta(minutes=i) for i in range(30)], "period_date": t.date(), "role": ["user"] * 12 + ["paid"] * 5 + ["user"] * 13})
    state = State()
    out = next(_admission()((1, t.date()), iter([rows.iloc[15:], rows.iloc[:15]]), state))
    assert out["admitted"].tolist() == [True] * 10 + [False] * 2 + [True] * 5 + [False] * 13 and state.kept == (15,)
