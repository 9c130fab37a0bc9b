"""Hand-made fixtures for the semantic traps of the survey (sections 2.11 and
8) and the reference's own test vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotline.functions import features as FT
from lotline.functions import geo, keys, scoring
from lotline.operators import asof, clean, columns, ranking, spatial, trends, usage
from lotline.sources import sinks

D = dt.date
T = dt.datetime


# ------------------------------------------------------------------ as-of
def test_event_history_strictly_before_and_time_part(spark):
    spine = spark.createDataFrame([(1, D(2020, 5, 10)), (1, D(2020, 5, 10)), (2, D(2020, 1, 1))], "bbl long, as_of_date date")
    ev = spark.createDataFrame([
        (10, 1, T(2020, 5, 10, 0, 0), 100.0),   # on the as_of day: excluded
        (11, 1, T(2020, 5, 9, 15, 30), 200.0),  # day before with a time part: included, days_since floors to 0
        (12, 1, T(2019, 1, 1), 50.0),
        (13, 2, T(2020, 1, 2), 70.0),           # after as_of: excluded
    ], "document_id long, bbl long, document_date timestamp_ntz, document_amt double")
    out = {r.bbl: r for r in asof.asof_event_history(spine, ev).collect()}
    assert len(out) == 2  # duplicated spine key reduced to distinct keys
    assert out[1].deed_cnt == 2 and out[1].deed_last_document_amt == 200.0
    assert out[1].deed_days_since_last == 0
    assert out[2].deed_cnt == 0 and out[2].deed_last_date is None


def test_latest_version_period_tiebreak(spark):
    spine = spark.createDataFrame([(1, D(2021, 3, 1)), (1, D(2020, 12, 31))], "bbl long, as_of_date date")
    rolls = spark.createDataFrame([
        (1, 2021, "TENTATIVE", 10), (1, 2021, "FINAL", 30), (1, 2021, "ACTUAL", 20), (1, 2020, "FINAL", 5),
    ], "bbl long, year int, period string, v int")
    rank = F.when(F.col("period") == "FINAL", 3).when(F.col("period") == "ACTUAL", 2).otherwise(1)
    out = {r.as_of_date: r for r in asof.asof_latest_version(spine, rolls, order=[rank], carry=("v",)).collect()}
    assert out[D(2021, 3, 1)].roll_v == 30  # same year: FINAL wins; year known from Jan 1 (<=)
    assert out[D(2020, 12, 31)].roll_v == 5


def test_cumulative_null_sum_and_active_flag(spark):
    spine = spark.createDataFrame([(1, D(2022, 6, 1)), (2, D(2022, 6, 1)), (3, D(2022, 6, 1))], "bbl long, as_of_date date")
    ab = spark.createDataFrame([
        (1, 1, 2020, None, 2015, 2030), (2, 2, 2021, 5.0, 2010, None), (3, 3, 2022, 9.0, 2012, 2040),
    ], "row_id long, bbl long, tax_year long, abatement double, init_year long, expiry_year long")
    out = {r.bbl: r for r in asof.asof_cumulative(spine, ab).collect()}
    assert out[1].j51_total_abatement == 0.0 and out[1].j51_active_flag == 1  # rows exist, all NULL -> 0
    assert out[2].j51_active_flag is None                                     # unknown expiry -> NULL
    assert out[3].j51_total_abatement is None                                 # tax_year not < as_of year


# ------------------------------------------------------------------ keys / coercions
def test_keys_and_coercions(spark):
    df = spark.createDataFrame([("1", "12", "1005", "1,224", " nan ", "123.0"), ("x", None, "7", "bad", "ok", "BBL-0042")],
                               "b string, bl string, lt string, area string, txt string, raw string")
    r = df.select(keys.parcel_key_text("b", "bl", "lt").alias("t"), keys.parcel_key_int("b", "bl", "lt").alias("i"),
                  keys.parent_lot(F.col("lt").cast("int")).alias("p"), FT.map_with_default(F.lit("zz"), {"a": 1}, 0).alias("m"),
                  F.col("area"), keys.normalise_parcel_key("raw").alias("n")).collect()
    from lotline.functions.coerce import norm_text, strip_thousands
    c = df.select(strip_thousands("area").alias("a"), norm_text("txt").alias("t")).collect()
    assert r[0].t == "1000121005" and r[0].i == 1_000_121_005 and r[0].p == 1
    assert r[1].t == "0000000007" and r[1].i is None and r[1].p == 7
    assert r[0].n == "123" and r[1].n == "42"
    assert c[0].a == 1224.0 and c[1].a is None and c[0].t is None and c[1].t == "OK"


def test_headers_and_resolve(spark):
    df = spark.createDataFrame([(1, 2)], ["  SALE\nPRICE ", "Borough"])
    n = columns.norm_headers(df)
    assert n.columns == ["sale price", "borough"]
    assert columns.resolve_column(n, "BOROUGH", "x") == "borough"
    with pytest.raises(KeyError):
        columns.resolve_column(n, "missing")


# ------------------------------------------------------------------ scores
def test_investment_score_vectors(spark):
    df = spark.createDataFrame([(1_185_000.0, 1_250_000.0), (611081.6875, 550000.0), (100.0, 0.0)], "p double, m double")
    r = df.select(scoring.investment_score("p", "m").alias("s"), scoring.roi_pct("p", "m").alias("roi"),
                  scoring.legacy_investment_score("p", "m").alias("legacy")).collect()
    assert r[0].s == 34
    assert scoring.deal_label(F.lit(34)) is not None
    assert abs(r[1].roi - 11.105761363636365) < 1e-12
    assert abs(r[1].legacy - 77.7644034090909) < 1e-9
    assert r[2].roi == 0.0  # market <= 0 -> ROI 0


def test_valuation_interval_floor(spark):
    df = spark.createDataFrame([(100.0, 150.0, 2.0, True), (100.0, 0.0, 1.0, False)], "p double, mae double, u double, pu boolean")
    lo, hi = scoring.valuation_interval(F.col("p"), F.col("mae"), F.col("u"), F.col("pu"))
    r = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (r[0].lo, r[0].hi) == (0.0, 400.0)
    assert r[1].lo is None and r[1].hi is None


def test_validate_rows_invalid_request(spark):
    df = spark.createDataFrame([(1700, -100.0, 1.0, 1.0, 1.0, 10.0, -73.9, "2", "BATHGATE", "01")],
                               "year_built int, gross_sqft double, land_sqft double, total_units double, residential_units double, "
                               "latitude double, longitude double, borough string, neighborhood string, building_class string")
    r = clean.validate_rows(df, clean.request_rules()).first()
    assert sorted(r.errors) == ["gross_sqft_positive", "latitude_range", "year_built_range"] and not r.is_valid


# ------------------------------------------------------------------ trends
def test_yoy_needs_five_prior_sales(spark):
    rows = []
    d0 = D(2020, 1, 1)
    for i in range(5):          # year-ago window of the late target
        rows.append(("s", 1, "A", d0 + dt.timedelta(days=10 + i), 100_000.0 + i))
    rows.append(("s", 1, "A", d0 + dt.timedelta(days=400), 200_000.0))
    for i in range(4):
        rows.append(("s", 1, "B", d0 + dt.timedelta(days=10 + i), 100_000.0))
    rows.append(("s", 1, "B", d0 + dt.timedelta(days=400), 200_000.0))
    sales = spark.createDataFrame(rows, "seg string, borough int, nb string, sale_date date, price double")
    sp = sales.withColumn("as_of_date", F.lit(d0 + dt.timedelta(days=420))).unionByName(
        # date-only copies: below the 100k price floor, so they add spine dates but no prices
        sales.withColumn("as_of_date", F.col("sale_date") - 1).withColumn("price", F.lit(1.0)))
    g = trends.trend_grid(sp, segment="seg", neighborhood="nb", price="price")
    r = {x.nb: x for x in g.where(F.col("as_of_date") == d0 + dt.timedelta(days=420)).collect()}
    assert r["A"].nbhd_median_l365 == 200_000.0 and abs(r["A"].nbhd_yoy_growth - (200_000.0 / 100_002.0 - 1)) < 1e-12
    assert r["B"].nbhd_yoy_growth is None  # year-ago group of 4: suppressed


# ------------------------------------------------------------------ comps
def test_comps_window_radius_price_and_ppsqft(spark):
    t = D(2021, 1, 1)
    rows = [  # sale_id, sale_date, lat, lon, price, sqft
        (1, t + dt.timedelta(days=1), 40.7, -73.9, 500_000.0, 1000.0),          # target (as_of = t)
        (2, t - dt.timedelta(days=365), 40.7, -73.9, 300_000.0, 100.0),         # exactly 365 days: in; sqft 100 excluded from ppsf
        (3, t - dt.timedelta(days=366), 40.7, -73.9, 300_000.0, 1000.0),        # 366 days: out
        (4, t - dt.timedelta(days=10), 40.7 + 0.05, -73.9, 400_000.0, 101.0),   # ~5.6 km: out
        (5, t - dt.timedelta(days=10), 40.7 + 0.02, -73.9, 99_999.0, 1000.0),   # below 100k: out
        (6, t - dt.timedelta(days=20), 40.7 + 0.02, -73.9, 202_000.0, 101.0),   # ~2.2 km: in
    ]
    df = spark.createDataFrame(rows, "sale_id long, sale_date date, latitude double, longitude double, sales_price double, gross_sqft double")
    df = df.withColumn("as_of_date", F.date_sub("sale_date", 1)).withColumn("bbl", F.col("sale_id")).withColumn("comp_segment", F.lit("x"))
    r = spatial.knn_temporal_comps(df).where("bbl = 1").first()
    assert r.comp_count == 2
    assert r.comp_median_price == 251_000.0
    assert abs(r.comp_median_ppsqft - 2000.0) < 1e-9
    assert r.comp_recency_days == 20


def test_haversine_and_nearest(spark):
    pts = spark.createDataFrame([(1, 40.7, -74.0, 2, False), (2, 40.8, -74.0, 1, True)], "station_id long, lat double, lon double, route_count int, is_cbd boolean")
    tg = spark.createDataFrame([(10, 40.71, -74.0), (11, 40.79, -74.0)], "bbl long, latitude double, longitude double")
    f = {r.bbl: r for r in spatial.transit_features(tg, pts).collect()}
    assert abs(f[10].subway_dist_km - 1.1119492664) < 1e-6
    assert f[10].subway_hub_flag == 1 and f[11].subway_hub_flag == 0
    assert f[10].subway_n_1km == 0 and f[11].subway_n_1km == 0
    assert abs(f[10].subway_cbd_dist_km - 10.0075433976) < 1e-6
    d = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first().d
    assert abs(d - 111.19492664455873) < 1e-9


# ------------------------------------------------------------------ ranking / usage
def test_top_n_per_group_matches_row_number(spark):
    import random
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 50), i, rnd.choice([1, 3, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, ts int, id int, n int")
    got = usage.top_n_per_group(df, ["g", "n"], ["ts", "id"], F.col("n"), salts=4).select("id").collect()
    want = []
    for key in {(g, n) for g, _, _, n in rows}:
        grp = sorted([r for r in rows if (r[0], r[3]) == key], key=lambda r: (r[1], r[2]))
        want += [r[2] for r in (grp if key[1] is None else grp[: key[1]])]
    assert sorted(r.id for r in got) == sorted(want)


def test_quota_states(spark):
    ev = spark.createDataFrame([(i, T(2024, 1, 1, 0, i), 3 if i < 12 else 4, "user" if i < 12 else "admin") for i in range(15)],
                               "event_id long, ts timestamp_ntz, user_id long, role string")
    a = {r.event_id: r for r in usage.quota_admission(ev).collect()}
    assert [a[i].admitted for i in range(12)] == [True] * 10 + [False] * 2
    assert a[11].reason == "quota_exhausted" and all(a[i].admitted for i in range(12, 15))
    counters = usage.daily_counter(ev)
    st = {r.user_id: r for r in usage.quota_status(ev.select("user_id", "role").distinct(), counters, F.lit(D(2024, 1, 1))).collect()}
    assert st[3].daily_limit == 10 and st[3].remaining == 0 and st[3].used_today == 12
    assert st[4].daily_limit is None and st[4].remaining is None


def test_folds_drop_empty_train(spark):
    df = spark.createDataFrame([(D(y, 6, 1),) for y in (2021, 2022, 2023) for _ in range(60)], "d date")
    f = ranking.build_folds(df, "d").orderBy("fold").collect()
    assert [r.test_year for r in f] == [2022, 2023]  # 2021 would train on nothing
    assert f[0].test_start == D(2022, 1, 31)


def test_portfolio_csv_escaping(spark):
    df = spark.createDataFrame([('Main St, "A"', None, "x\ny")], "a string, b string, c string")
    r = df.select(sinks.csv_field(F.col("a")).alias("a"), sinks.csv_field(F.col("b")).alias("b"),
                  sinks.csv_field(F.col("c")).alias("c")).first()
    assert r.a == '"Main St, ""A"""' and r.b == "" and r.c == '"x\ny"'


def test_band_and_caps_keep_rows_without_sqft(spark):
    rows = [(i, "N", 1000.0 * (i + 1), 10.0) for i in range(150)] + [(999, "N", 5.0, None)]
    df = spark.createDataFrame(rows, "sale_id int, neighborhood string, sales_price double, gross_sqft double")
    out = {r.sale_id for r in clean.band_group_quantile(df).collect()}
    assert 999 in out and 0 not in out and 149 not in out and 75 in out


def test_exact_quantiles_multi_round_matches_numpy(spark):
    import random

    import numpy as np

    from lotline.operators.quantiles import exact_quantiles
    rnd = random.Random(3)
    rows = [("hot", rnd.random() * 1000) for _ in range(20000)] + [("small", float(rnd.randint(0, 50))) for _ in range(300)]
    rows += [(None, 5.0), (None, 7.0), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"p02": 0.02, "p50": 0.5, "p99": 0.99}
    out = {r.g: r for r in exact_quantiles(df, ["g"], "v", qs, max_band=500).collect()}  # forces refinement rounds
    assert "nulls" not in out
    for g in ("hot", "small", None):
        arr = np.array([v for gg, v in rows if gg == g and v is not None])
        for n, q in qs.items():
            assert getattr(out[g], n) == pytest.approx(float(np.quantile(arr, q)), rel=1e-12, abs=1e-12)


def test_multi_file_header_offsets_tags_and_missing(spark, tmp_path):
    from lotline.sources import readers
    a = tmp_path / "bronx_2023.csv"
    b = tmp_path / "queens_hist.csv"
    a.write_text("Rolling sales\nBronx\n\nas of 2023\n SALE  PRICE ,Block,LOT\n100,1,2\n200,3,4\n")
    b.write_text("t\nt\nt\nt\nt\nt\n  sale price ,BLOCK,lot,extra\n300,5,6,x\n")
    specs = [
        {"path": str(a), "skip": 4, "tags": {"borough": 2, "file_type": "current"}},
        {"path": str(b), "skip": 6, "tags": {"borough": 4, "file_type": "historical"}},
        {"path": str(tmp_path / "missing.csv"), "skip": 4, "tags": {"borough": 1}},
    ]
    df = readers.read_multi_file(spark, specs)
    rows = sorted(((r["sale price"], r["block"], r["borough"], r["file_type"], r["extra"]) for r in df.collect()),
                  key=lambda t: t[0])
    assert rows == [("100", "1", 2, "current", None), ("200", "3", 2, "current", None), ("300", "5", 4, "historical", "x")]


def test_stream_quota_state_carries_across_micro_batches(spark, tmp_path):
    from lotline.streaming import counters as S
    src = tmp_path / "src"
    src.mkdir()
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    b1 = [(i, T(2024, 1, 1, 0, i), 3, "view", 1.0, "{}") for i in range(8)]           # user 3 -> role 'user' (limit 10)
    b2 = [(100 + i, T(2024, 1, 1, 1, i), 3, "view", 1.0, "{}") for i in range(4)]     # calls 9..12 in a later batch
    spark.createDataFrame(b1, schema).coalesce(1).write.parquet(str(src / "part1"))
    spark.createDataFrame(b2, schema).coalesce(1).write.parquet(str(src / "part2"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
              .parquet(str(src)).withColumn("__ets", F.col("ts").cast("timestamp")))
    work = tmp_path / "work"
    with S._utc(spark):
        S.stream_quota_admission(stream, str(work / "out"), str(work / "ckpt")).awaitTermination()
    out = {r.event_id: r.admitted for r in spark.read.schema(S._OUT_SCHEMA).parquet(str(work / "out")).collect()}
    assert len(out) == 12
    assert [out[i] for i in range(8)] == [True] * 8
    assert [out[100 + i] for i in range(4)] == [True, True, False, False]


def test_asof_hot_key_matches_brute_force(spark):
    import random
    rnd = random.Random(11)
    base = T(2020, 1, 1)
    # key 1 holds ~90% of all events, many per day; key 2 a few
    ev = [(i, 1 if i % 10 else 2, base + dt.timedelta(days=rnd.randint(0, 59), minutes=rnd.randint(0, 1439)),
           float(rnd.randint(1, 1000))) for i in range(6000)]
    spine = [(k, D(2020, 1, 1) + dt.timedelta(days=d)) for k in (1, 2) for d in range(0, 62, 3)]
    e = spark.createDataFrame(ev, "document_id long, bbl long, document_date timestamp_ntz, document_amt double")
    s = spark.createDataFrame(spine, "bbl long, as_of_date date")
    got = {(r.bbl, r.as_of_date): r for r in asof.asof_event_history(s, e).collect()}
    for k, a in spine:
        prior = [x for x in ev if x[1] == k and x[2].date() < a]
        r = got[(k, a)]
        assert r.deed_cnt == len(prior)
        if prior:
            last = max(prior, key=lambda x: (x[2], x[0]))
            assert r.deed_last_document_amt == last[3] and r.deed_last_date == last[2]
        else:
            assert r.deed_last_date is None
