"""Registered source / sink queries (survey 2.1). File formats are exercised
by round-tripping driver tables through the session's scratch folder (the
shared checkpoint folder on a cluster) and reading them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotline.plans import bindings as B
from lotline.plans.ranking_queries import _SCORED_SQL, scored_properties
from lotline.plans.registry import register
from lotline.session import ensure_checkpoint_dir
from lotline.sources import readers, sinks


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lotline-io-{name}-{uuid.uuid4().hex}"


def _orders_csv_dirs(spark, sf):
    """Folders of sale files as offices write them: 4 or 6 lines of preamble before
    the header, a comment with quotes and line breaks, another column order."""
    base = _scratch(spark, "multi")
    o = B.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus",
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('He said "no",\nthen yes: '), F.col("o_orderkey").cast("string"))).otherwise(F.lit("plain")).alias("note"))
    specs = []
    for st, ftype, skip, names in (("F", "historical", 6, ["o_custkey", "note", "o_orderkey", "o_totalprice", "o_orderdate"]),
                                   ("O", "current", 4, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "note"]), ("P", "current", 4, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "note"])):
        path = f"{base}/status={st}"
        lines = o.where(F.col("o_orderstatus") == st).select(F.concat_ws(",", *[sinks.csv_field(F.col(c)) for c in names]).alias("value"))
        sinks.write_lines(lines, path, [*[f"Rolling sales, line {i} of \"preamble" for i in range(skip)], ",".join(c.upper() for c in names)])
        specs.append({"path": path, "skip": skip, "tags": {"file_tag": st, "file_type": ftype}})
    specs.append({"path": f"{base}/status=missing", "tags": {"file_tag": "X"}})
    return specs


@register(
    "src_multi_file",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus AS file_tag,
  CASE WHEN o_orderkey % 3 = 0 THEN 'He said "no",' || chr(10) || 'then yes: ' || o_orderkey ELSE 'plain' END AS note,
  CASE WHEN o_orderstatus = 'F' THEN 'historical' ELSE 'current' END AS file_type FROM orders""",
)
def q_src_multi_file(spark, sf):
    df = readers.read_multi_file(spark, _orders_csv_dirs(spark, sf))
    return df.select(
        F.col("o_orderkey").try_cast("bigint").alias("o_orderkey"),
        F.col("o_custkey").try_cast("bigint").alias("o_custkey"),
        F.col("o_totalprice").try_cast("double").alias("o_totalprice"),
        F.try_to_timestamp("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"),
        "file_tag", "note", "file_type",
    )


@register("src_csv_projected", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def q_src_csv_projected(spark, sf):
    path = _scratch(spark, "csvproj")
    sinks.write_csv(B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path)
    df, _missing = readers.read_csv_projected(spark, path, ["l_orderkey", "l_linenumber", "l_quantity", "l_not_there"])
    return df.select(F.col("l_orderkey").try_cast("bigint").alias("l_orderkey"),
                     F.col("l_linenumber").try_cast("int").alias("l_linenumber"),
                     F.col("l_quantity").try_cast("double").alias("l_quantity"))


@register("src_csv_case_insensitive", "SELECT p_partkey, p_brand, p_size FROM part")
def q_src_csv_case_insensitive(spark, sf):
    path = _scratch(spark, "csvci")
    p = B.table(spark, sf, "part").select(F.col("p_partkey").alias("P_PARTKEY"), F.col("p_brand").alias("P_Brand"),
                                          F.col("p_size").alias("p_SIZE"))
    sinks.write_csv(p, path)
    df = readers.read_csv_case_insensitive(spark, path, ["p_partkey", "P_BRAND", "p_size", "p_missing"])
    return df.select(F.col("p_partkey").try_cast("bigint").alias("p_partkey"), "p_brand",
                     F.col("p_size").try_cast("int").alias("p_size"))


@register("src_parquet_projected", "SELECT o_orderkey, o_totalprice FROM orders")
def q_src_parquet_projected(spark, sf):
    return readers.read_parquet_projected(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"])


@register(
    "src_parquet_point_lookup",
    "SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')",
)
def q_src_parquet_point_lookup(spark, sf):
    keys = B.table(spark, sf, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")) \
        .select("o_orderkey")
    return readers.parquet_lookup_many(spark, f"{sf}/lineitem.parquet", "l_orderkey", keys)


@register(
    "src_sql_table",
    B.with_ctes(B.SPINE_SQL) + "SELECT sale_id AS id, borough, neighborhood, building_class, year_built, sales_price FROM spine",
)
def q_src_sql_table(spark, sf):
    sp = B.spine(spark, sf).select(F.col("sale_id").alias("id"), "borough", "neighborhood", "building_class",
                                    "year_built", "sales_price", "gross_sqft")
    name = f"housing_data_{uuid.uuid4().hex[:8]}"
    sp.createOrReplaceTempView(name)
    return readers.read_table(spark, name, ["id", "borough", "neighborhood", "building_class", "year_built", "sales_price"])


@register(
    "src_best_available",
    B.with_ctes(B.SPINE_SQL) + """SELECT sale_id, segment, CASE WHEN segment = 'condo_coop' THEN 'specialised' ELSE 'standard' END AS source FROM spine""",
)
def q_src_best_available(spark, sf):
    sp = B.spine(spark, sf)
    specialised = {"condo_coop": sp.where(F.col("segment") == "condo_coop").withColumn("source", F.lit("specialised"))}
    standard = sp.withColumn("source", F.lit("standard"))
    # the segments that have a dataset of their own; every other one, known or not, shares the standard one
    own = F.coalesce(F.col("segment").isin(*specialised), F.lit(False))
    out = standard.where(~own)
    for seg in specialised:
        out = out.unionByName(readers.best_available(seg, specialised, standard))
    return out.select("sale_id", "segment", "source")


@register(
    "sink_parquet",
    B.with_ctes(B.SPINE_SQL) + "SELECT sale_id, bbl, sale_date, sales_price, segment FROM spine",
)
def q_sink_parquet(spark, sf):
    path = _scratch(spark, "parquet")
    sinks.write_parquet(B.spine(spark, sf).select("sale_id", "bbl", "sale_date", "sales_price", "segment"), path, ["segment"])
    return spark.read.parquet(path).select("sale_id", "bbl", "sale_date", "sales_price", "segment")


@register(
    "sink_published",
    B.with_ctes(B.SPINE_SQL) + """SELECT segment, count(*) AS rows_now, count(*) FILTER (year(sale_date) < 1999) AS rows_before FROM spine GROUP BY segment""",
)
def q_sink_published(spark, sf):
    """A table published twice; the version before can still be read."""
    base = _scratch(spark, "published")
    sp = B.spine(spark, sf).select("sale_id", "sale_date", "segment")
    sinks.publish_parquet(sp.where(F.year("sale_date") < 1999), base)
    sinks.publish_parquet(sp, base)
    count = lambda df, name: df.groupBy("segment").agg(F.count(F.lit(1)).alias(name))
    now, before = sinks.read_published(spark, base), sinks.read_published(spark, base, back=1)
    return count(now, "rows_now").join(count(before, "rows_before"), "segment", "left").fillna(0, ["rows_before"])


@register(
    "sink_bucketed",
    B.with_ctes(B.SPINE_SQL, B.PARCELS_SQL) + "SELECT s.sale_id, s.bbl, p.latitude, p.lotarea FROM spine s JOIN parcels p USING (bbl)",
)
def q_sink_bucketed(spark, sf):
    """Sales and parcels as tables bucketed by parcel, joined without a shuffle."""
    made = []
    for name, df in (("sales", B.spine(spark, sf).select("sale_id", "bbl")), ("parcels", B.parcels(spark, sf).select("bbl", "latitude", "lotarea"))):
        path = _scratch(spark, f"bucketed-{name}")
        made.append(sinks.write_bucketed(df, f"bucketed_{name}_" + path.rsplit("-", 1)[-1], "bbl", 16, path))
    return made[0].hint("merge").join(made[1], "bbl").select("sale_id", "bbl", "latitude", "lotarea")


@register("sink_csv", "SELECT p_partkey, p_name, p_type, p_retailprice FROM part")
def q_sink_csv(spark, sf):
    path = _scratch(spark, "csv")
    sinks.write_csv(B.table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_retailprice"), path)
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("p_partkey").try_cast("bigint").alias("p_partkey"), "p_name", "p_type",
                     F.col("p_retailprice").try_cast("double").alias("p_retailprice"))


@register(
    "sink_json_report",
    "SELECT p_type AS segment, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price, min(p_size) AS min_size FROM part GROUP BY p_type",
)
def q_sink_json_report(spark, sf):
    path = _scratch(spark, "json")
    rep = B.table(spark, sf, "part").groupBy(F.col("p_type").alias("segment")).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"),
                 F.min("p_size").alias("min_size")).alias("metrics"))
    sinks.write_json_report(rep, path)
    back = spark.read.schema("segment string, metrics struct<n: bigint, mean_price: double, min_size: int>").json(path)
    return back.select("segment", "metrics.n", "metrics.mean_price", "metrics.min_size")


@register(
    "sink_metrics_merge",
    """WITH p AS (SELECT p_type AS segment, year(l_shipdate) AS yr, l_extendedprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey),
old AS (SELECT segment, count(*) AS n, 'v1' AS version FROM p WHERE yr <= 1998 GROUP BY segment),
new AS (SELECT segment, count(*) AS n, 'v2' AS version FROM p WHERE segment IN ('SMALL', 'LARGE') GROUP BY segment)
SELECT * FROM old WHERE segment NOT IN (SELECT segment FROM new) UNION ALL SELECT * FROM new""",
)
def q_sink_metrics_merge(spark, sf):
    from lotline.plans.stats_queries import pred
    p = pred(spark, sf)
    old = p.where(F.col("yr") <= 1998).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.lit("v1").alias("version"))
    new = p.where(F.col("segment").isin("SMALL", "LARGE")).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.lit("v2").alias("version"))
    return sinks.merge_metrics(old, new, ["segment"])


@register(
    "sink_truncate_reload",
    "SELECT c_custkey AS customer_id, c_name AS name, TRY_CAST(c_mktsegment AS DOUBLE) AS segment_code, c_acctbal AS balance FROM customer",
)
def q_sink_truncate_reload(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("string"))
    path = _scratch(spark, "reload")
    return sinks.truncate_reload(
        c, "reload_" + path.rstrip("/").rsplit("-", 1)[-1],
        {"c_custkey": "customer_id", "c_name": "name", "c_mktsegment": "segment_code", "c_acctbal": "balance"},
        {"segment_code": "double", "balance": "double"}, path)


def _csv_sql(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '[\",\\n\\r]') THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE COALESCE({text}, '') END"


def _number_sql(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


_EXPORT_SQL = [
    "CAST(id AS VARCHAR)", _csv_sql("address"), "zipcode", "CAST(bedrooms AS VARCHAR)", "CAST(bathrooms AS VARCHAR)", "CAST(sqft AS VARCHAR)", _number_sql("listing_price"),
    "strftime(created_at, '%Y-%m-%d %H:%M:%S')", "deal_label", "CAST(investment_score AS VARCHAR)", _number_sql("round(predicted_price, 2)"), _number_sql("round(market_price, 2)"),
    _number_sql("round(roi_estimate, 2)"), _number_sql("round(roi_estimate, 2)"), _csv_sql("recommendation"), _csv_sql("analysis_summary"),
]


@register("sink_portfolio_csv", _SCORED_SQL + "SELECT id AS property_id, concat_ws(',', " + ", ".join(_EXPORT_SQL) + ") AS line FROM labelled")
def q_sink_portfolio_csv(spark, sf):
    """Escaped CSV lines of every saved analysis: all 16 columns, numbers to two digits."""
    d = scored_properties(spark, sf)
    two = lambda c, block: F.round(F.col(f"analysis.{block}.{c}"), 2)
    a = F.col("analysis")
    for block, names in (("valuation", ("predicted_price", "market_price", "price_difference_pct")), ("investment_analysis", ("roi_estimate",))):
        for c in names:
            a = a.withField(f"{block}.{c}", two(c, block))
    return sinks.portfolio_csv_lines(d.withColumn("analysis", a).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")))


@register(
    "apply_changes",
    """WITH base AS (SELECT o_orderkey AS id, o_totalprice AS listing_price, o_orderpriority AS label FROM orders WHERE o_orderstatus IN ('F', 'O')),
ch AS (
  SELECT o_orderkey AS id, 'insert' AS op, o_totalprice AS listing_price, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'update', o_totalprice * 1.1, 'UPDATED' FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, 'delete', NULL, NULL FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW')
SELECT COALESCE(b.id, c.id) AS id,
  CASE WHEN c.op = 'insert' OR c.op = 'update' THEN c.listing_price ELSE b.listing_price END AS listing_price,
  CASE WHEN c.op = 'insert' THEN c.label ELSE b.label END AS label
FROM base b FULL OUTER JOIN ch c ON b.id = c.id
WHERE COALESCE(c.op, '') <> 'delete' AND (b.id IS NOT NULL OR c.op = 'insert')""",
)
def q_apply_changes(spark, sf):
    o = B.table(spark, sf, "orders")
    base = o.where(F.col("o_orderstatus").isin("F", "O")).select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("listing_price"), F.col("o_orderpriority").alias("label"))
    ins = o.where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("id"), F.lit("insert").alias("op"), F.array(F.lit("listing_price"), F.lit("label")).alias("sent"),
        F.col("o_totalprice").alias("listing_price"), F.col("o_orderpriority").alias("label"))
    upd = o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select(
        F.col("o_orderkey").alias("id"), F.lit("update").alias("op"), F.array(F.lit("listing_price")).alias("sent"),
        (F.col("o_totalprice") * 1.1).alias("listing_price"), F.lit("UPDATED").alias("label"))
    dele = o.where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW")).select(
        F.col("o_orderkey").alias("id"), F.lit("delete").alias("op"), F.array().cast("array<string>").alias("sent"),
        F.lit(None).cast("double").alias("listing_price"), F.lit(None).cast("string").alias("label"))
    return sinks.apply_changes(base, ins.unionByName(upd).unionByName(dele), "id", ["listing_price", "label"])
