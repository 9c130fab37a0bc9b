"""Registered window / ordering / top-k / portfolio queries (survey 2.6, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.operators import ranking
from lotline.operators.usage import daily_counter
from lotline.operators.columns import union_align
from lotline.operators.score import score_predictions
from lotline.plans import bindings as B
from lotline.plans.registry import register

_SP = B.with_ctes(B.SPINE_SQL)


@register(
    "latest_per_key",
    B.with_ctes(B.TAX_ROLLS_SQL) + """SELECT bbl, year, period, curacttot, curmkttot, units FROM (
  SELECT *, row_number() OVER (PARTITION BY bbl ORDER BY year DESC, curacttot DESC) AS rn FROM tax_rolls) WHERE rn = 1""",
)
def q_latest_per_key(spark, sf):
    return ranking.latest_per_key(B.tax_rolls(spark, sf), ["bbl"], [F.col("year"), F.col("curacttot")])


_FOLDS_SQL = _SP + """, yc AS (SELECT segment, CAST(year(sale_date) AS INTEGER) AS test_year, count(*) AS n FROM spine GROUP BY ALL),
v AS (SELECT *, min(test_year) OVER (PARTITION BY segment) AS first_year,
             row_number() OVER (PARTITION BY segment ORDER BY test_year DESC) AS rk FROM yc WHERE n >= 50),
s AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY test_year) AS fold FROM v WHERE rk <= 3),
folds AS (
  SELECT segment, CAST(fold AS INTEGER) AS fold, test_year, make_date(first_year, 1, 1) AS train_start,
         make_date(test_year - 1, 12, 31) AS train_end, make_date(test_year - 1, 12, 31) + 31 AS test_start,
         make_date(test_year, 12, 31) AS test_end
  FROM s WHERE make_date(test_year - 1, 12, 31) >= make_date(first_year, 1, 1))
"""


def _folds(spark, sf):
    return ranking.build_folds(B.spine(spark, sf), "sale_date", ["segment"])


@register("expanding_train_window", _FOLDS_SQL + "SELECT * FROM folds")
def q_expanding_train_window(spark, sf):
    return _folds(spark, sf).withColumn("fold", F.col("fold").cast("int"))


@register(
    "fold_assignment",
    _FOLDS_SQL + """SELECT f.segment, f.fold, CASE WHEN s.sale_date BETWEEN f.train_start AND f.train_end THEN 'train' ELSE 'test' END AS role,
  count(*) AS n_rows
FROM spine s JOIN folds f ON s.segment = f.segment
WHERE s.sale_date BETWEEN f.train_start AND f.train_end OR s.sale_date BETWEEN f.test_start AND f.test_end
GROUP BY ALL""",
)
def q_fold_assignment(spark, sf):
    folds = _folds(spark, sf).withColumn("fold", F.col("fold").cast("int"))
    a = ranking.assign_folds(B.spine(spark, sf), folds, "sale_date", ["segment"])
    return a.groupBy("segment", "fold", "role").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "time_split",
    _SP + """SELECT sale_id, CASE WHEN sale_date <= DATE '1998-12-31' THEN 'train'
  WHEN sale_date >= DATE '1999-01-31' THEN 'test' ELSE 'gap' END AS split FROM spine""",
)
def q_time_split(spark, sf):
    return ranking.time_split(B.spine(spark, sf), "sale_date", "1998-12-31", "1999-01-31").select("sale_id", "split")


@register(
    "train_test_random",
    _SP + """SELECT sale_id, ((((sale_id % 2147483648) * 48271 + 42 * 69621) % 2147483647) // 100) % 100 < 80 AS in_train FROM spine""",
)
def q_train_test_random(spark, sf):
    return ranking.hash_split(B.spine(spark, sf), "sale_id").select("sale_id", "in_train")


@register(
    "sort_multi",
    _SP + "SELECT sale_id, sale_date, borough, neighborhood, sales_price FROM spine "
    "ORDER BY sale_date, borough, neighborhood, sales_price DESC, sale_id",
)
def q_sort_multi(spark, sf):
    sp = B.spine(spark, sf).select("sale_id", "sale_date", "borough", "neighborhood", "sales_price")
    return ranking.sort_multi(sp, ["sale_date", "borough", "neighborhood", "sales_price", "sale_id"], ["sales_price"])


@register(
    "topk_global",
    "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
)
def q_topk_global(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return ranking.topk(p, [F.desc("p_retailprice"), F.asc("p_partkey")], 10)


@register(
    "topk_users",
    B.with_ctes(B.USAGE_SQL) + """SELECT user_id, count(*) AS calls FROM usage
WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 6 FROM usage) GROUP BY user_id ORDER BY calls DESC, user_id LIMIT 20""",
)
def q_topk_users(spark, sf):
    u = B.usage_events(spark, sf)
    # whole days: today and the six before, from the daily counters
    today = F.to_date(u.select(F.max("ts")).scalar())
    recent = daily_counter(u).where(F.col("period_date") >= F.date_sub(today, 6))
    agg = recent.groupBy("user_id").agg(F.sum("call_count").alias("calls"))
    return ranking.topk(agg, [F.desc("calls"), F.asc("user_id")], 20)


@register("page", _SP + "SELECT sale_id, bbl, sales_price FROM spine WHERE segment = 'condo_coop' ORDER BY sale_id LIMIT 50 OFFSET 100")
def q_page(spark, sf):
    sp = B.spine(spark, sf).where(F.col("segment") == "condo_coop").select("sale_id", "bbl", "sales_price")
    return ranking.page(sp, ["sale_id"], offset=100, limit=50)


def scored_properties(spark, sf):
    from lotline.operators.score import analysis_document
    p = score_predictions(B.properties_raw(spark, sf))
    p = p.withColumn("price_low", F.lit(None).cast("double")).withColumn("price_high", F.lit(None).cast("double"))
    p = p.withColumn("top_drivers", F.array().cast("array<string>"))
    # every third property has an explanation, some of them without a recommendation
    told = F.struct(F.concat(F.lit("Explained "), F.col("id").cast("string")).alias("summary"), F.when(F.col("id") % 2 == 0, F.lit('Say "yes", soon')).alias("recommendation"),
                    F.lit("High").alias("confidence"))
    p = p.withColumn("explanation", F.when(F.col("id") % 3 == 0, told))
    return analysis_document(p).select("id", "address", "zipcode", "bedrooms", "bathrooms", "sqft", "listing_price",
                                       "created_at", "user_id", "analysis")


_SCORED_SQL = B.with_ctes(B.PROPERTIES_SQL) + f""", scored AS (
  SELECT *, {B.score_sql()} AS investment_score,
         CASE WHEN market_price > 0 THEN (predicted_price - market_price) / market_price * 100.0 ELSE 0.0 END AS roi_estimate
  FROM props),
labelled AS (SELECT *, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'Say "yes", soon' ELSE 'Hold' END AS recommendation, CASE WHEN id % 3 = 0 THEN 'High' ELSE 'Low' END AS confidence,
             CASE WHEN id % 3 = 0 THEN 'Explained ' || id ELSE 'AI explanation unavailable' END AS told,
             CASE WHEN predicted_price - market_price > 0 THEN 'Property appears undervalued by approximately $' || format('{{:,}}', CAST(round_even(predicted_price - market_price, 0) AS BIGINT))
                  ELSE 'Property may be overpriced by approximately $' || format('{{:,}}', CAST(round_even(abs(predicted_price - market_price), 0) AS BIGINT)) END || ' based on model analysis.' AS analysis_summary,
             CASE WHEN investment_score >= 70 THEN 'Buy' WHEN investment_score >= 40 THEN 'Hold' ELSE 'Avoid' END AS deal_label
             FROM scored)
"""


@register(
    "portfolio_view",
    _SCORED_SQL + """SELECT id, user_id, investment_score, round(roi_estimate, 9) AS roi_estimate FROM labelled
WHERE deal_label = 'Buy' ORDER BY COALESCE(investment_score, -1) DESC, id DESC""",
)
def q_portfolio_view(spark, sf):
    v = ranking.portfolio_view(scored_properties(spark, sf), label="Buy", sort="score_desc")
    return v.select("id", "user_id", F.col("analysis.investment_analysis.investment_score").alias("investment_score"),
                    F.round("analysis.investment_analysis.roi_estimate", 9).alias("roi_estimate"))


@register(
    "compare_best",
    _SCORED_SQL + """, sel AS (SELECT user_id, id, epoch(created_at) AS pos, predicted_price, market_price, CAST(investment_score AS DOUBLE) AS investment_score, roi_estimate
             FROM labelled QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) <= CASE WHEN user_id % 3 = 0 THEN 2 ELSE 10 END),
long AS (UNPIVOT sel ON predicted_price, market_price, investment_score, roi_estimate INTO NAME metric VALUE value),
signed AS (SELECT *, CASE WHEN metric = 'market_price' THEN -value ELSE value END AS s FROM long WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric ORDER BY s DESC, pos ASC, id ASC) AS rn FROM signed)
SELECT user_id, metric, id AS winner_id, round(value, 6) AS value FROM r WHERE rn = 1""",
)
def q_compare_best(spark, sf):
    role = F.element_at(F.array(*[F.lit(r) for r in B.ROLE_CYCLE]), (F.col("user_id") % 3 + 1).cast("int"))
    p = ranking.limit_selection(scored_properties(spark, sf).withColumn("role", role), "user_id", ["created_at", "id"], "role")
    # saved order as a zone-independent number: days * 86400 + seconds of day (NTZ wall clock)
    ca = F.col("created_at")
    pos = F.unix_date(F.to_date(ca)).cast("long") * 86400 + F.hour(ca) * 3600 + F.minute(ca) * 60 + F.second(ca)
    sel = p.select("user_id", "id", pos.alias("pos"),
                   F.col("analysis.valuation.predicted_price").alias("predicted_price"),
                   F.col("analysis.valuation.market_price").alias("market_price"),
                   F.col("analysis.investment_analysis.investment_score").cast("double").alias("investment_score"),
                   F.col("analysis.investment_analysis.roi_estimate").alias("roi_estimate"))
    out = ranking.compare_best(sel, "user_id", "id", "pos",
                               {"predicted_price": "max", "market_price": "min", "investment_score": "max",
                                "roi_estimate": "max"})
    return out.withColumn("value", F.round("value", 6))


@register(
    "union_align",
    B.with_ctes(B.documents_sql("deeds", "F"), B.documents_sql("mtges", "O"))
    + """SELECT document_id, bbl, document_amt, buyer_name, NULL AS lender FROM deeds
UNION ALL SELECT document_id, bbl, document_amt, NULL, 'LENDER ' || CAST(document_id % 13 AS VARCHAR) FROM mtges""",
)
def q_union_align(spark, sf):
    d = B.documents(spark, sf, "F").select("document_id", "bbl", "document_amt", "buyer_name")
    m = B.documents(spark, sf, "O").select("document_id", "bbl", "document_amt",
                                           F.concat(F.lit("LENDER "), (F.col("document_id") % 13).cast("string")).alias("lender"))
    return union_align(d, m)
