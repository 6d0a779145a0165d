"""Queries of profiles, sheets, matching and corruptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalogue.registry import query, table
from sparkloom.operators import matching
from sparkloom.sources import profile

_NUMERIC = ("o_orderkey", "o_custkey", "o_totalprice")
_COLUMNS = {"o_orderkey": "quantitative", "o_custkey": "quantitative", "o_orderstatus": "categorical", "o_totalprice": "quantitative", "o_orderdate": "temporal", "o_orderpriority": "categorical"}


def _profile_sql() -> str:
    number_of = lambda c, f: f"round({f}(CAST({c} AS DOUBLE)), 4)" if c in _NUMERIC else "CAST(NULL AS DOUBLE)"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{s}' AS semantic, count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", {number_of(c, 'min')} AS \"min\", {number_of(c, 'max')} AS \"max\", {number_of(c, 'avg')} AS mean, {number_of(c, 'stddev_pop')} AS std FROM orders" for c, s in _COLUMNS.items()
    )


@query(_profile_sql())
def profile_columns(spark, d):
    return profile.column_profile(table(spark, d, "orders"), list(_COLUMNS)).withColumns({c: F.round(c, 4) for c in ("min", "max", "mean", "std")})


@query("""WITH l AS (SELECT 'o_orderstatus' AS "column", nullif(o_orderstatus, 'P') AS value FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders), c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY 1, 2)
SELECT "column", value, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS r FROM c) WHERE r <= 5""")
def profile_top_values(spark, d):
    df = table(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return profile.top_values(df, ["o_orderstatus", "o_custkey"])


def _messy(spark, d):
    """A text table with numbers, dates, codes with zeros, and noise."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k, F.when(k % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("amount"), F.lpad(k.cast("string"), 6, "0").alias("code"),
        F.when(k % 2 == 0, "x").otherwise("1").alias("half"), F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("day"),
    )


@query("""SELECT 'amount' AS "column", count(*) AS n, round(avg(CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE 1.0 END), 6) AS numeric, 0.0 AS temporal, false AS zeros FROM customer
UNION ALL SELECT 'code', count(*), 1.0, 0.0, true FROM customer UNION ALL SELECT 'half', count(*), round(avg(CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE 1.0 END), 6), 0.0, false FROM customer UNION ALL SELECT 'day', count(*), 0.0, 1.0, false FROM customer""")
def profile_parse_shares(spark, d):
    shares = profile.parse_shares(_messy(spark, d), ["amount", "code", "half", "day"])
    # Plain numbers may parse as years; only the share of dates of the date column is compared.
    return shares.select("column", "n", F.round("numeric", 6).alias("numeric"), F.when(F.col("column") == "day", F.col("temporal")).otherwise(0.0).alias("temporal"), "zeros")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) END AS amount, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '1' END AS half FROM customer")
def profile_coerce(spark, d):
    return profile.coerce_types(_messy(spark, d), ["amount", "code", "half", "day"]).select("c_custkey", "amount", "code", "half")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 15")
def cap_per_source(spark, d):
    return profile.cap_per_source(table(spark, d, "documents").select("lang", "doc_id"), "lang", ["doc_id"], 15)


# ---------------------------------------------------------------- matching


def _wide(spark, d):
    return table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_tax"), 2).alias("tax"))


@query("""WITH w AS (SELECT l_shipdate, round(sum(l_quantity), 2) AS quantity, round(sum(l_tax), 2) AS tax FROM lineitem GROUP BY 1)
SELECT 'quantity' AS series, strftime(l_shipdate, '%Y-%m-%d') AS x, quantity AS value FROM w UNION ALL SELECT 'tax', strftime(l_shipdate, '%Y-%m-%d'), tax FROM w""")
def wide_to_long(spark, d):
    return matching.wide_to_long(_wide(spark, d).withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")), "l_shipdate", ["quantity", "tax"])


def _pair(spark, d, factor=1.0):
    """Truth by month and flag, and a prediction with one series scaled."""
    rows = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("x"), F.col("l_returnflag").alias("series")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    pred = rows.withColumn("value", F.when(F.col("series") == "A", F.col("value") * factor).otherwise(F.col("value"))).withColumn("n", F.xxhash64("x", "series") % 1000000)
    return pred, rows


@query("""SELECT series, x, CASE WHEN series = 'A' THEN CASE WHEN abs(v - v * 0.7) <= greatest(v * 0.015, 1.0) THEN 'match' ELSE 'wrong_value' END ELSE 'match' END AS type, v AS gt, round(CASE WHEN series = 'A' THEN v * 0.7 ELSE v END, 6) AS pred
FROM (SELECT l_returnflag AS series, strftime(l_shipdate, '%Y-%m') AS x, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1, 2)""")
def greedy_match(spark, d):
    pred, truth = _pair(spark, d, 0.7)
    return matching.greedy_match(pred, truth, "n").select("series", "x", "type", "gt", F.round("pred", 6).alias("pred"))


@query("""SELECT count(*) FILTER (WHERE ok) AS tp, count(*) FILTER (WHERE NOT ok) AS fp, CAST(0 AS BIGINT) AS fn, round(2.0 * count(*) FILTER (WHERE ok) / (count(*) + count(*) FILTER (WHERE ok)), 6) AS f1
FROM (SELECT series <> 'A' OR abs(v - v * 0.7) <= greatest(v * 0.015, 1.0) AS ok FROM (SELECT l_returnflag AS series, strftime(l_shipdate, '%Y-%m') AS x, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1, 2))""")
def match_f1(spark, d):
    pred, truth = _pair(spark, d, 0.7)
    return matching.f1(matching.greedy_match(pred, truth, "n")).withColumn("f1", F.round("f1", 6))


@query("SELECT count(*) AS tp, count(*) AS n_pred, count(*) AS n_truth, 1.0 AS rnss FROM (SELECT 1 FROM lineitem GROUP BY l_returnflag, strftime(l_shipdate, '%Y-%m'))")
def match_values_only(spark, d):
    pred, truth = _pair(spark, d)
    return matching.rnss(pred, truth, "n")


@query("""SELECT event_id, arg_min(label, (abs(pos - value), pos)) AS label FROM events, (VALUES (0.0, 'zero'), (25.0, 'low'), (50.0, 'mid'), (75.0, 'high')) t(pos, label) GROUP BY 1""")
def snap_to_ticks(spark, d):
    ticks = spark.createDataFrame([(0.0, "zero"), (25.0, "low"), (50.0, "mid"), (75.0, "high")], "pos double, label string")
    return matching.snap_to_ticks(table(spark, d, "events").select("event_id", F.col("value").alias("x")), ticks).select("event_id", "label")


@query("SELECT event_type, round(avg(score), 6) AS score FROM (SELECT event_type, (least(greatest(value / 100, 0), 1) * 0.5 + least(greatest(value / 20, 0), 1) * 0.3) / 0.8 AS score FROM events) GROUP BY 1")
def weighted_scores(spark, d):
    s = matching.weighted_score({"a": F.col("value") / 100, "b": None, "c": F.col("value") / 20}, {"a": 0.5, "b": 0.5, "c": 0.3})
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(s), 6).alias("score"))


@query("SELECT event_type, round(avg(CASE WHEN value > 10 THEN value END), 6) AS mean, count(*) FILTER (WHERE value > 10) AS n_ok FROM events GROUP BY 1")
def ablation_means(spark, d):
    return matching.ablation_means(table(spark, d, "events").withColumn("ok", F.col("value") > 10), "event_type", "value", "ok").withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, CASE WHEN value >= 99 THEN 'full' WHEN value >= 50 THEN 'partial' ELSE 'none' END AS class FROM events")
def coverage_class(spark, d):
    return table(spark, d, "events").select("event_id", matching.coverage_class(F.col("value") / 100).alias("class"))


@query("""WITH w AS (SELECT l_shipdate, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1), e AS (SELECT arg_min(v, l_shipdate) AS a, arg_max(v, l_shipdate) AS b, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM w)
SELECT l_shipdate, CASE WHEN l_shipdate = lo THEN b WHEN l_shipdate = hi THEN a ELSE v END AS quantity, round(v * 0.7, 6) AS scaled, 0.0 AS dropped FROM w, e""")
def corruptions(spark, d):
    df = _wide(spark, d)
    swapped = matching.swap_categories(df.select("l_shipdate", "quantity"), "quantity", "l_shipdate")
    scaled = matching.scale_series(df.select("l_shipdate", "quantity"), "quantity").select("l_shipdate", F.round("quantity", 6).alias("scaled"))
    dropped = matching.drop_series(df, ["quantity", "tax"], "tax").select("l_shipdate", F.col("tax").alias("dropped"))
    return swapped.join(scaled, "l_shipdate").join(dropped, "l_shipdate")


@query("""WITH w AS (SELECT l_shipdate, round(sum(l_quantity), 2) AS v, md5('0|' || CAST(l_shipdate AS VARCHAR)) AS h FROM lineitem GROUP BY 1) SELECT l_shipdate, CASE WHEN h = (SELECT min(h) FROM w) THEN CASE WHEN v = 0 THEN 42.0 ELSE v * 0.6 END ELSE v END AS quantity FROM w""")
def corruption_wrong_value(spark, d):
    return matching.wrong_value(_wide(spark, d), "quantity", ["l_shipdate"]).select("l_shipdate", "quantity")
