"""Queries of the transform language and of chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalogue.registry import query, table
from sparkloom.functions.expressions import si_number
from sparkloom.plans import chart
from sparkloom.plans.dsl import condition, run_spec

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_FILTERS = {
    "eq": ("p", "==", "1-URGENT"), "ne": ("p", "!=", "1-URGENT"), "gt": ("o_totalprice", ">", 200000.0), "le": ("o_totalprice", "<=", 1000.0), "in": ("p", "in", ["1-URGENT", "5-LOW"]),
    "not_in": ("p", "not in", ["1-URGENT", "5-LOW"]), "between": ("o_totalprice", "between", [1000.0, 5000.0]), "contains": ("p", "contains", "H|W"),
}


@query("""WITH o AS (SELECT *, nullif(o_orderpriority, '2-HIGH') AS p FROM orders)
SELECT 'eq' AS filter, count(*) AS n FROM o WHERE p = '1-URGENT' UNION ALL SELECT 'ne', count(*) FROM o WHERE p IS DISTINCT FROM '1-URGENT'
UNION ALL SELECT 'gt', count(*) FROM o WHERE o_totalprice > 200000 UNION ALL SELECT 'le', count(*) FROM o WHERE o_totalprice <= 1000
UNION ALL SELECT 'in', count(*) FROM o WHERE p IN ('1-URGENT', '5-LOW') UNION ALL SELECT 'not_in', count(*) FROM o WHERE p IS NULL OR p NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT 'between', count(*) FROM o WHERE o_totalprice BETWEEN 1000 AND 5000 UNION ALL SELECT 'contains', count(*) FROM o WHERE coalesce(regexp_matches(p, 'H|W'), false)""")
def dsl_filters(spark, d):
    df = table(spark, d, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("2-HIGH")))
    counts = df.agg(*[F.count_if(condition(*f)).alias(k) for k, f in _FILTERS.items()])
    return counts.unpivot([], list(_FILTERS), "filter", "n")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, round(sum(o_totalprice), 2) AS total, round(max(o_totalprice), 2) AS most, count(*) AS n
FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2""")
def dsl_period_aggregate(spark, d):
    out = run_spec(
        table(spark, d, "orders"),
        {
            "transforms": [
                {"op": "filter", "field": "o_totalprice", "cmp": ">", "value": 1000.0},
                {"op": "derive", "as": "month", "fn": "to_period", "field": "o_orderdate", "freq": "M"},
                {"op": "derive", "as": "quarter", "fn": "to_period", "field": "o_orderdate", "freq": "Q"},
                {"op": "aggregate", "group_by": ["month", "quarter"], "measures": [{"field": "o_totalprice", "agg": "sum", "as": "total"}, {"field": "o_totalprice", "agg": "max", "as": "most"}, {"field": "o_orderkey", "agg": "count", "as": "n"}]},
            ]
        },
    )
    return out.withColumns({"total": F.round("total", 2), "most": F.round("most", 2)})


@query("SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def dsl_topk(spark, d):
    return run_spec(table(spark, d, "orders"), {"transforms": [{"op": "topk", "k": 3, "order_by": "o_totalprice", "group_by": ["o_orderstatus"], "tie": ["o_orderkey"]}]}).select("o_orderstatus", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, count(DISTINCT o_custkey) AS nunique, round(stddev_samp(o_totalprice), 4) AS std, round(var_samp(o_totalprice) / 1e6, 4) AS var_m, round(min(o_totalprice), 2) AS least
FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND o_orderstatus <> 'P' GROUP BY 1""")
def dsl_all_aggregates(spark, d):
    names = (("mean", "mean"), ("median", "median"), ("std", "std"), ("var", "var_m"), ("min", "least"))
    spec = {
        "transforms": [{"op": "filter", "field": "o_orderdate", "cmp": "between", "value": ["1995-01-01", "1996-12-31"]}, {"op": "filter", "field": "o_orderstatus", "cmp": "!=", "value": "P"}]
        + [{"op": "aggregate", "group_by": ["o_orderpriority"], "measures": [{"field": "o_totalprice", "agg": a, "as": n} for a, n in names] + [{"field": "o_custkey", "agg": "nunique", "as": "nunique"}]}],
    }
    out = run_spec(table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), spec)
    return out.select("o_orderpriority", *[F.round(F.col(c) / (1e6 if c == "var_m" else 1), 2 if c == "least" else 4).alias(c) for _, c in names], "nunique")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-06-30'")
def dsl_constraints(spark, d):
    spec = {"transforms": [{"op": "sort", "by": [{"field": "o_totalprice", "desc": True}, {"field": "o_orderkey"}]}], "constraints": {"filters": [{"field": "o_orderpriority", "cmp": "==", "value": "1-URGENT"}], "time_field": "o_orderdate", "time_range": ["1995-03-01", "1995-06-30"]}}
    return run_spec(table(spark, d, "orders"), spec).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def chart_bar(spark, d):
    return chart.bar(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 2))


_PIVOT = ", ".join(f"round(coalesce({{f}}(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END), 0), {{d}}) AS p{p[0]}" for p in PRIORITIES)


@query(f"SELECT o_orderstatus, {_PIVOT.format(f='sum', d=2)} FROM orders GROUP BY 1")
def chart_grouped_bar(spark, d):
    out = chart.grouped_bar(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", PRIORITIES)
    return out.select("o_orderstatus", *[F.round(F.col(f"`{p}`"), 2).alias(f"p{p[0]}") for p in PRIORITIES])


@query(f"SELECT o_orderstatus, {_PIVOT.format(f='avg', d=4)} FROM orders GROUP BY 1")
def chart_heatmap(spark, d):
    out = chart.heatmap(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", PRIORITIES)
    return out.select("o_orderstatus", *[F.round(F.col(f"`{p}`"), 4).alias(f"p{p[0]}") for p in PRIORITIES])


@query("SELECT event_type, ts, value FROM events")
def chart_line(spark, d):
    return chart.line(table(spark, d, "events"), "ts", "value", "event_type")


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT CAST(least(floor((value - lo) * 20 / (hi - lo)), 19) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(20) t(i) LEFT JOIN c ON bin = i""")
def chart_histogram(spark, d):
    return chart.histogram(table(spark, d, "events"), "value")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (WHERE i) AS low, max(value) FILTER (WHERE i) AS high, count(*) FILTER (WHERE NOT i) AS outliers
FROM (SELECT q.*, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS i FROM events JOIN q USING (event_type)) GROUP BY 1, 2, 3, 4""")
def chart_box(spark, d):
    return chart.box(table(spark, d, "events"), "event_type", "value").withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("WITH s AS (SELECT c_mktsegment, sum(c_acctbal) AS v FROM customer GROUP BY 1) SELECT c_mktsegment, round(v, 2) AS c_acctbal, round(v / sum(v) OVER (), 6) AS share FROM s WHERE v > 0")
def chart_pie(spark, d):
    return chart.pie(table(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"), F.round("share", 6).alias("share"))


@query("SELECT p_size, p_retailprice, p_brand FROM part")
def chart_scatter(spark, d):
    return chart.scatter(table(spark, d, "part"), "p_size", "p_retailprice", "p_brand")


@query("""WITH e AS (SELECT min(l_quantity) AS ax, max(l_quantity) AS bx, min(l_discount) AS ay, max(l_discount) AS b_y FROM lineitem)
SELECT CAST(least(floor((l_quantity - ax) * 20 / (bx - ax)), 19) AS BIGINT) AS bx, CAST(least(floor((l_discount - ay) * 20 / (b_y - ay)), 19) AS BIGINT) AS "by", count(*) AS n FROM lineitem, e GROUP BY 1, 2""")
def chart_bins_2d(spark, d):
    return chart.bins_2d(table(spark, d, "lineitem"), "l_quantity", "l_discount").select(F.col("bx").cast("long").alias("bx"), F.col("by").cast("long").alias("by"), "n")


@query(f"""WITH q AS (SELECT event_type, quantile_cont(value, [{", ".join(str(i / 20) for i in range(21))}]) AS q FROM events GROUP BY 1)
SELECT event_type, CAST(s - 1 AS INTEGER) AS step, round(q[s], 6) AS value FROM q, range(1, 22) t(s)""")
def chart_violin(spark, d):
    return chart.violin(table(spark, d, "events"), "event_type", "value").withColumn("value", F.round("value", 6))


_STACK = """WITH c AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, sum(o_totalprice) AS v FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND year(o_orderdate) % 2 = 0) GROUP BY 1, 2),
f AS (SELECT y, p, coalesce(v, 0) AS v FROM (SELECT DISTINCT y FROM c) CROSS JOIN (SELECT DISTINCT p FROM c) LEFT JOIN c USING (y, p)), n AS (SELECT y, p, {v} AS v FROM f)
SELECT y, p, round(v, {d}) AS v, round(sum(v) OVER w, {d}) AS top, round(sum(v) OVER w - v, {d}) + 0.0 AS bottom FROM n WINDOW w AS (PARTITION BY y ORDER BY p ROWS UNBOUNDED PRECEDING)"""


def _stack(spark, d, normalise, digits):
    df = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v")).filter("not (p = '5-LOW' and y % 2 = 0)")
    out = chart.stacked(df, "y", "p", "v", normalise=normalise)
    return out.select("y", "p", *[(F.round(c, digits) + 0.0).alias(c) for c in ("v", "top", "bottom")])


@query(_STACK.format(v="v", d=2))
def chart_stacked_bar(spark, d):
    return _stack(spark, d, False, 2)


@query(_STACK.format(v="v / CASE WHEN sum(v) OVER (PARTITION BY y) = 0 THEN 1 ELSE sum(v) OVER (PARTITION BY y) END", d=6))
def chart_stacked_share(spark, d):
    return _stack(spark, d, True, 6)


@query("SELECT o_orderdate, o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1, 2")
def chart_aggregate_repeats(spark, d):
    return chart.aggregate_repeats(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority", False).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT 'l_discount' AS \"column\", true AS ratio UNION ALL SELECT 'l_quantity', false UNION ALL SELECT 'l_tax', true")
def chart_ratio_detection(spark, d):
    df = table(spark, d, "lineitem")
    return chart.is_ratio(df, "l_discount").unionByName(chart.is_ratio(df, "l_quantity")).unionByName(chart.is_ratio(df, "l_tax"))


@query("""WITH s AS (SELECT count(v) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.9) AS q FROM (SELECT CASE WHEN event_id % 1000 = 0 THEN value * 50 ELSE value END AS v FROM events)), g AS (SELECT *, hi - q > greatest(1.0, 0.25 * (q - lo)) AS gap FROM s)
SELECT n, gap, CASE WHEN gap THEN round(q, 6) END AS gap_start, CASE WHEN gap THEN round(hi - 0.35 * (hi - q), 6) END AS gap_end FROM g""")
def chart_axis_break(spark, d):
    df = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 1000 == 0, F.col("value") * 50).otherwise(F.col("value")))
    return chart.axis_break(df, "v").withColumns({c: F.round(c, 6) for c in ("gap_start", "gap_end")})


@query("SELECT least(0.0, min(value)) AS lo, max(value) AS hi FROM events")
def chart_axis_range(spark, d):
    return chart.axis_range(table(spark, d, "events"), "value", False)


@query("SELECT p_brand FROM (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)) WHERE i % greatest(1, CAST(ceil(n / 10.0) AS BIGINT)) = 0")
def chart_thin_categories(spark, d):
    return chart.thin_categories(table(spark, d, "part"), "p_brand", 10)


@query("SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 50")
def chart_encode_sample(spark, d):
    return chart.encode_sample(table(spark, d, "events"), ["ts", "event_id"]).select("event_id", "ts", "value")


@query("SELECT event_id, value FROM events WHERE event_type <> 'error'")
def chart_prepare(spark, d):
    df = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return chart.prepare(df, "ts", ["v"], ["event_id"]).select("event_id", "value")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN printf('%.1fM', o_totalprice / 1e6) WHEN o_totalprice >= 1e3 THEN printf('%.1fK', o_totalprice / 1e3) ELSE printf('%.1f', o_totalprice) END AS shown
FROM (SELECT o_orderkey, floor(o_totalprice) + 0.25 AS o_totalprice FROM orders)""")
def chart_si_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", si_number(F.floor("o_totalprice") + F.lit(0.25)).alias("shown"))
