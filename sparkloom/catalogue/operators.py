"""Queries of the typed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalogue.registry import query, table
from sparkloom.functions.expressions import rounded
from sparkloom.operators import ordered
from sparkloom.operators.transforms import OPERATORS as OP


@query("SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS wavg FROM lineitem")
def weighted_mean(spark, d):
    out = OP["weighted_mean"]({"df": table(spark, d, "lineitem")}, {"value": "l_extendedprice", "weight": "l_quantity"})
    return out.select(F.round("wavg", 6).alias("wavg"))


@query("SELECT o_orderkey, o_orderpriority, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority), 9) AS share FROM orders")
def within_group_share(spark, d):
    out = OP["within_group_share"]({"df": table(spark, d, "orders")}, {"group": "o_orderpriority", "value": "o_totalprice"})
    return out.select("o_orderkey", "o_orderpriority", F.round("share", 9).alias("share"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_tax - l_discount) * 100, 6) + 0.0 AS pp FROM lineitem")
def pct_point(spark, d):
    out = OP["pct_point"]({"df": table(spark, d, "lineitem")}, {"new": "l_tax", "old": "l_discount"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round("pp", 6) + 0.0).alias("pp"))


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM (SELECT DISTINCT o_orderkey, o_orderpriority, o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1")
def dedup_then_agg(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    lines = orders.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    out = OP["dedup_then_agg"]({"df": lines}, {"key": "o_orderkey", "value": "o_totalprice", "group": "o_orderpriority"})
    return out.select("o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT o_orderkey, o_totalprice, n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def left_join_keep_all(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return OP["left_join_keep_all"]({"df": table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "df2": lines}, {})


@query("SELECT l_returnflag, round(sum(l_discount) / sum(l_tax), 6) AS ctr FROM lineitem GROUP BY 1")
def pooled_rate(spark, d):
    out = OP["pooled_rate"]({"df": table(spark, d, "lineitem")}, {"group": "l_returnflag", "num": "l_discount", "den": "l_tax"})
    return out.select("l_returnflag", F.round("ctr", 6).alias("ctr"))


@query("SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def median_per_group(spark, d):
    out = OP["median_not_mean"]({"df": table(spark, d, "lineitem")}, {"group": ["l_returnflag", "l_linestatus"], "value": "l_extendedprice"})
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS balance FROM events")
def cumulative_running(spark, d):
    out = OP["cumulative_running"]({"df": table(spark, d, "events")}, {"value": "value", "order": ["ts", "event_id"]})
    return out.select("event_id", F.round("balance", 4).alias("balance"))


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS balance FROM events")
def running_total_in_group(spark, d):
    out = OP["cumulative_running"]({"df": table(spark, d, "events")}, {"group": "user_id", "value": "value", "order": ["ts", "event_id"]})
    return out.select("event_id", "user_id", F.round("balance", 6).alias("balance"))


@query("SELECT event_id, value FROM (SELECT *, rank() OVER (ORDER BY value DESC) AS r FROM events) WHERE r <= 50")
def topn_with_ties(spark, d):
    return OP["topn_with_ties"]({"df": table(spark, d, "events")}, {"value": "value", "n": 50}).select("event_id", "value")


@query("SELECT event_id, event_type, value FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS r FROM events) WHERE r <= 2")
def topn_with_ties_in_group(spark, d):
    return OP["topn_with_ties"]({"df": table(spark, d, "events")}, {"group": "event_type", "value": "value", "n": 2}).select("event_id", "event_type", "value")


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'error' OR user_id % 7 = 0 THEN 0 ELSE value END), 6) AS v FROM events GROUP BY 1")
def null_as_zero_sum(spark, d):
    v = F.when((F.col("event_type") == "error") | (F.col("user_id") % 7 == 0), None).otherwise(F.col("value"))
    out = OP["nan_as_zero_sum"]({"df": table(spark, d, "events").withColumn("v", v)}, {"group": "user_id", "value": "v"})
    return out.select("user_id", F.round("v", 6).alias("v"))


@query("SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey % 3 <> 0) ON n_nationkey = s_nationkey GROUP BY 1")
def count_includes_empty(spark, d):
    suppliers = table(spark, d, "supplier").filter("s_nationkey % 3 <> 0").withColumnRenamed("s_nationkey", "n_nationkey")
    return OP["count_includes_empty"]({"df": suppliers, "domain": table(spark, d, "nation")}, {"category": "n_nationkey"})


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 9) AS pass_rate FROM orders GROUP BY 1")
def proportion_true(spark, d):
    out = OP["proportion_true"]({"df": table(spark, d, "orders").withColumn("passed", F.col("o_orderstatus") == "F")}, {"group": "o_orderpriority", "flag": "passed"})
    return out.select("o_orderpriority", F.round("pass_rate", 9).alias("pass_rate"))


@query("SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def zscore_within_group(spark, d):
    out = OP["zscore_within_group"]({"df": table(spark, d, "events")}, {"group": "event_type", "value": "value"})
    return out.select("event_id", (F.round("z", 6) + 0.0).alias("z"))


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY value DESC) AS BIGINT) AS rank FROM events")
def dense_rank(spark, d):
    return OP["dense_rank"]({"df": table(spark, d, "events")}, {"value": "value"}).select("event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS occurrence FROM events")
def cumcount_per_group(spark, d):
    return OP["cumcount_per_group"]({"df": table(spark, d, "events")}, {"group": "user_id", "order": ["ts", "event_id"]}).select("event_id", "occurrence")


@query("SELECT event_id, round((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(*) OVER (), 9) AS pct FROM events")
def rank_pct(spark, d):
    return OP["rank_pct"]({"df": table(spark, d, "events")}, {"value": "value"}).select("event_id", F.round("pct", 9).alias("pct"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE least(greatest(value, 10), 60) END AS v FROM events")
def clip_outlier(spark, d):
    df = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return OP["clip_outlier"]({"df": df}, {"value": "v", "lo": 10.0, "hi": 60.0}).select("event_id", "v")


@query("SELECT c_custkey, round(c_acctbal + coalesce(s, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def align_by_key(spark, d):
    sums = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    out = OP["index_align"]({"df": table(spark, d, "customer"), "df2": sums}, {"key": "c_custkey", "value": "c_acctbal", "addend": "s"})
    return out.select("c_custkey", F.round("total", 2).alias("total"))


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key FROM customer")
def id_as_string(spark, d):
    df = table(spark, d, "customer").withColumn("code", F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return OP["dtype_coerce"]({"df": df}, {"id_col": "code"}).select("c_custkey", "key")


@query("SELECT nullif(o_orderpriority, '4-NOT SPECIFIED') AS g, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def null_key_group(spark, d):
    df = table(spark, d, "orders").withColumn("g", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))
    return OP["groupby_dropna_key"]({"df": df}, {"group": "g", "value": "o_totalprice"}).select("g", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, d):
    # Columns are chosen first: the row that is kept is one struct, which the scan cannot prune behind it.
    df = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return OP["order_dependent_dedup"]({"df": df}, {"key": "user_id", "order": ["ts", "event_id"]})


@query("""WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS ts, sum(value) AS v FROM events GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(ts) FROM s), (SELECT max(ts) FROM s), INTERVAL 1 HOUR)) AS ts)
SELECT spine.ts AS ts, round(coalesce(v, 0), 6) AS value FROM spine LEFT JOIN s ON spine.ts = s.ts""")
def resample_right(spark, d):
    df = table(spark, d, "events")
    out = OP["resample_boundary"]({"df": df}, {"time": "ts", "value": "value", "freq": "1 hour"})
    return out.select("ts", F.round("value", 6).alias("value"))


@query("SELECT n_nationkey, '  ' || upper(n_name) || ' ' AS name, n_regionkey * 10 AS v FROM nation")
def normalised_join(spark, d):
    nation = table(spark, d, "nation")
    left = nation.select("n_nationkey", F.concat(F.lit("  "), F.upper("n_name"), F.lit(" ")).alias("name"))
    right = nation.select(F.concat(F.lower("n_name"), F.lit("\t")).alias("name"), (F.col("n_regionkey") * 10).alias("v"))
    return OP["string_normalize_join"]({"df": left, "df2": right}, {"key": "name", "lookup_value": "v"}).select("n_nationkey", "name", "v")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def fanout_safe_agg(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    out = OP["join_fanout"]({"df": table(spark, d, "orders"), "df2": lines}, {"group": "o_orderpriority", "measure": "o_totalprice", "matched_on": "o_orderkey"})
    return out.select("o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT event_type, count(*) AS n, count(CASE WHEN value > 20 THEN value END) AS n_present FROM events GROUP BY 1")
def count_star_vs_col(spark, d):
    df = table(spark, d, "events").withColumn("v", F.when(F.col("value") > 20, F.col("value")))
    n = OP["null_in_agg_count"]({"df": df}, {"group": "event_type"})
    present = OP["mean_and_count"]({"df": df}, {"group": "event_type", "value": "v"}).select("event_type", F.col("n").alias("n_present"))
    return n.join(present, "event_type")


@query("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 5 <> 0) SELECT event_id, round((value - m) / s, 6) + 0.0 AS scaled FROM events, s")
def train_only_scaling(spark, d):
    df = table(spark, d, "events").withColumn("split", F.when(F.col("event_id") % 5 == 0, "test").otherwise("train"))
    out = OP["scale_before_split_leakage"]({"df": df}, {"feature": "value", "split": "split", "train_label": "train"})
    return out.select("event_id", (F.round("scaled", 6) + 0.0).alias("scaled"))


@query("SELECT event_id, user_id, round(value / lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, 6) + 0.0 AS ret FROM events")
def past_return(spark, d):
    out = OP["lookahead_return"]({"df": table(spark, d, "events")}, {"price": "value", "group": "user_id", "order": ["ts", "event_id"]})
    return out.select("event_id", "user_id", (rounded(F.col("ret"), 6) + 0.0).alias("ret"))


@query("SELECT event_id, round(value / lag(value) OVER (ORDER BY ts, event_id) - 1, 6) + 0.0 AS ret FROM events")
def past_return_global(spark, d):
    out = OP["lookahead_return"]({"df": table(spark, d, "events")}, {"price": "value", "order": ["ts", "event_id"]})
    return out.select("event_id", (rounded(F.col("ret"), 6) + 0.0).alias("ret"))


@query("SELECT s_suppkey, s_acctbal / 10000.0 * 90 AS lat, s_nationkey * 7.0 AS lon FROM supplier")
def latlon_identity(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000.0 * 90).alias("lat"), (F.col("s_nationkey") * F.lit(7.0)).alias("lon"))
    return OP["latlon_swap"]({"df": df}, {"lat": "lat", "lon": "lon"})


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 6) AS total, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def array_diff(spark, d):
    df = table(spark, d, "embeddings").withColumn("back", F.reverse("embedding"))
    out = OP["array_difference"]({"df": df}, {"a": "embedding", "b": "back"})
    return out.select("vec_id", F.round(F.aggregate("diff", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"), F.size("diff").cast("long").alias("n"))


@query("WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT strftime(m, '%Y-%m') AS month, round(v / p - 1, 6) + 0.0 AS growth FROM (SELECT m, v, lag(v) OVER (ORDER BY m) AS p FROM m) WHERE p IS NOT NULL")
def mom_growth(spark, d):
    months = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    out = OP["growth_rate"]({"df": months}, {"value": "v", "order": ["m"]})
    return out.select(F.date_format("m", "yyyy-MM").alias("month"), (F.round("growth", 6) + 0.0).alias("growth"))


@query("SELECT event_type, round(avg(CASE WHEN value > 20 THEN value END), 6) AS mean, count(CASE WHEN value > 20 THEN value END) AS n FROM events GROUP BY 1")
def mean_and_count(spark, d):
    df = table(spark, d, "events").withColumn("v", F.when(F.col("value") > 20, F.col("value")))
    return OP["mean_and_count"]({"df": df}, {"group": "event_type", "value": "v"}).select("event_type", F.round("mean", 6).alias("mean"), "n")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def top2_per_group(spark, d):
    out = OP["top_per_group"]({"df": table(spark, d, "orders")}, {"group": "o_orderpriority", "value": "o_totalprice", "n": 2, "order": ["o_orderkey"]})
    return out.select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name, round(sum(c_acctbal) OVER (ORDER BY c_mktsegment, c_name, c_custkey ROWS UNBOUNDED PRECEDING), 2) + 0.0 AS balance FROM customer")
def running_sum_by_text(spark, d):
    out = ordered.running_sum(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment", "c_name", "c_custkey"], "balance")
    return out.select("c_custkey", "c_name", (F.round("balance", 2) + 0.0).alias("balance"))


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name DESC) AS BIGINT) AS rank FROM part")
def dense_rank_of_text(spark, d):
    return ordered.dense_rank(table(spark, d, "part"), "p_name", "rank").select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, row_number() OVER (ORDER BY text, doc_id) AS place FROM documents")
def numbered_by_text(spark, d):
    return ordered.numbered(table(spark, d, "documents").select("doc_id", "text"), ["text", "doc_id"], "place").select("doc_id", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, round((rank() OVER (ORDER BY text) + (count(*) OVER (PARTITION BY text) - 1) / 2) / count(*) OVER (), 9) AS pct FROM documents")
def rank_pct_of_text(spark, d):
    return ordered.rank_pct(table(spark, d, "documents").select("doc_id", "text"), "text", "pct").select("doc_id", F.round("pct", 9).alias("pct"))
