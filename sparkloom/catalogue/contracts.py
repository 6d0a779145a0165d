"""Queries of the contract engine, statistics, intent rules, repair, comparison and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalogue.registry import query, table
from sparkloom.contracts import engine
from sparkloom.functions import statistics
from sparkloom.operators.slips import SLIPS
from sparkloom.operators.transforms import OPERATORS
from sparkloom.plans import intent


def cases(spark, d):
    """One case for each operator over the test tables: name -> (inputs, roles)."""
    t = lambda n: table(spark, d, n)
    orders, events, lines, customer, nation, supplier = (t(n) for n in ("orders", "events", "lineitem", "customer", "nation", "supplier"))
    fan = lines.select(F.col("l_orderkey").alias("o_orderkey"))
    missing = events.withColumn("v", F.when(F.col("event_type") != "error", F.col("value"))).withColumn("g", F.col("user_id") % 9)
    by_key = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s")).filter("c_custkey % 3 <> 0")
    on = ["ts", "event_id"]
    return {
        "weighted_mean": ({"df": lines}, {"value": "l_discount", "weight": "l_extendedprice"}),
        "within_group_share": ({"df": orders}, {"group": "o_orderpriority", "value": "o_totalprice"}),
        "pct_point": ({"df": lines}, {"new": "l_tax", "old": "l_discount"}),
        "dedup_then_agg": ({"df": orders.join(fan, "o_orderkey")}, {"key": "o_orderkey", "value": "o_totalprice", "group": "o_orderpriority"}),
        "left_join_keep_all": ({"df": orders, "df2": fan.distinct().filter("o_orderkey % 2 = 0")}, {"key": "o_orderkey"}),
        "pooled_rate": ({"df": lines}, {"group": "l_returnflag", "num": "l_discount", "den": "l_quantity"}),
        "median_not_mean": ({"df": lines}, {"group": "l_returnflag", "value": "l_extendedprice"}),
        "cumulative_running": ({"df": events}, {"value": "value", "order": on}),
        "topn_with_ties": ({"df": customer.withColumn("v", F.floor(F.col("c_acctbal") / 100))}, {"value": "v", "n": 5}),
        "nan_as_zero_sum": ({"df": missing}, {"group": "g", "value": "v"}),
        "count_includes_empty": ({"df": supplier.filter("s_nationkey % 3 <> 0").withColumnRenamed("s_nationkey", "n_nationkey"), "domain": nation}, {"category": "n_nationkey"}),
        "proportion_true": ({"df": orders.withColumn("passed", F.col("o_orderstatus") == "F")}, {"group": "o_orderpriority", "flag": "passed"}),
        "zscore_within_group": ({"df": events.withColumn("g", F.col("user_id") % 9)}, {"group": "g", "value": "value"}),
        "dense_rank": ({"df": events.withColumn("v", F.floor("value"))}, {"value": "v"}),
        "cumcount_per_group": ({"df": events}, {"group": "user_id", "order": on}),
        "rank_pct": ({"df": events}, {"value": "value"}),
        "clip_outlier": ({"df": events}, {"value": "value", "lo": 10.0, "hi": 60.0}),
        "index_align": ({"df": customer, "df2": by_key}, {"key": "c_custkey", "value": "c_acctbal", "addend": "s"}),
        "dtype_coerce": ({"df": customer.withColumn("code", F.lpad(F.col("c_custkey").cast("string"), 9, "0"))}, {"id_col": "code"}),
        "groupby_dropna_key": ({"df": orders.withColumn("g", F.nullif("o_orderpriority", F.lit("2-HIGH")))}, {"group": "g", "value": "o_totalprice"}),
        "order_dependent_dedup": ({"df": events}, {"key": "user_id", "order": on}),
        "resample_boundary": ({"df": events.withColumn("ts", F.date_trunc("hour", "ts"))}, {"time": "ts", "value": "value", "freq": "3 hours"}),
        "string_normalize_join": ({"df": nation.select("n_nationkey", F.concat(F.lit(" "), F.upper("n_name")).alias("name")), "df2": nation.select(F.lower("n_name").alias("name"), F.col("n_regionkey").alias("v"))}, {"key": "name", "lookup_value": "v"}),
        "join_fanout": ({"df": orders, "df2": fan}, {"group": "o_orderpriority", "measure": "o_totalprice", "matched_on": "o_orderkey"}),
        "null_in_agg_count": ({"df": missing}, {"group": "g", "value": "v"}),
        "scale_before_split_leakage": ({"df": events.withColumn("split", F.when(F.col("value") > 40, "test").otherwise("train"))}, {"feature": "value", "split": "split", "train_label": "train"}),
        "lookahead_return": ({"df": events}, {"price": "value", "group": "user_id", "order": on}),
        "latlon_swap": ({"df": supplier.select((F.col("s_nationkey") * 3.0).alias("lat"), (F.col("s_acctbal") / 60).alias("lon"))}, {"lat": "lat", "lon": "lon"}),
        "array_difference": ({"df": t("embeddings").withColumn("back", F.reverse("embedding"))}, {"a": "embedding", "b": "back"}),
    }


_NAMES = ", ".join(f"('{n}')" for n in SLIPS)


@query(f"SELECT name AS contract, true AS applicable, false AS fired FROM (VALUES {_NAMES}) t(name)")
def contract_verdicts_correct(spark, d):
    rows = [(n, i, p, OPERATORS[n](i, p)) for n, (i, p) in cases(spark, d).items()]
    return engine.verdicts(rows).select("contract", "applicable", "fired")


@query(f"SELECT name AS contract, true AS applicable, true AS fired FROM (VALUES {_NAMES}) t(name)")
def contract_verdicts_slip(spark, d):
    rows = [(n, i, p, SLIPS[n](i, p)) for n, (i, p) in cases(spark, d).items()]
    return engine.verdicts(rows).select("contract", "applicable", "fired")


@query("SELECT * FROM (VALUES ('no_such_operator', false, CAST(NULL AS BOOLEAN)), ('pooled_rate', false, NULL), ('median_not_mean', false, NULL), ('dense_rank', true, true)) t(contract, applicable, fired)")
def contract_abstains(spark, d):
    df = table(spark, d, "events")
    rows = [("no_such_operator", {"df": df}, {}, df), ("pooled_rate", {"df": df}, {"group": "event_type"}, df), ("median_not_mean", {"df": df}, {"group": "absent", "value": "value"}, df), ("dense_rank", {"df": df}, {"value": "value"}, df)]
    return engine.verdicts(rows).select("contract", "applicable", "fired")


_SUBSTRATE = {
    "pooled_rate": ("SELECT l_returnflag, sum(l_discount) / sum(l_quantity) AS ctr FROM lineitem GROUP BY 1", "SELECT l_returnflag, avg(l_discount / l_quantity) AS ctr FROM lineitem GROUP BY 1"),
    "groupby_dropna_key": ("SELECT nullif(o_orderpriority, '2-HIGH') AS g, sum(o_totalprice) AS o_totalprice FROM orders GROUP BY 1", "SELECT nullif(o_orderpriority, '2-HIGH') AS g, sum(o_totalprice) AS o_totalprice FROM orders WHERE o_orderpriority <> '2-HIGH' GROUP BY 1"),
    "median_not_mean": ("SELECT l_returnflag, median(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1", "SELECT l_returnflag, avg(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1"),
    "proportion_true": ("SELECT o_orderpriority, avg(CAST(o_orderstatus = 'F' AS INT)) AS pass_rate FROM orders GROUP BY 1", "SELECT o_orderpriority, sum(CAST(o_orderstatus = 'F' AS INT)) AS pass_rate FROM orders GROUP BY 1"),
    "within_group_share": ("SELECT o_orderpriority, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS share FROM orders", "SELECT o_orderpriority, o_totalprice / sum(o_totalprice) OVER () AS share FROM orders"),
    "cumulative_running": ("SELECT *, sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS balance FROM events", "SELECT *, value AS balance FROM events"),
}


@query("SELECT name AS contract, form, form = 'slip' AS fired FROM (VALUES " + ", ".join(f"('{n}')" for n in _SUBSTRATE) + ") t(name), (VALUES ('right'), ('slip')) u(form)")
def contract_sql_substrate(spark, d):
    """The same contracts over results of SQL text."""
    for n in ("lineitem", "orders", "events"):
        table(spark, d, n).createOrReplaceTempView(n)
    given, out = cases(spark, d), None
    for form in (0, 1):
        rows = engine.verdicts([(n, *given[n], spark.sql(q[form])) for n, q in _SUBSTRATE.items()]).select("contract", F.lit(("right", "slip")[form]).alias("form"), "fired")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH c AS (SELECT event_type, CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1)
SELECT event_type, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(k / n, 9) AS rate, round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 9) AS lo, round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 9) AS hi FROM c""")
def wilson(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count(F.lit(1)).alias("n"))
    return statistics.with_wilson(c, "k", "n").select("event_type", "k", "n", *[F.round(x, 9).alias(x) for x in ("rate", "lo", "hi")])


@query("""SELECT event_type, count(*) FILTER (WHERE ok AND w AND f) AS tp, count(*) FILTER (WHERE ok AND w AND NOT f) AS fn, count(*) FILTER (WHERE ok AND NOT w AND f) AS fp, count(*) FILTER (WHERE ok AND NOT w AND NOT f) AS tn,
count(*) FILTER (WHERE NOT ok) AS crashes, round(count(*) FILTER (WHERE ok AND w) / count(*) FILTER (WHERE ok), 9) AS silent_rate FROM (SELECT event_type, event_id % 11 <> 0 AS ok, value > 50 AS w, event_id % 3 = 0 AS f FROM events) GROUP BY 1""")
def confusion(spark, d):
    df = table(spark, d, "events").select("event_type", (F.col("event_id") % 11 == 0).alias("c"), (F.col("value") > 50).alias("w"), (F.col("event_id") % 3 == 0).alias("f"))
    return statistics.confusion(df, ["event_type"], "w", "f", "c").withColumn("silent_rate", F.round("silent_rate", 9))


@query("""SELECT count(*) FILTER (WHERE own AND w) AS n_own, count(*) FILTER (WHERE own AND w AND f) AS hit, count(*) FILTER (WHERE NOT own AND NOT w) AS n_other, count(*) FILTER (WHERE NOT own AND NOT w AND f) AS "cross"
FROM (SELECT event_type = 'error' AS own, value > 50 AS w, event_id % 3 = 0 AS f FROM events)""")
def attribution(spark, d):
    df = table(spark, d, "events").select(F.lit("error").alias("truth"), F.col("event_type").alias("contract"), (F.col("value") > 50).alias("wrong"), (F.col("event_id") % 3 == 0).alias("fired"))
    return statistics.attribution(df)


@query("SELECT event_type, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def variant_spread(spark, d):
    return statistics.spread(table(spark, d, "events"), ["event_type"], "value").withColumn("std", F.round("std", 6))


@query("SELECT event_id, i > n - CASE WHEN n = 1 THEN 0 ELSE greatest(1, CAST(round_even(n * 0.3, 0) AS BIGINT)) END AS held_out FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def stratified_split(spark, d):
    return statistics.stratified_split(table(spark, d, "events"), "user_id", ["event_id"]).select("event_id", "held_out")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events) WHERE p IN (SELECT CAST(floor(j * (SELECT count(*) FROM events) / 77) AS BIGINT) FROM range(77) t(j))")
def even_stride(spark, d):
    return statistics.even_stride(table(spark, d, "events").select("event_id"), ["event_id"], 77)


_CODE = ("df.groupby('a').sum()", "df.merge(x).groupby('b').rank()", "df.fillna(0).cumsum()", "df.groupby('a').apply(f)")


def _code(spark, d):
    """A line of code for every event, in one of four forms, and the request it came from."""
    pick = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(pick(*_CODE).alias("code"), pick("sum by group", "mean by group", "running sum", "by group, please").alias("prompt"))


@query("SELECT family, count(*) AS n FROM events JOIN (VALUES ('groupby', 0), ('groupby', 1), ('groupby', 3), ('apply', 3), ('cumulative', 2), ('fill', 2), ('join', 1), ('rank', 1)) t(family, k) ON event_id % 4 = k GROUP BY 1")
def prevalence(spark, d):
    return statistics.prevalence(_code(spark, d), "code")


@query("SELECT count(*) FILTER (WHERE event_id % 4 <> 2) AS hits, count(*) FILTER (WHERE event_id % 4 IN (0, 3)) AS confirmed, count(*) AS n FROM events")
def rule_precision(spark, d):
    """How often a rule on the request is borne out by the code: here it asks for a grouping by 'a'."""
    return statistics.rule_precision(_code(spark, d), "prompt", "code", "by group", r"groupby\('a'")


_PROMPTS = [
    ("What is the average price weighted by quantity?", "weighted_mean"), ("Give each city's share of its region's sales", "within_group_share"), ("Report the change in percentage points", "pct_point"),
    ("Total revenue, but count each order once", "dedup_then_agg"), ("List all customers, keep all rows even if there is no match", "left_join_keep_all"), ("Pooled click rate by region", "pooled_rate"),
    ("What does a typical order cost, by segment?", "median_not_mean"), ("Show the running balance", "cumulative_running"), ("Show the top 3 scores with ties", "topn_with_ties"),
    ("Sum by group where missing values count as zero", "nan_as_zero_sum"), ("Count per category including empty ones", "count_includes_empty"), ("The pass rate by class", "proportion_true"),
    ("Z-score of each value in its batch", "zscore_within_group"), ("Rank teams without gaps", "dense_rank"), ("The occurrence number of each event by user", "cumcount_per_group"), ("Each player's percentile", "rank_pct"),
    ("Cap readings at 0 and 100", "clip_outlier"), ("Tell me a story", None),
]


#: More forms, with a place for a word of the table; what is ruled out is said in some.
_FORMS = [(p, op) for p, op in _PROMPTS] + [
    ("Price of {} parts, each weighted by its quantity, not the plain mean", "weighted_mean"), ("For {} give each sale divided by its own region's total", "within_group_share"),
    ("How did {} change, in percentage points?", "pct_point"), ("Sales of {}: count every order exactly once", "dedup_then_agg"), ("A left join of {} with its scores", "left_join_keep_all"),
    ("Total clicks / total views of {}, rather than a mean of rates", "pooled_rate"), ("The median order of {}", "median_not_mean"), ("Cumulative spend of {}", "cumulative_running"),
    ("Top 5 of {} with all ties", "topn_with_ties"), ("Sum of {} with blanks or missing entries treated as 0", "nan_as_zero_sum"), ("Rows of {} per category, even categories with zero rows, include zero counts", "count_includes_empty"),
    ("Fraction of {} rows that passed", "proportion_true"), ("z-score of {} within each batch", "zscore_within_group"), ("Dense rank of {}", "dense_rank"), ("A running count of {} that restarts for each user", "cumcount_per_group"),
    ("Percentile of {} among all, not a plain rank", "rank_pct"), ("Clip {} to the range 0 to 9", "clip_outlier"), ("Align {} by key", "index_align"), ("Keep the {} code as a string, with leading zeros", "dtype_coerce"),
    ("Sum {} with a missing key as its own group", "groupby_dropna_key"), ("The latest row of {} for each id", "order_dependent_dedup"), ("Resample {} into right-closed bins", "resample_boundary"),
    ("Join {} by name, ignoring case", "string_normalize_join"), ("Total of {} without double-counting by tags", "join_fanout"), ("How many rows has {}? Use group sizes", "null_in_agg_count"),
    ("Standardize {} with the mean of the train rows", "scale_before_split_leakage"), ("The daily return of {}", "lookahead_return"), ("Latitude and longitude of {}", "latlon_swap"),
    ("Subtract the vectors of {} element by element", "array_difference"), ("Not the median of {}, please", None), ("Hello {}", None),
]


@query("SELECT c_custkey, CASE c_custkey % " + str(len(_FORMS)) + " " + " ".join(f"WHEN {k} THEN {repr(op) if op else 'NULL'}" for k, (_, op) in enumerate(_FORMS)) + " END AS op FROM customer")
def intent_rules(spark, d):
    """A question about every customer's segment, in the form that the key picks."""
    forms = F.array(*[F.lit(p) for p, _ in _FORMS])
    form = F.element_at(forms, (F.col("c_custkey") % len(_FORMS) + 1).cast("int"))
    asked = table(spark, d, "customer").select("c_custkey", F.replace(form, F.lit("{}"), F.lower("c_mktsegment")).alias("prompt"))
    return asked.select("c_custkey", intent.operator_column(F.col("prompt")).alias("op"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first_id FROM events GROUP BY 1")
def evidence_counts(spark, d):
    """The typed evidence log: counts by type, and what was first."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.min("event_id").alias("first_id"))


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def evidence_tail(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20)
