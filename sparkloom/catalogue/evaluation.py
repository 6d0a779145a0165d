"""Queries of comparison, verdicts, intent and repair, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom import compare
from sparkloom.catalogue.contracts import cases
from sparkloom.catalogue.registry import query, table
from sparkloom.contracts import engine, repair
from sparkloom.operators.slips import SLIPS
from sparkloom.operators.transforms import OPERATORS
from sparkloom.plans import dsl, intent

# ---------------------------------------------------------------- comparison

#: Forms of one table, as expressions over supplier: key, value, condition.
_FORMS = {
    "same": ("s_suppkey", "s_acctbal", "true"),
    "rounding": ("s_suppkey", "s_acctbal + 1e-9", "true"),
    "changed": ("s_suppkey", "CASE WHEN s_suppkey = 1 THEN s_acctbal + 1 ELSE s_acctbal END", "true"),
    "shortened": ("s_suppkey", "s_acctbal", "s_suppkey > 1"),
    "permuted": ("s_suppkey", "(SELECT max(s_suppkey) FROM supplier) - s_suppkey", "true"),
    "other_keys": ("s_suppkey + 1", "s_acctbal", "true"),
}


def _form(spark, d, name):
    k, v, keep = _FORMS[name]
    t = table(spark, d, "supplier")
    t.createOrReplaceTempView("supplier")
    return t.filter(keep).select(F.expr(k).alias("k"), F.expr(v).cast("double").alias("v"))


def _equal_sql(columns: str) -> str:
    gold = "SELECT s_suppkey AS k, round(s_acctbal, {d}) AS v FROM supplier"
    one = "SELECT '{n}' AS form, NOT EXISTS ((SELECT {c} FROM ({f}) EXCEPT ALL SELECT {c} FROM ({g})) UNION ALL (SELECT {c} FROM ({g}) EXCEPT ALL SELECT {c} FROM ({f}))) AS same"
    made = []
    for n, (k, v, keep) in _FORMS.items():
        digits = 6 if columns == "k, v" else 4
        made.append(one.format(n=n, c=columns, f=f"SELECT {k} AS k, round(CAST({v} AS DOUBLE), {digits}) AS v FROM supplier WHERE {keep}", g=gold.format(d=digits)))
    return " UNION ALL ".join(made)


@query(_equal_sql("k, v"))
def compare_equal(spark, d):
    """Equality after rounding, whatever the order of rows."""
    gold = _form(spark, d, "same")
    return spark.createDataFrame([(n, compare.equal(_form(spark, d, n), gold)) for n in _FORMS], "form string, same boolean")


@query("SELECT form, same, false AS renamed FROM (" + _equal_sql("k, v") + ")")
def compare_subset(spark, d):
    """More columns are forgiven, a missing one is not."""
    gold = _form(spark, d, "same")
    rows = [(n, compare.subset_equal(f := _form(spark, d, n).withColumn("more", F.lit("x")), gold), compare.subset_equal(f.withColumnRenamed("v", "w"), gold)) for n in _FORMS]
    return spark.createDataFrame(rows, "form string, same boolean, renamed boolean")


@query("SELECT form, a.same AS key_right, b.same AS value_right FROM (" + _equal_sql("k") + ") a JOIN (" + _equal_sql("v") + ") b USING (form)")
def compare_column_status(spark, d):
    """Each column by its multiset of values."""
    gold = _form(spark, d, "same")
    status = {n: compare.column_status(_form(spark, d, n), gold) for n in _FORMS}
    return spark.createDataFrame([(n, s["k"], s["v"]) for n, s in status.items()], "form string, key_right boolean, value_right boolean")


@query("""WITH g AS (SELECT sum(l_discount * l_extendedprice) / sum(l_extendedprice) AS gold, avg(l_discount) AS slip FROM lineitem)
SELECT * FROM (SELECT 'right' AS form, abs(gold - gold) <= greatest(1e-4 * abs(gold), 1e-6) AS same FROM g UNION ALL SELECT 'near', abs(gold * 1.00005 - gold) <= greatest(1e-4 * abs(gold), 1e-6) FROM g UNION ALL SELECT 'slip', abs(slip - gold) <= greatest(1e-4 * abs(gold), 1e-6) FROM g)""")
def compare_scalar(spark, d):
    """A number in a one-row result, found by its type."""
    inputs, p = cases(spark, d)["weighted_mean"]
    right = OPERATORS["weighted_mean"](inputs, p)
    gold = right.first()[0]
    forms = {"right": right, "near": right.select((F.col(right.columns[0]) * 1.00005).alias("w")), "slip": inputs["df"].agg(F.avg(p["value"]).alias("w"))}
    return spark.createDataFrame([(n, compare.scalar_equal(f.withColumn("note", F.lit("total")), gold)) for n, f in forms.items()], "form string, same boolean")


@query("SELECT event_type, user_id, CAST(floor(value) AS BIGINT) AS v FROM events EXCEPT SELECT event_type, user_id, CAST(floor(value) AS BIGINT) FROM events WHERE event_id % 2 = 0")
def compare_new_errors(spark, d):
    """What fires after and did not fire before, over all events."""
    e = table(spark, d, "events").withColumn("v", F.floor("value").cast("long"))
    return compare.new_error_rows(e.filter("event_id % 2 = 0"), e, ["event_type", "user_id", "v"])


@query("SELECT n, columns FROM (SELECT count(*) AS n FROM supplier), (SELECT 's_acctbal,s_name,s_nationkey,s_suppkey' AS columns)")
def compare_signature(spark, d):
    """The order of rows does not change a signature, a value does; returned: its count and names."""
    t = table(spark, d, "supplier")
    a, b, c = (compare.signature(x).first() for x in (t, t.orderBy(F.col("s_acctbal").desc()), t.withColumn("s_acctbal", F.col("s_acctbal") + 1)))
    if a != b or a.h == c.h:
        raise AssertionError("signatures")
    return compare.signature(t).select("n", "columns")


# ---------------------------------------------------------------- verdicts


@query("""SELECT 'none' AS form, false AS runs, false AS valid UNION ALL SELECT 'whole', true, (SELECT count(*) > 0 AND count(s_acctbal) > 0 FROM supplier) UNION ALL SELECT 'empty', true, (SELECT count(*) > 0 FROM supplier WHERE s_suppkey < 0)
UNION ALL SELECT 'all_missing', true, (SELECT count(CASE WHEN s_suppkey < 0 THEN s_acctbal END) > 0 FROM supplier)""")
def detector_verdicts(spark, d):
    """The weak detectors to compare contracts with."""
    t = table(spark, d, "supplier").select("s_name", "s_acctbal", "s_suppkey")
    forms = {"none": None, "whole": t, "empty": t.filter("s_suppkey < 0"), "all_missing": t.select("s_name", F.when(F.col("s_suppkey") < 0, F.col("s_acctbal")).alias("v"))}
    return spark.createDataFrame([(n, engine.execution_pass(f), engine.valid(f)) for n, f in forms.items()], "form string, runs boolean, valid boolean")


@query("SELECT CAST(arg_min(i, i) AS INTEGER) AS first_of_most, CAST(count(*) AS INTEGER) AS agree FROM (SELECT * FROM (VALUES (0, 'mean'), (1, 'median'), (2, 'median')) t(i, f)) WHERE f = 'median'")
def modal_result(spark, d):
    """Of three results the one that a strict majority gives."""
    inputs, p = cases(spark, d)["median_not_mean"]
    right, slip = (f["median_not_mean"](inputs, p) for f in (OPERATORS, SLIPS))
    at, n = compare.modal_result([slip, right, right.orderBy(F.col(p["group"]).desc())])
    return spark.createDataFrame([(at, n)], "first_of_most int, agree int")


@query("""SELECT * FROM (VALUES ('median_not_mean', 'right', 0), ('median_not_mean', 'slip', 1), ('within_group_share', 'right', 0), ('within_group_share', 'slip', 1)) t(operator, form, own_fired)""")
def contract_run_all(spark, d):
    """All contracts that apply to a result's family; whether the operator's own one fires."""
    given, rows = cases(spark, d), []
    for name, others in (("median_not_mean", ("pooled_rate",)), ("within_group_share", ("dense_rank", "rank_pct"))):
        inputs, p = given[name]
        params_of = {name: p, **{o: given[o][1] for o in others}}
        for form, f in (("right", OPERATORS), ("slip", SLIPS)):
            fired = engine.run_all(inputs, params_of, f[name](inputs, p))
            rows.append((name, form, int(fired.get(name, False))))
    return spark.createDataFrame(rows, "operator string, form string, own_fired int")


@query("SELECT 'share' AS result, (SELECT count(*) FILTER (WHERE v > 0 AND v < 1) > 0 AND min(v) >= 0 AND max(v) <= 1 FROM (SELECT o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS v FROM orders)) AS unit UNION ALL SELECT 'flag', false UNION ALL SELECT 'price', (SELECT max(o_totalprice) <= 1 FROM orders)")
def unit_columns(spark, d):
    """The sign of a rank in per cent, by which candidates are pruned."""
    inputs, p = cases(spark, d)["within_group_share"]
    share = OPERATORS["within_group_share"](inputs, p).select("share")
    o = inputs["df"]
    forms = {"share": share, "flag": o.select((F.col("o_orderstatus") == "F").cast("int").alias("v")), "price": o.select("o_totalprice")}
    return spark.createDataFrame([(n, engine.has_unit_column(f)) for n, f in forms.items()], "result string, unit boolean")


_CANDIDATES = ("weighted_mean", "pooled_rate", "median_not_mean", "groupby_dropna_key")


@query("SELECT name AS operator, 'VIABLE' AS verdict FROM (VALUES " + ", ".join(f"('{n}')" for n in _CANDIDATES) + ") t(name)")
def candidate_verdicts(spark, d):
    """A contract earns its place: it fires on the slip and is silent on the right result and its other form."""
    given, rows = cases(spark, d), []
    for n in _CANDIDATES:
        inputs, p = given[n]
        right, slip = (f[n](inputs, p) for f in (OPERATORS, SLIPS))
        rows.append((n, engine.candidate_verdict(inputs, p, n, right, slip, [right.select(*reversed(right.columns))])))
    return spark.createDataFrame(rows, "operator string, verdict string")


@query("SELECT 'within_group_share' AS operator, 2 AS passes, true AS probes_fire")
def contract_score(spark, d):
    """Score without an answer key: passes of the agreeing results, and whether a probe fires."""
    inputs, p = cases(spark, d)["within_group_share"]
    right, slip = (f["within_group_share"](inputs, p) for f in (OPERATORS, SLIPS))
    passes, fires = engine.contract_score("within_group_share", inputs, p, [slip, right, right], ["o_orderkey"])
    return spark.createDataFrame([("within_group_share", passes, fires > 0)], "operator string, passes int, probes_fire boolean")


@query("""WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS n, count(*) OVER () AS m FROM events)
SELECT 'scaled' AS probe, count(*) AS n, round(sum((value * 2 + 1) * event_id), 3) AS weight FROM e UNION ALL SELECT 'reversed', count(*), round(sum(b.value * a.event_id), 3) FROM e a JOIN e b ON a.n + b.n = a.m + 1
UNION ALL SELECT 'shortened', count(*), round(sum(value * event_id), 3) FROM e WHERE n < m UNION ALL SELECT 'spiked', count(*), round(sum(CASE WHEN n = 1 THEN value + 1000 ELSE value END * event_id), 3) FROM e""")
def metamorphic_probes(spark, d):
    """The changed forms of a result, by their size and a weighted sum."""
    out = None
    for name, f in engine.probes(table(spark, d, "events").select("event_id", "value"), ["event_id"]).items():
        row = f.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * F.col("event_id")), 3).alias("weight")).select(F.lit(name).alias("probe"), "n", "weight")
        out = row if out is None else out.unionByName(row)
    return out


_FAN = "SELECT l_orderkey AS o_orderkey FROM lineitem"
#: Results of SQL text, right and slip, for the operators that the first substrate query leaves out.
_MORE_SQL = {
    "weighted_mean": ("SELECT sum(l_discount * l_extendedprice) / sum(l_extendedprice) AS wavg FROM lineitem", "SELECT avg(l_discount) AS wavg FROM lineitem"),
    "join_fanout": (f"SELECT o_orderpriority, sum(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey IN ({_FAN}) GROUP BY 1", f"SELECT o_orderpriority, sum(o_totalprice) AS o_totalprice FROM orders JOIN ({_FAN}) USING (o_orderkey) GROUP BY 1"),
    "left_join_keep_all": (f"SELECT * FROM orders LEFT JOIN (SELECT DISTINCT * FROM ({_FAN}) WHERE o_orderkey % 2 = 0) USING (o_orderkey)", f"SELECT * FROM orders JOIN (SELECT DISTINCT * FROM ({_FAN}) WHERE o_orderkey % 2 = 0) USING (o_orderkey)"),
    "dedup_then_agg": (
        f"SELECT o_orderpriority, sum(v) AS o_totalprice FROM (SELECT o_orderkey, o_orderpriority, max(o_totalprice) AS v FROM orders JOIN ({_FAN}) USING (o_orderkey) GROUP BY 1, 2) GROUP BY 1",
        f"SELECT o_orderpriority, sum(o_totalprice) AS o_totalprice FROM orders JOIN ({_FAN}) USING (o_orderkey) GROUP BY 1",
    ),
    "null_in_agg_count": ("SELECT user_id % 9 AS g, count(*) AS n FROM events GROUP BY 1", "SELECT user_id % 9 AS g, count(CASE WHEN event_type <> 'error' THEN value END) AS n FROM events GROUP BY 1"),
}


@query("SELECT name AS contract, form, form = 'slip' AS fired FROM (VALUES " + ", ".join(f"('{n}')" for n in _MORE_SQL) + ") t(name), (VALUES ('right'), ('slip')) u(form)")
def contract_sql_more(spark, d):
    """The contracts over results of SQL text, for five more operators."""
    for n in ("lineitem", "orders", "events"):
        table(spark, d, n).createOrReplaceTempView(n)
    given, out = cases(spark, d), None
    for k, form in enumerate(("right", "slip")):
        rows = engine.verdicts([(n, *given[n], spark.sql(q[k])) for n, q in _MORE_SQL.items()]).select("contract", F.lit(form).alias("form"), "fired")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- transform language


@query("SELECT o_orderkey, o_totalprice AS price, CAST(NULL AS VARCHAR) AS gone FROM orders")
def dsl_copy_column(spark, d):
    """A copy of a column; of one that is not there, an empty column."""
    steps = [{"op": "derive", "as": "price", "fn": "copy", "field": "o_totalprice"}, {"op": "derive", "as": "gone", "fn": "copy", "field": "nothing"}]
    return dsl.run_spec(table(spark, d, "orders"), {"transforms": steps}).select("o_orderkey", "price", "gone")


@query("""SELECT * FROM (VALUES ('unknown filter', 'SpecError'), ('unknown transform', 'SpecError'), ('unknown aggregate', 'SpecError'), ('empty after', 'EmptyResult')) t(form, error) UNION ALL SELECT 'right', CASE WHEN (SELECT count(*) FROM orders WHERE o_totalprice > 0) = 0 THEN 'EmptyResult' ELSE 'none' END""")
def dsl_errors(spark, d):
    """What the language does not have, and what leaves nothing, is an error."""
    one = lambda cmp, value: {"transforms": [{"op": "filter", "field": "o_totalprice", "cmp": cmp, "value": value}]}
    specs = {
        "unknown filter": one("like", 1.0), "unknown transform": {"transforms": [{"op": "twist"}]}, "unknown aggregate": {"transforms": [{"op": "aggregate", "measures": [{"field": "o_totalprice", "agg": "mode"}]}]},
        "empty after": one("<", -1e12), "right": one(">", 0.0),
    }
    rows = []
    for n, spec in specs.items():
        try:
            dsl.run_spec(table(spark, d, "orders"), spec, check_empty=True)
            rows.append((n, "none"))
        except (dsl.SpecError, dsl.EmptyResult) as e:
            rows.append((n, type(e).__name__))
    return spark.createDataFrame(rows, "form string, error string")


# ---------------------------------------------------------------- intent and repair

_ASKED = [
    ("orders", "What is the median price per priority, as \"typical\"?", {"group": "o_orderstatus", "value": "o_totalprice", "out": "typical"}),
    ("customer", "Show the top 5 customers with ties", {"n": "5", "value": "c_acctbal"}),
    ("customer", "Cap balances at 0 and 1000", {"lo": "0.0", "hi": "1000.0"}),
    ("events", "Occurrence number of each event by user", {"key": "event_id", "time": "ts"}),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{r}', '{v}')" for t, _, roles in _ASKED for r, v in roles.items()) + ") t(table_name, role, value)")
def intent_params(spark, d):
    """Roles filled from the types and names of a table's columns and from the prompt."""
    rows = []
    for t, prompt, roles in _ASKED:
        found = intent.infer_params("any", table(spark, d, t), prompt)
        rows += [(t, r, str(found.get(r))) for r in roles]
    return spark.createDataFrame(rows, "table_name string, role string, value string")


@query("""SELECT * FROM (VALUES ('id column', 'dedup_then_agg'), ('no total asked', NULL)) t(form, op) UNION ALL SELECT 'missing values', CASE WHEN (SELECT count(*) FROM events WHERE event_type = 'error') > 0 THEN 'nan_as_zero_sum' END UNION ALL SELECT 'whole values', NULL""")
def intent_schema(spark, d):
    """Where no rule fits, the schema and missing values decide."""
    e = table(spark, d, "events")
    gaps = e.select("ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    forms = {"id column": (e, "the total, please"), "no total asked": (e, "tell me more"), "missing values": (gaps, "sum it up"), "whole values": (e.select("ts", "value"), "sum it up")}
    return spark.createDataFrame([(n, intent.infer_from_schema(*f)) for n, f in forms.items()], "form string, op string")


_COLUMN_ROLES = {"orders": {"o_orderkey": "num", "o_totalprice": "num", "o_orderstatus": "cat", "o_orderdate": "time"}, "supplier": {"s_suppkey": "num", "s_name": "cat"}}


@query("SELECT table_name, column_name, CASE WHEN data_type IN ('BIGINT', 'DOUBLE', 'INTEGER') THEN 'num' WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'time' WHEN data_type = 'BOOLEAN' THEN 'bool' ELSE 'cat' END AS role FROM information_schema.columns WHERE (table_name, column_name) IN (" + ", ".join(f"('{t}', '{c}')" for t, cs in _COLUMN_ROLES.items() for c in cs) + ")")
def intent_roles(spark, d):
    rows = []
    for t, columns in _COLUMN_ROLES.items():
        rows += [(t, c, kind) for kind, names in intent.roles(table(spark, d, t)).items() for c in names if c in columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, role string")


_REPAIRED = ("pooled_rate", "median_not_mean", "null_in_agg_count")


@query("SELECT name AS operator, 'contract_pass' AS outcome, 1 AS attempts, true AS equals_gold, true AS primary_is_own FROM (VALUES " + ", ".join(f"('{n}')" for n in _REPAIRED) + ") t(name)")
def repair_outcomes(spark, d):
    """Slips diagnosed by contracts and repaired by the library until their own contract is silent."""
    given, rows = cases(spark, d), []
    for n in _REPAIRED:
        inputs, p = given[n]
        slip, gold = SLIPS[n](inputs, p), OPERATORS[n](inputs, p)
        found = repair.diagnose(inputs, {n: p}, slip, hint=n)
        outcome, result, attempts = repair.repair(n, inputs, p, slip)
        rows.append((n, outcome, attempts, compare.subset_equal(result, gold), found.primary == n))
    return spark.createDataFrame(rows, "operator string, outcome string, attempts int, equals_gold boolean, primary_is_own boolean")


@query("""SELECT * FROM (VALUES ('contract', true, 1), ('fixpoint', true, 2), ('gold', true, 1)) t(arm, equals_gold, attempts)""")
def repair_arms(spark, d):
    """When each arm of a comparison stops, from one slip."""
    inputs, p = cases(spark, d)["pooled_rate"]
    slip, gold = SLIPS["pooled_rate"](inputs, p), OPERATORS["pooled_rate"](inputs, p)
    return spark.createDataFrame([(a, *repair.run_arm(a, "pooled_rate", inputs, p, slip, gold)) for a in ("contract", "fixpoint", "gold")], "arm string, equals_gold boolean, attempts int")
