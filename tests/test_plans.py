"""The transform language, chart data, matching, profiles, intent rules and streams on small rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom import compare
from sparkloom.functions import expressions as X
from sparkloom.functions import quantiles, specs
from sparkloom.operators import assignment, matching
from sparkloom.operators.transforms import OPERATORS
from sparkloom.plans import chart, dsl, intent
from sparkloom.sources import corpus, files, profile
from sparkloom.streaming import events


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("a", "2024-01-05", 3.0), ("a", "2024-02-01", 1.0), ("b", "bad", 2.0), (None, "2024-05-01", None)], "g string, d string, v double")


def values(df, c):
    return [r[c] for r in df.collect()]


@pytest.mark.parametrize(("f", "n"), [(("g", "==", "a"), 2), (("g", "!=", "a"), 2), (("v", ">=", 2.0), 2), (("v", "<", 2.0), 1), (("g", "in", ["a", "b"]), 3), (("g", "not in", ["a"]), 2), (("v", "between", [1.0, 2.0]), 2), (("g", "contains", "^[ab]$"), 3)])
def test_filters(sales, f, n):
    assert sales.filter(dsl.condition(*f)).count() == n


def test_dsl_steps(sales):
    out = dsl.run_spec(sales, {"transforms": [{"op": "derive", "as": "m", "fn": "to_period", "field": "d"}, {"op": "derive", "as": "copy", "field": "nothing"}, {"op": "sort", "by": [{"field": "v", "desc": True}]}]})
    assert values(out, "m") == ["2024-01", None, "2024-02", "2024-05"] and values(out, "copy") == [None] * 4
    assert values(dsl.run_spec(sales, {"transforms": [{"op": "sort", "by": [{"field": "v"}]}]}), "v") == [1.0, 2.0, 3.0, None]
    q = {"transforms": [{"op": "derive", "as": "q", "fn": "to_period", "field": "d", "freq": "Q"}, {"op": "aggregate", "group_by": ["q"], "measures": [{"field": "v"}]}]}
    assert {r.q: r.v for r in dsl.run_spec(sales, q).collect()} == {"2024Q1": 4.0, "2024Q2": None, None: 2.0}
    top = {"transforms": [{"op": "topk", "k": 1, "order_by": "v", "group_by": ["g"]}]}
    assert sorted(values(dsl.run_spec(sales, top), "v"), key=str) == [2.0, 3.0, None]
    assert dsl.run_spec(sales, {"transforms": [{"op": "topk", "k": 2, "order_by": "v", "desc": False}]}).count() == 2
    limits = {"constraints": {"time_field": "d", "time_range": ["2024-01-05", "2024-02-01"], "filters": [{"field": "v", "cmp": ">", "value": 1.0}]}}
    assert values(dsl.run_spec(sales, limits), "v") == [3.0]


@pytest.mark.parametrize("t", [{"op": "explode"}, {"op": "filter", "field": "v", "cmp": "~", "value": 1}, {"op": "filter", "field": "v", "cmp": "between", "value": [1]}, {"op": "aggregate", "measures": []}, {"op": "aggregate", "measures": [{"field": "v", "agg": "mode"}]}, {"op": "derive", "as": "x", "fn": "sqrt", "field": "v"}, {"op": "derive", "as": "x", "fn": "to_period", "field": "d", "freq": "W"}])
def test_unknown_parts_are_errors(sales, t):
    with pytest.raises(dsl.SpecError):
        dsl.run_spec(sales, {"transforms": [t]})


def test_empty_is_an_error_where_asked(sales):
    with pytest.raises(dsl.EmptyResult):
        dsl.run_spec(sales.filter("false"), {}, check_empty=True)
    with pytest.raises(dsl.EmptyResult):
        dsl.run_spec(sales, {"transforms": [{"op": "filter", "field": "v", "cmp": ">", "value": 99.0}]}, check_empty=True)


def test_chart_edges(spark, sales):
    assert {r.bin: r.n for r in chart.histogram(sales, "v", 2).collect()} == {0: 1, 1: 2}
    assert chart.histogram(sales.filter("v = 1"), "v", 3).filter("n > 0").collect() == [(0, 1)]
    assert chart.axis_range(sales, "v", True).first() == (0.95, 1.2)
    assert not chart.axis_break(sales, "v").first().gap
    assert chart.is_ratio(sales, "v").first().ratio is False
    columns = [{"name": "month", "semantic": "categorical", "distinct": 9}, {"name": "kind", "semantic": "categorical", "distinct": 3}, {"name": "units", "semantic": "quantitative", "distinct": 9}, {"name": "fail_rate", "semantic": "quantitative", "distinct": 2}]
    assert chart.choose_columns(columns) == {"x": "month", "y": "fail_rate", "group": "kind"}
    assert [chart.overlay_role(n) for n in ("sales", "Target 2024", "plan_q1", "baseline")] == ["main", "target", "forecast", "baseline"]
    categories = chart.prepare(spark.createDataFrame([("z", "1", 1), ("y", "x", 2), ("z", "3", 3), ("q", "4", 4)], "c string, v string, o int"), "c", ["v"], ["o"])
    assert values(categories, "c") == ["z", "z", "q"]
    assert values(sales.select(X.si_number(F.col("v") * 1234567.0).alias("s")).orderBy("s"), "s") == [None, "1.2M", "2.5M", "3.7M"]


def test_greedy_match_rules(spark):
    truth = spark.createDataFrame([("s", "a", 100.0), ("s", "a", 200.0), ("t", "a", 300.0), ("s", "b", 0.5)], "series string, x string, value double")
    pred = spark.createDataFrame([(0, "s", "a", 199.0), (1, "s", "a", 130.0), (2, "s", "a", 100.0), (3, "u", "a", 301.0), (4, "s", "c", 1.0), (5, "s", "b", 1.4)], "n int, series string, x string, value double")
    got = {(r.x, r.pred, r.gt): r.type for r in matching.greedy_match(pred, truth, "n").collect()}
    assert got == {("a", 199.0, 200.0): "match", ("a", 130.0, 100.0): "wrong_value", ("a", 100.0, None): "wrong_mapping", ("a", 301.0, 300.0): "match", ("c", 1.0, None): "wrong_mapping", ("b", 1.4, 0.5): "match"}
    f = matching.f1(matching.greedy_match(pred, truth, "n")).first()
    assert (f.tp, f.fp, f.fn) == (3, 3, 0) and f.f1 == pytest.approx(2 / 3)
    empty = matching.f1(matching.greedy_match(pred.filter("false"), truth, "n")).first()
    assert (empty.tp, empty.fn, empty.f1) == (0, 4, 0.0)
    assert matching.best_source(truth, "n", drawn=pred, given=truth.withColumn("n", F.lit(1)))[0] == "given"
    assert matching.rnss(pred, truth, "n").first().tp == 4


def test_match_helpers(spark):
    truth = spark.createDataFrame([("s", "a", 1.0), ("t", "b", 2.0)], "series string, x string, value double")
    pred = spark.createDataFrame([(None, "a", 1.0), (None, "z", 5.0)], "series string, x string, value double")
    assert {r.x: r.series for r in matching.fill_series(pred, truth).collect()} == {"a": "s", "z": None}
    assert matching.coerce_prediction(spark.createDataFrame([("q", "7"), ("r", "bad")], "label string, amount string")).collect() == [(None, "q", 7.0), (None, "r", None)]
    assert matching.first_source(a=None, b=truth)[0] == "b"
    a = F.array(*map(F.lit, "abc"))
    assert spark.range(1).select(matching.order_agrees(a, F.array(F.lit("c"), F.lit("a"))).alias("v"), matching.order_agrees(a, F.array(F.lit("b"), F.lit("x"), F.lit("c"))).alias("w")).first() == (False, True)
    df = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 9.0)], "k int, y double")
    assert df.exceptAll(matching.wrong_value(df, "y", ["k"])).count() == 1
    with pytest.raises(ValueError):
        matching.drop_series(df, ["y"], "y")
    bad = matching.greedy_match(pred.select(F.lit("s").alias("series"), "x", "value", F.lit(1).alias("n")), truth, "n")
    assert matching.localised(bad, "s").first().localised is False


def test_profiles_of_small_tables(spark):
    df = spark.createDataFrame([("01", "1,5", "2024-01-01"), ("02", "7", "2024-02-01"), ("03", "x", "nothing")], "code string, v string, d string")
    out = profile.coerce_types(df, ["code", "v", "d"], 0.6)
    assert dict(out.dtypes) == {"code": "string", "v": "string", "d": "timestamp"}
    assert profile.dtype_profile(out) == {"code": "string", "v": "string", "d": "datetime"}
    assert profile.unique_names(["a", "", "a", None, "a"]) == ["a", "column", "a_2", "column_2", "a_3"]
    assert profile.unique_names(["a", "a"], ".", 1) == ["a", "a.1"]
    assert profile.merge_units(["dose", "n"], ["mg", None]) == ["dose (mg)", "n"] and profile.synthetic_names(2) == ["col0", "col1"]
    grid = spark.createDataFrame([(0, ["note", None, None]), (1, ["name", "size", ""]), (2, ["x", "1", None]), (3, [None, None, None]), (4, ["y", "2", None])], "row_idx int, cells array<string>")
    built = profile.build_table(grid)
    assert built.columns == ["row_idx", "name", "size"] and built.count() == 2
    p = profile.table_profile(df, ["code"], 2)
    assert (p["rows"], p["columns"], len(p["samples"])) == (3, 3, 2)
    wide = spark.createDataFrame([(("a", "b")[i % 2], float(i)) for i in range(10)], "c string, v double")
    assert {r.column: r.use for r in profile.task_columns(wide).collect()} == {"c": "category", "v": "number"}
    assert spark.range(1).select(profile.block_status(F.lit(True), F.lit(0.4)).alias("s")).first().s == "weak"
    sheets = spark.createDataFrame([("a", f"s{i}", 4, 1, 10) for i in range(5)] + [("a", "wide", 20, 1, 10)], "article string, sheet string, cols int, panels int, rows int")
    assert values(profile.shortlist(sheets, cap=2), "sheet") == ["s0", "s1"]


def test_pages_with_bad_markup(spark):
    html = '<title>T &amp; x</title><figure id="f1"><img src="a.png"><figcaption>Fig. 2 <b>dose</b></figcaption></figure><figure>no image</figure><a href="d.csv">Data <i>file</i></a><p><a href="x">open'
    r = corpus.parse_pages(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert r[0].title == "T & x" and [(f.img, f.caption, f.anchor) for f in r[0].figures] == [("a.png", "Fig. 2 dose", "f1")]
    assert [(x.href, x.text) for x in r[0].links] == [("d.csv", "Data file")] and r[1].title == ""


def test_references_of_titles(spark):
    html = '<title>\n a&amp;lt; &lt;b&gt; &quot;&#39; &eacute; &copy=1 &ampx; &&amp</title><svg><title>other</title></svg><a href="?a=1&copy=2&amp;b">x</a>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = corpus.parse_pages(pages, ("lt", "gt", "quot", "amp")).first()
    assert r.title == 'a&lt; <b> "&#39; &eacute; &copy=1 &ampx; &&amp' and r.links[0].href == "?a=1&copy=2&b"
    assert corpus.parse_pages(pages).first().title.startswith("a&lt; <b> \"' é ")


def test_intent(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0, True)], "grp string, price double, qty double, ok boolean")
    op, p = intent.infer(df, "Average price weighted by quantity as 'wavg'")
    assert op == "weighted_mean" and (p["value"], p["weight"], p["out"], p["flag"]) == ("price", "qty", "wavg", "ok")
    assert intent.infer(df, "top three by price")[1]["n"] == 3 and intent.infer(df, "Sing a song") == (None, {})
    assert intent.infer_params("clip_outlier", df, "clip to 0 and 9.5") | {"lo": 0.0, "hi": 9.5} == intent.infer_params("clip_outlier", df, "clip to 0 and 9.5")
    assert intent.infer_from_schema(df.withColumnRenamed("grp", "order_id"), "the total") == "dedup_then_agg"
    assert intent.infer_from_schema(df.withColumn("price", F.lit(None).cast("double")), "the sum") == "nan_as_zero_sum"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿code,v\n007,1\n", encoding="utf-8")
    df = files.read_any(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["code", "v"] and df.first() == ("007", "1")
    files.route_messages(df.withColumn("kind", F.lit("pair")), "kind", str(tmp_path / "out"))
    files.write_records(df, str(tmp_path / "p.parquet"), "parquet")
    assert spark.read.json(str(tmp_path / "out")).first().kind == "pair" and files.read_any(spark, str(tmp_path / "p.parquet")).count() == 1
    assert len(files.file_hashes(spark, str(tmp_path / "a.csv")).first().sha256) == 64
    assert files.raw_grid(spark, str(tmp_path / "a.csv")).count() == 2
    with pytest.raises(ValueError):
        files.read_any(spark, "x.docx")


def test_streams_equal_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), src.schema)
    q = events.start(events.resampled(stream, "ts", "value", "1 day", "3650 days"), str(tmp_path / "out"), str(tmp_path / "ck1"))
    q.awaitTermination(120)
    once = events.start(events.first_seen(stream, ["user_id"], "ts", "3650 days"), str(tmp_path / "once"), str(tmp_path / "ck2"))
    once.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "once")).count() == src.select("user_id").distinct().count()
    live = events.resampled(stream, "ts", "value", "1 day", "3650 days").writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    live.awaitTermination(120)
    want = src.groupBy(F.window(F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"), "1 day")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(values(spark.table("bins"), "n")) == sorted(values(want, "n"))
    assert spark.table("bins").agg(F.sum("n")).first()[0] == src.count() and dt.datetime.min


def test_small_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(X.number(F.lit(" 1.5 "))) == 1.5 and one(X.number(F.lit("1d"))) is None and one(X.number(F.lit("1,200%"), ",%")) == 1200.0
    assert one(X.normal_key(F.lit("\t Ab c "))) == "ab c" and one(X.slug(F.lit("__a b/c!"))) == "a_b_c"
    assert one(X.half_even(F.lit(2.5))) == 2 and one(X.half_even(F.lit(3.5))) == 4
    assert one(X.wilson(F.lit(0), F.lit(0))[0]) is None
    assert one(X.quarter_text(F.lit("2024-05-01").cast("timestamp"))) == "2024Q2"


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles_of_hot_groups(spark, monkeypatch, accuracy):
    """One group of nearly all rows, ties, missing groups and values: as ``percentile``, also with a coarse sketch."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = random.Random(4)
    rows = [(None if i % 9 == 0 else "hot", rng.choice([rng.gauss(0, 1e3), float(rng.randint(0, 5)), None])) for i in range(6000)]
    rows += [("one", 2.0), ("two", 1.0), ("two", 4.0), ("empty", None), ("same", 7.0), ("same", 7.0), ("same", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    steps = {f"q{i}": q for i, q in enumerate([0.5, 0.0, 0.1, 0.25, 0.777, 0.9, 1.0])}
    want = df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in steps.items()])
    close = lambda r: tuple(x if isinstance(x, str) or x is None else round(x, 7) for x in r)
    assert sorted(map(repr, map(close, quantiles.exact_quantiles(df, ["g"], "v", steps).collect()))) == sorted(map(repr, map(close, want.collect())))
    total = df.agg(F.percentile("v", F.lit(0.3)).alias("x")).first()
    assert close(quantiles.exact_quantiles(df, [], "v", {"x": 0.3}).first()) == close(total)
    assert quantiles.exact_quantiles(df.filter("false"), ["g"], "v", steps).count() == 0
    assert tuple(quantiles.exact_quantiles(df.filter("false"), [], "v", {"x": 0.3}).first()) == (None,)


def plain_merge(base, override):
    if isinstance(base, dict) and isinstance(override, dict):
        return base | {k: plain_merge(base[k], v) if k in base else v for k, v in override.items()}
    return override


def plain_leaves(value, path=""):
    if isinstance(value, dict) and value:
        return {p: x for k, v in value.items() for p, x in plain_leaves(v, f"{path}/" + k.replace("~", "~0").replace("/", "~1")).items()}
    return {path: json.dumps(value, separators=(",", ":"))}


def test_deep_merge_equals_recursion(spark):
    rng = random.Random(12)

    def spec(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([1, 2.5, "x", "", None, True, [1, {"a": 2}], [], {}])
        return {k: spec(depth - 1) for k in rng.sample(["a", "b", "c/d", "e~f", "g h"], rng.randint(0, 4))}

    pairs = [(i, spec(4), spec(4)) for i in range(150)] + [(900, {"a": {"b": {}}}, {"a": {}}), (901, {"a": 1}, {"a": {}}), (902, {}, {"a": {"b": 1}}), (903, {"a": {"b": 1}}, 5)]
    frame = lambda k: spark.createDataFrame([(p[0], json.dumps(p[k])) for p in pairs] + [(-k, None), (-9, "no { json")], "id long, spec string")
    out = specs.deep_merge(specs.leaves(frame(1), "id", "spec"), specs.leaves(frame(2), "id", "spec"))
    got = {}
    for r in out.collect():
        assert r.path not in got.setdefault(r.id, {})
        got[r.id][r.path] = r.value
    assert {i: got.get(i) for i, _, _ in pairs} == {i: plain_leaves(plain_merge(a, b)) for i, a, b in pairs} and set(got) == {i for i, _, _ in pairs}


def test_consensus_of_many_candidates(spark):
    rng = random.Random(6)
    results = {f"c{i}": rng.choice([[("x", 1.0), ("y", 2.0)], [("x", 1.0), ("y", 2.5)], [("x", 1.0)], [("x", 1.0), ("x", 1.0), ("y", 2.0)], [("x", 1.0), ("y", 2.0)]]) for i in range(200)}
    long = [(c, str(n), col, str(v)) for c, rows in results.items() for n, row in enumerate(rng.sample(rows, len(rows))) for col, v in zip(("k", "v"), row)]
    long += [("other", "0", "k", "x"), ("other", "0", "w", "1.0"), ("blank", "0", "k", None), ("blank", "0", "v", "1.0")]
    got = {r.candidate: (r.agree, r.modal, r.majority) for r in compare.consensus(spark.createDataFrame(long, "candidate string, row string, column string, value string")).collect()}
    count = {}
    for rows in results.values():
        count[tuple(sorted(rows))] = count.get(tuple(sorted(rows)), 0) + 1
    most = max(count.values())
    for c, rows in results.items():
        n = count[tuple(sorted(rows))]
        assert got[c] == (n, n == most, n == most and 2 * most > len(results) + 2), c
    assert got["other"][0] == got["blank"][0] == 1
    frame = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0), (3, "x", 1.0000000001), (4, "x", 1.1)], "c long, k string, v double")
    cells = compare.cells(frame.select("k", "v", "c"), F.col("c"), F.lit(0)).filter("column <> 'c'")
    assert [r.majority for r in compare.consensus(cells).orderBy("candidate").collect()] == [True, True, True, False]


def test_nearest_tick_by_merging(spark):
    rng = random.Random(9)
    ticks = [(float(p), rng.choice("abc") + str(p)) for p in rng.sample(range(-400, 400), 60)] + [(7.0, "z7"), (7.0, "a7")]
    xs = [rng.uniform(-500, 500) for _ in range(300)] + [float(rng.randint(-400, 400)) / 2 for _ in range(200)] + [t[0] for t in ticks] + [None]
    points = spark.createDataFrame(list(enumerate(xs)), "n long, x double").repartition(4)
    got = {r.n: r.label for r in matching.snap_to_ticks(points, spark.createDataFrame(ticks, "pos double, label string")).collect()}
    for n, x in enumerate(xs):
        assert got[n] == (None if x is None else min((abs(p - x), p, label) for p, label in ticks)[2]), (n, x)
    none = matching.snap_to_ticks(points, spark.createDataFrame([], "pos double, label string")).collect()
    assert len(none) == len(xs) and all(r.label is None for r in none)


def test_snapping_is_the_same_by_look_up_and_by_merging(spark):
    ticks = spark.createDataFrame([(float(p), f"t{p}") for p in (-4, 0, 1, 9)] + [(1.0, None), (0.0, "a")], "pos double, label string")
    xs = [-9.0, -4.0, -2.0, -1.9, 0.0, -0.0, 0.5, 0.6, 1.0, 5.0, 5.1, 1e300, float("inf"), float("-inf"), None]
    points = spark.createDataFrame(list(enumerate(xs)), "n long, x double").repartition(3)
    want = ["t-4", "t-4", "t-4", "a", "a", "a", "a", "t1", "t1", "t1", "t9", "t9", "t9", "t-4", None]
    for few in (0, 3, 4):
        out = matching.snap_to_ticks(points, ticks, few).orderBy("n").collect()
        assert [r.label for r in out] == want and [r.x for r in out] == xs, few
    rng = random.Random(9)
    many = spark.createDataFrame([(float(p), rng.choice("abc") + str(p)) for p in rng.sample(range(-400, 400), 60)], "pos double, label string")
    drawn = spark.createDataFrame([(n, rng.choice([rng.uniform(-500, 500), rng.randint(-400, 400) / 2])) for n in range(500)], "n long, x double").repartition(4)
    both = [matching.snap_to_ticks(drawn, many, few).orderBy("n").collect() for few in (0, 60)]
    assert both[0] == both[1] and all(r.label for r in both[0])
    # Neither way reads the rest of a range again for each of its rows.
    for few, moved in ((0, True), (4, False)):
        plan = matching.snap_to_ticks(points, ticks, few)._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedfollowing" not in plan.lower().replace("1, unboundedfollowing", "") and ("Window" in plan) == moved


def test_many_points_of_one_range(spark):
    """Quadratic frames took minutes here."""
    ticks = spark.createDataFrame([(0.0, "a"), (1.0, "b")], "pos double, label string")
    points = spark.range(200_000).select(F.col("id").alias("n"), F.lit(0.4).alias("x"))
    for few in (0, 2):
        assert matching.snap_to_ticks(points, ticks, few).groupBy("label").count().collect() == [("a", 200_000)]


def plain_assignment(seekers, targets, tolerance):
    """``seekers``: (n, pool, v, roams), ``targets``: (pool, v); the value that each seeker takes."""
    used, out = set(), {}
    for n, pool, v, roams in sorted(seekers):
        free = [(abs(t - v), t, p or "", j) for j, (p, t) in enumerate(targets) if j not in used and (roams or p == pool)]
        if free and (tolerance is None or min(free)[0] <= max(abs(min(free)[1]) * tolerance[0], tolerance[1])):
            used.add(min(free)[3])
            out[n] = min(free)[1]
    return out, sorted((str(p), t) for j, (p, t) in enumerate(targets) if j not in used)


@pytest.mark.parametrize(("seed", "part", "tolerance", "mixed"), [(0, 8, None, True), (1, 15, (0.1, 0.5), False), (2, 5, (0.0, 0.0), False), (3, 30, None, False), (4, 10**6, (0.3, 2.0), True), (5, 12, (1.5, 0.0), False)])
def test_assignment_in_parts_equals_the_sequential_rule(spark, seed, part, tolerance, mixed):
    rng, rows, want = random.Random(seed), [], {}
    for g in ("hot", "small", "surplus"):
        targets = [(rng.choice(["a", "b", None]) if mixed else "a", rng.choice([rng.randint(-90, 90) / 2, rng.randint(0, 9) * 10.0])) for _ in range({"hot": 120, "small": 4, "surplus": 30}[g])]
        seekers = []
        for n in range({"hot": 110, "small": 5, "surplus": 45}[g]):
            roams = mixed and rng.random() < 0.2
            seekers.append((n, "q" if roams else rng.choice(["a", "b", None]) if mixed else "a", rng.choice(targets)[1] + rng.choice([0.0, 0.0, 0.25, -1.0, 6.0]), roams))
        want[g] = plain_assignment(seekers, targets, tolerance)
        rows += [(g, False, n, v, p, r) for n, p, v, r in seekers] + [(g, True, 0, v, p, False) for p, v in targets]
    df = spark.createDataFrame(rows, "g string, target boolean, n long, v double, pool string, roams boolean").repartition(3)
    out = assignment.assigned(df, ["g"], tolerance, part_rows=part).collect()
    for g in want:
        assert {r.n: r.gt for r in out if r.g == g and not r.target and r.used} == want[g][0]
        assert sorted((str(r.pool), r.v) for r in out if r.g == g and r.target and not r.used) == want[g][1]
    assert len(out) == len(rows)


@pytest.mark.parametrize(("seed", "tolerance", "mixed"), [(0, None, True), (1, (0.1, 0.5), True), (2, (0.0, 0.0), False)])
def test_many_small_groups_share_a_call(spark, seed, tolerance, mixed):
    """Keys of two kinds, large and missing ones among them; a call for each group took 30 ms of a core."""
    rng, rows, want = random.Random(seed), [], {}
    for g in range(300):
        key = (None if g % 100 == 7 else 2**60 + g // 2, None if g == 8 else "ab"[g % 2] + ("x" if g % 100 == 7 else "") + (str(g) if g % 100 == 7 else ""))
        targets = [(rng.choice(["a", "b", None]) if mixed else None, rng.randint(-9, 9) / 2) for _ in range(rng.randint(0, 5))]
        seekers = [(n, rng.choice(["a", "b", "q", None]) if mixed else None, rng.randint(-9, 9) / 2, mixed and rng.random() < 0.3) for n in range(rng.randint(0, 5))]
        want[key] = plain_assignment(seekers, targets, tolerance)
        rows += [(*key, False, n, v, p, r) for n, p, v, r in seekers] + [(*key, True, 0, v, p, False) for p, v in targets]
    df = spark.createDataFrame(rows, "k long, g string, target boolean, n long, v double, pool string, roams boolean").repartition(3)
    found = assignment.assigned(df, ["k", "g"], tolerance)
    out = found.collect()
    assert len(out) == len(rows) and len(want) == 300 and "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()
    for key, (taken, left) in want.items():
        own = [r for r in out if (r.k, r.g) == key]
        assert {r.n: r.gt for r in own if not r.target and r.used} == taken, key
        assert sorted((str(r.pool), r.v) for r in own if r.target and not r.used) == left


def test_values_without_tolerance_are_counted(spark):
    rng, rows = random.Random(4), []
    for g in range(40):
        rows += [(g, target, n, rng.choice([rng.randint(0, 4) / 4, 0.0, -0.0])) for target in (True, False) for n in range(rng.randint(0, 9))]
    df = spark.createDataFrame([*rows, (50, False, 0, None), (50, True, 0, 1.0), (50, False, 1, float("nan"))], "g long, target boolean, n long, value double")
    got = {r.g: r for r in matching.rnss(df.filter("not target"), df.filter("target"), "n", 0.0, 0.0, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        seekers, targets = [(n, "a", v, False) for k, t, n, v in rows if k == g and not t], [("a", v) for k, t, _, v in rows if k == g and t]
        assert (got[g].tp, got[g].n_pred, got[g].n_truth) == (len(plain_assignment(seekers, targets, (0.0, 0.0))[0]), len(seekers), len(targets))
    assert (got[50].tp, got[50].n_pred, got[50].n_truth, got[50].rnss) == (0, 0, 1, 0.0) and not got.keys() - {50} - {r[0] for r in rows}
    near = matching.rnss(df.filter("not target"), df.filter("target"), "n", 0.0, 1e-9, ["g"])  # the sequential rule agrees
    assert {r.g: r for r in near.collect()} == got


def test_stream_with_empty_bins_equals_batch(spark, tmp_path):
    """Bins in order with the empty ones between, over restarts; a row later than the watermark allows is dropped."""
    at = lambda day, h=0: dt.datetime(2024, 1, day, h)
    batches = [[("a", at(1, 5), 1.0), ("a", at(4), 2.0), ("b", at(2, 1), 7.0), ("b", at(2, 3), None)], [("a", at(9, 1), 4.0), ("b", at(6, 1), 1.0), ("a", at(1, 6), 100.0)], [("a", at(9, 2), 0.5), ("z", at(30), 0.0)], []]
    kind, kept = "k string, t timestamp, v double", [r for b in batches for r in b if r[2] != 100.0 and r[0] != "z"]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = events.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema)
        events.start(events.resampled_with_gaps(stream, "t", "v", "1 day", "1 hour", "k"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted((r.k, r.t, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = []
    for k in "ab":
        df = spark.createDataFrame([r for r in kept if r[0] == k], kind)
        want += [(k, r.t, r.v) for r in OPERATORS["resample_boundary"]({"df": df}, {"time": "t", "value": "v", "freq": "1 day"}).collect()]
    assert got == sorted(want) and 0.0 in {v for _, _, v in got}
