"""Sheets, files, matching with ties, numbering, and unions, against plain versions."""

import hashlib
import random
import zipfile
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom import compare
from sparkloom.contracts import engine
from sparkloom.functions.expressions import number
from sparkloom.operators import matching, ordered
from sparkloom.operators.transforms import OPERATORS
from sparkloom.plans import tasks
from sparkloom.sources import corpus, files, profile

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _book(path):
    cell = lambda at, v, kind="": f'<c r="{at}"{kind}><v>{v}</v></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="Fig. 1a" sheetId="1" r:id="rId1"/><sheet name="Notes" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>dose</t></si><si><r><t>res</t></r><r><t>ponse</t></r></si></sst>")
        rows = f'<row r="1">{cell("A1", 0, " t=\"s\"")}{cell("C1", 1, " t=\"s\"")}</row><row r="2"/>'
        rows += "".join(f'<row r="{i}">{cell(f"A{i}", i)}{cell(f"C{i}", i / 2)}</row>' for i in range(3, 8))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData><row r="4"><c r="B4" t="inlineStr"><is><t>a note</t></is></c></row></sheetData></worksheet>')


def test_workbooks_are_grids(spark, tmp_path):
    _book(f"{tmp_path}/a.xlsx")
    rows = {(r.sheet, r.row_idx): r.cells for r in files.read_any(spark, f"{tmp_path}/a.xlsx").collect()}
    assert rows["Fig. 1a", 0] == ["dose", None, "response"] and rows["Fig. 1a", 3] == ["4", None, "2.0"]
    assert rows["Notes", 3] == [None, "a note"] and ("Fig. 1a", 1) not in rows and len(rows) == 7
    out = {(r.sheet, r.first_col): r for r in profile.repair_sheets(files.read_xlsx(spark, f"{tmp_path}/*.xlsx"), ["path", "sheet"]).collect()}
    assert [out["Fig. 1a", k].status for k in (0, 2)] == ["ok", "ok"] and out["Fig. 1a", 2].header == ["response"] and out["Fig. 1a", 0].n_rows == 5
    assert out["Notes", 1].status == "no_header"


def test_messages_and_hashes(spark, tmp_path):
    df = spark.createDataFrame([("article", 1), ("pair", 2), ("pair", 3)], "kind string, v long")
    files.route_messages(df, "kind", f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/kind=pair").count() == 2
    (tmp_path / "x.bin").write_bytes(b"some bytes")
    r = files.file_hashes(spark, f"{tmp_path}/x.bin").first()
    assert (r.length, r.sha256) == (10, hashlib.sha256(b"some bytes").hexdigest())


def _plain_match(pred, truth, relative=0.015, floor=1.0):
    used, rows = set(), []
    for n, s, x, v in sorted(pred):
        at_x = [j for j, t in enumerate(truth) if t[1] == x]
        own = [j for j in at_x if truth[j][0] == s] or at_x
        free = [j for j in own if j not in used]
        if not free:
            rows.append(("wrong_mapping", s, x, None, v))
            continue
        j = min(free, key=lambda j: (abs(truth[j][2] - v), j))
        used.add(j)
        gt = truth[j][2]
        rows.append(("match" if abs(gt - v) <= max(abs(gt) * relative, floor) else "wrong_value", s, x, gt, v))
    return rows + [("missing_series", s, x, v, None) for j, (s, x, v) in enumerate(truth) if j not in used]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_with_ties_and_left_over_rows(spark, seed):
    rng = random.Random(seed)
    # Distinct truth values of an x, so that the nearest does not depend on the order of rows.
    truth = [(rng.choice("ab"), x, float(v)) for x in "pqr" for v in rng.sample(range(0, 60, 3), rng.randint(1, 6))]
    pred = [(n, rng.choice("abc"), rng.choice("pqrs"), rng.choice(truth)[2] + rng.choice([0.0, 0.5, 1.25, 7.25])) for n in range(12)]
    got = matching.greedy_match(spark.createDataFrame(pred, "n long, series string, x string, value double"), spark.createDataFrame(truth, "series string, x string, value double"), "n").collect()
    want = _plain_match(pred, truth)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and "missing_series" in {r[0] for r in want}


@pytest.mark.parametrize("seed", range(3))
def test_values_only_with_ties(spark, seed):
    rng = random.Random(seed)
    truth = [(c, float(rng.randint(0, 30))) for c in "ab" for _ in range(20)]
    pred = [(c, n, rng.randint(0, 62) / 2) for n, c in enumerate("ab" * 15)]
    want = {}
    for c in "ab":
        left, tp = sorted(v for k, v in truth if k == c), 0
        for _, _, v in sorted(p for p in pred if p[0] == c):
            j = min(range(len(left)), key=lambda j: (abs(left[j] - v), j), default=None)
            if j is not None and abs(left[j] - v) <= max(abs(left[j]) * 0.015, 0.6):
                tp += 1
                left.pop(j)
        want[c] = (tp, 15, 20)
    out = matching.rnss(spark.createDataFrame(pred, "chart string, n long, value double"), spark.createDataFrame(truth, "chart string, value double"), "n", floor=0.6, by=["chart"])
    assert {r.chart: (r.tp, r.n_pred, r.n_truth) for r in out.collect()} == want


def test_numbers_of_rows_in_order(spark):
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else rng.randint(-40, 40) / 4, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, i long").repartition(7)
    want = {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1)}
    assert {r.i: r.n for r in ordered.numbered(df, ["v", "i"], "n").collect()} == want
    assert {r.i: r.n for r in ordered.numbered(df.withColumn("s", F.lpad(F.col("i").cast("string"), 5, "0")), ["s"], "n").collect()} == {i: i + 1 for i in range(3000)}
    few = ordered.ranged(df, "v", 100).groupBy("__range").count().collect()
    assert len(few) <= 101 and sum(r["count"] for r in few) == 3000


def test_an_error_at_run_time_is_a_fire(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    broken = df.groupBy("g").agg(F.median("v").alias("v")).withColumn("v", F.when(F.raise_error(F.lit("broken")).isNull(), F.col("v")))
    cases = [("median_not_mean", {"df": df}, {"group": "g", "value": "v"}, r) for r in (broken, df.groupBy("g").agg(F.median("v").alias("v")))]
    rows = engine.evaluated(cases)
    assert [r.fired for r in rows] == [True, False]


def test_percent_ranks_are_pruned_without_a_unit_column(spark):
    df = spark.range(20).select((F.col("id") * 3.0).alias("v"))
    inputs, p = {"df": df}, {"rank_pct": {"value": "v"}}
    assert engine.run_all(inputs, p, df.withColumn("rank_pct", F.col("v") + 5)) == {}
    assert engine.run_all(inputs, p, OPERATORS["rank_pct"](inputs, p["rank_pct"])) == {"rank_pct": False}


def test_unions_of_frames_grouped_alike(spark):
    """Sides that are hash-partitioned alike but coalesced apart must not split the groups above them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        base = spark.range(4000).select((F.col("id") % 700).cast("string").alias("g"), F.col("id").alias("v"), F.lpad(F.lit("x"), 40, "x").alias("pad"))
        a = base.groupBy("g").agg(F.sum("v").alias("v"))
        b = base.groupBy("g").agg(F.max("pad").alias("pad"), F.sum("v").alias("v")).select("g", "v")
        assert compare.equal(a, b) and compare.subset_equal(b, a)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_newest_in_two_orders_with_unknown_years(spark):
    rows = [(None if i % 9 == 0 else 2000 + i % 3, i, i % 40) for i in range(200)]
    out = corpus.newest_by_year(spark.createDataFrame(rows, "y int, i long, k long"), "y", ["i"], 6, 45, key=["k"]).collect()
    seen, want = set(), []
    for y in (2002, 2001, 2000, None):
        own = sorted(r for r in rows if r[0] == y) if y is not None else [r for r in rows if r[0] is None]
        for r in own[:6] + (own[::-1][:6] if len(own) > 6 else []):
            if r[2] not in seen:
                seen.add(r[2])
                want.append(r)
    assert [tuple(r) for r in out] == want[:45]


def test_axes_by_overlay_or_type(spark):
    df = spark.createDataFrame([("a", "s", 1.0, 2)], "_i string, day string, v double, n long")
    assert matching.infer_axes(df) == ("day", "v", None)
    assert matching.infer_axes(df, {"x": "n", "y": "gone", "series": "day"}) == ("n", "v", "day")


def test_generated_tasks_tell_right_from_slip(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), round(rng.random() * 50, 2), None if i % 6 == 0 else round(rng.random() * 9, 2)) for i in range(60)]
    made = tasks.generate(spark.createDataFrame(rows, "g string, v double, w double"), cap=6)
    names = [t.operator for t in made]
    assert "weighted_mean" in names and "pooled_rate" in names and 4 <= len(made) <= 6


def test_tasks_of_many_tables_equal_those_of_each(spark):
    rng = random.Random(5)
    frames = {}
    for name, n in (("plain", 40), ("gaps", 30), ("few", 6), ("flat", 24)):
        rows = [(i, rng.choice(["x", "y", None if name == "gaps" else "z"]), f"k{i % 2}", round(rng.random() * 50, 2), None if name == "gaps" and i % 5 == 0 else float(i % 3), 1.0 if name == "flat" else rng.randint(1, 9) * 1.0) for i in range(n)]
        frames[name] = spark.createDataFrame(rows, "row long, g string, h string, v double, w double, u double")
    cells = reduce(DataFrame.unionByName, [tasks.as_cells(df, name, "row") for name, df in frames.items()])
    got = {}
    for r in tasks.generate_many(cells, cap=9).orderBy("table", "place").collect():
        got.setdefault(r.table, []).append((r.operator, r.params))
    for name in ("plain", "gaps", "few"):
        want = [(t.operator, t.params) for t in tasks.generate(frames[name].drop("row"), cap=9)]
        assert got.get(name, []) == want, name
    assert got["flat"] and not any(op == "zscore_within_group" and p["value"] == "u" for op, p in got["flat"])
    assert tasks.generate_many(cells.filter("false")).count() == 0


def test_labels_captions_and_sheets_on_small_rows(spark):
    """Forms with one right answer each."""
    one = lambda kind, rows, c: [r.v for r in spark.createDataFrame(rows, kind).select(c.alias("v")).collect()]
    labels = [("Source Data Fig. 1, 3-5 and 7",), ("Extended Data Fig. 9-7 (see 2)",), ("Figure 2",), ("none",)]
    assert one("label string", labels, F.array_join(corpus.label_keys(F.col("label")), ",")) == ["main:1,main:3,main:4,main:5,main:7", "extended:7,extended:8,extended:9", "main:2", ""]
    assert one("caption string, idx int", [("Fig. 3: dose", 0), ("Extended Data Fig. 2 | rate", 1), ("A photo", 4)], corpus.figure_identity(F.col("caption"), F.col("idx"))["key"]) == ["main:3", "extended:2", "main:5"]
    rows = [("https://x/og.png", None, None, []), ("", "a.jpg 1x, b.jpg 2x", "z.png", []), (None, None, "c.png", ["fig1.png"]), (None, None, None, ["fig1.png", "x.tif", "fig2.tif", "fig3.tif"])]
    assert one("og string, srcset string, src string, anchors array<string>", rows, corpus.best_image(F.col("og"), F.col("srcset"), F.col("src"), F.col("anchors"))) == ["https://x/og.png", "b.jpg", "c.png", "fig2.tif"]
    assert one("cell string", [("1,200",), ("35%",), (" 7.5 ",), ("1d",), ("abc",), ("-3",)], number(F.col("cell"), ",%")) == [1200.0, 35.0, 7.5, None, None, -3.0]
    keys = one("name string", [("ED 1a-b",), ("Fig. 3",), ("Extended Data Fig 12c",), ("Notes",), ("figure_2 a,b",)], profile.sheet_key(F.col("name")))
    assert [tuple(k) for k in keys] == [("extended", 1, "a-b"), ("main", 3, ""), ("extended", 12, "c"), ("main", None, ""), ("main", 2, "a,b")]
    grid = [["Table of results", None, None, None, None], ["dose", "response", None, "time", "cells"], ["1", "2.5", None, "0", "100"], ["2", "3.5", None, "24", "180"], ["3", "4.5", None, "48", "310"]]
    sheet = spark.createDataFrame(list(enumerate(grid)), "row_idx int, cells array<string>")
    assert sorted((r.block, r.first_col, r.last_col, r.header_row) for r in profile.block_headers(sheet).collect()) == [(0, 0, 1, 0), (1, 3, 4, 1)]
    head = profile.header_row(sheet).first()
    assert (head.row_idx, "|".join(c for c in head.cells if c)) == (1, "dose|response|time|cells")
    assert tuple(profile.usable(sheet).first()) == (True, True)
    t = lambda *xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "term string, pos int")
    assert [r.term for r in corpus.keyword_list(t("alpha"), t("a", "b"), t("u", "v", "w"), 5).collect()] == ["alpha", "a u", "a v", "a w", "b u"]
