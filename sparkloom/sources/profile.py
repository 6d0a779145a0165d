"""Profiles of tables, header detection, type coercion and the repair of sheets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import EDGE_SPACE, number

NUMBER_TYPES = ("bigint", "int", "smallint", "tinyint", "double", "float")


def semantic_type(dtype: str) -> str:
    if dtype.startswith(("timestamp", "date", "interval")):
        return "temporal"
    if dtype in NUMBER_TYPES or dtype.startswith("decimal"):
        return "quantitative"
    return "categorical"


def dtype_profile(df: DataFrame) -> dict[str, str]:
    """datetime, numeric or string; a boolean is a string here."""
    names = {"temporal": "datetime", "quantitative": "numeric", "categorical": "string"}
    return {c: names[semantic_type(t)] for c, t in df.dtypes}


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each column: present values, distinct values, and min, max, mean, deviation of numbers.

    One aggregate over the table, then a turn of its single row.
    """
    types = dict(df.dtypes)
    columns = list(columns or df.columns)
    stats: list[Column] = []
    for c in columns:
        v = F.col(f"`{c}`")
        n = v.cast("double") if semantic_type(types[c]) == "quantitative" else F.lit(None).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(semantic_type(types[c])).alias("semantic"), F.count(v).alias("non_null"), F.count_distinct(v).alias("distinct"),
                F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"),
            ).alias(c)
        )
    return df.agg(F.array(*stats).alias("p")).select(F.inline("p"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column, missing ones included; ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def table_profile(df: DataFrame, order: Sequence[str], samples: int = 5, columns: Sequence[str] | None = None) -> dict:
    kept = df.select(*(columns or df.columns))
    return {
        "rows": df.count(),
        "columns": len(kept.columns),
        "profile": [r.asDict() for r in column_profile(kept).collect()],
        "samples": [r.asDict() for r in df.orderBy(*order).select(*kept.columns).limit(samples).collect()],
    }


# ---------------------------------------------------------------- headers and types


def filled(cell: Column) -> Column:
    return cell.isNotNull() & (F.regexp_replace(cell, EDGE_SPACE, "") != "")


def header_score(cells: Column) -> Column:
    """1.5 a filled cell, 2.5 a short text, 1 a different value."""
    own = F.filter(cells, filled)
    short = F.filter(own, lambda c: number(c).isNull() & (F.length(c) <= 40))
    return 1.5 * F.size(own) + 2.5 * F.size(short) + F.size(F.array_distinct(own))


def header_row(grid: DataFrame, most: int = 200) -> DataFrame:
    """The row with the best score of the first ``most``; the first of equals."""
    scored = grid.filter(F.col("row_idx") < most).select("row_idx", "cells", header_score(F.col("cells")).alias("score"))
    return scored.agg(F.max_by(F.struct("row_idx", "cells", "score"), F.struct("score", -F.col("row_idx"))).alias("r")).select("r.*")


def unique_names(names: Sequence[str | None], joiner: str = "_", first: int = 2) -> list[str]:
    """Blank names become ``column``; repeated ones get a number (``a``, ``a_2``; or ``a``, ``a.1``)."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        name = (raw or "").strip() or "column"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}{joiner}{seen[name] - 2 + first}")
    return out


def build_table(grid: DataFrame) -> DataFrame:
    """Rows under the detected header, without empty rows and columns, all text."""
    head = header_row(grid).first()
    body = grid.filter(F.col("row_idx") > head.row_idx)
    width = len(head["cells"])
    used = body.agg(*[F.bool_or(filled(F.get("cells", F.lit(i)))).alias(f"c{i}") for i in range(width)]).first()
    keep = [i for i in range(width) if used[f"c{i}"]]
    names = unique_names([head["cells"][i] for i in keep])
    table = body.select("row_idx", *[F.get("cells", F.lit(i)).alias(n) for i, n in zip(keep, names, strict=True)])
    return table.filter(F.greatest(*[filled(F.col(f"`{n}`")).cast("int") for n in names], F.lit(0)) == 1)


def parse_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each text column: the shares that parse as numbers and as times, and leading zeros."""
    stats = []
    for c in columns:
        v = F.col(f"`{c}`")
        stats.append(
            F.struct(
                F.lit(c).alias("column"), F.count_if(filled(v)).alias("n"), F.coalesce(F.count_if(number(v).isNotNull()) / F.nullif(F.count_if(filled(v)), F.lit(0)), F.lit(0.0)).alias("numeric"),
                F.coalesce(F.count_if(F.try_to_timestamp(v).isNotNull()) / F.nullif(F.count_if(filled(v)), F.lit(0)), F.lit(0.0)).alias("temporal"),
                F.coalesce(F.bool_or(v.rlike(r"^\s*0[0-9]")), F.lit(False)).alias("zeros"),
            )
        )
    return df.agg(F.array(*stats).alias("p")).select(F.inline("p"))


def coerce_types(df: DataFrame, columns: Sequence[str], share: float = 0.7) -> DataFrame:
    """Numbers where more than ``share`` of the cells parse, else times; ids with leading zeros stay text."""
    out = df
    for r in parse_shares(df, columns).collect():
        if r.zeros:
            continue
        if r.numeric > share:
            out = out.withColumn(r.column, number(F.col(f"`{r.column}`")))
        elif r.temporal > share:
            out = out.withColumn(r.column, F.try_to_timestamp(F.col(f"`{r.column}`")))
    return out


# ---------------------------------------------------------------- sheets with several blocks


def numeric_cell(cell: Column) -> Column:
    return F.coalesce(number(cell, ",%").isNotNull(), F.lit(False))


def grid_cells(grid: DataFrame) -> DataFrame:
    return grid.select("row_idx", F.posexplode("cells").alias("col_idx", "cell"))


def column_blocks(grid: DataFrame) -> DataFrame:
    """Runs of columns between empty ones: (block, first_col, last_col).  Columns are few; rows are aggregated first."""
    used = grid_cells(grid).groupBy("col_idx").agg(F.bool_or(filled(F.col("cell"))).alias("used"))
    w = Window.orderBy("col_idx")
    runs = used.withColumn("gaps", F.sum((~F.col("used")).cast("int")).over(w)).filter("used")
    blocks = runs.groupBy("gaps").agg(F.min("col_idx").alias("first_col"), F.max("col_idx").alias("last_col"))
    return blocks.select((F.row_number().over(Window.orderBy("first_col")) - 1).alias("block"), "first_col", "last_col")


def block_headers(grid: DataFrame, look: int = 6) -> DataFrame:
    """For each block the first of its top rows that is half text, above a row that is half numbers."""
    top = grid.filter(F.col("row_idx") < look + 3)
    cells = grid_cells(top).join(F.broadcast(column_blocks(grid)), F.col("col_idx").between(F.col("first_col"), F.col("last_col")))
    rows = cells.groupBy("block", "first_col", "last_col", "row_idx").agg(
        F.avg((filled(F.col("cell")) & ~numeric_cell(F.col("cell"))).cast("int")).alias("text"),
        F.avg(numeric_cell(F.col("cell")).cast("int")).alias("numeric"),
    )
    below = F.max("numeric").over(Window.partitionBy("block").orderBy("row_idx").rowsBetween(1, 3))
    heads = rows.withColumn("below", below).filter((F.col("row_idx") < look) & (F.col("text") >= 0.5) & (F.col("below") >= 0.5))
    found = heads.groupBy("block").agg(F.min("row_idx").alias("header_row"))
    return column_blocks(grid).join(found, "block", "left")


def merge_units(names: Sequence[str | None], units: Sequence[str | None]) -> list[str]:
    return [f"{(n or '').strip()} ({u.strip()})" if u and u.strip() else (n or "").strip() for n, u in zip(names, units, strict=True)]


def synthetic_names(n: int) -> list[str]:
    return [f"col{j}" for j in range(n)]


def block_status(header_found: Column, coerced: Column) -> Column:
    return F.when(~header_found, "no_header").when(coerced >= 0.5, "ok").otherwise("weak")


def usable(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each sheet (``by``; without, one row): two rows or more, and three tenths of the filled cells numeric."""
    c = grid.select(*by, "row_idx", F.explode("cells").alias("cell"))
    numbers = F.avg(F.when(filled(F.col("cell")), numeric_cell(F.col("cell")).cast("int")))
    return c.groupBy(*by).agg((F.count_distinct("row_idx") >= 2).alias("rows_ok"), F.coalesce(numbers >= 0.3, F.lit(False)).alias("numbers_ok"))


def repair_sheets(grid: DataFrame, by: Sequence[str] = (), look: int = 6) -> DataFrame:
    """Each block of columns of each sheet: header, number of data rows, of numeric columns, and status.

    ``by`` names the columns that tell sheets apart; a sheet's rows are (row_idx, cells).  Rows that
    are empty within a block do not count for it; shares are of a row's filled cells.  The header is
    the first of the top ``look`` rows that is half text with a row of half numbers among the three
    below; a text row right under it has the units.  A block whose first row is half numbers has
    made-up names; else there is none.  A column is numeric if half of the data rows parse.
    """
    keys = list(by)
    cells = grid.select(*keys, "row_idx", F.posexplode("cells").alias("col_idx", "cell")).withColumn("cell", F.when(filled(F.col("cell")), F.regexp_replace("cell", EDGE_SPACE, "")))
    used = cells.groupBy(*keys, "col_idx").agg((F.count("cell") > 0).alias("used"))
    runs = used.withColumn("gaps", F.sum((~F.col("used")).cast("int")).over(Window.partitionBy(*keys).orderBy("col_idx"))).filter("used")
    first = runs.groupBy(*keys, "gaps").agg(F.min("col_idx").alias("first_col"))
    cells = cells.join(runs.join(first, [*keys, "gaps"]).select(*keys, "col_idx", "first_col"), [*keys, "col_idx"]).withColumn("is_number", numeric_cell(F.col("cell")))
    block = [*keys, "first_col"]
    rows = cells.groupBy(*block, "row_idx").agg(
        F.count("cell").alias("n"), F.count_if(F.col("cell").isNotNull() & ~F.col("is_number")).alias("texts"), F.count_if("is_number").alias("numbers"),
        F.array_sort(F.collect_list(F.struct("col_idx", "cell", "is_number"))).alias("cells"),
    ).filter("n > 0").withColumn("names", F.col("cells.cell"))
    in_order = Window.partitionBy(*block).orderBy("place")
    top = rows.withColumns({"text": F.col("texts") / F.col("n"), "numeric": F.col("numbers") / F.col("n")}).withColumn("place", F.row_number().over(Window.partitionBy(*block).orderBy("row_idx")))
    top = top.filter(F.col("place") <= look + 3).withColumn("below", F.max("numeric").over(in_order.rowsBetween(1, 3)))
    after = F.struct(F.lead("row_idx").over(in_order).alias("at"), F.lead("names").over(in_order).alias("names"))
    top = top.withColumn("units", F.when((F.lead("text").over(in_order) >= 0.5) & (F.lead("numeric").over(in_order) < 0.5), after))
    made_up = lambda i: F.concat(F.lit("col"), i.cast("string"))
    unit = lambda i: F.coalesce(F.concat(F.lit(" ("), F.get(F.col("units")["names"], i), F.lit(")")), F.lit(""))
    named = F.transform("names", lambda n, i: F.concat(F.coalesce(n, made_up(i)), unit(i)))
    head = F.min(F.when((F.col("place") <= look) & (F.col("text") >= 0.5) & (F.col("below") >= 0.5), F.struct("row_idx", F.coalesce(F.col("units")["at"], F.col("row_idx")).alias("last"), named.alias("names"))))
    plain = F.max(F.when((F.col("place") == 1) & (F.col("numeric") >= 0.5), F.struct("row_idx", (F.col("row_idx") - 1).alias("last"), F.transform("names", lambda _, i: made_up(i)).alias("names"))))
    heads = top.groupBy(*block).agg(F.coalesce(head, plain).alias("head")).select(*block, F.col("head.last").alias("head_row"), F.col("head.names").alias("header"))
    data = rows.join(heads.drop("header"), block).filter("row_idx > head_row").select(*block, F.explode("cells").alias("cell"))
    per_column = data.groupBy(*block, "cell.col_idx").agg(F.avg(F.col("cell.is_number").cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))
    sums = per_column.groupBy(*block).agg(F.max("n").alias("n_rows"), F.count_if(F.col("share") >= 0.5).alias("n_numeric"))
    out = heads.join(sums, block, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_numeric")})
    status = F.when(F.col("header").isNull(), "no_header").when((F.col("n_numeric") >= 1) & (F.col("n_rows") >= 2), "ok").otherwise("weak")
    return out.select(*keys, "first_col", "header", "n_rows", "n_numeric", status.alias("status"))


def plottable(df: DataFrame, columns: Sequence[str], share: float = 0.6, most: int = 3) -> DataFrame | None:
    """A text table as (x, numbers): x the first label column (else the first numeric one), at most ``most`` numbers.

    Rows without any of the numbers go; with no number beside x, or under three rows, there is nothing to plot.
    """
    parses = df.agg(*[F.avg(number(F.col(f"`{c}`")).isNotNull().cast("int")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    numeric = [c for i, c in enumerate(columns) if (parses[f"c{i}"] or 0) >= share]
    x = next((c for c in columns if c not in numeric), columns[0] if columns else None)
    ys = [c for c in numeric if c != x][:most]
    if not ys:
        return None
    out = df.select(F.col(f"`{x}`").cast("string").alias(x), *[number(F.col(f"`{c}`")).alias(c) for c in ys]).dropna("all", subset=ys)
    return out if out.limit(3).count() == 3 else None


def sheet_alignment(pairs: DataFrame, sheets: DataFrame, sheet: str = "sheet", usable: str = "usable") -> DataFrame:
    """Each pair (figure_key ``kind:number``, data) with the sheets of its data file that name its figure.

    ``sheets``: (data, sheet name, whether it is a table of numbers).  Adds n_matched, n_usable and a
    status: bad_figure_key, no_sheet_match, matched or usable.  Pairs keep their number of rows.
    """
    key = F.regexp_extract("figure_key", r"^(\w+):(\d+)$", 1), F.nullif(F.regexp_extract("figure_key", r"^(\w+):(\d+)$", 2), F.lit("")).cast("int")
    named = sheets.select("data", sheet_key(F.col(sheet)).alias("k"), F.col(usable).alias("__ok")).select("data", F.col("k.kind").alias("__kind"), F.col("k.number").alias("__number"), "__ok")
    found = named.filter("__number is not null").groupBy("data", "__kind", "__number").agg(F.count(F.lit(1)).alias("n_matched"), F.count_if("__ok").alias("n_usable"))
    out = pairs.withColumns({"__kind": key[0], "__number": key[1]}).join(found, ["data", "__kind", "__number"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_matched", "n_usable")})
    status = F.when(F.col("__number").isNull(), "bad_figure_key").when(F.col("n_matched") == 0, "no_sheet_match").when(F.col("n_usable") == 0, "matched").otherwise("usable")
    return out.withColumn("status", status).drop("__kind", "__number")


def alignment_rates(aligned: DataFrame) -> DataFrame:
    """One row: pairs, those with a matching sheet, those with a usable one, and both rates."""
    n = F.count(F.lit(1))
    c = aligned.agg(n.alias("pairs"), F.count_if(F.col("n_matched") > 0).alias("matched"), F.count_if(F.col("n_usable") > 0).alias("usable"), F.count_if(F.col("status") == "bad_figure_key").alias("bad_keys"))
    return c.withColumns({"match_rate": F.try_divide("matched", "pairs"), "usable_rate": F.try_divide("usable", "pairs")})


SHEET = r"(?i)^\s*(ed|extended data|supp(?:lementary)?)?[\s_]*(fig|figure|table)?\.?[\s_]*(\d+)\s*([a-z](?:\s*[-,]\s*[a-z])*)?"


def sheet_key(name: Column) -> Column:
    """(kind, number, panels) of a sheet name such as ``ED 1a-b``; NULL number if there is none."""
    part = lambda k: F.regexp_extract(name, SHEET, k)
    kind = F.when(F.lower(part(1)).rlike("^(ed|extended)"), "extended").when(part(1) != "", "supplementary").otherwise("main")
    return F.struct(kind.alias("kind"), F.nullif(part(3), F.lit("")).cast("int").alias("number"), F.regexp_replace(F.lower(part(4)), r"\s", "").alias("panels"))


def task_columns(df: DataFrame) -> DataFrame:
    """Columns fit for generated tasks: categories that repeat, numbers with enough values."""
    p = column_profile(df)
    n = df.agg(F.count(F.lit(1))).scalar()
    category = (F.col("semantic") == "categorical") & (F.col("distinct") >= 2) & (F.col("distinct") <= F.greatest(F.lit(3), n / 3))
    return p.select("column", F.when(category, "category").when((F.col("semantic") == "quantitative") & (F.col("non_null") >= 8), "number").alias("use")).filter("use is not null")


def cap_per_source(df: DataFrame, source: str, order: Sequence[str], cap: int = 15) -> DataFrame:
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap).drop("__r")


def shortlist(sheets: DataFrame, cap: int | None = None, total: int | None = None) -> DataFrame:
    """Sheets with 3 to 8 columns, one panel at most and 3 to 60 rows, one a (article, sheet)."""
    fit = sheets.filter(F.col("cols").between(3, 8) & (F.col("panels") <= 1) & F.col("rows").between(3, 60)).dropDuplicates(["article", "sheet"])
    fit = cap_per_source(fit, "article", ["sheet"], cap) if cap else fit
    return fit.orderBy("article", "sheet").limit(total) if total else fit


def safe_names(names: Sequence[str]) -> list[str]:
    return [re.sub(r"\W+", "_", n).strip("_") or "column" for n in names]
