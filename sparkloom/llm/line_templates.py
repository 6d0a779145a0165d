"""Line dedup by log templates, in DataFrame operations only.

Each line is parsed to a fixed depth: its token count, then its leading tokens; these name its
leaf.  Variable fields are generalised in two ways.  Tokens with a digit are ``<*>`` wherever
they stand.  The tokens behind the leading ones are cut into ``PARTS`` parts, and a line has,
beside the template of all its tokens, one template with each part as ``<*>`` (if at least
``MIN_FIXED`` tokens stay): lines of a leaf that differ in one part only share that one.
A template found in ``min_docs`` different documents or more is recurring, and its lines are
dropped; the document with the smallest id that has it keeps them (``keep_first``), so that a
group of copies does not lose its only text.

Defined results: null text stays null with no lines; an empty text has one empty line.  Lines
with fewer than ``min_tokens`` tokens are never dropped.  A null id counts as one document and
never as the first unless no other has the template.  Rows with equal id and text get equal
results.  Columns named like the results are replaced, all others stay, whatever their names.
Only ``\n`` ends a line.  A text may have any number of lines: they are handed on one by one with
two numbers each, and what is kept is picked by place in time linear in the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import unused, written

MIN_DOCS, MIN_TOKENS, DEPTH, PARTS, MIN_FIXED = 5, 3, 2, 4, 6
# ASCII white space but the line end (each becomes a blank), digits (each becomes 0), the mark of a field.
FROM, TO, FIELD = "\t\x0b\f\r0123456789", "    0000000000", "<*>"


def masked_tokens(line: Column) -> Column:
    """The tokens of a line with variable fields generalised.

    Single characters are mapped and split at, which needs no regular expression; the walk over
    the tokens is taken only by lines with a digit.
    """
    plain = F.translate(line, FROM, TO)
    tokens = F.array_remove(F.split(plain, " "), "")
    masked = F.transform(tokens, lambda t: F.when(F.contains(t, F.lit("0")), F.lit(FIELD)).otherwise(t))
    return F.when(F.contains(plain, F.lit("0")), masked).otherwise(tokens)


def leaf_of(tokens: Column, depth: int = DEPTH) -> Column:
    """The leaf of a line, as a 64-bit key of its token count and leading tokens."""
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, depth))


def templates(tokens: Column, depth: int = DEPTH) -> Column:
    """64-bit keys of the line's templates within its leaf: of what each keeps fixed."""
    n = F.size(tokens)
    found = [F.xxhash64(F.lit(-1), tokens)]
    for j in range(PARTS):
        first, past = (F.lit(depth) + F.floor((n - depth) * k / PARTS).cast("int") for k in (j, j + 1))
        fixed = F.xxhash64(F.lit(j), F.slice(tokens, F.lit(1), first), F.slice(tokens, past + 1, n - past))
        found.append(F.when((n > depth) & (past > first) & (n - past + first >= MIN_FIXED), fixed))
    return F.array_compact(F.array(*found))


def _in_documents(keys: DataFrame, by: list[str], least: int) -> DataFrame:
    """Keys found in at least so many different documents, and the first of these."""
    return keys.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).filter(F.col("n") >= least).drop("n")


def drop_recurring(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    depth: int = DEPTH,
    keep_first: bool = True,
) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines``, ``n_dropped``."""
    rows = docs.drop("clean_text", "n_lines", "n_dropped")
    row, parts, marked_doc, marked_row, gone = unused(rows.columns, "row", "parts", "marked_doc", "marked_row", "gone")
    row_key = F.xxhash64(F.col(id_col), F.col(text_col))
    # Parsed once and written: keys and places only, no text.  The key of a row is made below the
    # explode, which then hands on two numbers beside each line and never the whole text.  Short
    # lines are left out when it is read: a filter here would be pushed below the parsing and parse
    # every line a second time.
    tokens = F.col("tokens")
    lines = written(
        rows.select(F.col(id_col).alias("doc"), row_key.alias("row"), F.split(F.col(text_col), "\n").alias("parts"))
        .select("doc", "row", F.posexplode("parts").alias("at", "line"))
        .select("doc", "row", "at", masked_tokens(F.col("line")).alias("tokens"))
        .select("doc", "row", "at", leaf_of(tokens, depth).alias("leaf"), F.when(F.size(tokens) >= min_tokens, templates(tokens, depth)).alias("rests")),
        "lines",
    ).filter("rests is not null")
    # All templates of a line lie in its leaf, so only leaves with enough documents need a look.
    # Small sides are written, so that the joins read plain exchanges and can split a hot key.
    busy = written(_in_documents(lines.select("leaf", "doc"), ["leaf"], min_docs).select("leaf"), "leaves")
    lines = written(lines.join(busy, "leaf", "left_semi").select("doc", "row", "at", "leaf", F.explode("rests").alias("rest")), "templates")
    recurring = written(_in_documents(lines.select("leaf", "rest", "doc"), ["leaf", "rest"], min_docs), "recurring")
    dropped = lines.join(recurring, ["leaf", "rest"])
    if keep_first:
        dropped = dropped.filter(~F.col("doc").eqNullSafe(F.col("first")))
    marks = dropped.groupBy("doc", "row").agg(F.collect_set("at").alias("gone")).toDF(marked_doc, marked_row, gone)
    # The lines cross the join in place of the text, so that a kept line is one step from its place.
    cut = rows.withColumns({row: row_key, parts: F.split(F.col(text_col), "\n")}).drop(*([text_col] if text_col != id_col else []))
    out = cut.join(marks, F.col(id_col).eqNullSafe(F.col(marked_doc)) & (F.col(row) == F.col(marked_row)), "left")
    text = F.array_join(parts, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in rows.columns],
        F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(places, lambda at: F.get(parts, at)), "\n")).alias("clean_text"),
        F.when(F.col(parts).isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
