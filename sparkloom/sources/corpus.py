"""Corpus jobs: figures and data files out of pages, pairs, manifests, merges, resume."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import half_even, slug
from sparkloom.session import safe_unions

DATA_FILES = ("csv", "tsv", "xls", "xlsx", "zip", "txt")
FIGURE = r"(?i)^\s*(extended\s+data\s+)?fig(?:ure|\.)?\s*(\d+)"


# ---------------------------------------------------------------- pages


_AND = re.compile(r"&(?:(#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)?")


def _only_whole(html: str, names: tuple[str, ...]) -> str:
    """Markup whose references to other than ``names``, or without their semicolon, stand for themselves."""
    return _AND.sub(lambda m: m[0] if m[1] in names else "&amp;" + m[0][1:], html)


class _Page(HTMLParser):
    """Title (the first), links, images with their captions; tolerant of bad markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str]] = []
        self.figures: list[dict] = []
        self.title, self._titles, self._text, self._href, self._figure, self._in = "", 0, [], None, None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a":
            self._href, self._text = a.get("href"), []
        elif tag == "figure":
            self._figure = {"img": None, "caption": [], "anchor": a.get("id")}
        elif tag == "img" and self._figure is not None and not self._figure["img"]:
            self._figure["img"] = a.get("src")
        elif tag == "title":
            self._titles += 1
        self._in.append(tag)

    def handle_endtag(self, tag):
        if tag == "a" and self._href is not None:
            self.links.append((self._href, " ".join("".join(self._text).split())))
            self._href = None
        elif tag == "figure" and self._figure is not None:
            if self._figure["img"]:
                self.figures.append({**self._figure, "caption": " ".join("".join(self._figure["caption"]).split())})
            self._figure = None
        while self._in and self._in.pop() != tag:
            pass

    def handle_data(self, data):
        if self._href is not None:
            self._text.append(data)
        if "title" in self._in[-1:] and self._titles == 1:
            self.title += data
        if self._figure is not None and "figcaption" in self._in:
            self._figure["caption"].append(data)


PAGE = "page_id long, title string, links array<struct<href:string,text:string>>, figures array<struct<idx:int,img:string,caption:string,anchor:string>>"


def parse_pages(pages: DataFrame, references: tuple[str, ...] | None = None) -> DataFrame:
    """Whole pages by the tolerant parser; figures without an image go.

    Character references are read as browsers do, some also without a semicolon.  With ``references`` only
    those names are read, and only with it: ``&amp`` cut off at the end of a title stays as it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                page = _Page()
                page.feed(html or "" if references is None else _only_whole(html or "", references))
                page.close()
                rows.append((page_id, page.title.strip(" \t\n\r\f"), [{"href": h, "text": t} for h, t in page.links], [{"idx": i, "img": f["img"], "caption": f["caption"], "anchor": f["anchor"]} for i, f in enumerate(page.figures)]))
            yield pd.DataFrame(rows, columns=["page_id", "title", "links", "figures"])

    return pages.select("page_id", "html").mapInPandas(run, PAGE)


def page_links(pages: DataFrame) -> DataFrame:
    """Title and link targets by expressions only, for pages in regular markup."""
    return pages.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1).alias("hrefs"))


def figure_identity(caption: Column, index: Column) -> Column:
    """(kind, number, key) from the caption, else from the place on the page."""
    number = F.nullif(F.regexp_extract(caption, FIGURE, 2), F.lit("")).cast("int")
    kind = F.when(F.regexp_extract(caption, FIGURE, 1) != "", "extended").otherwise("main")
    kind, number = F.when(number.isNull(), "main").otherwise(kind), F.coalesce(number, index + 1)
    return F.struct(kind.alias("kind"), number.alias("number"), F.concat(kind, F.lit(":"), number.cast("string")).alias("key"))


def expand_numbers(text: Column) -> Column:
    """``1, 3-5 and 7`` as sorted different integers; ranges count in either direction."""
    parts = F.regexp_extract_all(F.regexp_replace(text, "[–—]", "-"), F.lit(r"(\d+\s*-\s*\d+|\d+)"), 1)
    one = lambda p: F.sequence(F.split(p, r"\s*-\s*")[0].cast("int"), F.element_at(F.split(p, r"\s*-\s*"), -1).cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))


def label_keys(label: Column) -> Column:
    """Figure keys that a source label names; text in parentheses does not count."""
    bare = F.regexp_replace(label, r"\([^)]*\)", " ")
    kind = F.when(bare.rlike("(?i)extended"), "extended").otherwise("main")
    return F.transform(expand_numbers(bare), lambda n: F.concat(kind, F.lit(":"), n.cast("string")))


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; a minimum over structs, so copies are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    keyed = df.withColumn("__o", F.struct(*order))
    return keyed.groupBy(*key).agg(F.min_by(F.struct(*rest), "__o").alias("__r")).select(*key, "__r.*").select(*df.columns)


def pairs(anchors: DataFrame, files: DataFrame, figures: DataFrame, labelled: DataFrame) -> DataFrame:
    """Figures with data: by anchor (no label, wins), else by the label's keys; one a (figure, image, data)."""
    safe_unions(figures.sparkSession)
    by_anchor = figures.join(anchors, "figure_key").join(files, "anchor").select("figure_key", "img", "data", F.lit(None).cast("string").alias("label"), F.lit(0).alias("source"))
    keys = labelled.select("data", "label", F.explode(label_keys(F.col("label"))).alias("figure_key"))
    by_label = figures.join(keys, "figure_key").select("figure_key", "img", "data", "label", F.lit(1).alias("source"))
    return keep_first(by_anchor.unionByName(by_label), ["figure_key", "img", "data"], ["source", "label"])


# ---------------------------------------------------------------- URLs and names


def url_parts(url: Column) -> dict[str, Column]:
    bare = F.regexp_replace(url, "[?#].*$", "")
    return {
        "https": F.regexp_replace(url, "^http://", "https://"),
        "host": F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1)),
        "basename": F.regexp_extract(bare, "([^/]*)/?$", 1),
        "query": F.regexp_extract(url, r"\?([^#]*)", 1),
    }


def query_get(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def query_set(url: Column, name: str, value: str) -> Column:
    return F.regexp_replace(url, rf"([?&]{name}=)[^&#]*", f"$1{value}")


def file_index(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(\d+)(?=\.[^.]*$)", 1), F.lit("")).cast("int")


def author_list(authors: Column) -> Column:
    """``Family, Given; ...`` from structs (family, given)."""
    return F.array_join(F.transform(authors, lambda a: F.concat_ws(", ", a["family"], a["given"])), "; ")


def best_image(og: Column, srcset: Column, src: Column, anchors: Column) -> Column:
    """og tag, last of srcset, img, else the anchor with the best score (first of equals)."""
    last = F.regexp_extract(F.element_at(F.split(srcset, ","), -1), r"^\s*(\S+)", 1)
    kind = lambda u: F.lower(F.regexp_extract(u, r"\.([A-Za-z]+)(?:[?#]|$)", 1))
    score = lambda u: F.when(u.rlike("(?i)fig"), 5).otherwise(0) + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (("tif", 4), ("tiff", 4), ("png", 3), ("jpg", 2), ("jpeg", 2), ("webp", 1)) for x in kv]), kind(u)), F.lit(0))
    ranked = F.array_max(F.transform(anchors, lambda u, i: F.struct(score(u).alias("s"), (-i).alias("i"), u.alias("u"))))["u"]
    return F.coalesce(F.nullif(og, F.lit("")), F.nullif(last, F.lit("")), F.nullif(src, F.lit("")), ranked)


def download_name(disposition: Column, url: Column, content_type: Column) -> Column:
    """File name from the header (percent-decoded), else the URL's, with an extension from the type if it has none."""
    named = F.nullif(F.regexp_extract(disposition, r"""filename\*?=(?:UTF-8'')?"?([^";]+)""", 1), F.lit(""))
    name = F.coalesce(F.try_url_decode(named), url_parts(url)["basename"])
    ext = F.when(content_type.contains("csv"), ".csv").when(content_type.contains("json"), ".json").when(content_type.contains("pdf"), ".pdf").when(content_type.contains("zip"), ".zip").otherwise(".bin")
    return F.when(name.rlike(r"\.[A-Za-z0-9]{1,5}$"), name).otherwise(F.concat(name, ext))


# ---------------------------------------------------------------- merging, resume, selection


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New keys are added; existing rows win."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def merge_records(existing: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """By lower-case key, existing first, first of equals; blank keys go."""
    safe_unions(existing.sparkSession)
    both = existing.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    both = both.withColumn("__k", F.lower(F.trim(key))).filter("__k is not null and __k <> ''")
    return keep_first(both, ["__k"], ["__src", position]).drop("__k", "__src")


def in_family(title: Column, names: list[str]) -> Column:
    t = F.lower(F.trim(title))
    return F.exists(F.array(*map(F.lit, names)), lambda n: (t == F.lower(n)) | t.startswith(F.concat(F.lower(n), F.lit(" "))))


def join_search(a: DataFrame, b: DataFrame, key: str, prefer_b: list[str]) -> DataFrame:
    """Left join of two sources; for some fields the second one is preferred."""
    right = b.select(key, *[F.col(c).alias(f"__{c}") for c in prefer_b])
    return a.join(right, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in prefer_b else F.col(c) for c in a.columns])


def newest_by_year(df: DataFrame, year: str, tie: list[str], per_year: int, total: int | None = None, key: list[str] | None = None) -> DataFrame:
    """The first ``per_year`` of each year, newest year first; an unknown year is the oldest.

    With ``key`` a year that has more rows than ``per_year`` is read in the second order too (the
    last ones first), and of rows with one key the first found stays, before the total is cut.
    """
    first = _top_of_year(df, year, [F.col(c).asc() for c in tie], per_year)
    if key is None:
        rows = first.drop("__r").orderBy(F.col(year).desc_nulls_last(), *tie)
        return rows.limit(total) if total else rows
    capped = df.groupBy(F.col(year).alias("__y")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > per_year)
    second = _top_of_year(df.join(capped, F.col(year).eqNullSafe(F.col("__y")), "left_semi"), year, [F.col(c).desc() for c in tie], per_year)
    both = first.withColumn("__pass", F.lit(0)).unionByName(second.withColumn("__pass", F.lit(1)))
    found = keep_first(both.withColumn("__age", -F.coalesce(F.col(year).cast("long"), F.lit(-1 << 40))), key, ["__age", "__pass", "__r"])
    rows = found.orderBy("__age", "__pass", "__r", *key)
    return (rows.limit(total) if total else rows).select(*df.columns)


def _top_of_year(df: DataFrame, year: str, order: list[Column], n: int) -> DataFrame:
    """The first rows of each year; the limit is applied before the shuffle too."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(year).orderBy(*order))).filter(F.col("__r") <= n)


def order_records(df: DataFrame, year: str, tie: list[str], newest_first: bool = True) -> DataFrame:
    """Records by year; an unknown year is the oldest of all."""
    return df.orderBy(F.col(year).desc_nulls_last() if newest_first else F.col(year).asc_nulls_first(), *tie)


def keyword_list(base: DataFrame, first: DataFrame, second: DataFrame, least: int) -> DataFrame:
    """Base terms in order, then pairs ``first second`` until there are ``least``.

    The first ``least`` different terms of each list are enough for that, so no more are paired.
    """
    lead = lambda df: df.groupBy("term").agg(F.min("pos").alias("pos")).orderBy("pos", "term").limit(least)
    ends = lead(second).agg(F.collect_list(F.struct(F.col("term").alias("b"), F.col("pos").alias("j")))).scalar()
    combined = lead(first).select(F.col("term").alias("a"), F.col("pos").alias("i"), F.inline(ends))
    both = base.select("term", F.lit(0).alias("s"), "pos", F.lit(0).alias("j")).unionByName(combined.select(F.concat_ws(" ", "a", "b").alias("term"), F.lit(1).alias("s"), F.col("i").alias("pos"), "j"))
    firsts = both.groupBy("term").agg(F.min(F.struct("s", "pos", "j")).alias("o"))
    return firsts.orderBy("o").limit(least).select("term")


# ---------------------------------------------------------------- manifests


def longest(text: str, tie: str) -> Column:
    return F.max_by(text, F.struct(F.length(text), -F.col(tie)))


def merge_duplicates(df: DataFrame, key: list[str], text: str, value: str, items: str, order: str) -> DataFrame:
    """Longest text (first of equals), first value there is, sorted union of the item arrays."""
    return df.groupBy(*key).agg(
        longest(text, order).alias(text),
        F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items),
    )


def contains_join(names: DataFrame, anchors: DataFrame, name: str, anchor: str) -> DataFrame:
    """Pairs whose name contains the anchor: on shared word pieces where the anchor is one, never all with all.

    Anchors are alphanumeric ids, so an anchor in a name lies in one alphanumeric run; each run's
    substrings of the anchors' lengths are looked up by equality.  Anchors' lengths are few.
    """
    lengths = [r[0] for r in anchors.select(F.length(anchor)).distinct().collect() if r[0]]
    if not lengths:
        return names.join(anchors, F.lit(False))

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - (n - 1)))
        return F.transform(starts, lambda i: F.substring(F.col(name), i, F.lit(n)))

    grams = F.array_distinct(F.flatten(F.array(*map(pieces, lengths))))
    return names.withColumn("__g", F.explode(grams)).join(anchors, F.col("__g") == F.col(anchor)).drop("__g")


def pair_metadata(pairs: DataFrame, files: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """What is known of each image: longest caption, first value of each field, sorted files and labels.

    ``pairs``: (img_url, caption, data_url, label, fields ..., order); ``files``: (data), the names at hand.
    Images and data files are told apart by the last part of their URLs; pairs without an image go.
    """
    name = lambda c: F.nullif(url_parts(F.col(c))["basename"], F.lit(""))
    rows = pairs.withColumns({"__img": name("img_url"), "__data": name("data_url")}).filter("__img is not null")
    known = files.select(F.col("data").alias("__data"), F.lit(True).alias("__known")).distinct()
    rows = rows.join(known, "__data", "left").withColumn("__data", F.when(F.col("__known"), F.col("__data")))
    sorted_set = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    caption = F.nullif(F.col("caption"), F.lit(""))
    return rows.groupBy(F.col("__img").alias("img")).agg(
        F.max_by(caption, F.when(caption.isNotNull(), F.struct(F.length(caption), -F.col(order)))).alias("caption"),
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields],
        sorted_set("__data").alias("files"), sorted_set("label").alias("labels"),
    )


def preflight(articles: DataFrame, figures: DataFrame) -> DataFrame:
    """One row of counts before a run: articles, figures, figures without caption and without source data."""
    blank = F.coalesce(F.length("caption"), F.lit(0)) == 0
    f = figures.agg(F.count(F.lit(1)).alias("figures"), F.count_if(blank).alias("caption_missing"), F.count_if(F.coalesce(F.size("files"), F.lit(0)) < 1).alias("source_missing"))
    return f.select(articles.agg(F.count(F.lit(1))).scalar().alias("articles"), "figures", "caption_missing", "source_missing")


def article_manifest(figures: DataFrame, files: DataFrame) -> DataFrame:
    f = figures.groupBy("article").agg(F.count(F.lit(1)).alias("n_figures"), F.count_if(F.coalesce(F.length("caption"), F.lit(0)) == 0).alias("missing_captions"))
    d = files.groupBy("article").agg(F.count(F.lit(1)).alias("n_files"))
    return f.join(d, "article", "full").na.fill(0)


def figure_manifest(figures: DataFrame, pair_meta: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Figure rows with the pair's fields first and the figure's where those are missing."""
    meta = pair_meta.select(*key, *[F.col(c).alias(f"__{c}") for c in fields])
    return figures.join(meta, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in figures.columns])


def padded_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, pad: float) -> list[Column]:
    """A box grown by a share of its size (a quarter at most) and cut to the image; halves round to even."""
    share = min(pad, 0.25)
    px, py = half_even((x1 - x0) * share), half_even((y1 - y0) * share)
    zero = F.lit(0)
    return [F.greatest(zero, x0 - px), F.greatest(zero, y0 - py), F.least(width, x1 + px), F.least(height, y1 + py)]


def safe_name(text: Column) -> Column:
    return slug(text)
