"""The registered queries of this subpackage, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, kneser_ney, license_scan, line_templates, mixing, quality_rules, ranked_search, rindex, simhash, token_alignment, url_filter, weak_labels

RANKS, A_FILE, B_FILE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    # A scan of fewer splits than cores is a small one; dealing it out lets all cores work.
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ranks_and_pattern() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents", "doc_id", "text", "lang")).drop("text", "lang")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = kneser_ney.train(docs.filter(kneser_ney.learns(F.col("doc_id"))))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", (~kneser_ney.learns(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(_table(spark, sf_dir, "pages", "page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("strict_terms", ",").alias("strict_found"), F.array_join("soft_terms", ",").alias("soft_found"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir, "documents", "doc_id", "text"), *ranks_and_pattern()))


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        "n_blocks",
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.aggregate("found.n_differences", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_differences"),
        F.round(F.array_max("found.saving"), 6).alias("best_saving"),
    )


def op8_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rindex.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "clean_text", "n_lines", "n_dropped")


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return token_alignment.align(docs, public_tokenizers.path(A_FILE), public_tokenizers.PATTERN, public_tokenizers.path(B_FILE))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_kneser_ney, op3_url_filter, op4_decontaminate, op5_bpe, op6_weak_labels, op7_license_scan, op8_run_length_index, op9_simhash, op10_line_templates, op11_mix_sources, op12_token_alignment, op13_ranked_search, pipeline)
}


def _op3_sql() -> str:
    def hits(terms: tuple[str, ...]) -> str:
        cases = ", ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{t}' END" for t in sorted(terms))
        return f"list_filter([{cases}], lambda x: x IS NOT NULL)"

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"

    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH a AS (
      SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '^(?s:.*?)://((?s:[^/?#]*))((?s:[^?#]*))', ['host', 'path']) AS x FROM pages
    ), b AS (SELECT page_id, {lower.format("url")} AS u, {lower.format("x.host")} AS host, x.path AS path FROM a
    ), c AS (SELECT page_id, host, path, CASE {rule} END AS rule, {hits(url_filter.STRICT_TERMS)} AS s, {hits(url_filter.SOFT_TERMS)} AS w FROM b)
    SELECT page_id, host, path, rule,
      CASE {verdict} WHEN len(s) > 0 OR len(w) >= {url_filter.MIN_SOFT} THEN 'block' ELSE 'allow' END AS verdict,
      array_to_string(s, ',') AS strict_found, array_to_string(w, ',') AS soft_found
    FROM c"""


def _op4_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    n = decontaminate.WINDOW
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    b AS (SELECT item_id, w, least({n}, len(w)) AS m FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS i FROM b)),
    dp AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m),
    h AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM dp) dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
    p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS pos FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _op10_sql() -> str:
    d, k = line_templates.DEPTH, line_templates.PARTS
    return f"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
    l AS (SELECT doc_id, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS line FROM d),
    t AS (SELECT doc_id, i, line, list_transform(list_filter(regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> ''),
            lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
    p AS (SELECT DISTINCT doc_id, i, w, len(w) AS n, j, CASE WHEN j < 0 THEN 0 ELSE {d} + CAST(floor((len(w) - {d}) * j / {k}) AS BIGINT) END AS a,
            CASE WHEN j < 0 THEN 0 ELSE {d} + CAST(floor((len(w) - {d}) * (j + 1) / {k}) AS BIGINT) END AS b FROM t, range(-1, {k}) r(j) WHERE len(w) >= {line_templates.MIN_TOKENS}),
    k AS (SELECT doc_id, i, CASE WHEN j < 0 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:a], ' ') || chr(10) || array_to_string(w[b + 1:n], ' ') || chr(10) || j || ' ' || n END AS template
          FROM p WHERE j < 0 OR (n > {d} AND b > a AND n - b + a >= {line_templates.MIN_FIXED})),
    r AS (SELECT template, min(doc_id) AS first FROM k GROUP BY template HAVING count(DISTINCT doc_id) >= {line_templates.MIN_DOCS}),
    g AS (SELECT DISTINCT k.doc_id, k.i FROM k JOIN r ON k.template = r.template AND r.first <> k.doc_id),
    m AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS clean_text,
      CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped
    FROM m GROUP BY doc_id"""


def _op11_sql() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    most, share = mixing.MOST_EPOCHS, mixing.SHARE
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{mixing.SEED}:' || doc_id || ':' || md5(coalesce(text, ''))) AS shuffled FROM documents),
    s AS (SELECT source, sum(size) AS source_size, CAST([{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
    l AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, weight, source_size * {most}.0::DOUBLE AS bound, source_size * {most}.0::DOUBLE / weight AS level, sum(weight) OVER () AS all_weight, CAST(sum(source_size) OVER () AS BIGINT) * {share}::DOUBLE AS budget FROM s),
    u AS (SELECT *, sum(bound) OVER w + level * (all_weight - sum(weight) OVER w) <= budget AS at_bound FROM l WINDOW w AS (ORDER BY level, source ROWS UNBOUNDED PRECEDING)),
    v AS (SELECT *, coalesce(sum(bound) FILTER (WHERE at_bound) OVER (), 0.0) AS bounds, coalesce(sum(weight) FILTER (WHERE at_bound) OVER (), 0.0) AS weights FROM u),
    t AS (SELECT source, source_size, budget, CASE WHEN at_bound THEN bound ELSE least((budget - bounds) * weight / (all_weight - weights), bound) END AS target FROM v),
    p AS (SELECT doc_id, size, source_size, target, budget, source, row_number() OVER (PARTITION BY source ORDER BY shuffled, size) AS place,
            sum(size) OVER (PARTITION BY source ORDER BY shuffled, size ROWS UNBOUNDED PRECEDING) AS given FROM d JOIN t USING (source)),
    q AS (SELECT *, (given + epoch * source_size)::DOUBLE / target AS finish FROM p, range({most}) e(epoch)),
    r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source, place, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q WHERE size > 0 OR epoch = 0)
    SELECT doc_id, CAST(any_value(size) AS BIGINT) AS size, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(greatest(0, least(size, floor(budget) - start))) AS BIGINT) AS taken FROM r GROUP BY doc_id"""


def _op13_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
    q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({words}) AS t FROM benchmark) GROUP BY 1, 2),
    p AS (SELECT doc_id, t, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
    f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t),
    i AS (SELECT doc_id, p.t, w * (({ranked_search.SCALE} * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS impact FROM p JOIN f USING (t), c),
    s AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {ranked_search.K}"""


ORACLE_SQL: dict[str, str] = {"op3_url_filter": _op3_sql(), "op4_decontaminate": _op4_sql(), "op10_line_templates": _op10_sql(), "op11_mix_sources": _op11_sql(), "op13_ranked_search": _op13_sql()}
