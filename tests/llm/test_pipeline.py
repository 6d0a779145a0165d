"""The pipeline: each stage on its own input against a plain version, and the queries that have SQL."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from sparkloom.llm import quality_rules, queries
from sparkloom.llm.shared import written
from tests.llm.test_text_operators import brute_similar

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages", "labels")


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Prose with junk, near copies, shared lines and benchmark passages."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 8)))
    line = lambda n=12: " ".join(rng.choice(["the", "of", "and", "to"]) if j % 4 == 0 else word() for j in range(n)) + "."
    items = [line(20) for _ in range(5)]
    texts = ["\n".join(line() for _ in range(10)) for _ in range(60)]
    texts += [t.replace("the", "a", 1) for t in texts[:10]] + texts[:5]
    texts += [t + "\n" + items[i % 5] + "\nthe end" for i, t in enumerate(texts[20:30])]
    texts += ["\n".join(line() for _ in range(6)) + "\n" + item + "\nthe end" for item in items]  # like no other text
    texts = [t + "\nShared footer number 7 of all" if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [" ".join(word() + "%%%" for _ in range(90)) for _ in range(6)] + [None, "", "short"]
    d = str(tmp_path_factory.mktemp("world"))
    rows = [(i * 2, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_equal_plain_versions(spark, world):
    d, items = world
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    (_, quality), (_, lines), (_, near), (_, clean), (_, bpe) = corpus_pipeline.STAGES

    out = written(quality(spark, docs, d), "t")
    kept = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert out.columns == columns and set(rows_of(out)) == kept
    assert len(kept) == docs.count() - 9

    before, docs = rows_of(out), written(lines(spark, out, d), "t")
    where = {}

    def forms(line):
        w = ["<*>" if re.search("[0-9]", x) else x for x in line.split()]
        out = [(-1, tuple(w))] if len(w) >= 3 else []
        for j in range(4 if len(w) > 2 else 0):
            a, b = (2 + (len(w) - 2) * k // 4 for k in (j, j + 1))
            if b > a and len(w) - b + a >= 6:
                out.append((j, len(w), tuple(w[:a]), tuple(w[b:])))
        return out

    for i in sorted(before):
        for t in {t for x in before[i].text.split("\n") for t in forms(x)}:
            where.setdefault(t, []).append(i)
    after = rows_of(docs)
    assert docs.columns == columns and set(after) == set(before)
    for i, r in before.items():
        want = "\n".join(x for x in r.text.split("\n") if all(len(where[t]) < 5 or where[t][0] == i for t in forms(x)))
        assert (after[i].text, after[i].n_chars) == (want, len(want))
    assert sum("footer" in r.text for r in after.values()) == 1

    before, docs = after, written(near(spark, docs, d), "t")
    label = brute_similar([(i, r.text) for i, r in before.items()])
    assert len(set(label.values())) < len(label)
    assert docs.columns == columns and set(rows_of(docs)) == {i for i in label if label[i] == i}

    before, docs = rows_of(docs), written(clean(spark, docs, d), "t")
    after = rows_of(docs)
    assert docs.columns == columns and set(after) == set(before)
    assert any(items[k] in r.text for r in before.values() for k in range(5))
    for i, r in before.items():
        want = r.text
        for item in items:
            want = want.replace(item.rstrip("."), "")
        assert after[i].text == want

    last = rows_of(bpe(spark, docs, d))
    assert {i: r.text for i, r in last.items()} == {i: r.text for i, r in after.items()}
    assert all(r.n_tokens == len(r.ids) for r in last.values())


def test_run_equals_its_stages(spark, world):
    d, _ = world
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d), "t")
    ids = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    assert ids(corpus_pipeline.run(spark, d)) == ids(docs)


def test_stages_on_an_empty_table(spark, world):
    docs = spark.read.parquet(f"{world[0]}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, world[0]), "t")
    assert docs.collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = c.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    text = lambda df: sorted(tuple("null" if x is None or x != x else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and text(got) == text(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_returns_a_row_for_each_document(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    key = "page_id" if name == "op3_url_filter" else "doc_id"
    ids = [r[0] for r in got.select(key).collect()]
    all_ids = [r[0] for r in spark.read.parquet(f"{DATA}/{'pages' if key == 'page_id' else 'documents'}.parquet").select(key).collect()]
    if name == "pipeline":
        assert 0 < len(ids) == len(set(ids)) and set(ids) < set(all_ids)
    else:
        assert sorted(ids) == sorted(all_ids)
