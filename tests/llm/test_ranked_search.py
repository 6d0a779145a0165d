"""Ranked search against a plain version that scores every document for every item."""

import collections
import math
import random
import re

import pytest

from sparkloom.llm import ranked_search
from tests.llm.test_text_operators import fixture_rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, items, k):
    bags = [(i, plain_terms(t)) for i, t in docs]
    n_docs, words = sum(bool(t) for _, t in bags), sum(len(t) for _, t in bags)
    df = collections.Counter(t for _, bag in bags for t in set(bag))
    out = []
    for item, text in items:
        asked, found = collections.Counter(plain_terms(text)), []
        for i, bag in bags:
            tf, score = collections.Counter(bag), 0
            for t, times in asked.items():
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * len(bag) * n_docs) // words
                    score += times * w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(600)] + ["Zwölf", "x1", "ÄB", "ab", "AB"]
    docs = [r[:2] for r in fixture_rows()]
    docs += [(2000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(3000 + i, "copy of one, the same w1 text") for i in range(40)] + [(None, "w1 w2 w3 alone"), (2000, "w7-w8_w9 same id")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "?!"), (93, "nowhere"), (94, "w1 W1 w1 the copy"), (94, "alpha beta"), (None, "gamma the of"), (95, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("k", "block_terms"), [(10, 1 << 18), (10, 40), (1, 150), (400, 1 << 18)])
def test_search_equals_plain_version(spark, k, block_terms):
    docs, items = search_rows()
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, n long, doc long, term string").repartition(4)
    q = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id long, text string, score double")
    got = ranked_search.search(d, q, k=k, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_search(docs, items, k)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and len(want) > 20


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "b c")], "item_id string, text string")
    assert [tuple(r) for r in ranked_search.search(d, q).collect()] == plain_search([(1, "a b")], [("i", "b c")], 10)
    more = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d")], "doc_id long, text string")
    assert [r.doc_id for r in ranked_search.search(more, q).orderBy("rank").collect()] == [r[2] for r in plain_search([(1, "a b"), (2, "c"), (3, "d")], [("i", "b c")], 10)]
    for docs, items in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0)), (d, q.filter("false"))):
        assert ranked_search.search(docs, items).count() == 0


def test_thresholds_prune_terms(spark):
    """The index has no entry for terms by which no document gets to the threshold, and keeps those that may."""
    import numpy as np

    from sparkloom.llm.shared import map_arrays, scratch

    rows = spark.createDataFrame([(0, 7, 0, 2, 10, 35), (0, 7, 1, 1, 14, 35), (0, 7, 2, 1, 30, 35), (0, 8, 2, 1, 30, 0)], "block int, item long, t int, times long, most long, low long")
    folder = scratch(spark, "index")
    ranked_search.put_index(rows, folder).count()
    items, low, rest, first, t, times, starts, of_term, count = (a.view(np.int64).tolist() for a in map_arrays(f"{folder}/0.bin"))
    assert items == [7, 8] and low == [35, 0] and rest == [34, 0]  # 14 and 2 * 10 stay under 35; only term 2 is essential for item 7
    assert [of_term[starts[2] : starts[3]], starts[:3]] == [[0, 1], [0, 0, 0]] and first == [0, 3, 4]


def test_lookup_checks_bytes(spark):
    assert ranked_search.terms("Ab-c_É1 \x7f".encode()) == ["ab".encode(), b"c", "É1".encode()]
