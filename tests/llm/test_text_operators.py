"""The text operators against plain brute-force versions on a small hard fixture."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql.functions import lit as F_lit
from pyspark.sql.functions import xxhash64 as F_hash

from sparkloom.llm import bpe, decontaminate, kneser_ney, line_templates, quality_rules, rindex, simhash, url_filter
from sparkloom.llm.queries import ranks_and_pattern

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, spans string"
SPACE = "[^\x20\x09-\x0d]+"


def fixture_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "deltaé", "eps", "the", "of", "and", "zeta9", "η", "kappa", "Lambda", "mu", "nu"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 30, 60, 80, 120, 200)]
    texts = [*base, "", None, " ", "\n\n", "x", "a b", "one two three", "é" * 70, "aaaa" * 60, "aaaa" * 61, "ab" * 100]
    for t in base:
        texts += [t, t + " tail", "head " + t, t[: len(t) // 2] + "!" + t[len(t) // 2 :]]
    texts += ["line one of all\nthe 12 lines\n" + b for b in base] + [(base[3] + "\n") * 40]
    rows = [(3 * i + 1 if i % 7 else -i, t, rng.choice(["en", "fr", None, "xx"]), "s", 0, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[3], (rows[4][0], "same id, other text of some length and more words to be over fifty bytes long", "en", "s", 0, None, None, None), (None, base[4], "en", "s", 0, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def order_key(i):
    return (i is None, i or 0)


def brute_repeats(rows, length):
    seen = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w not in seen or order_key(i) < order_key(seen[w]):
                seen[w] = i
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if order_key(seen[b[s : s + length]]) < order_key(i):
                hit[s : s + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((i, len(b), len(re.findall(b"\1+", bytes(hit))), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "anchor", "shard_bytes"), [(50, 20, 10**7), (50, 20, 900), (24, 8, 2000)])
def test_repeats_equal_brute_force(docs, length, anchor, shard_bytes):
    out = rindex.remove_repeats(docs, length=length, anchor=anchor, shard_bytes=shard_bytes)
    got = sorted(((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in out.collect()), key=repr)
    assert got == brute_repeats(fixture_rows(), length)


def test_repeats_with_ids_of_other_types(docs):
    by_text = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    rows = [(None if i is None else str(i), t) for i, t, *_ in fixture_rows()]
    order = {i: k for k, i in enumerate(sorted({i for i, _ in rows if i is not None}))}
    want = {(n, b, s, k) for n, b, s, k in brute_repeats([(order.get(i), t) for i, t in rows], 50)}
    got = {(order.get(r.doc_id), r.n_bytes, len(r.spans), bytes(r.kept)) for r in rindex.remove_repeats(by_text).collect()}
    assert got == want and len(want) > 20
    assert len(rindex.remove_repeats(by_text).collect()) == len(rows)


def test_maps_are_let_go(tmp_path):
    from sparkloom.llm.shared import MappedFolder, put_arrays

    for i in range(40):
        put_arrays(f"file://{tmp_path}/{i}.bin", [np.arange(i + 1, dtype="<u8")])
    folder = MappedFolder(f"file://{tmp_path}", most=5)
    for i in [*range(40), 3, 39, 41]:
        found = folder.get(str(i))
        assert (found is None) if i > 39 else (found[0].tolist() == list(range(i + 1)))
        assert len(folder.files) <= 5
    with open("/proc/self/maps") as f:
        assert sum(str(tmp_path) in line for line in f) <= 6


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from sparkloom.llm import shared

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(cluster)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "/some/folder/"), sparkContext=spark.sparkContext)
    assert shared.shared_dir(named) == "file:/some/folder"


def test_repeats_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcdef") for _ in range(5000))
    whole = rindex.anchors([text, text[:49], text[10:400]])
    monkeypatch.setattr(rindex, "PIECE", 300)
    parts = rindex.anchors([text, text[:49], text[10:400]])
    assert {tuple(map(int, r)) for r in zip(*whole)} == {tuple(map(int, r)) for r in zip(*parts)}


def test_repeated_windows_of_many_documents_with_one_passage():
    rng = random.Random(4)
    some = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passages = [some(n) for n in (60, 75, 90, 110, 140)]
    texts = []
    for _ in range(120):
        texts.append(b"".join(rng.choice(b"xyz").to_bytes(1, "little") * rng.randint(0, 2) + some(rng.randint(0, 3)) + p[rng.randint(0, 6) :] for p in rng.sample(passages, 3)))
    d, at, _, _ = rindex.anchors(texts)
    contexts = [texts[i][max(0, p - 30) : p + 50] for i, p in zip(d.tolist(), at.tolist(), strict=True)]
    row, first, past = rindex.repeated_windows(contexts, np.minimum(at, 30), d.astype("<u8"))
    start = np.maximum(at - 30, 0)[row]
    got = {(i, a) for i, a in zip(d[row].tolist(), (start + first).tolist(), strict=True)}
    # Contexts equal to a smaller document's are settled before the index.
    owner = {}
    for i, p, c in zip(d.tolist(), at.tolist(), contexts, strict=True):
        owner.setdefault((min(p, 30), c), i)
    got |= {(i, max(0, p - 30) + k) for i, p, c in zip(d.tolist(), at.tolist(), contexts, strict=True) if owner[min(p, 30), c] < i for k in range(len(c) - 49)}
    least = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            least.setdefault(t[k : k + 50], i)
    want = {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 49) if least[t[k : k + 50]] < i}
    assert len(want) > 1000 and got == want


@pytest.mark.parametrize("longest", [None, 62])
def test_index_matching_statistics_of_foreign_queries(longest):
    rng = random.Random(2)
    text = "".join(rng.choice("abc") for _ in range(400)) * 2
    codes = np.array([ord(c) - 96 for c in text] + [0], dtype=np.uint16)
    index = rindex.RunLengthIndex(codes, longest)
    assert index.runs < len(codes) * 0.7
    queries = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 60))) for _ in range(50)] + [text[37:99]]
    width = max(map(len, queries))
    table = np.zeros((len(queries), width), dtype=np.uint16)
    for row, q in enumerate(queries):
        table[row, width - len(q) :] = [ord(c) - 96 for c in q]
    length, place = index.matching_statistics(table, np.array([len(q) for q in queries]))
    for row, q in enumerate(queries):
        for i in range(len(q)):
            want = max(n for n in range(len(q) - i + 1) if q[i : i + n] in text)
            at = width - len(q) + i
            assert length[row, at] == want
            if want:
                assert text[place[row, at] : place[row, at] + want] == q[i : i + want]


# ---------------------------------------------------------------- language model


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute_kneser_ney(train, order):
    counts = [None] * (order + 1)
    counts[order] = collections.Counter()
    raw = collections.Counter()
    for t in train:
        seq = ["<s>"] * (order - 1) + tokens(t)
        raw.update(seq[order - 1 :])
        counts[order].update(tuple(seq[i - order + 1 : i + 1]) for i in range(order - 1, len(seq)))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    found = []
    for k in range(1, order + 1):
        n = collections.Counter(counts[k].values())
        found.append(kneser_ney.discounts(n[1], n[2], n[3], n[4]))

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(raw) + 1)
        follow = [c for g, c in counts[k].items() if g[:-1] == gram[:-1]]
        if not follow:
            return p(gram[1:])
        d = (0, *found[k - 1])
        c = counts[k][gram]
        back = sum(d[min(x, 3)] for x in follow)
        return (c - d[min(c, 3)]) / sum(follow) + back / sum(follow) * p(gram[1:])

    return p, raw


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_equals_brute_force(docs, order):
    rows = fixture_rows()
    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    train = [t for i, t, *_ in rows if learns(i)]
    model = kneser_ney.train(docs.filter(kneser_ney.learns(docs.doc_id)), order=order, shard_bytes=1500, chunk_tokens=300)
    p, raw = brute_kneser_ney(train, order)
    assert (model.tokens, model.distinct) == (sum(raw.values()), len(raw))
    want = []
    for i, t, *_ in rows:
        seq = ["<s>"] * (order - 1) + tokens(t)
        score = sum(math.log10(p(tuple(seq[j - order + 1 : j + 1]))) for j in range(order - 1, len(seq)))
        base = sum(math.log10((raw[w] + 1) / (sum(raw.values()) + len(raw) + 1)) for w in tokens(t))
        want.append((str(i), len(tokens(t)), sum(raw[w] > 0 for w in tokens(t)), round(base, 6), round(score, 6)))
    got = [(str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in kneser_ney.score(docs, model).collect()]
    assert sorted(got) == sorted(want)


def test_kneser_ney_without_training(spark, docs):
    model = kneser_ney.train(docs.filter("false"))
    assert {round(r.score / r.n_tokens, 9) for r in kneser_ney.score(docs, model).collect()} == {0.0}


# ---------------------------------------------------------------- near duplicates


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("radius", "part"), [(3, 4096), (3, 3), (5, 4096)])
def test_simhash_components_equal_brute_force(docs, radius, part, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (radius, part))
    monkeypatch.setattr(simhash, "PART_ROWS", part)
    rows = fixture_rows()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = sorted(((r[0], fps[i] - (fps[i] >> 63 << 64), least.get(root(i))) for i, r in enumerate(rows)), key=repr)
    assert by_row(simhash.near_duplicates(docs, radius=radius), "doc_id", "fp", "component_id") == want


@pytest.mark.parametrize("radius", [2, 3, 6])
def test_bit_sliced_groups(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fp[100:200] = fp[7] ^ (np.uint64(1) << rng.integers(0, 60, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, 100).astype(np.uint64))
    bucket = np.sort(rng.integers(0, 5, 300))
    got = simhash.bucket_groups(fp, bucket, radius)
    label = np.arange(300)
    for i in range(300):
        for j in range(300):
            if bucket[i] == bucket[j] and int(fp[i] ^ fp[j]).bit_count() <= radius:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    assert (got == label).all()


def brute_similar(rows, shingle=5, similarity=0.8):
    """The smallest id reachable by pairs of texts whose sets of word shingles have that Jaccard index."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9 or rows[i][0] == rows[j][0]:
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def similar_rows():
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    texts = []
    for _ in range(80):
        base = some(rng.randint(3, 200))
        texts += [edited(base, rng.randint(0, max(1, len(base.split()) // 20))) for _ in range(rng.choice([1, 1, 2, 3, 8]))]
    base, passage = some(120), some(60)
    texts += [edited(base, rng.randint(0, 3)) for _ in range(150)]  # one large group
    texts += [some(rng.randint(5, 100)) + " " + passage for _ in range(120)]  # one passage in unlike texts
    texts += ["", "", None, " \n", "one", "ONE", "one two", texts[0], texts[0]]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[3], (rows[5][0], rows[40][1])]  # a repeated row, an id with two texts


@pytest.mark.parametrize("part", [4096, 48])
def test_similar_groups_equal_brute_force(spark, part):
    rows = similar_rows()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in [*rows, (None, rows[0][1])]], "doc_id long, text string, sig string, component_id string").repartition(5)
    out = simhash.similar_groups(df, part_rows=part).collect()
    assert len(out) == len(rows) and {r.doc_id: r.component_id for r in out} == brute_similar(rows)


@pytest.mark.parametrize(("texts", "hubs"), [(20, 12), (20, 0), (7, 2)])
def test_similar_groups_of_large_clusters(spark, monkeypatch, texts, hubs):
    """Clusters over the bound: candidates, hubs, and parts of what these leave apart give the same groups."""
    monkeypatch.setattr(simhash, "WHOLE_TEXTS", texts)
    monkeypatch.setattr(simhash, "HUBS", hubs)
    rows = similar_rows()
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_similar(rows)


def far_pairs(most_bits=16):
    """Pairs of similar texts whose fingerprints are far apart, and the rest that was drawn."""
    rng, far, near = random.Random(12), [], []
    while len(far) < 6:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(13, 20))]
        a, b = " ".join(words), " ".join([*words[:-1], "other"])
        x, y = (simhash.shingle_set(t.encode()) for t in (a, b))
        alike = len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
        bits = (simhash._print_of(x) ^ simhash._print_of(y)).bit_count()
        (far if alike and bits > most_bits else near)[:0] = [(a, b)]
    return far, near[:40]


@pytest.mark.parametrize("meet", [1024, 3])
def test_similar_texts_with_far_fingerprints(spark, monkeypatch, meet):
    monkeypatch.setattr(simhash, "MEET_ROWS", meet)
    far, near = far_pairs()
    hot = [(" ".join([f"h{k % 3}" for k in range(12)] + [f"v{i}"]),) for i in range(12)]  # one key of many texts
    rows = list(enumerate(t for p in [*far, *near, *hot] for t in p))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_similar(rows) and all(got[2 * k + 1] == 2 * k for k in range(len(far)))


def test_candidates_of_a_large_key_keep_it_whole(spark):
    """Keys over 53 bits beside rows without one: both parts of a large key go on to the next round under the same key."""
    fp = [1 << k for k in range(40)]
    rows = [(k + 1, f, 0, 2**62 + 1) for k, f in enumerate(fp)] + [(100 + k, k, 0, 7 * k) for k in range(200)]
    pairs, shared = simhash._candidates(spark.createDataFrame(rows, "sig long, fp long, place int, key long"), 16)
    roots = {k: k for k in range(1, 41)}
    for r in pairs.collect():
        a, b = sorted((roots[r.a], roots[r.b]))
        roots = {k: a if v == b else v for k, v in roots.items()}
    assert set(roots.values()) == {1}
    assert sorted((r.sig, r.key) for r in shared.collect()) == [(k + 1, 2**62 + 1) for k in range(40)]


def test_filters_of_pairs_lose_none():
    """Spreads never count more than the shingles that only one has; similar sets meet at some shared leading one."""
    rng = np.random.default_rng(3)
    for n in (1, 4, 20, 90, 700, 4000):
        a = np.unique(rng.integers(0, 2**64, n, dtype="<u8"))
        for share in (0.5, 0.8, 0.9, 1.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(0, 2**64, rng.integers(0, n // 8 + 2), dtype="<u8")]))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            assert simhash.unshared(simhash.spread(a), simhash.spread(b)) <= len(a) + len(b) - 2 * both
            common = np.unique(np.concatenate([a[::3], b[::5]]))
            x, y = (simhash.leading(h, common, (common % 5 + 1).astype(np.int64), 0.8) for h in (a, b))
            rows = sorted([(int(k), len(h), i, c) for c, (h, lead) in enumerate([(a, x), (b, y)]) for i, k in enumerate(lead)])
            bucket, size, place, cluster = (np.array([r[k] for r in rows], dtype="<u8" if k == 0 else np.int64) for k in range(4))
            if both >= 0.8 * (len(a) + len(b) - both):
                assert len(simhash.meeting(bucket, size, place, cluster, 0.8)[0])
    same = np.full(300, 7, dtype="<u8")
    assert simhash.spread(same).max() == 255 and simhash.unshared(simhash.spread(same), simhash.spread(same[:280])) <= 20


def test_links_across_groups_of_sets():
    rng = random.Random(2)
    base = [np.array(sorted(rng.sample(range(1000 * g, 1000 * g + 400), 60)), dtype=np.int64) for g in range(3)]
    sets = [np.unique(np.concatenate([rng.choice(base)[: rng.randint(40, 60)], np.array(rng.sample(range(9000), rng.randint(0, 6)), dtype=np.int64)])) for _ in range(90)]
    group = np.array([rng.randint(0, 4) for _ in sets])
    alike = [(i, j) for i in range(90) for j in range(i) if group[i] != group[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    found = simhash.linked_sets(sets, 0.8, group)

    def roots(edges):
        parent = list(range(90))
        for i, j in edges:
            a, b = (simhash._root(np.array(parent), x) for x in (i, j))
            parent = [min(a, b) if p in (a, b) else p for p in parent]
        return parent

    assert roots(found) == roots(alike) and {tuple(sorted(e)) for e in found} <= {tuple(sorted(e)) for e in alike} and found
    assert simhash.linked_sets([], 0.8) == []


def test_similar_groups_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.similar_groups(df).collect() == []
    one = spark.createDataFrame([(7, "only one text"), (8, None)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(one).collect()} == {7: 7, 8: 8}


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize(("window", "block"), [(10, 10**6), (4, 150)])
def test_decontamination_equals_brute_force(spark, docs, window, block):
    rows = fixture_rows()
    texts = [rows[3][1], rows[3][1], "ALPHA, beta gamma", "", None, "x", rows[5][1][:200], "the of", "zeta9 η"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    want = []
    for i, t, *_ in rows:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for k, item in enumerate(texts):
            v = word.findall(lower(item))
            n = min(window, len(v))
            wins = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1 if v else 0):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found.add(k)
        want.append((i, len(w), len(hit), sorted(found)))
    out = decontaminate.decontaminate(docs, items, window=window, block_chars=block)
    assert by_row(out, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=repr)
    clean = out.filter("n_hit > 0").select("text", "clean_text", "n_words", "n_hit").first()
    assert len(word.findall(lower(clean.clean_text))) == clean.n_words - clean.n_hit


@pytest.mark.parametrize("coverage", [0.3, 0.5, 0.9])
def test_coverage_limit_equals_brute_force(spark, coverage):
    rng = random.Random(12)
    some = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    items = [some(rng.choice([1, 2, 5, 8, 12, 30])) for _ in range(25)]
    texts = [some(rng.randint(0, 40)) + rng.choice(items)[: rng.randint(0, 30)] + ["zz"] * (k % 2) + some(5) for k in range(120)]
    want = []
    for k, w in enumerate(texts):
        hit, found = set(), set()
        for j, v in enumerate(items):
            n = min(10, max(1, math.ceil(coverage * len(v) - 1e-9)))
            wins = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)}
            wins |= {tuple(v[s : s + 10]) for s in range(len(v) - 9)}
            for n in {len(x) for x in wins}:
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) in wins:
                        hit |= set(range(s, s + n))
                        found.add(j)
        want.append((k, len(hit), sorted(found)))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(j, " ".join(v)) for j, v in enumerate(items)], "item_id long, text string")
    assert by_row(decontaminate.decontaminate(docs, table, coverage=coverage, block_chars=60), "doc_id", "n_hit", "items") == sorted(want, key=repr)


def test_decontamination_of_a_very_long_text(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    item = [word() for _ in range(60)]
    text = [word() for _ in range(200_000)]
    text[50_000:50_030], text[199_980:] = item[10:40], item[-20:]
    out = decontaminate.decontaminate(spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string"), spark.createDataFrame([("x", " ".join(item))], "item_id string, text string")).first()
    assert (out.n_words, out.n_hit, out["items"]) == (200_000, 50, ["x"]) and [tuple(s) for s in out.spans] == [(50_000, 50_030), (199_980, 200_000)]


# ---------------------------------------------------------------- BPE


def test_bpe_equals_whole_text_encoding(docs):
    enc = bpe.encoding(*ranks_and_pattern())
    want = sorted(((r[0], enc.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in fixture_rows()), key=repr)
    got = sorted(((r.doc_id, r.ids, bytes(r.bytes)) for r in bpe.encode_decode(docs, *ranks_and_pattern()).collect()), key=repr)
    assert got == want
    r = bpe.digests(bpe.encode_decode(docs.limit(1), *ranks_and_pattern())).first()
    assert len(r.ids_sha256) == len(r.decoded_sha256) == 64


def test_bpe_pieces_do_not_change_ids():
    rng = random.Random(3)
    ranks = ranks_and_pattern()
    for _ in range(200):
        text = "".join(rng.choice(["a", "é", " ", "  ", "\n", "'s", "'", "7", "!", "\t", "字", "don't"]) for _ in range(200))
        for size in (1, 7, 40):
            assert "".join(bpe.pieces(text, size)) == text
            assert bpe.encode_text(text, *ranks, size) == bpe.encode_text(text, *ranks)
    for _ in range(200):
        text = "".join(rng.choice(["a", "!", " " * 9, "\n" * 8, "\x1c" * 9, "!\x1f", "\u3000" * 3, "\xa0\x85", " \n\t" * 5]) for _ in range(40))
        assert "".join(bpe.pieces(text, 7)) == text and bpe.encode_text(text, *ranks, 7) == bpe.encode_text(text, *ranks)
    odd = bpe.encoding(*ranks).encode_ordinary("字")[:1]
    assert bpe.encoding(*ranks).decode_bytes(odd) == "字".encode()[: len(bpe.encoding(*ranks).decode_bytes(odd))]


def test_bpe_of_very_long_texts(spark):
    ranks = ranks_and_pattern()
    enc = bpe.encoding(*ranks)
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + " " * 1_500_000 + "b c", "x\u3000" + "\t" * 1_200_000 + "\n!", "^" * 1_500_000, "a" * 300_000, "some words, " * 100_000, "don't " * 40_000 + "\r\n" * 600_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in bpe.encode_decode(df, *ranks).collect():
        assert bytes(r.bytes).decode() == texts[r.doc_id]
    # Runs that the library can still encode whole: equal ids with and without a cut.
    for text in (" " * 700_000, " " * 700_000 + "x", "x" + "\n" * 700_000, "x " + "\n" * 700_000 + " y", " \t" * 300_000 + "1"):
        assert bpe.encode_text(text, *ranks) == enc.encode_ordinary(text)


# ---------------------------------------------------------------- rules and URLs


def test_quality_counts_equal_brute_force(docs):
    want = []
    for i, t, *_ in fixture_rows():
        t = t or ""
        w = re.findall(SPACE, t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {j for s in range(len(w) - 2) if grams[tuple(w[s : s + 3])] > 1 for j in range(s, s + 3)}
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    out = quality_rules.judge(docs)
    assert by_row(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not out.filter("base_failed and kept").count()


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(4)
    # Words in the shape of prose; every fifth is a function word.
    make = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(3, 9)))
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "to"]) if j % 5 == 0 else make() for j in range(150)) + "."
    junk = lambda: " ".join(make() + "%%%" for _ in range(150))
    rows = [(i, prose() if i % 10 else junk(), "en") for i in range(200)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: bool(i % 10) for i in range(200)}
    assert quality_rules.js_distance(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1)


def _plain_jsd(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return math.sqrt(max(0.0, sum(0.5 * a * math.log2(2 * a / (a + b)) for a, b in zip(p, q) if a) + sum(0.5 * b * math.log2(2 * b / (a + b)) for a, b in zip(p, q) if b)))


def _plain_histograms(text, lang):
    classes = collections.Counter()
    for c in text:
        b = c.encode()[0]
        kind = "line" if c == "\n" else "space" if c in " \t\r\x0b\x0c" else "stop" if c in ".,;:!?'\"-()" else "symbol" if c in "#*$%&|<>" else None
        kind = kind or ("lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "other_ascii" if b < 128 else "latin" if b < 0xCA else "wide")
        classes[kind] += 1
    h = [classes[k] for k in quality_rules.CLASSES]
    common = quality_rules.COMMON_WORDS.get(lang)
    if not common:
        return h, None
    words = [w.lower().strip(".,;:!?'\"-()") for w in re.findall(SPACE, text)]
    return h, [sum(w == c for w in words) for c in common] + [sum(w not in common for w in words)]


def test_quality_distances_and_verdicts_equal_brute_force(spark):
    rng = random.Random(8)
    make = lambda: "".join(rng.choice("abdeilmnorstABé9") for _ in range(rng.randint(2, 8)))
    texts = []
    for i in range(60):
        lang = ["en", "fr", "xx", None, "en"][i % 5]
        some = quality_rules.COMMON_WORDS.get(lang, ["zu", "ba"])
        junk = i % 7 == 0
        words = [make() + ("%%%" if junk else "") if junk or j % 3 else rng.choice(some) for j in range(rng.choice([20, 49, 50, 90, 200]))]
        texts.append((i, " ".join(w + rng.choice(["", "", ",", ".", "\n", " -"]) for w in words), lang))
    long_enough = lambda t: len(re.findall(SPACE, t)) >= 50 and len(t.encode()) >= 200
    sums = {}
    for _, t, lang in texts:
        if lang is None or not long_enough(t):
            continue
        for kind, h in zip(("class", "word"), _plain_histograms(t, lang)):
            if h:
                old = sums.get((lang, kind), [0.0] * len(h))
                sums[lang, kind] = [a + x / sum(h) for a, x in zip(old, h)]
    want = {}
    for i, t, lang in texts:
        found = {"class": None, "word": None}
        if lang is not None and long_enough(t):
            found |= {k: _plain_jsd(h, sums[lang, k]) for k, h in zip(found, _plain_histograms(t, lang)) if h}
        words = re.findall(SPACE, t)
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        again = {j for s in range(len(words) - 2) if grams[tuple(words[s : s + 3])] > 1 for j in range(s, s + 3)}
        base = len(words) < 50 or 100 * len(again) > 50 * len(words)
        far = (found["class"] or 0) > quality_rules.MAX_CLASS_DISTANCE if found["word"] is None else found["class"] + found["word"] > quality_rules.MAX_DISTANCE
        want[i] = (found["class"], found["word"], not base and not far)
    out = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, (a, b, kept) in want.items():
        assert out[i].kept == kept
        for x, y in ((out[i].class_distance, a), (out[i].word_distance, b)):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6)
    assert 5 < sum(w[2] for w in want.values()) < 55 and sum(w[0] is None for w in want.values()) > 5


def test_very_long_texts_equal_brute_force(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, long), (2, long[:150_000] + " other words " + long[150_200:]), (3, "x" + long[90_000:120_000]), (4, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in rindex.remove_repeats(df).collect()), key=repr)
    assert got == brute_repeats(rows, 50)
    fp = {i: brute_fingerprint(t) for i, t in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in simhash.near_duplicates(df).collect()} == fp
    model = kneser_ney.train(df, chunk_tokens=9000, shard_bytes=100_000)
    raw = collections.Counter(w for _, t in rows for w in tokens(t))
    out = {r.doc_id: r for r in kneser_ney.score(df, model).collect()}
    for i, t in rows:
        base = sum(math.log10((raw[w] + 1) / (sum(raw.values()) + len(raw) + 1)) for w in tokens(t))
        assert out[i].n_tokens == out[i].n_known == len(tokens(t)) and abs(out[i].base_score - base) < 1e-3
    judged = {r.doc_id: r for r in quality_rules.judge(df.selectExpr("*", "'en' as lang")).collect()}
    for i, t in rows:
        w = re.findall(SPACE, t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        assert judged[i].n_words == len(w) and judged[i].n_repeat_words == len({j for s in range(len(w) - 2) if grams[tuple(w[s : s + 3])] > 1 for j in range(s, s + 3)})


def test_quality_compares_documents_of_rare_languages(spark, monkeypatch):
    prose, junk = "some words of prose as they are, and more. " * 12, "#5 %%7 <9> &2 *|* $44 " * 20
    rows = spark.range(9000).selectExpr("id as doc_id", "'en' as lang").unionByName(spark.createDataFrame([(-1, "rare")], "doc_id long, lang string"))
    got = quality_rules.judge(rows.selectExpr("doc_id", f"'{prose}' as text", "lang")).filter("doc_id < 0").first()
    assert got.class_distance == 0

    # Past the languages with references of their own, one for all others.
    monkeypatch.setattr(quality_rules, "MOST_LANGUAGES", 1)
    rows = [(i, prose.replace("words", f"words {i}"), lang) for i, lang in enumerate(["en", *[f"x{k}" for k in range(30)], None])]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame([*rows, (99, junk, "x99")], "doc_id long, text string, lang string")).collect()}
    assert got[0].class_distance == 0 and got[31].class_distance is None
    assert all(0 < got[i].class_distance < 0.25 for i in range(1, 31)) and got[99].class_distance > 0.25 and not got[99].kept


def test_repeat_words_with_many_different_words():
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 8])
    assert quality_rules.repeat_words(ids, 10) == quality_rules.repeat_words(ids, 1 << 22) == 6


def test_url_filter(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no-scheme.com/en": ("", "", None, "allow"),
        "http://A.Example.COM/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "https://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "https://a.org?x=casino": ("a.org", "", None, "block"),
        "https://casinos.org/": ("casinos.org", "/", None, "allow"),
        "https://cheap.org/cheap": ("cheap.org", "/cheap", None, "allow"),
        "https://cheap.org/WIN": ("cheap.org", "/WIN", None, "block"),
        "https://spam-farm.com/casino": ("spam-farm.com", "/casino", "com/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_url_vocabulary_from_a_file(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("# weights\nstrict bad-site\nsoft one\n\nsoft two\nsoft ONE\n")
    strict, soft = url_filter.read_vocabulary(spark, f"file://{tmp_path}/terms.txt")
    assert (strict, soft) == (("bad-site",), ("one", "two"))
    rows = [(1, "https://bad-site.org/"), (2, "https://x.org/one"), (3, "https://x.org/one-TWO"), (3, "https://x.org/one-TWO"), (4, None), (5, "https://x.org/ones/two"), (6, "https://x.org/" + "one " * 50000 + "two")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted((r.page_id, r.verdict) for r in url_filter.filter_urls(df, strict=strict, soft=soft).collect())
    assert got == [(1, "block"), (2, "allow"), (3, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "block")]
    assert url_filter.filter_urls(df.filter("false"), strict=strict, soft=soft).collect() == []
    (tmp_path / "bad.txt").write_text("heavy word\n")
    with pytest.raises(ValueError, match="heavy"):
        url_filter.read_vocabulary(spark, f"file://{tmp_path}/bad.txt")


def test_line_templates(spark):
    rows = [(i, f"Posted by user {i} at noon\nown line {'abcdefgh'[i]} of text\nok", "z") for i in range(8)] + [(9, None, "z"), (10, "", "z"), (None, "Posted by user 5 at noon", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, clean_text string")
    got = {r.doc_id: (r.clean_text, r.n_lines, r.n_dropped) for r in line_templates.drop_recurring(df).collect()}
    assert got[0] == (rows[0][1], 3, 0)
    assert got[3] == ("own line d of text\nok", 3, 1)
    assert (got[9], got[10], got[None]) == ((None, 0, 0), ("", 1, 0), ("", 1, 1))
    named = [(i, f"welcome back to the site dear {n} we missed you") for i, n in enumerate(["ann", "bob", "cyd", "dee", "eve", "fay"])]
    named += [(10 + i, f"welcome back to a {n} shop where all is {n} and new") for i, n in enumerate("pqrstu")]
    out = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(spark.createDataFrame(named, "doc_id long, text string")).collect()}
    assert out == {i: int(0 < i < 10) for i, _ in named}  # one part differs; two parts differ
    plan = line_templates.drop_recurring(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("build", [
    quality_rules.judge, rindex.remove_repeats, simhash.near_duplicates, line_templates.drop_recurring,
    lambda d: decontaminate.decontaminate(d, d.selectExpr("doc_id as item_id", "text")),
    lambda d: bpe.encode_decode(d, *ranks_and_pattern()),
    lambda d: kneser_ney.score(d, kneser_ney.train(d)),
])
def test_empty_tables(docs, build):
    assert build(docs.filter("false")).collect() == []


def test_line_templates_on_long_texts_and_clashing_names(spark):
    clash = "gone long, gone_ string, row string, __row string, parts string, marked_doc string, DOC string, n_dropped string"
    rows = [(i, "\n".join(f"entry {j % 7} of the log says {'abc'[j % 3] * 3} {i if j % 2 else 'x'}" if j % 5 else f"own {i * 100000 + j:x}q".translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(30000)), i, "a", "b", "c", "d", "e", "f", "g") for i in range(8)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {clash}").repartition(4)
    out = line_templates.drop_recurring(df)
    assert out.columns == [*[c for c in df.columns if c != "n_dropped"], "clean_text", "n_lines", "n_dropped"]
    for r in out.collect():
        lines = rows[r.doc_id][1].split("\n")
        keep = lines if r.doc_id == 0 else [x for x in lines if x.startswith("own")]
        assert r.clean_text == "\n".join(keep) and (r.text, r.n_lines, r.n_dropped) == (rows[r.doc_id][1], 30000, 30000 - len(keep))
        assert (r.gone, r.gone_, r.row, r["__row"], r.parts, r.marked_doc, r.DOC) == rows[r.doc_id][2:9]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # the lines are parsed before, into a written table


def test_equal_row_keys_do_not_drop_lines_of_another_document(spark, monkeypatch):
    monkeypatch.setattr(line_templates.F, "xxhash64", lambda *c: F_hash(*c) if len(c) != 2 or "text" not in str(c[1]) else F_lit(7))
    rows = [(i, f"the same line for all of them\nown line {'abcdefgh'[i]} of text") for i in range(6)] + [(9, "one\ntwo")]
    out = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_dropped for r in out} == {0: 0, **{i: 1 for i in range(1, 6)}, 9: 0}
