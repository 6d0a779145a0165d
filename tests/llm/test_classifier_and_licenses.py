"""Weak labels on a task with known classes; license scan against planted notices."""

import itertools
import math
import random

import numpy as np
import pytest

from sparkloom.llm import license_scan, weak_labels


def _texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(rng.choice(["the", "of", "and"]) if j % 4 == 0 else word() for j in range(12)).capitalize() + "."
    good = lambda: " ".join(sentence() for _ in range(12))
    bad = [lambda: " ".join(word() + "%%%" for _ in range(120)), lambda: " ".join([word()] * 150), lambda: " | ".join(word() for _ in range(120)), lambda: " ".join(word().upper() + "!!" for _ in range(120))]
    return [(i, good() if i % 5 else bad[i // 5 % 4](), i % 5 > 0) for i in range(600)]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t, _ in _texts()], "doc_id long, text string, votes string").cache()


def test_classifier_finds_junk_without_labels(labelled):
    truth = {i: good for i, _, good in _texts()}
    out = {r.doc_id: r for r in weak_labels.classify(labelled).collect()}
    assert np.mean([out[i].kept == truth[i] for i in truth]) > 0.97
    assert min(np.mean([out[i].kept for i in truth if truth[i]]), np.mean([not out[i].kept for i in truth if not truth[i]])) > 0.9


def test_held_out_accuracy_of_the_scorer(labelled):
    truth = {i: good for i, _, good in _texts()}
    model = weak_labels.train(labelled.filter("doc_id < 400"), sample_rows=150)
    features, right = weak_labels.Features(), []
    for i, t, _ in _texts()[400:]:
        at, value = features.of(t.encode().split())
        right.append((model.weights[at] @ value + model.bias > 0) == truth[i])
    assert np.mean(right) > 0.9


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    accuracy = np.array([0.9, 0.8, 0.7, 0.85])
    votes = np.where(rng.random((20000, 4)) < accuracy, truth[:, None], ~truth[:, None]) * 2
    votes[rng.random((20000, 4)) < 0.3] = 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.fit_votes(patterns, counts.astype(float), 500)
    assert abs(model.prior - 0.7) < 0.05
    assert np.abs(model.accuracy() - accuracy).max() < 0.06


def test_classifier_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (2, "y " * 50000)], "doc_id long, text string")
    assert len(weak_labels.classify(df).collect()) == 4
    assert weak_labels.train(df.filter("false")) is None
    assert weak_labels.classify(df.filter("false")).collect() == []


def test_sample_of_one_text_or_one_id(spark):
    one = spark.range(0, 3000, 1, 4).selectExpr("7L as doc_id", "'the one text of all rows, and of the table.' as text")
    assert {r.kept for r in weak_labels.classify(one, sample_rows=100).collect()} == {True}
    texts = spark.createDataFrame([(7, t) for _, t, _ in _texts()], "doc_id long, text string")
    assert weak_labels.train(texts, sample_rows=40).weights.any()


def test_sample_is_bounded_by_entries(spark, monkeypatch):
    monkeypatch.setattr(weak_labels, "SAMPLE_ENTRIES", 5000)
    fitted = []
    real = weak_labels.fit_scorer
    monkeypatch.setattr(weak_labels, "fit_scorer", lambda rows, labels: fitted.append((len(rows), sum(len(r[0]) for r in rows))) or real(rows, labels))
    weak_labels.train(spark.createDataFrame([(i, t) for i, t, _ in _texts()], "doc_id long, text string"))
    assert 0 < fitted[0][0] < 600 and fitted[0][1] <= 5000


def _plain_em(rows, rounds):
    """The estimates for votes one by one, from the same start, in plain Python."""
    n, k = len(rows), len(rows[0])
    rare = [[math.log((2 + sum(r[j] in (0, 2) for r in rows)) / (1 + sum(r[j] == v for r in rows))) for v in (0, 2)] for j in range(k)]
    balance = [sum(rare[j][1] * (r[j] == 2) - rare[j][0] * (r[j] == 0) for j in range(k)) for r in rows]
    good = [1 / (1 + math.exp(-max(-4, min(4, b)))) for b in balance]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (n + 2)
        rate = {}
        for j in range(k):
            for cls in (0, 1):
                w = {v: 1 + sum((g if cls else 1 - g) for r, g in zip(rows, good) if r[j] == v) for v in (0, 2)}
                for v in (0, 2):
                    rate[j, cls, v] = w[v] / (w[0] + w[2])
        new = []
        for r in rows:
            p = [(1 - prior), prior]
            for j in range(k):
                for cls in (0, 1):
                    p[cls] *= rate[j, cls, r[j]] if r[j] != 1 else 1
            new.append(p[1] / (p[0] + p[1]))
        good = new
    return good


def test_posteriors_equal_plain_estimation(spark, labelled):
    rows = [[int(c) for c in weak_labels.votes(t.encode(), t.encode().split())] for _, t, _ in _texts()]
    patterns, where, counts = np.unique(np.array(rows), axis=0, return_inverse=True, return_counts=True)
    model = weak_labels.fit_votes(patterns, counts.astype(float), 7)
    assert np.abs(model.posterior(patterns)[where] - np.array(_plain_em(rows, 7))).max() < 1e-9
    out = {r.doc_id: r for r in weak_labels.classify(labelled).collect()}
    assert all(out[i].votes == "".join(map(str, rows[i])) for i in range(len(rows)))


def test_scorer_is_a_logistic_model_of_the_posteriors():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(50, 5, replace=False)), rng.random(5)) for _ in range(80)]
    labels = rng.random(80)
    w, bias = weak_labels.fit_scorer(rows, labels)
    loss = lambda w, b: -np.mean([y * np.log(p) + (1 - y) * np.log(1 - p) for (at, v), y in zip(rows, labels) for p in [1 / (1 + np.exp(-(w[at] @ v + b)))]])
    flat = loss(np.zeros_like(w), float(np.log(labels.mean() / (1 - labels.mean()))))
    assert loss(w, bias) < flat
    for at in range(0, 50, 7):  # no small step along a weight helps much
        step = np.zeros_like(w)
        step[at] = 0.05
        assert loss(w + step, bias) > loss(w, bias) - 2e-3 and loss(w - step, bias) > loss(w, bias) - 2e-3


def test_licenses(spark):
    rows = [
        (1, "some words\nReleased under the MIT License.\nmore words"),
        (2, "Licensed under CC BY-NC 4.0.\n\nAll rights reserved."),
        (3, "A license to talk about many things, none of them a notice."),
        (4, None),
        (5, ""),
        (6, "x " * 60000 + "\nThis work is licensed under the GNU General Public License,\nversion 3.\n" + license_scan.TEMPLATES["MIT-text"]),
        (7, "Licensed under the Apache Licence, Version 2.0."),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_blocks string")
    got = {r.doc_id: {f.license: f.n_differences for f in r.found} for r in license_scan.scan(df).collect()}
    assert got[1] == {"MIT": 0}
    assert got[2] == {"CC-BY-NC-4.0": 0, "all-rights-reserved": 0}
    assert got[3] == got[4] == got[5] == {}
    assert got[6] == {"GPL-3.0": 0, "MIT-text": 0}
    assert license_scan.scan(df.filter("false")).collect() == []


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_each_template_is_its_own_best(name):
    found = license_scan.scan_block(license_scan.TEMPLATES[name], license_scan.TEMPLATES)
    assert (found[0][0], found[0][2]) == (name, 0)


def test_saving_ranks_the_right_template_first():
    ranked = license_scan.savings(license_scan.TEMPLATES["GPL-3.0-header"].replace("program", "library"), license_scan.TEMPLATES)
    assert ranked[0][0] == "GPL-3.0-header" and ranked[0][1] > 0.5


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_notice_inside_a_long_line(name):
    rng = random.Random(8)
    some = lambda n: " ".join("".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 9))) if j % 3 else rng.choice(["the", "of", "and", "to", "this", "under", "in"]) for j in range(n))
    line = some(400) + " " + license_scan.TEMPLATES[name] + " " + some(400) + " licensed"
    assert [(a, d) for a, _, d in license_scan.scan_block(line, license_scan.TEMPLATES)] == [(name, 0)]
    twice = license_scan.scan_block(f"{line} {line}", license_scan.TEMPLATES)
    assert [(a, d) for a, _, d in twice] == [(name, 0)] * 2


def test_notice_with_few_words_changed_inside_a_long_line():
    words = license_scan.TEMPLATES["MIT-text"].split()
    del words[5], words[12]
    line = "the license of this and the copy to any person " * 30 + " ".join(words) + " and other words of the text" * 30
    assert [(a, d) for a, _, d in license_scan.scan_block(line, license_scan.TEMPLATES)] == [("MIT-text", 2)]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _plain_fits(block, template):
    """All windows, each by a table of common subsequences; then the best that do not overlap."""
    n, most = len(template), max(1, len(template) // 5)
    found = []
    for i in range(len(block)):
        ends = []
        for start in range(max(0, i + 1 - n - most), i + 1):
            same = _common(block[start : i + 1], template)
            differ = n + i + 1 - start - 2 * same
            if same >= 0.9 * n - 1e-9 and differ <= most:
                ends.append((-same, differ, -start, i + 1))
        if ends:
            same, differ, start, past = min(ends)
            found.append((same, differ, -start, past))
    out, taken = [], set()
    for same, differ, start, past in sorted(found):
        if taken.isdisjoint(range(start, past)):
            taken.update(range(start, past))
            out.append((-same, differ, start, past))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_equal_brute_force(seed):
    rng = random.Random(seed)
    hits = 0
    for _ in range(60):
        template = [rng.choice("abcdefghijkl") for _ in range(rng.choice([2, 5, 10, 20, 25]))]
        block = []
        for _ in range(rng.randint(1, 4)):
            block += [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 15))]
            copy = list(template)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(copy) or 1)
                copy[k : k + rng.randint(0, 1)] = rng.choice([[], ["z"]])
            block += copy
        want = _plain_fits(block, template)
        hits += len(want)
        assert license_scan.fits(block, template) == want
    assert hits > 60


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_a_template_has_triggers_to_spare(name):
    words = license_scan.words_of(license_scan.TEMPLATES[name])
    marks = sum(any(t in w for t in license_scan.TRIGGERS) for w in words)
    assert marks >= 2 or marks and len(words) < 10


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_wrapped_notice_in_a_comment(spark, name):
    rng = random.Random(6)
    words = license_scan.TEMPLATES[name].split()
    lines = [" * " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    text = "/*\n * Copyright (c) 2001 Some One\n *\n" + "\n".join(lines) + "\n */\n" + "\n".join("int " + "".join(rng.choice("xyzw") for _ in range(9)) + ";" for _ in range(400))
    found = [x[:3] for b in license_scan.blocks(text, license_scan.reach_of(license_scan.TEMPLATES)) for x in license_scan.scan_words(b, license_scan.TEMPLATES)]
    assert [(a, d) for a, _, d in found] == [(name, 0)]


def test_wording_of_the_differences(spark):
    text = license_scan.TEMPLATES["MIT-whole-text"].replace("free of charge", "for a fee").replace("merge, ", "")
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
    assert [(x.license, x.n_differences) for x in r] == [("MIT-whole-text", 7)]
    assert (r[0].missing, r[0].added) == (["free", "of", "charge", "merge"], ["for", "a", "fee"])


def test_many_short_notices_and_shuffled_words():
    reach = license_scan.reach_of(license_scan.TEMPLATES)
    block = license_scan.blocks("All rights reserved.\n" * 20000, reach)
    assert len(block) == 1 and len(license_scan.scan_words(block[0], license_scan.TEMPLATES)) == 20000
    words = license_scan.words_of(license_scan.TEMPLATES["BSD-3-Clause-text"]) * 200
    random.Random(2).shuffle(words)
    assert license_scan.scan_words(words, license_scan.TEMPLATES) == []


def test_the_largest_saving_wins(monkeypatch):
    """Two templates hold in windows that meet: the one with more words, and the one that saves more."""
    words = "a of to in it is on at by as".split()
    long_words = ["licensedistributorship", "permissionlessness", "copyrightability", "warrantableness", "redistributability", "publicationsystem", "reservedlyspoken"]
    short, rare = " ".join(words + long_words[:2]), " ".join(long_words)
    templates = {"short": short, "rare": rare}
    block = words + long_words
    assert [x[0] for x in license_scan.scan_words(block, templates)] == ["rare"]
    by_name = lambda b, t: sorted((n, 0.1) for n in t)
    monkeypatch.setattr(license_scan, "savings", by_name)
    assert [x[0] for x in license_scan.scan_words(block, templates)] == ["short"]


def test_scan_equals_search_of_whole_texts(spark):
    """Notices in prose, changed and not, and words of notices without one: what all windows of the whole text hold."""
    rng = random.Random(11)
    prose = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "en", "ost", "licen", "il")]
    rows = []
    for i in range(60):
        parts = [[rng.choice(prose) for _ in range(rng.randint(0, 200))] for _ in range(3)]
        names = rng.sample(sorted(license_scan.TEMPLATES), rng.randint(0, 2))
        notices = []
        for name in names:
            w = license_scan.TEMPLATES[name].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = rng.choice(prose)
            notices.append(w)
        text = [x for p, n in itertools.zip_longest(parts, notices, fillvalue=[]) for x in p + n]
        rows.append((i, " ".join(text)))
    found = {r.doc_id: {f.license for f in r.found} for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    some = 0
    for i, text in rows:
        words = license_scan.words_of(text)
        held = {n: license_scan.fits(words, license_scan.words_of(t)) for n, t in license_scan.TEMPLATES.items()}
        held = {n: own for n, own in held.items() if own}
        some += len(held)
        assert found[i] <= set(held)
        for name, own in held.items():  # found, or its windows belong to what was
            taken = [(s, e) for n in found[i] for _, _, s, e in held[n]]
            assert name in found[i] or all(any(s < past and start < e for s, e in taken) for _, _, start, past in own), (i, name)
    assert some > 40
