"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

A term counts where no ASCII letter or digit touches it.  One strict term, or at least
``MIN_SOFT`` different soft terms, block a URL.  The vocabulary is a parameter; the fixed one
below is small, ``read_vocabulary`` reads larger ones from a file.

Defined results: a null URL or one without ``://`` has empty host and path, no rule fits, and
its text (empty for null) goes to the vocabulary.  Ties between rules cannot occur: of the
rules that fit one URL the longest wins, and two of one length cannot both fit a host and
path unless they are equal.  Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# host/path rules, the vocabulary.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
STRICT_TERMS = ("spam-farm", "cheap-pills", "porn", "xxx", "casino", "viagra", "malware", "phishing", "warez", "escort")
SOFT_TERMS = ("cheap", "pills", "spam", "free", "bonus", "win", "adult", "loan", "bet", "poker", "sale", "deal", "sex", "crack", "download", "click")
MIN_SOFT = 2

_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_url(url: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.encode().translate(_UPPER).decode(), slash + path


def fitting_rule(host: str, path: str, rules: Sequence[tuple[str, str]]) -> tuple[str, str] | None:
    """The longest rule whose host is this one or above it and whose path starts the path."""
    best = None
    for rule, verdict in rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def read_vocabulary(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a text file with one ``strict term`` or ``soft term`` a line; ``#`` starts a comment.

    Terms are lower-cased (A-Z) and different.  The list is sent to the workers, so it is for vocabularies, not for lists of hosts.
    """
    found: dict[str, dict[str, None]] = {"strict": {}, "soft": {}}
    for line in (r.value.strip() for r in spark.read.text(path).collect()):
        if not line or line.startswith("#"):
            continue
        weight, _, term = line.partition(" ")
        if weight not in found or not term.strip():
            raise ValueError(f"a line names strict or soft and a term, not {line!r}")
        found[weight][term.strip().encode().translate(_UPPER).decode()] = None
    return tuple(found["strict"]), tuple(found["soft"])


def build_automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def find_terms(url: str, automaton) -> tuple[list[str], list[str]]:
    """The different strict and soft terms with a boundary on both sides, sorted."""
    text = url.encode().translate(_UPPER).decode()
    found: tuple[set[str], set[str]] = (set(), set())
    if not len(automaton):
        return [], []
    for end, (term, weight) in automaton.iter(text):
        start = end + 1 - len(term)
        before = text[start - 1] if start else ""
        after = text[end + 1] if end + 1 < len(text) else ""
        if not any(c and c.isascii() and ord(c) in _WORD for c in (before, after)):
            found[2 - weight].add(term)
    return sorted(found[0]), sorted(found[1])


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    min_soft: int = MIN_SOFT,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the terms found."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(strict, soft)
        for rb in batches:
            rows = []
            for url in rb.column("url").to_pylist():
                host, path = split_url(url or "")
                rule = fitting_rule(host, path, rules)
                hard, light = find_terms(url or "", automaton)
                verdict = rule[1] if rule else "block" if hard or len(light) >= min_soft else "allow"
                rows.append((host, path, rule and rule[0], verdict, hard, light))
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([rb.column(id_col), *new], names=[id_col, "host", "path", "rule", "verdict", "strict_terms", "soft_terms"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(url_col).alias("url")).mapInArrow(run, f"{id_col} {kind}, host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>")
