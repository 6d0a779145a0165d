"""Quality rules: base counts, then Jensen-Shannon distance to references of the language.

Two histograms describe a document: its character classes, and its share of each common
word of its language (with one cell for all other words).  The references are the mean
histograms of all long enough documents of a language, learned in a first pass as exact
integer sums; the second pass compares each document with the reference of its ``lang``.

Defined results
* null text: an empty text (no words, ``base_failed``, not kept);
* null ``lang``: no reference, so only the base rules decide;
* the 4096 languages with most documents, those with a word list first, have references of
  their own; all others share one of character classes, learned from their documents together
  (this bounds what is sent to the workers);
* texts shorter than the guards: no distance (null), only the base rules decide;
* empty table: empty result.  Repeated rows: each is judged.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import short_batches, text_bytes, written

# Common function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it was for on are as with be by at this or an from not but he she they we you his her".split(),
    "fr": "le la les de des du et un une en est que qui dans pour par sur au aux ce pas ne se il elle avec plus son sa ou".split(),
    "de": "der die das und in zu den von mit ist des auf für im dem nicht ein eine als auch es an sich er sie aus bei nach wir um".split(),
    "es": "el la los las de del y en que un una es se por con para no su al lo como más o pero sus le ya este ha si".split(),
}
# The characters of each class, by byte; the other classes are ranges.
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"-()"
SPACE = b" \t\n\r\x0b\x0c"

CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "other_ascii", "latin", "wide")
#: Guards of a comparison: UTF-8 bytes and words of a text.
MIN_CHARS, MIN_WORDS = 200, 50
# The sum of both distances, or the class distance where the language has no word list.
MAX_DISTANCE, MAX_CLASS_DISTANCE = 0.45, 0.25
SCALE = 1 << 30
MOST_LANGUAGES = 4096


def _class_table() -> np.ndarray:
    """The class of each byte; UTF-8 continuation bytes get the class past the last, which is dropped."""
    table = np.full(256, CLASSES.index("other_ascii"), dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    for chars, name in ((SPACE, "space"), (b"\n", "line"), (PUNCTUATION, "stop"), (SYMBOLS, "symbol")):
        table[list(chars)] = CLASSES.index(name)
    table[0x80:0xC0] = len(CLASSES)
    table[0xC0:0xCA] = CLASSES.index("latin")
    table[0xCA:] = CLASSES.index("wide")
    return table


_TABLE = _class_table()


_ANY = frozenset(w.encode() for words in COMMON_WORDS.values() for w in words)
#: A common word with this many bytes of punctuation around it is none.
_LONGEST = 32


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (square root of the divergence to base 2), 0 to 1."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d / 2, 0.0)))


class _Batch:
    """Word numbers of the texts of a batch, shared by all counts."""

    def __init__(self, texts: list[bytes]) -> None:
        known: dict[bytes, int] = {}
        self.ids = [np.array([known.setdefault(w, len(known)) for w in t.split()], dtype=np.int64) for t in texts]
        self.known = known
        # Most words are common in no language; the few that are, found once for all languages.
        self.hits = [(i, f) for i, w in enumerate(known) if len(w) <= _LONGEST and (f := w.lower().strip(PUNCTUATION)) in _ANY]
        self.common: dict[str, np.ndarray] = {}

    def common_cells(self, lang: str) -> np.ndarray:
        """For each word number the cell of the common word, or the last cell."""
        if lang not in self.common:
            cells = {w.encode(): i for i, w in enumerate(COMMON_WORDS[lang])}
            table = self.common[lang] = np.full(len(self.known), len(cells), dtype=np.int64)
            for i, f in self.hits:
                table[i] = cells.get(f, len(cells))
        return self.common[lang]


def _histograms(batch: _Batch, text: bytes, ids: np.ndarray, lang: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    classes = np.bincount(_TABLE[np.frombuffer(text, dtype=np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    words = None
    if lang in COMMON_WORDS:
        words = np.bincount(batch.common_cells(lang)[ids], minlength=len(COMMON_WORDS[lang]) + 1)
    return classes, words


def repeat_words(ids: np.ndarray, size: int) -> int:
    """Words inside three-word windows that occur twice or more, the first time included."""
    if len(ids) < 4:
        return 0
    if size < 1 << 21:
        codes = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pair = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1].astype(np.int64)
        codes = pair * size + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    again = np.zeros(len(codes), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        hit[shift : shift + len(codes)] |= again
    return int(hit.sum())


def base_counts(text: bytes, ids: np.ndarray, size: int) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    bare = text.translate(None, SPACE)
    word_chars = len(bare.decode("utf-8", "replace"))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return word_chars, n_symbols, len(lines) - len(set(lines)), repeat_words(ids, size)


def learn_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str | None, dict[str, np.ndarray]]:
    """Mean histograms by language over all documents that reach the guards; those of the rest under None."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], np.ndarray] = {}
        for rb in batches:
            texts = text_bytes(rb, "text")
            batch = _Batch(texts)
            for text, ids, lang in zip(texts, batch.ids, rb.column("lang").to_pylist(), strict=True):
                if lang is None or len(ids) < MIN_WORDS or len(text) < MIN_CHARS:
                    continue
                classes, words = _histograms(batch, text, ids, lang)
                for kind, counts in (("class", classes), ("word", words)):
                    if counts is not None:
                        share = np.append(np.floor(counts / counts.sum() * SCALE), 1).astype(np.int64)
                        totals[lang, kind] = totals.get((lang, kind), 0) + share
        rows = [(lang, kind, i, int(v)) for (lang, kind), t in totals.items() for i, v in enumerate(t)]
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([r[0] for r in rows], pa.string()), "kind": pa.array([r[1] for r in rows], pa.string()), "cell": pa.array([r[2] for r in rows], pa.int32()), "total": pa.array([r[3] for r in rows], pa.int64())}
        )

    short_batches(docs.sparkSession)
    # Written, because it is read three times below and each time would be a pass over all texts.
    cells = written(
        docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .mapInArrow(sums, "lang string, kind string, cell int, total long")
        .groupBy("lang", "kind", "cell")
        .agg(F.sum("total").alias("total")),
        "references",
    )
    counts = cells.filter((F.col("kind") == "class") & (F.col("cell") == len(CLASSES))).select("lang", F.col("total").alias("n"))
    most = counts.orderBy(F.col("lang").isin(list(COMMON_WORDS)).desc(), F.col("n").desc(), "lang").limit(MOST_LANGUAGES).select("lang", F.lit(True).alias("own"))
    named = cells.join(most, "lang", "left").withColumn("lang", F.when(F.col("own"), F.col("lang"))).filter("own or kind = 'class'")
    usual = named.groupBy("lang", "kind", "cell").agg(F.sum("total").alias("total"))
    out: dict[str | None, dict[str, np.ndarray]] = {}
    for r in usual.orderBy("lang", "kind", "cell").collect():
        kinds = out.setdefault(r.lang, {})
        kinds[r.kind] = np.append(kinds.get(r.kind, np.empty(0)), r.total)
    return {lang: {kind: v[:-1] / SCALE for kind, v in kinds.items()} for lang, kinds in out.items()}


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_distance: float = MAX_DISTANCE,
    max_class_distance: float = MAX_CLASS_DISTANCE,
) -> DataFrame:
    """All columns of ``docs`` but those that this result names, then the counts and the verdict ``kept``."""
    references = learn_references(docs, text_col, lang_col)
    names = [x.split()[0] for x in RESULT.split(", ")]
    rest = docs.drop(*names)
    schema = rest.schema.simpleString()[7:-1] if not rest.columns else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)

    def verdicts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts, rows = text_bytes(rb, text_col), []
            batch = _Batch(texts)
            for text, ids, lang in zip(texts, batch.ids, rb.column(lang_col).cast(pa.string()).to_pylist(), strict=True):
                counts = base_counts(text, ids, len(batch.known))
                failed = len(ids) < 50 or 100 * counts[3] > 50 * len(ids)
                near: dict[str, float | None] = {"class": None, "word": None}
                known = references.get(lang, references.get(None, {})) if lang is not None else {}
                if known and len(text) >= MIN_CHARS and len(ids) >= MIN_WORDS:
                    for kind, own in zip(near, _histograms(batch, text, ids, lang), strict=True):
                        if own is not None and kind in known:
                            near[kind] = round(js_distance(own, known[kind]), 9)
                if near["word"] is None:
                    far = (near["class"] or 0) > max_class_distance
                else:
                    far = (near["class"] or 0) + near["word"] > max_distance
                rows.append((len(ids), *counts, failed, near["class"], near["word"], not failed and not far))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*rb.columns, *new], names=[*rb.schema.names, *names])

    return rest.mapInArrow(verdicts, f"{schema}, {RESULT}")
