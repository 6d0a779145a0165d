"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

Items are dealt to blocks of bounded size; one task builds the automaton of a block and puts it
in the shared folder as flat sorted arrays.  Workers map these (about 60 bytes a word of the items,
shared by the workers of a machine) and stream the documents' words, keeping the longest match
that ends at each word.  Two limits make a match a hit: it has ``window`` words or more, or it
covers the share ``coverage`` of an item or more.  The default of 1 means: all of an item, which
matters for items of fewer words than the window.  Hit spans are removed.

Defined results: null text or a text without words has no spans.  Items without words (or null)
never match.  Equal items are both reported.  Empty tables give empty results; repeated rows are
each judged; columns of ``docs`` with the names of the results are replaced, others stay.  Each
block is streamed over all documents, so time grows with the size of the items by blocks.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import map_arrays, put_arrays, scratch, short_batches, text_bytes

WINDOW, COVERAGE = 10, 1.0
#: Characters of items in one automaton; what a task that builds one holds is bounded by this.
BLOCK_CHARS = 2_000_000
#: Of so many blocks at most a worker holds the words in tables of its own (some 30 MB each); of more they are searched in the maps.
FEW_BLOCKS = 4

# Everything but 0-9, a-z and non-ASCII separates words; A-Z becomes a-z.
_NORMAL = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """States with suffix links over word numbers; built item by item."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW, coverage: float = COVERAGE) -> None:
        self.window, self.vocabulary = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names, sequences = [], []
        for name, text in items:
            if ids := [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]:
                self.names.append(name)
                sequences.append(ids)
                self._add(ids)
        #: The words in order that are a hit, for each item.
        self.least = [min(window, max(1, math.ceil(coverage * len(ids) - 1e-9))) for ids in sequences]
        self._label(sequences)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the strings of ``q`` that extend ``p`` by ``w``, cloned if ``q`` has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, ids: list[int]) -> None:
        last = 0
        for w in ids:
            if w in self.step[last]:
                last = self._split(last, w, self.step[last][w])
                continue
            new, p = self._new(self.length[last] + 1, {}, 0), last
            while p >= 0 and w not in self.step[p]:
                self.step[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w, self.step[p][w])
            last = new

    def _label(self, sequences: list[list[int]]) -> None:
        """The state of the window that ends a long match and its items; the shorter hits that end at a state."""
        window, n = self.window, len(self.length)
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        self.cut, self.short = [-1] * n, [()] * n
        for v in by_length:
            up = self.link[v]
            if self.length[v] >= window:
                self.cut[v] = v if self.length[up] < window else self.cut[up]
        self.items: dict[int, set[int]] = {}
        own: dict[int, set[tuple[int, int]]] = {}
        for k, (ids, least) in enumerate(zip(sequences, self.least, strict=True)):
            for v, size in self._matches(ids):
                if size >= window:
                    self.items.setdefault(self.cut[v], set()).add(k)
                if least < window and size >= least:
                    while self.length[self.link[v]] >= least:
                        v = self.link[v]
                    own.setdefault(v, set()).add((least, k))
        for v in by_length:
            up = self.short[self.link[v]]
            self.short[v] = up + tuple(sorted(own[v])) if v in own else up

    def _matches(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """State and length at each word of an item."""
        v = 0
        for size, w in enumerate(ids, 1):
            v = self.step[v][w]
            yield v, size

    def arrays(self) -> list[np.ndarray]:
        """The automaton as flat arrays, in the order in which ``MappedAutomaton`` takes them."""
        import xxhash

        n = len(self.length)
        words = sorted((xxhash.xxh64_intdigest(w), w, i) for w, i in self.vocabulary.items())
        root = np.zeros(len(words), dtype="<u4")
        for w, v in self.step[0].items():
            root[w] = v
        first = [next(iter(s.items()), (len(words), 0)) if v else (len(words), 0) for v, s in enumerate(self.step)]
        more = sorted((v << 32 | w, q) for v, s in enumerate(self.step) if v for w, q in s.items() if w != first[v][0])
        known: dict[tuple, int] = {}
        short_of = [known.setdefault(x, len(known)) for x in self.short]
        cuts = sorted(self.items)
        of = [sorted(self.items[v]) for v in cuts]
        number = lambda x, kind="<u4": np.array(list(x), dtype=kind)
        edges = lambda lists: np.cumsum([0, *map(len, lists)]).astype("<u4")
        return [
            number([self.window, min([self.window, *self.least])]),
            number((h for h, _, _ in words), "<u8"), number(i for _, _, i in words), edges([w for _, w, _ in words]), np.frombuffer(b"".join(w for _, w, _ in words), dtype="<u1"),
            number([0, *self.link[1:]]), number(self.length), root,
            number(w for w, _ in first), number(q for _, q in first), number((len(s) > 1 for s in self.step), "<u1"), number((k for k, _ in more), "<u8"), number(q for _, q in more),
            number(np.searchsorted(cuts, c) if c >= 0 else len(cuts) for c in self.cut), edges(of), number(k for o in of for k in o),
            number(short_of[:n]), edges(known), number(m for x in known for m, _ in x), number(k for x in known for _, k in x),
            np.frombuffer(pickle.dumps(self.names), dtype="<u1"),
        ]


class MappedAutomaton:
    """An automaton read from its mapped arrays."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        limits, self.hashes, self.ids, self.word_edges, self.words = arrays[:5]
        self.window, self.shortest = limits.tolist()
        # Views with native items: the cheapest access by place.
        rest = [a.data for a in arrays[5:-1]]
        self.link, self.length, self.root, self.one_word, self.one_state, self.branches, self.more, self.more_state, self.cut, self.item_edges, self.item, self.short, self.short_edges, self.short_words, self.short_item = rest
        self.names = pickle.loads(arrays[-1].tobytes())

    @functools.cached_property
    def vocabulary(self) -> dict[bytes, int]:
        """All words of the block's items and their numbers, as a table of this worker's own."""
        raw, edges = self.words.tobytes(), self.word_edges.tolist()
        return {raw[a:b]: i for a, b, i in zip(edges[:-1], edges[1:], self.ids.tolist(), strict=True)}

    def numbers(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """The numbers of those words that the items have; hashes find them, bytes confirm."""
        import xxhash

        words = list(words)
        if not len(self.hashes) or not words:
            return {}
        wanted = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype="<u8")
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        found = {}
        for i in np.flatnonzero(self.hashes[at] == wanted).tolist():
            j = int(at[i])
            while j < len(self.hashes) and self.hashes[j] == wanted[i]:
                if self.words[self.word_edges[j] : self.word_edges[j + 1]].tobytes() == words[i]:
                    found[words[i]] = int(self.ids[j])
                j += 1
        return found

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        link, length, root, one_word, one_state, branches, more, more_state = self.link, self.length, self.root, self.one_word, self.one_state, self.branches, self.more, self.more_state
        v = size = 0
        for w in ids:
            while v:
                if one_word[v] == w:
                    v = one_state[v]
                    break
                if branches[v]:
                    key = v << 32 | w
                    j = bisect_left(more, key)
                    if j < len(more) and more[j] == key:
                        v = more_state[j]
                        break
                v = link[v]
                size = length[v]
            else:
                v = root[w]
            size = size + 1 if v else 0
            yield v, size

    def hits(self, words: list[bytes], numbers: dict[bytes, int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans (first, past last; merged) of hits, and the items that have them."""
        get = numbers.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start < self.shortest:
                continue
            for i, (v, size) in enumerate(self.matches(ids[start:end].tolist()), start + 1):
                reach = 0
                if size >= self.window:
                    reach = self.window
                    c = self.cut[v]
                    found.update(self.item[self.item_edges[c] : self.item_edges[c + 1]])
                s = self.short[v]
                for j in range(self.short_edges[s], self.short_edges[s + 1]):
                    if (m := self.short_words[j]) <= size:
                        reach = max(reach, m)
                        found.add(self.short_item[j])
                if reach:
                    first = i - reach
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i))
        return spans, found


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between the words of one span."""
    at = [m.span() for m in _WORDS.finditer(text.translate(_NORMAL))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def build_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_chars: int, coverage: float = COVERAGE) -> list[str]:
    """Automata of all items in the shared folder, one file for each block of items."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    folder = scratch(spark, "automata")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{key[0]}.bin"
        put_arrays(path, SuffixAutomaton([(i, t.encode()) for i, t in zip(rows["item"], rows["text"], strict=True)], window, coverage).arrays())
        return pd.DataFrame({"path": [path]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    return sorted(r.path for r in dealt.groupBy("block").applyInPandas(build, "path string").collect())


@functools.lru_cache(maxsize=64)
def load_block(path: str) -> MappedAutomaton:
    return MappedAutomaton(map_arrays(path))


NEW = "n_words long, n_hit long, items array<{item}>, spans array<struct<first:int,past:int>>, clean_text string"


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    coverage: float = COVERAGE,
) -> DataFrame:
    """``docs`` with word counts, the items found, word spans, and the text without these spans.

    A span is what hits cover: runs of the window's words, or of the share ``coverage`` of an item.
    """
    blocks = build_blocks(items, item_id, item_text, window, block_chars, coverage)
    kind = items.schema[item_id].dataType
    new = NEW.format(item=kind.simpleString())
    names = ["n_words", "n_hit", "items", "spans", "clean_text"]
    rest = docs.drop(*names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = text_bytes(rb, text_col)
            split = [words_of(t) for t in texts]
            different = set().union(*split) if len(blocks) > FEW_BLOCKS else ()
            spans: list[list] = [[] for _ in texts]
            found: list[set] = [set() for _ in texts]
            for path in blocks:
                automaton = load_block(path)
                numbers = automaton.numbers(different) if different else automaton.vocabulary
                for i, words in enumerate(split):
                    s, f = automaton.hits(words, numbers)
                    if s:
                        spans[i] += s
                        found[i] |= {automaton.names[k] for k in f}
            spans = [merged(s) for s in spans]
            clean = [without_spans(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            null = [t is None for t in rb.column(text_col).to_pylist()] if rb.column(text_col).null_count else [False] * len(texts)
            columns = [
                pa.array([len(w) for w in split], pa.int64()),
                pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                pa.array([sorted(f) for f in found], pa.list_(_arrow(kind))),
                pa.array([[{"first": a, "past": b} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))),
                pa.array([None if z else c.decode() for z, c in zip(null, clean, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*rb.columns, *columns], names=[*rb.schema.names, *names])

    short_batches(docs.sparkSession)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{own}, {new}")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
