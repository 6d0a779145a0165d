"""Interpolated modified Kneser-Ney language model, counted in Spark, read from mapped files.

Counting.  A first pass finds the words so frequent that their contexts are split over shards
(their number is bounded by four a shard).  The second pass turns each part of the training
text into n-grams of word hashes, counts them, and sends one packed block to each shard.  A
shard merges its blocks, stores its sorted hash arrays in the shared folder, and sends distinct
n-grams on, shortened by a word, to be counted for the next lower order; so all orders are one
chain of shuffles and no n-gram table is ever joined.

Files of an order above one hold ``hash(n-gram) -> count`` and ``context -> total and numbers of
words with count 1, 2, 3+``; those of order one hold continuation and plain counts.  Workers
map the files and look up batches of hashes by binary search; nothing is broadcast but file
names and a few sums.

Defined results: null text is an empty text, that is one end token; a null id counts as the
empty string for the split.  Without training tokens all words have the uniform probability.
Ties do not matter; repeated rows count and are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import MappedFolder, mix, pack, put_arrays, scratch, sharded, short_batches, text_bytes, unpack

ORDER = 2
#: Training bytes for one shard, and tokens that a worker counts before it sends blocks.
SHARD_BYTES, CHUNK_TOKENS = 12_000_000, 2_500_000
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
HOT_GROUPS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def join_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * _ODD + (word ^ (word >> np.uint64(29))))


def learns(doc_id: Column) -> Column:
    """Whether a document is in the training part."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


# ---------------------------------------------------------------- tokens


class Tokens:
    """Word hashes of a batch of texts, each text followed by one end token."""

    def __init__(self, texts: list[bytes]) -> None:
        import xxhash

        known: dict[bytes, int] = {}
        parts = [np.array([known.setdefault(w, len(known)) for w in t.lower().split()] + [-1], dtype=np.int64) for t in texts]
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.ids = np.concatenate(parts)
        h64 = xxhash.xxh64_intdigest
        self.hashes = np.array([h64(w) for w in known] + [int(END)], dtype="<u8")  # id -1 is the end
        self.words = self.hashes[self.ids]

    def contexts(self, order: int) -> list[np.ndarray]:
        """Hashes of the last 1, 2, ... order-1 words before each token."""
        out: list[np.ndarray] = []
        place = np.arange(len(self.words)) - np.repeat(self.first, self.size)
        for back in range(1, order):
            word = np.roll(self.words, back)
            word[place < back] = START
            out.append(word if not out else join_hash(word, out[-1]))
        return out


def shard_of(context: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """Shards go by context, but those of frequent contexts by context and word."""
    split = np.isin(context, hot)
    return np.where(split, join_hash(context, word), mix(context)) % np.uint64(shards)


# ---------------------------------------------------------------- counting


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """The first position of each run of equal rows."""
    new = np.zeros(len(sorted_columns[0]), dtype=bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _delta(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0))


def _blocks(columns: list[np.ndarray], count: np.ndarray, raw: np.ndarray, hot: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Packed, counted rows for each shard; ``columns``: contexts from the longest, then the word."""
    lead, word = columns[0], columns[-1]
    where = shard_of(lead, word, hot, shards) if len(columns) > 1 else mix(word) % np.uint64(shards)
    order = np.lexsort((word, lead, where))
    columns, count, raw, where = [c[order] for c in columns], count[order], raw[order], where[order]
    at = _runs(columns[0], word[order], where)
    count, raw = np.add.reduceat(count, at), np.add.reduceat(raw, at)
    columns, where = [c[at] for c in columns], where[at]
    edges = np.append(_runs(where), len(where))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(where[a]), pack(_delta(columns[0][a:b]), *[c[a:b] for c in columns[1:]], count[a:b], raw[a:b])


def _merge(blocks: Iterable[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """All rows of a shard, sorted and summed."""
    parts = [unpack(b, width + 2) for b in blocks]
    columns = [np.concatenate([np.cumsum(p[0]) if i == 0 else p[i] for p in parts]) for i in range(width)]
    count, raw = (np.concatenate([p[width + i] for p in parts]) for i in range(2))
    del parts
    order = np.lexsort((columns[-1], columns[0])) if width > 1 else np.argsort(columns[0], kind="stable")
    columns, count, raw = [c[order] for c in columns], count[order], raw[order]
    at = _runs(columns[0], columns[-1])
    return [c[at] for c in columns], np.add.reduceat(count, at), np.add.reduceat(raw, at)


def _stats(count: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For runs of a context: total, and how many words have count 1, 2, 3+."""
    return [np.add.reduceat(x, at) for x in (count, (count == 1).astype("<u8"), (count == 2).astype("<u8"), (count > 2).astype("<u8"))]


ROW = "kind string, shard int, level int, block binary"
#: Of an order: n-grams with count 1 to 4, all, their counts, tokens, and n-grams with count 3 or more.
SUMS = ("n1", "n2", "n3", "n4", "n", "total", "tokens", "n3_up")


def _level(folder: str, level: int, hot: np.ndarray, shards: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """What a shard of one order does: store its arrays, send distinct n-grams and sums on."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, shard = key
        if kind == "sum" or kind == "hot" and level > 1:
            return rows
        if kind == "hot":
            for at in sorted(set(rows["level"])):
                parts = [unpack(b, 5) for b in rows.loc[rows["level"] == at, "block"]]
                columns = [np.concatenate([p[i] for p in parts]) for i in range(5)]
                order = np.argsort(columns[0], kind="stable")
                columns = [c[order] for c in columns]
                first = _runs(columns[0])
                put_arrays(f"{folder}/hot{at}-{shard}.bin", [columns[0][first], *[np.add.reduceat(c, first) for c in columns[1:]]])
            return rows.iloc[:0]
        columns, count, raw = _merge(rows["block"], level)
        if kind == "next" and level == 1:
            put_arrays(f"{folder}/1-{shard}.bin", [columns[0], count, raw])
            of = [np.array([x], dtype="<u8") for x in (*[(count == i).sum() for i in (1, 2, 3, 4)], len(count), count.sum(), raw.sum(), (count > 2).sum())]
            return pd.DataFrame({"kind": ["sum"], "shard": [int(shard)], "level": [1], "block": [pack(*of)]})
        out: list[tuple[str, int, int, bytes]] = []
        at = _runs(columns[0])
        context, stats = columns[0][at], _stats(count, at)
        split = np.isin(context, hot)
        keys = join_hash(columns[0], columns[-1])
        order = np.argsort(keys, kind="stable")
        sizes = count[order]
        large = sizes >= 255
        put_arrays(
            f"{folder}/{level}-{shard}.bin",
            [keys[order], np.minimum(sizes, 255).astype("<u1"), keys[order][large], sizes[large], context[~split], stats[0][~split], *[s[~split].astype("<u4") for s in stats[1:]]],
        )
        del keys, order, sizes
        for group, rows_of in sharded((mix(context[split]) % np.uint64(HOT_GROUPS)).astype(np.int64), HOT_GROUPS):
            out.append(("hot", group, level, pack(context[split][rows_of], *[s[split][rows_of] for s in stats])))
        of = [np.array([x], dtype="<u8") for x in (*[(count == i).sum() for i in (1, 2, 3, 4)], len(count), count.sum(), raw.sum(), (count > 2).sum())]
        out.append(("sum", int(shard), level, pack(*of)))
        out += [("next", s, level - 1, b) for s, b in _blocks(columns[1:], np.ones_like(count), raw, hot, shards)]
        return pd.DataFrame(out, columns=["kind", "shard", "level", "block"])

    return reduce


@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    shards: int
    hot: np.ndarray
    tokens: int
    distinct: int
    total: int  # of continuation counts (or plain counts in a model of order one)
    types: tuple[int, int, int]  # words with continuation count 1, 2, 3+
    discounts: tuple[tuple[float, float, float], ...]  # by order, from one


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams with count one to four; 0.5, 1, 1.5 where undefined."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(i)) for i, d in enumerate(found, 1))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES, chunk_tokens: int = CHUNK_TOKENS) -> Model:
    """Count all n-grams of all texts of ``docs`` and store the model in the shared folder."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(4, -(-size // shard_bytes))
    folder = scratch(spark, "kneser-ney")

    def frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words over one in eight times the shards in this part of the text."""
        counts: dict[int, int] = {}
        n = 0
        for rb in batches:
            t = Tokens(text_bytes(rb, "text"))
            most, times = np.unique(t.words, return_counts=True)
            n += len(t.words)
            often = times * 16 * shards > len(t.words)
            for w, c in zip(most[often].tolist(), times[often].tolist(), strict=True):
                counts[w] = counts.get(w, 0) + c
        if n:
            # A frequent word is frequent in some part; where it is not, its count is not needed exactly.
            rows = [(w, c) for w, c in counts.items() if c * 8 * shards > n]
            yield pa.RecordBatch.from_pydict({"word": pa.array([w - (1 << 64) if w >> 63 else w for w, _ in rows], pa.int64()), "n": pa.array([c for _, c in rows], pa.int64()), "of": pa.array([0] * len(rows), pa.int64())})
            yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.int64()), "n": pa.array([0], pa.int64()), "of": pa.array([n], pa.int64())})

    often = texts.mapInArrow(frequent, "word long, n long, of long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    n_all = (often.agg(F.coalesce(F.sum("of"), F.lit(0))).first()[0]) or 1
    hot_rows = often.filter("word is not null").filter(F.col("n") * (4 * shards) > n_all).select("word").collect()
    hot = np.sort(np.array([r.word for r in hot_rows], dtype="<i8").view("<u8"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([p[i] for p in parts]) for i in range(order)]
            ones = np.ones(len(columns[0]), dtype="<u8")
            rows = list(_blocks(columns, ones, ones, hot, shards))
            return pa.RecordBatch.from_pydict({"kind": pa.array(["next"] * len(rows)), "shard": pa.array([r[0] for r in rows], pa.int32()), "level": pa.array([order] * len(rows), pa.int32()), "block": pa.array([r[1] for r in rows], pa.binary())})

        for rb in batches:
            t = Tokens(text_bytes(rb, "text")) if rb.num_rows else None
            if t is None:
                continue
            parts.append([*reversed(t.contexts(order)), t.words])
            held += len(t.words)
            if held >= chunk_tokens:
                yield flush()
                parts, held = [], 0
        if held:
            yield flush()

    rows = texts.mapInArrow(count, ROW)
    for level in range(order, 0, -1):
        rows = rows.groupBy("kind", "shard").applyInPandas(_level(folder, level, hot, shards), ROW)

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            own = [[int(c[0]) for c in unpack(b, 8)] for b in rb.column("block").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("level"), *(pa.array([o[i] for o in own], pa.int64()) for i in range(8))], names=["level", *SUMS])

    added = rows.select("level", "block").mapInArrow(opened, ", ".join(["level int", *(f"{c} long" for c in SUMS)])).groupBy("level").agg(*[F.sum(c).alias(c) for c in SUMS])
    sums = [np.zeros(8, dtype=np.int64) for _ in range(order)]
    for r in added.collect():
        sums[r.level - 1] += np.array([r[c] for c in SUMS])
    words = sums[0]
    return Model(folder, order, shards, hot, int(words[6]), int(words[4]), int(words[5]), (int(words[0]), int(words[1]), int(words[7])), tuple(discounts(*map(int, s[:4])) for s in sums))


# ---------------------------------------------------------------- scoring


class Reader:
    """A model's mapped files in one worker."""

    def __init__(self, model: Model) -> None:
        self.model, self._file = model, MappedFolder(model.folder).get

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Continuation and plain counts of words."""
        out = np.zeros((2, len(hashes)), dtype=np.int64)
        for s, rows in sharded((mix(hashes) % np.uint64(self.model.shards)).astype(np.int64), self.model.shards):
            if f := self._file(f"1-{s}"):
                at, ok = self._find(f[0], hashes[rows])
                out[0, rows[ok]], out[1, rows[ok]] = f[1][at[ok]], f[2][at[ok]]
        return out[0], out[1]

    def counts(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), dtype=np.int64)
        keys = join_hash(context, word)
        for s, rows in sharded(shard_of(context, word, self.model.hot, self.model.shards).astype(np.int64), self.model.shards):
            if f := self._file(f"{level}-{s}"):
                rows = rows[np.argsort(keys[rows])]
                at, ok = self._find(f[0], keys[rows])
                found = f[1][at[ok]].astype(np.int64)
                if (big := found == 255).any():
                    found[big] = f[3][np.searchsorted(f[2], keys[rows[ok]][big])]
                out[rows[ok]] = found
        return out

    def contexts(self, level: int, context: np.ndarray) -> np.ndarray:
        """Total and numbers of words with count 1, 2, 3+ for each context; zeros for unseen ones."""
        out = np.zeros((4, len(context)), dtype=np.float64)
        split = np.isin(context, self.model.hot)
        groups = np.where(split, mix(context) % np.uint64(HOT_GROUPS), np.uint64(HOT_GROUPS) + mix(context) % np.uint64(self.model.shards)).astype(np.int64)
        for g, rows in sharded(groups, HOT_GROUPS + self.model.shards):
            f = self._file(f"hot{level}-{g}") if g < HOT_GROUPS else self._file(f"{level}-{g - HOT_GROUPS}")
            if f:
                f = f if g < HOT_GROUPS else f[4:]
                at, ok = self._find(f[0], context[rows])
                for i in range(4):
                    out[i, rows[ok]] = f[1 + i][at[ok]]
        return out

    def log10(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The model's log10 probability of each token, and the plain counts of the tokens."""
        m = self.model
        cont, raw = self.words(t.hashes)

        def mass(count: np.ndarray, level: int) -> np.ndarray:
            d = np.array([0.0, *m.discounts[level - 1]])
            return count - d[np.minimum(count, 3)]

        p = np.full(len(t.hashes), 1.0 / (m.distinct + 1))
        if m.total:
            back = sum(d * n for d, n in zip(m.discounts[0], m.types, strict=True)) / m.total
            p = mass(cont, 1) / m.total + back * p
        p = p[t.ids]
        for level, context in enumerate(t.contexts(m.order), 2):
            own, of = np.unique(context, return_inverse=True)
            total, *types = self.contexts(level, own)
            seen = total > 0
            back = np.where(seen, sum(d * n for d, n in zip(m.discounts[level - 1], types, strict=True)) / np.where(seen, total, 1), 1.0)[of]
            own_mass = mass(self.counts(level, context, t.words), level) / np.where(seen, total, 1)[of]
            p = np.where(seen[of], own_mass, 0.0) + back * p
        return np.log10(p), raw[t.ids]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, n_known, base_score (add-one words), score (the model), perplexity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        base = np.log10(model.tokens + model.distinct + 1)
        for rb in batches:
            if not rb.num_rows:
                continue
            t = Tokens(text_bytes(rb, "text"))
            each, raw = reader.log10(t)
            total = np.add.reduceat(each, t.first)
            columns = [
                pa.array(t.size),
                pa.array(np.add.reduceat((raw > 0).astype(np.int64), t.first)),
                pa.array(np.add.reduceat(np.log10(raw + 1.0) - base, t.first)),
                pa.array(total),
                pa.array(10.0 ** np.minimum(-total / t.size, 300.0)),
            ]
            yield pa.RecordBatch.from_arrays([rb.column(id_col), *columns], names=[id_col, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
