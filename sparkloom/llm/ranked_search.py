"""Ranked lexical search: the k best documents of each item, exactly, by thresholds known beforehand.

A term's impact in a document is a whole number that grows with its count and shrinks with the
document's length; a document's score for an item is the sum of its impacts of the item's terms,
repeats included.  For each term the k-th largest impact is stored.  An item's k-th score is at least
that of any of its terms alone, and at least the k-th exact score among the documents that hold
the k largest impacts of its terms (the seeds).  With that threshold, an item's terms in the order of
their largest impacts fall in two: a first part whose bounds sum to less than the threshold, so that
no document gets there by them alone, and the rest, the essential ones.  Only documents with an
essential term, whose essential impacts and the others' bound reach the threshold, are candidates,
and candidates are scored by all terms.  Nothing is dropped that could be among the k best.

Spark's part.  The items are a query set, dealt in blocks of about ``BLOCK_TERMS`` distinct terms;
each block is a few files of arrays that workers map.  The documents are read as text once, into
rows of the block's terms they have; those rows are then scanned for the counts, for the largest impacts,
for the seeds and for the candidates, each time without a shuffle but of what a task keeps: at most k
rows for a term or an item.

Defined results.  Terms are the longest stretches of letters and digits of ASCII and of all other
characters beyond ASCII; only A-Z are lower-cased.  Null and empty texts have no terms; an item without
terms, or whose terms no document has, has no rows.  Repeated documents are ranked each; items
with the same id are searched each.  Equal scores go by ascending document id, null last.  Extra
columns are not read.  Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.shared import MappedFolder, bounded_batches, put_arrays, scratch, text_bytes, written

K = 10
#: Distinct terms of a block of items, about; with the longest item it bounds what a worker looks into at once.
BLOCK_TERMS = 1 << 18
#: Pairs of document and item, and impacts, that a worker holds at once.
MOST_PAIRS = 1 << 21
#: Scored pairs that a worker keeps before it drops all but each item's best.
FOLD = 1 << 17
#: Fixed by the score: impacts are w * (SCALE * tf div (1000 * tf + 8 * m)), m = 25 + (75 * n * N div L).
SCALE = 1_000_000_000
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def terms(text: bytes) -> list[bytes]:
    """All terms of a text in UTF-8, in order; bytes beyond ASCII belong to characters beyond ASCII."""
    return _TERM.findall(text.translate(_LOWER))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    m = 25 + 75 * n * docs // max(words, 1)
    return w * (SCALE * tf // (1000 * tf + 8 * m))


# ---------------------------------------------------------------- items


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item`` (a number for each row), ``id, term`` (bytes), ``times``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            counts = [Counter(terms(t)) for t in text_bytes(rb, "text")]
            at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            made = [pa.array([t for c in counts for t in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays([rb.column("item").take(pa.array(at)), rb.column("id").take(pa.array(at)), *made], names=["item", "id", "term", "times"])

    bounded_batches(items.sparkSession)
    given = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"item long, id {items.schema[id_col].dataType.simpleString()}, term binary, times long")


def put_vocabulary(wanted: DataFrame, folder: str) -> DataFrame:
    """Number the terms of each block and write them, sorted by hash, to the block's file: ``block, term, t``."""

    def put(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words = [bytes(t) for t in rows["term"]]
        seed, hashes = 0, np.empty(0, np.uint64)
        while len(np.unique(hashes)) < len(words):  # another seed where two terms have one hash
            seed += 1
            hashes = np.array([xxhash.xxh64_intdigest(t, seed) for t in words], np.uint64)
        order = np.argsort(hashes)
        words = [words[i] for i in order]
        ends = np.cumsum([0, *map(len, words)])
        put_arrays(f"{folder}/{key[0]}.bin", [np.array([seed], "<u8"), hashes[order].astype("<u8"), ends.astype("<u8"), np.frombuffer(b"".join(words), np.uint8)])
        return pd.DataFrame({"block": key[0], "term": words, "t": np.arange(len(words), dtype=np.int32)})

    return written(wanted.groupBy("block").applyInPandas(put, "block int, term binary, t int"), "search-vocabulary")


# ---------------------------------------------------------------- documents


def _lookup(words: list[bytes], files: MappedFolder, block: int) -> np.ndarray:
    """The numbers of terms in a block, -1 where it has none such; a hash that is found is checked by its bytes."""
    seed, hashes, ends, letters = files.get(str(block))
    own = np.fromiter((xxhash.xxh64_intdigest(t, int(seed[0])) for t in words), np.uint64, len(words))
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    out = np.full(len(words), -1, np.int64)
    for k in np.flatnonzero(hashes[at] == own).tolist():
        i = int(at[k])
        if letters[int(ends[i]) : int(ends[i + 1])].tobytes() == words[k]:
            out[k] = i
    return out


def vectors(docs: DataFrame, folder: str, blocks: list[int], id_col: str, text_col: str) -> DataFrame:
    """A row a document and block that share terms (the first block: every document): ``doc, id, n, block``, the terms' numbers ``t`` and counts ``tf``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = MappedFolder(folder)
        for rb in batches:
            texts = [terms(t) for t in text_bytes(rb, "text")]
            n = np.array([len(t) for t in texts], np.int64)
            counts = [Counter(t) for t in texts]
            place: dict[bytes, int] = {}
            flat = np.fromiter((place.setdefault(t, len(place)) for c in counts for t in c), np.int64)
            tf = np.fromiter((x for c in counts for x in c.values()), np.int64)
            doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            words = list(place)
            for block in blocks:
                t = _lookup(words, files, block)[flat] if words else flat
                hit = np.flatnonzero(t >= 0)
                sizes = np.bincount(doc[hit], minlength=len(counts))
                rows = np.arange(len(counts)) if block == blocks[0] else np.flatnonzero(sizes)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes[rows])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v[hit].astype(np.int32))) for v in (t, tf)]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [rb.column("doc").take(at), rb.column("id").take(at), pa.array(n[rows]), pa.array(np.full(len(rows), block, np.int32)), *lists],
                    names=["doc", "id", "n", "block", "t", "tf"],
                )

    bounded_batches(docs.sparkSession)
    given = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"doc long, id {docs.schema[id_col].dataType.simpleString()}, n long, block int, t array<int>, tf array<int>")


class _Batch:
    """The impacts of a batch's rows of one block: for each, its row, term and impact, sorted by row and term."""

    def __init__(self, rb: pa.RecordBatch, weights: np.ndarray, docs: int, words: int) -> None:
        t, tf = (rb.column(c) for c in ("t", "tf"))
        sizes = np.diff(t.offsets.to_numpy())
        flat = t.flatten().to_numpy().astype(np.int64)
        n = rb.column("n").to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((flat, row))
        self.row, self.t = row[order], flat[order]
        self.c = impacts(weights[self.t], tf.flatten().to_numpy().astype(np.int64)[order], n[self.row], docs, words)
        self.many = len(weights)
        self.keys = self.row * self.many + self.t

    def of(self, row: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The impacts of terms in rows, 0 where a row lacks the term."""
        if not len(self.keys):
            return np.zeros(len(row), np.int64)
        keys = row * self.many + t
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.c[at], 0)


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of an array: which range, and which place, one after another."""
    which = np.repeat(np.arange(len(size)), size)
    return which, start[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose sizes sum to about ``most``; a larger one is alone or with its neighbours before it."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1)) if len(sizes) else np.empty(0, np.int64)
    yield from zip(edges.tolist(), [*edges[1:].tolist(), len(sizes)])


def _parts(rb: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one block, so few that their terms stay well within ``MOST_PAIRS`` (but a longer document)."""
    blocks = rb.column("block").to_numpy()
    for block in np.unique(blocks).tolist():
        rows = rb.take(pa.array(np.flatnonzero(blocks == block)))
        for start, past in _chunks(rows.column("t").value_lengths().to_numpy(zero_copy_only=False), MOST_PAIRS // 8):
            yield block, rows.slice(start, past - start)


# ---------------------------------------------------------------- largest impacts


def largest(rows: DataFrame, weights: str, docs: int, words: int, k: int) -> DataFrame:
    """The k largest impacts of each term (ties by document number): ``block, t, c, doc``, at most k a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = MappedFolder(weights), {}

        def fold(block: int) -> list[np.ndarray]:
            t, c, doc = (np.concatenate(x) for x in zip(*held[block]))
            order = np.lexsort((doc, -c, t))
            t, c, doc = t[order], c[order], doc[order]
            first = np.flatnonzero(np.diff(t, prepend=-1))
            near = np.arange(len(t)) - np.repeat(first, np.diff(first, append=len(t))) < k
            held[block] = [[t[near], c[near], doc[near]]]
            return held[block][0]

        waiting: Counter = Counter()
        for rb in batches:
            for block, part in _parts(rb):
                if (w := files.get(str(block))) is None:  # no document has a term of the block
                    continue
                b = _Batch(part, w[0].astype(np.int64), docs, words)
                some = b.c > 0
                held.setdefault(block, []).append([b.t[some], b.c[some], part.column("doc").to_numpy()[b.row[some]]])
                waiting[block] += int(some.sum())
                if waiting[block] > MOST_PAIRS:
                    waiting[block] = len(fold(block)[0]) // 2
        for block in held:
            t, c, doc = fold(block)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), block, np.int32)), pa.array(t.astype(np.int32)), pa.array(c), pa.array(doc)], names=["block", "t", "c", "doc"])

    found = rows.select("doc", "n", "block", "t", "tf").mapInArrow(run, "block int, t int, c long, doc long")
    place = F.row_number().over(Window.partitionBy("block", "t").orderBy(F.col("c").desc(), "doc"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


# ---------------------------------------------------------------- the index of a block


def put_index(block_terms: DataFrame, folder: str) -> DataFrame:
    """Write each block's items to its file; returns the number of blocks written.

    ``block_terms`` has a row an item and term: ``block, item, t, times, most`` (largest impact) and ``low``
    (the item's threshold).  The file has the items' numbers, thresholds, bounds of what is not
    essential, their terms by item, and the items of each essential term.
    """

    def put(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        item, at = np.unique(rows["item"].to_numpy(), return_inverse=True)
        t, times, most, low = (rows[c].to_numpy().astype(np.int64) for c in ("t", "times", "most", "low"))
        order = np.lexsort((t, most * times, at))
        at, t, times, most, low = at[order], t[order], times[order], most[order], low[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        bound = np.cumsum(most * times)
        bound -= np.repeat(bound[first] - (most * times)[first], np.diff(first, append=len(at)))
        need = bound >= np.maximum(low, 1)  # the terms up to here may reach the threshold
        rest = np.zeros(len(item), np.int64)
        np.add.at(rest, at[~need], (most * times)[~need])
        by_term = np.flatnonzero(need)[np.argsort(t[need], kind="stable")]
        starts = np.searchsorted(t[by_term], np.arange(int(t.max()) + 2))
        arrays = [item, low[first], rest, np.append(first, len(at)), t, times, starts, at[by_term], times[by_term]]
        put_arrays(f"{folder}/{key[0]}.bin", [a.astype("<u8") for a in arrays])
        return pd.DataFrame({"block": [key[0]]})

    return block_terms.groupBy("block").applyInPandas(put, "block int")


def _best(rows: DataFrame, weights: str, index: str, docs: int, words: int, k: int, seeds: str | None = None) -> DataFrame:
    """The k best documents of each item in a task: ``block, item, score, doc, id``.

    With ``seeds``, a folder of the terms' k-th impacts, only documents with one of the k largest impacts
    of an item's term are scored; without, all that may reach the item's threshold.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight_files, index_files, seed_files = MappedFolder(weights), MappedFolder(index), MappedFolder(seeds or index)
        held: dict[int, list[pa.Table]] = {}

        def fold(block: int) -> pa.Table:
            table = pa.concat_tables(held[block]).sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending"), ("doc", "ascending")])
            first = np.flatnonzero(np.diff(table.column("item").to_numpy(), prepend=-1))
            near = np.arange(len(table)) - np.repeat(first, np.diff(first, append=len(table))) < k
            held[block] = [table.filter(pa.array(near))]
            return held[block][0]

        def pairs_of(b: _Batch, part: pa.RecordBatch, block: int, arrays: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Rows and items to score, some at a time; all of a row's terms go together, as their impacts are summed."""
            _, low, rest, _, _, _, starts, of_term, times = arrays
            use = np.flatnonzero(b.t < len(starts) - 1)
            if seeds:
                kth, last = (a.view(np.int64) for a in seed_files.get(str(block)))
                doc, c, t = part.column("doc").to_numpy()[b.row[use]], b.c[use], b.t[use]
                use = use[(c > kth[t]) | ((c == kth[t]) & (doc <= last[t]) & (c > 0))]
            sizes = starts[b.t[use] + 1] - starts[b.t[use]]
            use, sizes = use[sizes > 0], sizes[sizes > 0]
            first = np.flatnonzero(np.diff(b.row[use], prepend=-1))
            edges = np.append(first, len(use))
            for s, e in _chunks(np.add.reduceat(sizes, first) if len(first) else sizes, MOST_PAIRS):
                some = slice(edges[s], edges[e])
                which, at = _spread(starts[b.t[use[some]]], sizes[some])
                term = use[some][which]
                keys, where = np.unique(b.row[term] * len(low) + of_term[at], return_inverse=True)
                row, item = keys // len(low), keys % len(low)
                if not seeds:
                    sums = np.zeros(len(keys), np.int64)
                    np.add.at(sums, where, b.c[term] * times[at])
                    may = sums + rest[item] >= low[item]
                    row, item = row[may], item[may]
                yield row, item

        waiting: Counter = Counter()
        for rb in batches:
            for block, part in _parts(rb):
                if (mapped := index_files.get(str(block))) is None:
                    continue
                arrays = [a.view(np.int64) for a in mapped]
                items, low, _, first, t, times, *_ = arrays
                b = _Batch(part, weight_files.get(str(block))[0].astype(np.int64), docs, words)
                for row, item in pairs_of(b, part, block, arrays):
                    score, size = np.zeros(len(row), np.int64), first[item + 1] - first[item]
                    for s, e in _chunks(size, MOST_PAIRS):
                        which, at = _spread(first[item[s:e]], size[s:e])
                        np.add.at(score, which + s, b.of(row[s:e][which], t[at]) * times[at])
                    good = np.flatnonzero((score > 0) & (score >= low[item]))
                    if not len(good):
                        continue
                    at = pa.array(row[good])
                    new = pa.table({"item": items[item[good]], "score": score[good], "doc": part.column("doc").take(at), "id": part.column("id").take(at)})
                    held.setdefault(block, []).append(new)
                    waiting[block] += len(new)
                    if waiting[block] > FOLD:
                        waiting[block] = len(fold(block)) // 2
        for block in held:
            table = fold(block)
            table = table.append_column("block", pa.array(np.full(len(table), block, np.int32)))
            yield from table.select(["block", "item", "score", "doc", "id"]).combine_chunks().to_batches()

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"block int, item long, score long, doc long, id {kind}")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "doc"]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def _put_columns(rows: DataFrame, folder: str, *columns: str) -> None:
    """Each block's columns as arrays by term number, in the block's file; terms without a row get 0."""

    def put(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t = part["t"].to_numpy()
        arrays = [np.zeros(int(part["many"].iloc[0]), np.int64) for _ in columns]
        for a, c in zip(arrays, columns):
            a[t] = part[c].to_numpy()
        put_arrays(f"{folder}/{key[0]}.bin", [a.astype("<i8") for a in arrays])
        return pd.DataFrame({"block": [key[0]]})

    rows.groupBy("block").applyInPandas(put, "block int").count()


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Each item's k best documents: ``item_col, rank, id_col, score``."""
    spark = docs.sparkSession
    folder = {name: scratch(spark, f"search-{name}") for name in ("terms", "weights", "kth", "seeds", "index")}
    asked = written(item_terms(items, item_col, item_text), "search-items")
    blocks = 1 + asked.count() // block_terms
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    known = put_vocabulary(asked.select("block", "term").distinct(), folder["terms"])
    sizes = known.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("many"))
    filled = sorted(r.block for r in sizes.select("block").collect())
    rows = written(vectors(docs, folder["terms"], filled, id_col, text_col), "search-vectors")
    first = rows.filter(F.col("block") == (filled[0] if filled else 0))
    total = first.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    weight = F.floor(1000 * F.log((2 * F.lit(total.docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    used = rows.select("block", F.explode("t").alias("t")).groupBy("block", "t").agg(F.count(F.lit(1)).alias("df")).withColumn("w", weight)
    _put_columns(used.join(sizes, "block"), folder["weights"], "w")
    top = written(largest(rows, folder["weights"], total.docs, total.words, k), "search-largest")
    stored = top.groupBy("block", "t").agg(F.max("c").alias("most"), F.max(F.when(F.col("place") == k, F.col("c"))).alias("kth"), F.max(F.when(F.col("place") == k, F.col("doc"))).alias("last"))
    stored = written(stored.fillna({"kth": 0}), "search-stored")
    _put_columns(stored.withColumn("last", F.coalesce("last", F.lit(-1))).join(sizes, "block"), folder["kth"], "kth", "last")
    wanted = written(asked.join(known, ["block", "term"]).join(stored, ["block", "t"]).select("block", "item", "id", "t", "times", "most", "kth"), "search-terms")
    # A threshold from the stored impacts alone, then from the exact scores of the documents that hold them.
    alone = wanted.groupBy("block", "item").agg(F.max(F.col("kth") * F.col("times")).alias("low"))
    put_index(wanted.withColumn("low", F.lit(0)), folder["seeds"]).count()
    seeds = _ranked(_best(rows, folder["weights"], folder["seeds"], total.docs, total.words, k, folder["kth"]), k)
    seeded = seeds.groupBy("item").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("seeded"))
    low = alone.join(seeded, "item", "left").select("item", F.greatest("low", F.coalesce("seeded", F.lit(0))).alias("low"))
    put_index(wanted.join(low, "item"), folder["index"]).count()
    best = _ranked(_best(rows, folder["weights"], folder["index"], total.docs, total.words, k), k)
    names = asked.select("item", F.col("id").alias("name")).distinct()
    return best.join(names, "item").select(F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
