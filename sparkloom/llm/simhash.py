"""SimHash near-duplicates: 64-bit fingerprints, bit-sliced comparison, connected components.

Fingerprints that differ in at most ``radius`` bits agree on at least ``blocks - radius`` of
``blocks`` bit blocks.  Each choice of that many blocks is a table; equal values in a table make
a bucket, and only rows of one bucket are compared.  Equal fingerprints are one row throughout.
In a bucket the rows lie as bit planes, 64 rows to a word.  For each offset all rows are compared
at once with the row so far behind: differing bits go into carry-save counters (ones, twos, over),
and a block of words is abandoned when all its rows are over the radius.  A bucket gives at most
one link a row (to the smallest of its group in the bucket), which keeps all components whole.
Large buckets are cut into parts, and each pair of parts is compared in a task of its own.

Defined results: null text is an empty text; a text without words has fingerprint zero, which
links like any other.  Fewer words than a shingle: the whole sequence is the one shingle.
Repeated ids with different texts give a row each and, sharing an id, fall in one component.
Null ids get a row; a component of null ids alone has a null ``component_id``.  Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.shared import short_batches, text_bytes, written
from sparkloom.session import safe_unions

RADIUS, SHINGLE = 3, 3
#: Rows of one part of a bucket; larger buckets are compared part by part.
PART_ROWS = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the word shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    h = np.array([h64(b" ".join(g), 42) for g in grams], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for part in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc`` and ``fp`` (the 64 bits as a signed long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            fp = np.array([fingerprint(t, shingle) for t in text_bytes(rb, "text")], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([rb.column("doc"), pa.array(fp)], names=["doc", "fp"])

    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind}, fp long")


# ---------------------------------------------------------------- comparison


def _planes(fp: np.ndarray) -> np.ndarray:
    """64 rows of bits: plane b holds bit b of every fingerprint, 64 fingerprints to a word."""
    pad = -len(fp) % 64
    bits = np.unpackbits(np.concatenate([fp, np.zeros(pad, dtype="<u8")]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def _behind(planes: np.ndarray, offset: int, words: np.ndarray) -> np.ndarray:
    """For the chosen words, the planes of the rows ``offset`` further on."""
    skip, bits = divmod(offset, 64)
    padded = np.concatenate([planes, np.zeros((len(planes), skip + 2), dtype="<u8")], axis=1)
    low = padded[:, words + skip]
    return low if not bits else (low >> np.uint64(bits)) | (padded[:, words + skip + 1] << np.uint64(64 - bits))


def _near(planes: np.ndarray, offset: int, live: np.ndarray, radius: int) -> np.ndarray:
    """Rows i (of the live lanes) whose fingerprint is within ``radius`` bits of row i + offset."""
    words = np.flatnonzero(live)
    lanes = live[words]
    counters = [np.zeros(len(words), dtype="<u8") for _ in range(radius.bit_length())]
    over = np.zeros(len(words), dtype="<u8")
    for first in range(0, 64, 8):
        block = planes[first : first + 8]
        apart = block[:, words] ^ _behind(block, offset, words)
        for carry in apart:
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over |= carry
        if radius & (radius + 1):
            over |= _above(counters, radius)
        stay = (lanes & ~over) != 0
        if not stay.any():
            return np.empty(0, dtype=np.int64)
        if not stay.all():
            words, lanes, over, counters = words[stay], lanes[stay], over[stay], [c[stay] for c in counters]
    hit = np.ascontiguousarray(lanes & ~over)
    w, b = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return words[w] * 64 + b


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius, for radii that are not all ones."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def bucket_groups(fp: np.ndarray, bucket: np.ndarray, radius: int, parent: np.ndarray | None = None, edges: list[tuple[int, int]] | None = None) -> np.ndarray:
    """For rows sorted by bucket, the first row of each row's group: linked within its bucket.

    ``parent``: groups found before; ``edges`` takes the pairs of rows that joined two groups.
    """
    n = len(fp)
    parent = np.arange(n) if parent is None else parent
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[:n])
    size = np.diff(np.append(first, n))
    left = np.repeat(first + size, size) - np.arange(n)  # rows of the bucket from this one on
    rows = np.flatnonzero(np.repeat(size, size) > 1)
    offset = 1
    while len(rows):
        planes, own = _planes(fp[rows]), left[rows]
        until, most = 2 * offset, int(own.max())
        while offset < min(until, most):
            lanes = np.zeros(-(-len(rows) // 64) * 64, dtype=np.uint8)
            lanes[: len(rows)] = own > offset
            live = np.packbits(lanes, bitorder="little").view("<u8")
            near = _near(planes, offset, live, radius)
            a, b = rows[near], rows[near + offset]
            part = parent[a] != parent[b]
            for x, y in zip(a[part].tolist(), b[part].tolist(), strict=True):
                i, j = _root(parent, x), _root(parent, y)
                if i != j:
                    parent[max(i, j)] = min(i, j)
                    if edges is not None:
                        edges.append((x, y))
            while (parent != parent[parent]).any():
                parent = parent[parent]
            offset += 1
        # From here on only buckets with rows that far apart matter.
        rows = rows[np.repeat(size, size)[rows] > offset] if offset < most else rows[:0]
    return parent


def _tables(blocks: int, radius: int) -> list[int]:
    """Masks of the tables: every choice of ``blocks - radius`` of the bit blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(masks, blocks - radius)]


def links(distinct: DataFrame, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints whose components are those of all pairs in the radius."""
    spark = distinct.sparkSession
    n = distinct.count()
    # Enough blocks that a bucket of unrelated fingerprints stays small: 16, 25, then 32 bits a table.
    blocks = radius + (1 if n < 1 << 24 else 2 if n < 1 << 33 else 3)
    signed = [m - (1 << 64) if m >> 63 else m for m in _tables(blocks, radius)]
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    large = rows.groupBy("t", "key").count().filter(F.col("count") > part_rows).select("t", "key", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    large = written(large, "large-buckets")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(signed) // 100_000)
    dealt = rows.join(large, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("lo"), F.greatest(p, F.col("own")).alias("hi")))
    )
    dealt = (
        dealt.withColumn("own", own)
        .select("t", "key", "fp", F.explode(pairs).alias("pair"))
        .select("t", "fp", F.xxhash64("t", "key", "pair.lo", "pair.hi").alias("bucket"))
        .withColumn("shard", F.pmod("bucket", F.lit(shards)))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, fp = pdf["bucket"].to_numpy(), pdf["fp"].to_numpy()
        order = np.lexsort((fp, bucket))
        bucket, fp = bucket[order], fp[order]
        group = bucket_groups(np.ascontiguousarray(fp).view("<u8"), bucket, radius)
        linked = np.flatnonzero(group != np.arange(len(group)))
        return pd.DataFrame({"a": fp[linked], "b": fp[group[linked]]})

    return dealt.groupBy("shard").applyInPandas(compare, "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node it can reach, for the nodes that have edges.

    Each round passes the smallest label over all edges and then follows labels once, so a
    component of diameter d takes about log d rounds; each is written, so a lost executor
    repeats one round at most.
    """
    safe_unions(nodes.sparkSession)
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("best"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "best").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = step.join(jump, step.next == jump.at, "left").select("node", F.least("next", "further").alias("label"), (F.least("next", "further") != F.col("label")).alias("changed"))
        moved = written(moved, "labels")
        labels = moved.select("node", "label")
        if not moved.filter("changed").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``id_col``, ``fp`` (long) and ``component_id``, one row for each row of ``docs``."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc").alias("node")), "distinct")
    found = links(distinct.select("fp"), radius)
    names = distinct.filter("node is not null")
    edges = found.join(names.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(names.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # An id with two texts joins their fingerprints.
    shared = prints.filter("doc is not null").groupBy("doc").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc")
    twice = prints.join(shared, "doc").join(distinct.filter("node is not null"), "fp").select(F.col("node").alias("a"), F.col("doc").alias("b")).filter("a <> b")
    labels = components(distinct, edges.union(twice))
    classes = distinct.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return prints.join(classes, "fp").select(F.col("doc").alias(id_col), "fp", "component_id")


# ---------------------------------------------------------------- similar texts

WORDS, SIMILARITY = 5, 0.8
#: Bits in which fingerprints of candidates may differ, tried from the nearest on.  At a similarity of 0.8 the
#: angle of the shingle vectors is 27 degrees: 10 bits are expected, with a deviation of 3, so 16 leave out 1 pair in 80,
#: which ``_met`` finds.  With 20 unlike texts that share a shingle join most of a large corpus to one cluster.
NEAR_BITS = (4, 10, 16)
#: Clusters of at most so many texts and shingles are compared whole, each in one task; larger ones by parts of this size.
WHOLE_TEXTS, WHOLE_SHINGLES = 1000, 4_000_000
#: The texts that most candidates share; so many of a larger cluster go to all its parts, which links most of these.
HUBS = 12
#: One document in so many tells how common shingles are: those that this many of them have, the most common ones.
SAMPLE, LEAST_COMMON, MOST_COMMON = 16, 3, 1 << 20
#: Rows of a part of a bucket where all pairs are looked at.
MEET_ROWS = 1024


def shingle_set(text: bytes, shingle: int = WORDS) -> np.ndarray:
    """The different XXH64 (seed 42) of the word shingles, sorted; of fewer words the whole sequence, of none nothing."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    h64 = xxhash.xxh64_intdigest
    return np.unique(np.array([h64(b" ".join(g), 42) for g in grams], dtype="<u8"))


def _signature(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 7)


def _print_of(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingles: each counts once."""
    total = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def leading(hashes: np.ndarray, common: np.ndarray, seen: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the set's shingles, common ones (``common``: sorted, with ``seen``, how often) last, that of two similar sets these have one in common."""
    least = int(np.ceil(similarity * len(hashes) - 1e-9))
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        order = np.lexsort((hashes, np.where(common[at] == hashes, seen[at], 0)))
    else:
        order = np.arange(len(hashes))
    return hashes[order[: len(hashes) - least + 1]]


def spanning(fp: np.ndarray, bucket: np.ndarray, radii: tuple[int, ...] = NEAR_BITS) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Groups within buckets (rows sorted by bucket), and pairs that hold each together, the nearest rows first."""
    edges: list[tuple[int, int]] = []
    parent = np.arange(len(fp))
    for radius in radii:
        parent = bucket_groups(fp, bucket, radius, parent, edges)
    return parent, edges


def linked_sets(sets: list[np.ndarray], similarity: float, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets that hold the groups of similar sets together; all pairs are compared (with ``group``, those of two groups)."""
    n = len(sets)
    if not n:
        return []
    size = np.array([len(x) for x in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
    column = np.cumsum(new) - 1
    if group is None:
        shared = np.bincount(column) > 1 if len(column) else np.zeros(0, dtype=bool)
    else:  # what only one group has adds nothing to pairs of two
        first = np.flatnonzero(new)
        shared = np.minimum.reduceat(group[of], first) < np.maximum.reduceat(group[of], first) if len(first) else new
    keep = shared[column]
    column, of = (np.cumsum(shared) - 1)[column[keep]], of[keep]
    both = np.zeros((n, n), dtype=np.float32)
    for first in range(0, int(shared.sum()), 2048):  # exact: counts stay far below the precision of a float
        a, b = np.searchsorted(column, [first, first + 2048])
        block = np.zeros((n, 2048), dtype=np.float32)
        block[of[a:b], column[a:b] - first] = 1
        both += block @ block.T
    alike = np.triu(both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6, 1)
    x, y = np.nonzero(alike if group is None else alike & (group[:, None] != group[None, :]))
    parent, edges = np.arange(n), []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = _root(parent, i), _root(parent, j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            edges.append((i, j))
    return edges


def _cuts(texts: str, entries: str, most_entries: int) -> Column:
    """Parts that bound both the texts and the shingles of each."""
    return F.ceil(F.greatest(F.col(texts) / WHOLE_TEXTS, F.col(entries) / most_entries)).cast("long")


def _within(texts: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` that link most of each large cluster (``texts``: sig, cluster, n): its texts are dealt to parts by chance, and its hubs to all parts."""
    size = texts.groupBy("cluster").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("entries")).select("cluster", _cuts("texts", "entries", WHOLE_SHINGLES // 2).alias("cuts"))
    dealt = texts.join(size, "cluster").select("cluster", "sig", F.pmod(F.xxhash64("sig", F.lit(4)), F.col("cuts")).alias("part"))
    degree = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select("b")).groupBy("sig").count()
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("count").desc(), "sig"))
    hubs = texts.select("cluster", "sig").join(degree, "sig").withColumn("rank", rank).filter(F.col("rank") <= HUBS)
    everywhere = hubs.join(size, "cluster").select("cluster", "sig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("part"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sig").sort_values("sig")
        sig = pdf["sig"].to_numpy()
        found = linked_sets([np.asarray(x, dtype=np.int64) for x in pdf["set"]], similarity)
        return pd.DataFrame([(int(sig[i]), int(sig[j])) for i, j in found], columns=["a", "b"], dtype=np.int64)

    return dealt.unionByName(everywhere).distinct().join(sets, "sig").groupBy("cluster", "part").applyInPandas(compare, "a long, b long")


def _across(texts: DataFrame, linked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of similar sets of a cluster (``texts``: sig, cluster, n) that the links leave apart.

    The groups that the links make are cut in parts, small groups are put together, and every two parts are
    compared whole but those of one group.  So no task has more than two parts, and a cluster
    that the links nearly hold together costs its rest times its size.
    """
    labels = components(texts.select(F.col("sig").alias("node")), linked)
    named = texts.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "cluster", "n", F.coalesce("label", "sig").alias("group"))
    named = written(named, "groups")
    part_entries = WHOLE_SHINGLES // 2
    groups = named.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("entries"))
    groups = groups.withColumn("alone", (F.col("texts") > WHOLE_TEXTS // 2) | (F.col("entries") > part_entries // 2)).withColumn("cuts", _cuts("texts", "entries", part_entries))
    groups = written(groups, "group-sizes")
    whole = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.when(~F.col("alone"), F.col("texts"))).alias("rest"), F.sum(F.when(~F.col("alone"), F.col("entries"))).alias("rest_entries"))
    whole = whole.filter("groups > 1").select("cluster", _cuts("rest", "rest_entries", part_entries).alias("rest_cuts"))
    own = F.xxhash64("cluster", "group", F.pmod(F.xxhash64("sig", F.lit(5)), F.col("cuts")))
    mixed = F.xxhash64("cluster", F.lit("rest"), F.pmod(F.xxhash64("group", F.lit(6)), F.col("rest_cuts")))
    placed = named.join(groups.select("cluster", "group", "alone", "cuts"), ["cluster", "group"]).join(whole, "cluster")
    placed = written(placed.select("sig", "cluster", "group", F.when(F.col("alone"), own).otherwise(mixed).alias("part"), F.when(F.col("alone"), F.col("group")).alias("only")), "parts")
    parts = placed.select("cluster", "part", "only").distinct()
    other = parts.select("cluster", F.col("part").alias("part2"), F.col("only").alias("only2"))
    # A row a pair of parts, not of texts.
    meet = parts.join(other, "cluster").filter((F.col("part") <= F.col("part2")) & ~F.coalesce(F.col("only") == F.col("only2"), F.lit(False)))
    meet = meet.select(F.xxhash64("part", "part2").alias("block"), F.explode(F.array_distinct(F.array("part", "part2"))).alias("part"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sig").sort_values("sig")
        sig, group = pdf["sig"].to_numpy(), np.unique(pdf["group"].to_numpy(), return_inverse=True)[1]
        found = linked_sets([np.asarray(x, dtype=np.int64) for x in pdf["set"]], similarity, group)
        return pd.DataFrame([(int(sig[i]), int(sig[j])) for i, j in found], columns=["a", "b"], dtype=np.int64)

    members = placed.select("sig", "group", "part").join(sets, "sig")
    return members.join(meet, "part").groupBy("block").applyInPandas(compare, "a long, b long")


def _candidates(rows: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of texts that share a leading shingle and have near fingerprints, and the rows (``sig, place, key``) of shared keys.

    A bucket (``key``) of at most ``part_rows`` rows is compared whole.  A larger one is cut into parts
    at random; each part's groups are held together by pairs, and one row of each group goes on to
    be compared with those of the other parts, so the work stays linear in the bucket.  What
    this leaves out, ``_met`` finds among the rows of shared keys.
    """
    spark = rows.sparkSession
    found, shared, level = None, None, rows
    while True:
        first = found is None
        counts = level.groupBy("key").count().filter(F.col("count") > part_rows)
        large = written(counts.select("key", F.ceil(F.col("count") / part_rows * 2).cast("int").alias("parts")), "large-keys")
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), level.count() // 500_000)
        part = F.xxhash64("key", F.pmod(F.xxhash64("sig", F.lit(3)), F.col("parts")))
        # A row crosses the shuffle as three numbers; only those of large buckets have the key beside.
        dealt = level.join(F.broadcast(large) if large.count() < 10_000 else large, "key", "left").select("sig", "fp", "place", F.coalesce(part, "key").alias("bucket"), F.when(F.col("parts").isNotNull(), F.col("key")).otherwise(0).alias("key"), F.col("parts").isNotNull().alias("large"))
        dealt = dealt.withColumn("shard", F.pmod("bucket", F.lit(shards)).cast("int"))

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            order = np.lexsort((pdf["sig"].to_numpy(), pdf["fp"].to_numpy(), pdf["bucket"].to_numpy()))
            bucket = pdf["bucket"].to_numpy()[order]
            # Most shingles are in one text only.
            same = bucket[1:] == bucket[:-1]
            cut = pdf["large"].to_numpy(dtype=bool)[order]
            with_other = np.append(same, False) | np.append(False, same) if len(bucket) else cut
            whole = order[with_other | cut] if first else order[:0]
            order, inside = order[with_other], cut[with_other]
            keys = np.where(pdf["large"].to_numpy(dtype=bool), pdf["key"].to_numpy(), pdf["bucket"].to_numpy())
            bucket, fp, sig = (pdf[c].to_numpy()[order] for c in ("bucket", "fp", "sig"))
            key = keys[order]
            parent, edges = spanning(np.ascontiguousarray(fp).view("<u8"), bucket)
            x, y = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
            again = np.unique(parent[x][inside[x]]) if len(x) else x
            none = lambda rows: np.zeros(len(rows), dtype=np.int64)
            return pd.concat([
                pd.DataFrame({"a": sig[x], "b": sig[y], "key": none(x), "fp": none(x), "kind": none(x)}),
                pd.DataFrame({"a": sig[again], "b": sig[again], "key": key[again], "fp": fp[again], "kind": none(again) + 1}),
                pd.DataFrame({"a": pdf["sig"].to_numpy()[whole], "b": pdf["place"].to_numpy()[whole].astype(np.int64), "key": keys[whole], "fp": none(whole), "kind": none(whole) + 2}),
            ])

        out = written(dealt.groupBy("shard").applyInPandas(compare, "a long, b long, key long, fp long, kind long"), "candidates")
        shared = out.filter("kind = 2").select(F.col("a").alias("sig"), F.col("b").alias("place"), "key") if first else shared
        pairs = out.filter("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = pairs if found is None else found.union(pairs)
        level = out.filter("kind = 1").select("key", F.col("a").alias("sig"), "fp", F.lit(0).alias("place"))
        if level.isEmpty():
            return written(found.filter("a <> b").distinct(), "pairs"), shared


def spread(hashes: np.ndarray) -> np.ndarray:
    """How many of a set's shingles are in each of equal ranges of their hashes, four or fewer a range on average; 255 stands for more."""
    bits = max(4, int(len(hashes) / 4).bit_length())
    return np.minimum(np.bincount((hashes.view("<u8") >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def unshared(a: np.ndarray, b: np.ndarray) -> int:
    """The least number of shingles that only one of two sets has, from their spreads."""
    n = min(len(a), len(b))
    a, b = (np.minimum(x.reshape(n, -1).sum(axis=1, dtype=np.int64), 255) for x in (a, b))
    return int(np.abs(a - b).sum())


def _least_shared(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles two similar sets of these sizes share, at least."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-6)


def meeting(bucket: np.ndarray, n: np.ndarray, place: np.ndarray, cluster: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (sorted by bucket and size) of a bucket that may be similar and are not of one cluster.

    Their sizes allow it, and so does what is left of both from the shingle that they share on: the first one that
    two similar texts share is such a one.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows, step = np.arange(len(bucket)), 1
    while len(rows):
        rows = rows[rows + step < len(bucket)]
        rows = rows[(bucket[rows] == bucket[rows + step]) & (n[rows] >= similarity * n[rows + step] - 1e-6)]
        x, y = rows, rows + step
        left = np.minimum(n[x] - place[x], n[y] - place[y])
        may = (left >= _least_shared(n[x], n[y], similarity)) & (cluster[x] != cluster[y])
        found.append((x[may], y[may]))
        step += 1
    return tuple(np.concatenate([f[k] for f in found]) if found else rows for k in (0, 1))


def _met(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of texts (``shared``: sig, place, key, n, cluster) that share a leading shingle, are of no common cluster and may be similar.

    A cluster goes by the ``sig`` of one of its texts; null: none.  All pairs of a key are looked at; a large one is cut in parts, and every two parts meet in a call of their own.
    """
    spark = shared.sparkSession
    shared = written(shared.select("sig", "place", "key", "n", "cluster"), "shared")
    large = shared.groupBy("key").count().filter(F.col("count") > MEET_ROWS).select("key", F.ceil(F.col("count") / MEET_ROWS).cast("int").alias("parts"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shared.count() // 100_000)
    own = F.pmod(F.xxhash64("sig", F.lit(8)), F.col("parts")).cast("int")
    blocks = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("lo"), F.greatest(p, F.col("own")).alias("hi")))
    )
    dealt = shared.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    dealt = dealt.select("sig", "place", "key", "n", F.coalesce("cluster", "sig").alias("cluster"), F.explode(blocks).alias("block"))
    dealt = dealt.select("sig", "place", "n", "cluster", F.xxhash64("key", "block.lo", "block.hi").alias("bucket")).withColumn("shard", F.pmod("bucket", F.lit(shards)).cast("int"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["n"].to_numpy(), pdf["bucket"].to_numpy()))
        bucket, n, place, cluster, sig = (pdf[c].to_numpy()[order] for c in ("bucket", "n", "place", "cluster", "sig"))
        x, y = meeting(bucket, n.astype(np.int64), place.astype(np.int64), cluster, similarity)
        return pd.DataFrame({"a": np.minimum(sig[x], sig[y]), "b": np.maximum(sig[x], sig[y])}).drop_duplicates()

    return dealt.groupBy("shard").applyInPandas(compare, "a long, b long").filter("a <> b").distinct()


def _not_apart(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose spreads (``texts``: sig, n, spread) do not rule out that they are similar."""
    side = lambda c: texts.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("spread").alias(f"spread_{c}"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n, m = rb.column("n_a").to_numpy().astype(np.int64), rb.column("n_b").to_numpy().astype(np.int64)
            most = n + m - 2 * _least_shared(n, m, similarity)
            near = [unshared(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(rb.column("spread_a").to_pylist(), rb.column("spread_b").to_pylist(), strict=True)]
            yield rb.select(["a", "b"]).filter(pa.array(np.array(near, dtype=np.int64) <= most))

    return written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long"), "far-pairs")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose whole sets are similar."""
    side = lambda c: sets.select(F.col("sig").alias(c), F.col("set").alias(f"set_{c}"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            like = []
            for x, y in zip(rb.column("set_a"), rb.column("set_b"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                like.append(both >= similarity * (len(x) + len(y) - both) - 1e-6)
            yield rb.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY, part_rows: int = PART_ROWS) -> DataFrame:
    """``id_col`` and ``component_id``: the smallest id that links of similar texts reach, for rows with an id.

    Similarity is the Jaccard index of the sets of word shingles.  Texts of one set are similar; of
    others those with a near fingerprint among the texts that share a leading shingle are candidates.
    Which shingles lead is a matter of balance only: any order does, and common shingles come last,
    so that a passage that many texts share makes no large bucket.  Texts that candidates connect
    are compared by their whole sets: all with all in clusters of up to ``WHOLE_TEXTS``.  Larger
    ones are cut in parts, each compared whole with the ``HUBS`` that most candidates share; what that
    leaves apart is compared between parts, so the size of a cluster changes no link.

    Fingerprints only find most links at little cost.  All other pairs that share a leading shingle, as similar
    texts must, are looked at too: sizes, the place of the shingle and how the shingles spread
    over ranges of hashes rule out pairs that cannot be similar, and the whole sets of the rest are compared.
    So the links are those of all pairs.

    Null ids have no row.  A null text is an empty text; texts without words are alike.  Rows of
    one id with different texts fall in one component.
    """
    spark = docs.sparkSession
    short_batches(spark)
    safe_unions(spark)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
    kind = docs.schema[id_col].dataType.simpleString()

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sets = [shingle_set(t, shingle) for t in text_bytes(rb, "text")]
            flat = np.concatenate([np.zeros(0, dtype="<u8"), *sets]).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array([i == 0 for i in range(len(flat))], pa.bool_())], names=["key", "first"])

    sample = rows.filter(F.pmod(F.xxhash64("doc", F.lit(11)), F.lit(SAMPLE)) == 0)
    often = sample.select("text").mapInArrow(hashes, "key long, first boolean").groupBy("key").count().filter(F.col("count") >= LEAST_COMMON)
    often = often.orderBy(F.col("count").desc(), "key").limit(MOST_COMMON).select("key", F.col("count").cast("int").alias("n")).toArrow()
    common, seen = often["key"].to_numpy().view("<u8"), often["n"].to_numpy()
    by_hash = np.argsort(common)
    common, seen = common[by_hash], seen[by_hash]

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sets = [shingle_set(t, shingle) for t in text_bytes(rb, "text")]
            sig = np.array([_signature(h) for h in sets], dtype="<u8").view("<i8")
            fp = np.array([_print_of(h) if len(h) else 0 for h in sets], dtype="<u8").view("<i8")
            keys = [leading(h, common, seen, similarity).view("<i8") for h in sets]
            sizes = pa.array([len(h) for h in sets], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc"), pa.array(sig), pa.array(fp), sizes, pa.array(keys, pa.list_(pa.int64())), pa.array([spread(h).tobytes() for h in sets], pa.binary())],
                names=["doc", "sig", "fp", "n", "keys", "spread"],
            )

    found = written(rows.mapInArrow(prints, f"doc {kind}, sig long, fp long, n int, keys array<long>, spread binary"), "prints")
    distinct = written(found.groupBy("sig").agg(F.min("doc").alias("node"), F.first("n").alias("n"), F.first("spread").alias("spread")), "distinct")
    first = distinct.select(F.col("sig").alias("own"), "node")
    one = found.select("doc", "sig", "fp", "keys").join(first, (F.col("doc") == F.col("node")) & (F.col("sig") == F.col("own")), "left_semi")
    one = written(one.select("sig", "fp", "keys"), "leading")
    pairs, shared = _candidates(one.select("sig", "fp", F.posexplode("keys").alias("place", "key")), part_rows)

    # Texts that candidates connect are a cluster.  Clusters of a bounded size are compared whole.
    need = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    cluster = components(need, pairs).select(F.col("node").alias("sig"), F.col("label").alias("cluster"))
    need = written(distinct.drop("spread").join(cluster, "sig"), "needed")
    size = need.groupBy("cluster").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("entries"))
    size = written(size.select("cluster", "entries", ((F.col("texts") > WHOLE_TEXTS) | (F.col("entries") > WHOLE_SHINGLES)).alias("large")), "clusters")
    entries = size.filter("not large").agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // WHOLE_SHINGLES)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sets = [shingle_set(t, shingle) for t in text_bytes(rb, "text")]
            own = np.array([_signature(h) for h in sets], dtype="<u8").view("<i8") == rb.column("sig").to_numpy()  # an id may have other texts too
            kept = rb.filter(pa.array(own))
            yield pa.RecordBatch.from_arrays([kept.column("sig"), kept.column("cluster"), kept.column("large"), pa.array([h.view("<i8") for h, ok in zip(sets, own, strict=True) if ok], pa.list_(pa.int64()))], names=["sig", "cluster", "large", "set"])

    # Whole sets of the texts in clusters only.
    wanted = need.join(size.select("cluster", "large"), "cluster").select(F.col("node").alias("doc"), "sig", "cluster", "large")
    sets = written(rows.join(wanted, "doc").select("text", "sig", "cluster", "large").mapInArrow(whole, "sig long, cluster long, large boolean, set array<long>"), "sets")

    def join_whole(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        pdf = pdf.drop_duplicates("sig").sort_values(["cluster", "sig"])
        for _, own in pdf.groupby("cluster", sort=False):
            sig, sets = own["sig"].to_numpy(), [np.asarray(x, dtype=np.int64) for x in own["set"]]
            found += [(int(sig[i]), int(sig[j])) for i, j in linked_sets(sets, similarity)]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    small = sets.filter("not large").select("sig", "cluster", "set", F.pmod(F.xxhash64("cluster"), F.lit(shards)).cast("int").alias("shard"))
    linked = small.groupBy("shard").applyInPandas(join_whole, "a long, b long")
    # Larger ones by parts, each with the texts that are in most candidates; then what that leaves apart.
    sets = sets.filter("large").select("sig", "set").dropDuplicates(["sig"])
    in_large = written(wanted.filter("large").select("sig", "cluster").join(need.select("sig", "n"), "sig"), "in-large")
    apart: list[DataFrame] = []
    if not in_large.isEmpty():
        held = written(_within(in_large, pairs, sets, similarity), "held-pairs")
        apart = [held, _across(in_large, held, sets, similarity)]
    # What no cluster holds together: the other pairs that share a leading shingle.
    met = _met(shared.join(distinct.select("sig", "n"), "sig").join(need.select("sig", "cluster"), "sig", "left"), similarity)
    far = _not_apart(met, distinct.select("sig", "n", "spread"), similarity)
    ends = far.select(F.col("a").alias("sig")).union(far.select("b")).distinct()
    alone = F.lit(0).cast("long").alias("cluster"), F.lit(False).alias("large")
    ends = rows.join(ends.join(distinct.select("sig", F.col("node").alias("doc")), "sig"), "doc").select("text", "sig", *alone)
    ends = written(ends.mapInArrow(whole, "sig long, cluster long, large boolean, set array<long>"), "far-sets").select("sig", "set").dropDuplicates(["sig"])
    linked = written(reduce(DataFrame.union, [linked, *apart, _alike(far, ends, similarity)]), "similar-pairs")

    names = lambda c, n: distinct.select(F.col("sig").alias(c), F.col("node").alias(n))
    edges = linked.join(names("a", "p"), "a").join(names("b", "q"), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    # An id with several texts joins them.
    twice = found.select("doc", "sig").join(distinct, "sig").filter("doc <> node").select(F.col("node").alias("a"), F.col("doc").alias("b"))
    twice = twice.join(found.groupBy("doc").agg((F.min("sig") < F.max("sig")).alias("several")).filter("several").select(F.col("doc").alias("b")), "b", "left_semi").select("a", "b")
    labels = components(distinct, edges.union(twice).distinct())
    classes = distinct.join(labels, "node", "left").select("sig", F.coalesce("label", "node").alias("component_id"))
    return found.select("doc", "sig").join(classes, "sig").select(F.col("doc").alias(id_col), "component_id")
