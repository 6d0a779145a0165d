"""Repeated byte strings across documents, by a run-length BWT index and matching statistics.

``remove_repeats`` marks each byte covered by a string of ``length`` bytes that also starts in
a document with a smaller id, and cuts those bytes out.

1. Anchors.  Of the ``ANCHOR``-byte strings in each window of ``length`` bytes the one with the
   smallest hash is an anchor, so equal windows have equal anchors at equal places.  An anchor's
   context is all that windows around it can reach.  A part of the text sends each different
   (anchor, context) once, for its smallest document; later copies in the part are already known
   to be covered.
2. A shard of anchors tells, for each anchor, which documents repeat a whole context of a smaller
   document (covered), and which share the anchor with other contexts only (to be compared).
3. The contexts to be compared, and only those, go to their shard as bytes.  There a run-length
   BWT with samples at both ends of its runs is built over the different contexts, beside the
   ranges of its rows that start with one recurring string of ``length`` bytes and the smallest
   document of each.  All contexts are streamed through it for matching statistics; a match of
   ``length`` bytes or more ends in a row, and the range of that row tells whether a smaller
   document has the string.  Which rows belong together comes from the ranks of the suffix sort,
   so bytes are compared and not hashes of them.
4. A last pass merges the spans of each document and cuts them.

Steps 2 and 3 leave their spans in sorted files in the shared folder, which the next pass maps;
texts are never shuffled.  Contexts count as equal in step 2 when 64 bits of the anchor and 48 of
the context agree.

Defined results: null text is an empty text, which keeps nothing and loses nothing.  Documents
of one id never cover one another; of those, rows whose texts agree in 32 bits of their hash are
taken for repeated rows.  A null id is larger than all others (and equal to the largest long).
Ids that are not whole numbers are numbered in their order first, which takes a join on the id.
Strings do not cross documents.  Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.shared import MappedFolder, mix, pack, put_arrays, scratch, sharded, short_batches, text_bytes, unpack, unused, written

LENGTH, ANCHOR = 50, 20
#: Text bytes for one shard, bytes hashed at once, bytes whose anchors are counted together.
SHARD_BYTES, PIECE, CHUNK_BYTES = 8_000_000, 1 << 19, 16_000_000
COVERED, COMPARE = 1, 2
_ODD, _SIGN = np.uint64(0x9E3779B97F4A7C15), np.uint64(1 << 63)
_BASE = 0x5851F42D4C957F2D
_BYTE = mix(np.arange(1, 257, dtype="<u8") * _ODD)


# ---------------------------------------------------------------- the index


def suffix_array(codes: np.ndarray, strings: bool = False, depth: int = 0) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Suffix array by prefix doubling; the first seven codes (below 257) are sorted at once.

    Beside it the ranks of all suffixes by their first ``d`` codes, and ``d``: the largest of the
    compared lengths that is not over ``depth`` (none if suffixes differ before).

    With ``strings``, zeros end strings and all differ, the earlier the smaller: suffixes are
    compared up to their first zero and then by place, so sorting is whole as soon as the
    compared depth is over the longest string.
    """
    n = len(codes)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([codes.astype(np.int64) + 1, np.zeros(7, dtype=np.int64)])
    ended = np.zeros(n, dtype=bool)  # the suffix has met its zero
    for k in range(7):
        own = padded[k : k + n]
        key = key * 258 + np.where(ended, 0, own)
        if strings:
            ended |= own == 1
    step, ranks, ranked_by = 7, None, 0
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.concatenate([[True], (ranked[1:] != ranked[:-1]) | ended[order[1:]]])[:n]  # a rank starts in this row
    del ranked, key
    rank = np.empty(n, dtype=np.int64)  # the first row of those with equal codes so far
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            return order, ranks, ranked_by
        if step <= depth:
            ranks, ranked_by = rank.copy(), step
        # Only tied rows are sorted on; they stay in the rows of their rank.
        own = order[tied]
        after = np.zeros(len(own), dtype=np.int64)
        more = own + step < n
        after[more] = rank[own[more] + step] + 1
        key = rank[own] * (n + 1) + after
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[tied] = own
        head[tied] = new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = np.maximum.accumulate(np.where(new, tied, 0))
        step *= 2


class RunLengthIndex:
    """Run-length BWT of a text with suffix positions sampled at both ends of each run.

    A row and its text position move together, so suffixes are in one strict order that a code
    put before them keeps.  With ``longest``, zeros end strings of at most so many codes, and no
    query has a zero: order among equal strings is by place, which that mapping keeps too, and
    no suffix need be sorted deeper than its string.
    """

    def __init__(self, codes: np.ndarray, longest: int | None = None, owner: np.ndarray | None = None, length: int = 0) -> None:
        n = len(codes)
        sa, ranks, depth = suffix_array(codes, longest is not None, length)
        bwt = codes[sa - 1]  # of the first suffix: the last code, a separator
        start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        end = np.append(start[1:], n) - 1
        self.codes, self.n = codes, n
        self.start, self.head = start, bwt[start].astype(np.int64)
        self.first_sample, self.last_sample = sa[start], sa[end]
        size = end - start + 1
        self.end = end
        # A bit for each row where a run starts, and the runs before each word of bits.
        bits = np.zeros(n + -n % 64 + 64, dtype=np.uint8)
        bits[start] = 1
        self.bits = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.bits).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones - 1
        by_head = np.argsort(self.head, kind="stable")
        # Where the last-to-first mapping sends the first row of each run.
        self.to = np.empty(len(start), dtype=np.int64)
        self.to[by_head] = np.cumsum(size[by_head]) - size[by_head]
        self.runs = len(start)
        self.keys = self.head[by_head] * self.runs + by_head
        self.by_head = by_head
        self.origin = int(sa[0])
        if owner is not None:
            self._repeats(sa, ranks, depth, owner, length)

    def _repeats(self, sa: np.ndarray, ranks: np.ndarray | None, depth: int, owner: np.ndarray, length: int) -> None:
        """The rows that start with one string of ``length`` codes, for strings that recur, and the least owner of each.

        Such rows are neighbours; two neighbours have the same ``length`` codes if both their
        first ``depth`` and their last ``depth`` of these have equal ranks.
        """
        none = np.zeros(0, dtype=np.int64)
        self.from_row, self.to_row, self.least = none, none, none.astype(owner.dtype)
        if ranks is None or 2 * depth < length:
            return
        same = np.flatnonzero(ranks[sa[1:]] == ranks[sa[:-1]])
        further = length - depth
        a, b = sa[same] + further, sa[same + 1] + further
        ok = (a < self.n) & (b < self.n)
        same = same[ok][ranks[a[ok]] == ranks[b[ok]]]
        if len(same):
            first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1] + 1]))
            last = np.append(first[1:], len(same)) - 1
            self.from_row, self.to_row = same[first], same[last] + 1
            size = self.to_row - self.from_row + 1
            at = np.cumsum(size) - size
            rows = np.repeat(self.from_row - at, size) + np.arange(size.sum())
            self.least = np.minimum.reduceat(owner[sa[rows]], at)

    def least_owner(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The least owner of the string at each row, or ``own`` where it does not recur."""
        if not len(self.from_row):
            return own
        at = np.searchsorted(self.from_row, rows, "right") - 1
        inside = (at >= 0) & (rows <= self.to_row[at])
        return np.where(inside, self.least[at], own)

    def run_of(self, rows: np.ndarray) -> np.ndarray:
        """The run of each row, by counting bits."""
        word = rows >> 6
        upto = ~np.uint64(0) >> (np.uint64(63) - (rows & 63).astype("<u8"))
        return self.before[word] + np.bitwise_count(self.bits[word] & upto)

    def matching_statistics(self, queries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match from each place, and a text position where it occurs."""
        return self.stream(queries, sizes)[:2]

    def stream(self, queries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length of the longest match from each place, a text position where it occurs, and the row of that suffix.

        ``queries``: codes, one row for each query, aligned at the right; ``sizes``: their lengths.
        Codes run from right to left through the last-to-first mapping; at a mismatch the search
        goes on from the nearer end of the run before or after that has the longer common string.
        """
        m, width = queries.shape
        length = np.zeros((m, width), dtype=np.int32)
        place, rows = np.zeros((2, m, width), dtype=np.int64)
        row = np.zeros(m, dtype=np.int64)
        text = np.full(m, self.origin, dtype=np.int64)
        size = np.zeros(m, dtype=np.int64)
        for i in range(width - 1, -1, -1):
            live = np.flatnonzero(sizes >= width - i)
            if not len(live):
                break
            c = queries[live, i].astype(np.int64)
            run = self.run_of(row[live])
            same = self.head[run] == c
            at = live[same]
            row[at] = self.to[run[same]] + row[at] - self.start[run[same]]
            text[at] -= 1
            size[at] += 1
            if not same.all():
                self._jump(queries, i, live[~same], c[~same], run[~same], row, text, size)
            length[live, i], place[live, i], rows[live, i] = size[live], text[live], row[live]
        return length, place, rows

    def _jump(self, queries: np.ndarray, i: int, at: np.ndarray, c: np.ndarray, run: np.ndarray, row: np.ndarray, text: np.ndarray, size: np.ndarray) -> None:
        j = np.searchsorted(self.keys, c * self.runs + run)
        best = np.full(len(at), -1, dtype=np.int64)
        for shift, sample, last in ((-1, self.last_sample, True), (0, self.first_sample, False)):
            k = j + shift
            ok = (k >= 0) & (k < self.runs)
            ok[ok] &= self.head[self.by_head[k[ok]]] == c[ok]
            rows = np.flatnonzero(ok)
            other = self.by_head[k[rows]]
            common = self._common(sample[other], queries, i + 1, at[rows], size[at[rows]])
            better = common > best[rows]
            rows, other, common = rows[better], other[better], common[better]
            best[rows] = common
            inside = self.end[other] - self.start[other] if last else 0
            row[at[rows]] = self.to[other] + inside
            text[at[rows]] = sample[other] - 1
        size[at] = best + 1
        lost = at[best < 0]  # the code does not occur in the text
        row[lost], text[lost], size[lost] = 0, self.origin, 0

    def _common(self, place: np.ndarray, queries: np.ndarray, i: int, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common string of the text from ``place`` and the queries from column ``i``."""
        out = np.zeros(len(at), dtype=np.int64)
        live = np.arange(len(at))
        for k in range(queries.shape[1] - i):
            live = live[(most[live] > k) & (place[live] + k < self.n)]
            live = live[self.codes[place[live] + k] == queries[at[live], i + k]]
            if not len(live):
                break
            out[live] += 1
        return out


# ---------------------------------------------------------------- anchors

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                _POWERS[name] = np.cumprod(np.concatenate([np.ones(1, dtype="<u8"), np.full(n, base, dtype="<u8")]))
    return _POWERS["up"], _POWERS["down"]


def _slide(a: np.ndarray, width: int, f: Callable) -> np.ndarray:
    """For each place, ``f`` over the next ``width`` values (fewer at the end)."""
    out, done = a.copy(), 1
    while done * 2 <= width:
        out[:-done] = f(out[:-done], out[done:])
        done *= 2
    if rest := width - done:
        out[:-rest] = f(out[:-rest], out[rest:])
    return out


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts in groups of about ``PIECE`` bytes; rows: document, offset in it, first and past last window start."""
    group, rows, held = [], [], 0
    for d, t in enumerate(texts):
        for s in range(0, len(t) - length + 1, PIECE):
            a, b = max(0, s - 2 * length), min(len(t), s + PIECE + 3 * length)
            part = t if a == 0 and b == len(t) else t[a:b]
            group.append(part)
            rows.append((d, a, s - a, min(s + PIECE, len(t) - length + 1) - a))
            held += len(part)
            if held >= PIECE:
                yield group, np.array(rows, dtype=np.int64)
                group, rows, held = [], [], 0
    if group:
        yield group, np.array(rows, dtype=np.int64)


def anchors(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> list[np.ndarray]:
    """Document number, place, anchor hash and context hash (48 bits) of all anchors."""
    reach, found = length - anchor, []
    for group, rows in _pieces(texts, length):
        data = np.frombuffer(b"".join(group), dtype=np.uint8)
        n = len(data)
        size = np.array([len(g) for g in group], dtype=np.int64)
        past = np.cumsum(size)
        first = past - size
        up, down = _powers(n)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, dtype="<u8"), np.cumsum(_BYTE[data] * up[:n])])
            h = mix((total[anchor:] - total[:-anchor]) * down[: n - anchor + 1])
        least = _slide(h, reach + 1, np.minimum)
        ok = np.zeros(len(h) + 1, dtype=np.int8)
        np.add.at(ok, np.minimum(first + rows[:, 2], len(h)), 1)
        np.add.at(ok, np.minimum(first + rows[:, 3], len(h)), -1)
        least[np.cumsum(ok[:-1]) == 0] = 0
        most = _slide(np.concatenate([np.zeros(reach, dtype="<u8"), least]), reach + 1, np.maximum)[: len(h)]
        p = np.flatnonzero((most == h) & (h > 0))
        g = np.searchsorted(past, p, "right")
        # Only where windows of this piece can reach; a string of the text before may have matched.
        p, g = (c[(p >= first[g] + rows[g, 2]) & (p < first[g] + rows[g, 3] + reach)] for c in (p, g))
        a, b = np.maximum(first[g], p - reach), np.minimum(past[g], p + length)
        with np.errstate(over="ignore"):
            context = mix((total[b] - total[a]) * down[a] + (p - a).astype("<u8") * _ODD) >> np.uint64(16)
        found.append([rows[g, 0], p - first[g] + rows[g, 1], h[p], context])
    if not found:
        return [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<u8")]
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def anchor_hash(strings: np.ndarray) -> np.ndarray:
    """The hash of anchors given as rows of bytes."""
    up, _ = _powers(strings.shape[1])
    with np.errstate(over="ignore"):
        return mix((_BYTE[strings] * up[: strings.shape[1]]).sum(axis=1, dtype="<u8"))


# ---------------------------------------------------------------- rows of documents


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as unsigned numbers of the same order; null is the largest."""
    raw = np.array([(1 << 63) - 1 if v is None else int(v) for v in column.to_pylist()], dtype=np.int64)
    return raw.view("<u8") ^ _SIGN


def _tags(texts: list[bytes]) -> np.ndarray:
    """Bits of each text, to tell rows of one id apart."""
    import xxhash

    return np.array([xxhash.xxh32_intdigest(t) for t in texts], dtype="<u8")


def _key(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(ids * _ODD + tags)


def _in_order(a: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by anchor, context, document; most anchors are one row, so only ties are sorted by all three."""
    order = np.argsort(a)
    ranked = a[order]
    same = ranked[1:] == ranked[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(a) else order
    own = order[tied]
    order[tied] = own[np.lexsort((ids[own], x[own], a[own]))]
    return order


ROW = "kind string, shard int, block binary"
_NONE = pd.DataFrame({"kind": [], "shard": [], "block": []}, dtype=object).astype({"shard": "int32"})


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.string()), "shard": pa.array([r[1] for r in rows], pa.int32()), "block": pa.array([r[2] for r in rows], pa.binary())})


def _frame(rows: list[tuple[str, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "shard", "block"]) if rows else _NONE


def _delta(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0))


def _to_documents(ids: np.ndarray, tags: np.ndarray, *values: np.ndarray, shards: int) -> list[tuple[str, int, bytes]]:
    """Blocks of (id, tag, values) for the shards of documents."""
    out = []
    for s, rows in sharded((mix(ids) % np.uint64(shards)).astype(np.int64), shards):
        rows = rows[np.lexsort((values[0][rows], tags[rows], ids[rows]))]
        out.append(("document", s, pack(_delta(ids[rows]), tags[rows], *[v[rows].astype("<u8") for v in values])))
    return out


def _store(folder: str, name: str, width: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Write a shard's rows as arrays sorted by document: keys, first rows, values."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b, 2 + width) for b in rows["block"]]
        of = _key(np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]))
        values = [np.concatenate([p[2 + i] for p in parts]) for i in range(width)]
        order = np.argsort(of, kind="stable")
        of = of[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        put_arrays(f"{folder}/{name}-{int(key[1])}.bin", [of[first], np.append(first, len(of)), *[v[order].astype("<u4") for v in values]])
        return pd.DataFrame({"n": [len(of)]})

    return write


class Spans:
    """Reads what ``_store`` wrote."""

    def __init__(self, folder: str, name: str, shards: int) -> None:
        self.files, self.name, self.shards = MappedFolder(folder), name, shards

    def of(self, number: np.uint64, key: np.uint64) -> list[np.ndarray] | None:
        s = int(mix(np.array([number]))[0] % np.uint64(self.shards))
        f = self.files.get(f"{self.name}-{s}")
        if f is None:
            return None
        at = int(np.searchsorted(f[0], key))
        if at == len(f[0]) or f[0][at] != key:
            return None
        return [v[int(f[1][at]) : int(f[1][at + 1])] for v in f[2:]]


# ---------------------------------------------------------------- the steps


def _share(shards: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Step 2: a shard of anchors; rows of documents pass."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] == "document":
            return rows
        parts = [unpack(b, 5) for b in rows["block"]]
        a, x, ids, tags, at = (np.concatenate([np.cumsum(p[0]) if i == 0 else p[i] for p in parts]) for i in range(5))
        del parts
        order = _in_order(a, x, ids)
        a, x, ids, tags, at = a[order], x[order], ids[order], tags[order], at[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_x = new_a | np.concatenate([[True], x[1:] != x[:-1]])
        edge_a, edge_x = np.flatnonzero(new_a), np.flatnonzero(new_x)
        of_a, of_x = np.cumsum(new_a) - 1, np.cumsum(new_x) - 1
        smallest = ids[edge_x][of_x]
        several = np.add.reduceat(new_x.astype(np.int64), edge_a) > 1
        apart = np.minimum.reduceat(ids, edge_a) < np.maximum.reduceat(ids, edge_a)
        what = np.where(ids > smallest, COVERED, np.where((several & apart)[of_a], COMPARE, 0))
        use = np.flatnonzero(what)
        return _frame(_to_documents(ids[use], tags[use], at[use], what[use], shards=shards))

    return reduce


def _distinct(strings: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    seen: dict[bytes, int] = {}
    of = np.array([seen.setdefault(s, len(seen)) for s in strings], dtype=np.int64)
    return list(seen), of


def repeated_windows(contexts: list[bytes], left: np.ndarray, ids: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> list[np.ndarray]:
    """Row, first and past last byte of all windows of the contexts that a smaller document has.

    ``left``: bytes before the anchor in each context; ``ids``: the documents, equal for equal
    contexts (of those only the rows of the smallest document are compared).
    """
    none = [np.zeros(0, dtype=np.int64)] * 3
    strings, of = _distinct([bytes([v]) + c for v, c in zip(left.tolist(), contexts, strict=True)])
    if len(strings) < 2:
        return none
    least = np.full(len(strings), ~np.uint64(0))
    np.minimum.at(least, of, ids)
    # A window reaches half its rest to the left or to the right of the anchor: one such half must recur.
    half = (length - anchor) // 2
    halves: dict[tuple[int, bytes], int] = {}
    sides = []
    for s in strings:
        v, c = s[0], s[1:]
        own = [(0, c[v - half : v + anchor])] if v >= half else []
        own += [(1, c[v : v + anchor + half])] if len(c) - v - anchor >= half else []
        sides.append(own)
        for h in own:
            halves[h] = halves.get(h, 0) + 1
    use = [i for i, own in enumerate(sides) if any(halves[h] > 1 for h in own)]
    del halves, sides
    if len(use) < 2:
        return none
    size = np.array([len(strings[i]) - 1 for i in use], dtype=np.int64)
    text = np.frombuffer(b"".join(strings[i][1:] for i in use), dtype=np.uint8)
    first = np.cumsum(size) - size
    width = int(size.max())
    codes = np.zeros(len(text) + len(use), dtype=np.uint16)  # zero ends each context
    codes[np.arange(len(text)) + np.repeat(np.arange(len(use)), size)] = text.astype(np.uint16) + 1
    begin = first + np.arange(len(use))
    owner = least[np.array(use)]
    index = RunLengthIndex(codes, width, np.repeat(owner, size + 1), length)
    out_of, out_at = [], []
    for k in range(0, len(use), 1 << 14):
        part = np.arange(k, min(k + (1 << 14), len(use)))
        queries = np.zeros((len(part), width), dtype=np.uint16)
        for row, i in enumerate(part.tolist()):
            queries[row, width - size[i] :] = codes[begin[i] : begin[i] + size[i]]
        match, _, rows = index.stream(queries, size[part])
        q, at = np.nonzero(match >= length)
        own = owner[part[q]]
        older = index.least_owner(rows[q, at], own) < own
        out_of.append(np.array(use)[part[q[older]]])
        out_at.append(at[older] - (width - size[part[q[older]]]))
    covered_of, covered_at = np.concatenate(out_of), np.concatenate(out_at)
    # Back to the rows of each context: only those of its smallest document are compared here.
    rows_of = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[rows_of], np.arange(len(strings) + 1))
    count = (edges[1:] - edges[:-1])[covered_of]
    pick = np.repeat(edges[covered_of], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(covered_at, count)
    return [rows_of[pick], at, at + length]


def _compare(shards: int, length: int, anchor: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Step 3: contexts of one shard of anchors."""
    import zstandard

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts, contexts = [], []
        for block, data in zip(rows["block"], rows["bytes"], strict=True):
            p = unpack(block, 5)
            raw = zstandard.ZstdDecompressor().decompress(data)
            ends = np.cumsum(p[4]).astype(np.int64).tolist()
            contexts += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            parts.append(p)
        ids, tags, start, left = (np.concatenate([p[i] for p in parts]) for i in range(4))
        row, a, b = repeated_windows(contexts, left, ids, length, anchor)
        if not len(row):
            return _NONE
        # Windows of one row that overlap are one span.
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], b[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (a[1:] > b[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        own = row[first]
        return _frame(_to_documents(ids[own], tags[own], start[own] + a[first].astype("<u8"), start[own] + b[last].astype("<u8"), shards=shards))

    return reduce


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> tuple[str, int]:
    """Steps 1 to 3: the folder with the covered spans of all documents, and its number of shards."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(4, -(-size // shard_bytes))
    folder = scratch(spark, "repeats")
    reach = length - anchor

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            a, x, ids, tags, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = _in_order(a, x, ids)
            a, x, ids, tags, at = a[order], x[order], ids[order], tags[order], at[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (x[1:] != x[:-1])])[: len(a)]
            again = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
            out = _to_documents(ids[again], tags[again], at[again], np.full(int(again.sum()), COVERED), shards=shards)
            a, x, ids, tags, at = (c[~again] for c in (a, x, ids, tags, at))
            for s, pick in sharded((a % np.uint64(shards)).astype(np.int64), shards):
                out.append(("anchor", s, pack(_delta(a[pick]), x[pick], ids[pick], tags[pick], at[pick])))
            return _batch(out)

        for rb in batches:
            texts = text_bytes(rb, "text")
            d, at, a, x = anchors(texts, length, anchor)
            ids, tags = _ids(rb.column("id")), _tags(texts)
            parts.append([a, x, ids[d], tags[d], at.astype("<u8")])
            held += sum(map(len, texts))
            if held >= CHUNK_BYTES:
                if any(len(p[0]) for p in parts):
                    yield flush()
                parts, held = [], 0
        if any(len(p[0]) for p in parts):
            yield flush()

    shared = rows.mapInArrow(find, ROW).groupBy("kind", "shard").applyInPandas(_share(shards), ROW)
    shared.groupBy("kind", "shard").applyInPandas(_store(folder, "shared", 2), "n long").agg(F.sum("n")).collect()

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        stored = Spans(folder, "shared", shards)
        held: list[tuple] = []
        held_bytes = 0

        def flush() -> pa.RecordBatch:
            strings = np.frombuffer(b"".join(c[v : v + anchor] for *_, v, c in held), dtype=np.uint8).reshape(-1, anchor)
            where = (anchor_hash(strings) % np.uint64(shards)).astype(np.int64)
            out = []
            for s, pick in sharded(where, shards):
                chosen = [held[i] for i in pick.tolist()]
                columns = [np.array([c[i] for c in chosen], dtype="<u8") for i in range(4)]
                data = b"".join(c[4] for c in chosen)
                out.append((s, pack(*columns, np.array([len(c[4]) for c in chosen], dtype="<u8")), zstandard.ZstdCompressor(level=1).compress(data)))
            return pa.RecordBatch.from_pydict({"shard": pa.array([o[0] for o in out], pa.int32()), "block": pa.array([o[1] for o in out], pa.binary()), "bytes": pa.array([o[2] for o in out], pa.binary())})

        for rb in batches:
            texts = text_bytes(rb, "text")
            ids, tags = _ids(rb.column("id")), _tags(texts)
            for text, number, tag, key in zip(texts, ids, tags, _key(ids, tags), strict=True):
                if (found := stored.of(number, key)) is None:
                    continue
                for p in np.unique(found[0][found[1] == COMPARE]).tolist():
                    a = max(0, p - reach)
                    c = text[a : p + length]
                    held.append((int(number), int(tag), a, p - a, c))
                    held_bytes += len(c) + 200
            if held_bytes >= CHUNK_BYTES:
                yield flush()
                held, held_bytes = [], 0
        if held:
            yield flush()

    compared = rows.mapInArrow(contexts, "shard int, block binary, bytes binary").groupBy("shard").applyInPandas(_compare(shards, length, anchor), ROW)
    compared.groupBy("kind", "shard").applyInPandas(_store(folder, "compared", 2), "n long").agg(F.sum("n")).collect()
    return folder, shards


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a long column that orders rows as their ids do (null for null), and its name.

    Ids are sorted over ranges, where rows have numbers in ascending order; the numbers are written
    before use, as a second run of the sort might number otherwise.
    """
    (number,) = unused(docs.columns, "number")
    ids = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy("id")
    ids = written(ids.select("id", F.monotonically_increasing_id().alias(number)), "ids")
    return docs.join(ids, F.col(id_col) == F.col("id"), "left").drop("id"), number


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``id_col``, n_bytes, spans (first and past last byte, merged), kept (the other bytes)."""
    docs = docs.select(id_col, text_col)
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        docs, number = numbered(docs, id_col)
        found = remove_repeats(docs, number, text_col, length, anchor, shard_bytes)
        names = docs.select(number, F.col(id_col).alias("own")).distinct()
        found = found.withColumnRenamed(number, "number")
        return found.join(names.withColumnRenamed(number, "of"), F.col("number").eqNullSafe(F.col("of"))).select(F.col("own").alias(id_col), "n_bytes", "spans", "kept")
    folder, shards = repeated_spans(docs, id_col, text_col, length, anchor, shard_bytes)
    reach = length - anchor

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, compared = Spans(folder, "shared", shards), Spans(folder, "compared", shards)
        for rb in batches:
            texts = text_bytes(rb, "text")
            ids, tags = _ids(rb.column("id")), _tags(texts)
            spans, kept = [], []
            for text, number, key in zip(texts, ids, _key(ids, tags), strict=True):
                starts, ends = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                if (found := shared.of(number, key)) is not None:
                    p = found[0][found[1] == COVERED].astype(np.int64)
                    starts.append(np.maximum(0, p - reach))
                    ends.append(np.minimum(len(text), p + length))
                if (found := compared.of(number, key)) is not None:
                    starts.append(found[0].astype(np.int64))
                    ends.append(found[1].astype(np.int64))
                own = _union(np.concatenate(starts), np.concatenate(ends))
                spans.append([{"first": a, "past": b} for a, b in own])
                edges = [0, *[x for s in own for x in s], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [rb.column("own"), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "spans", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"{id_col} {kind}, n_bytes long, spans array<struct<first:long,past:long>>, kept binary")


def _union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans merged."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:], len(ends)) - 1].tolist(), strict=True))
