"""Alignment of two tokenizers' tokens by a sweep over the byte offsets where tokens end.

Every token is an event: it ends at a byte offset of the text, on side A or B.  The events of both
sides are united, dealt out by document, sorted by offset, and streamed through a small machine.  Where
both sides end at an offset, the machine closes a group (all tokens of either side since the group
before) and links the two tokens that end there.

Spark's part.  A row holds the ids of up to ``BLOCK_TOKENS`` events of one side in a row, with the
offset of the first; the lengths follow from the ids, so they do not travel.  The machine keeps what
has come of the open group and of blocks that overlap it, and a running hash of the closed ones.
Linked id pairs are counted a partition, then summed for ranges of B ids into files of sorted
arrays, which the workers of the last pass map to look up the counts of each document's links.

Defined results.  Texts that are null or empty, or whose tokens' joined bytes are not the text after
a space (as where a tokenizer normalises), have no tokens: zeros, and an empty digest.  Special tokens'
strings are plain text.  Repeated rows are documents of their own.  Other columns are not read.
An empty table gives an empty result.  Long texts are encoded in pieces that give the ids of the whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import bpe
from sparkloom.llm.shared import MappedFolder, bounded_batches, put_arrays, scratch, sharded, text_bytes, written

#: Tokens of one side in one row; the machine holds some such blocks at once.
BLOCK_TOKENS = 1 << 13
#: Ranges of B ids, each with a file of pair counts: a range has at most (A ids) x (B ids) / SHARDS pairs, whatever the input.
SHARDS = 64
#: Pairs that a worker counts or merges before it folds them.
FOLD = 1 << 21
PIECE_CHARS = 1 << 16
A, B = 0, 1
_SEPARATE = re.compile(r"(?<=\S) (?=\S)")


# ---------------------------------------------------------------- the two tokenizers


class Tokens:
    """What the sweep needs of a tokenizer: ids of a text in chunks, and the bytes of each id."""

    def __init__(self, chunks: Callable[[str], Iterator[list[int]]], raw: list[bytes]) -> None:
        if any(not b for b in raw):
            raise ValueError("a token without bytes would end where another ends")
        self.chunks, self.raw = chunks, raw
        self.lengths = np.array([len(b) for b in raw], np.int64)

    def encode(self, text: str, whole: bytes) -> np.ndarray | None:
        """The ids, or None where their bytes are not ``whole``."""
        out, at = [], 0
        for ids in self.chunks(text):
            joined = b"".join([self.raw[i] for i in ids])
            if whole[at : at + len(joined)] != joined:
                return None
            at += len(joined)
            out.append(np.array(ids, np.int64))
        return np.concatenate(out) if at == len(whole) and out else None


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a visible letter: itself, or the next free one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def byte_level(path: str, pattern: str) -> Tokens:
    """A byte-level BPE file; ``pattern`` is that of its pre-tokenizer.

    Where merges rank as their results' ids, as in the usual files, tiktoken merges by ids alone and
    gives the file's ids some times faster; other files go to their own library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = _bytes_of_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    raw = [b"?"] * (max([*vocab.values(), *special.values()]) + 1)  # ids without an entry never come out
    for token, i in vocab.items():
        raw[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    ranks = {raw[i]: i for t, i in vocab.items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    split, results = spec.get("pre_tokenizer") or {}, [vocab["".join(m)] for m in merges]
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if plain and results == sorted(set(results)) and len(results) + 256 == len(ranks) and max(ranks[bytes([b])] for b in range(256)) < results[0]:
        import tiktoken

        enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def chunks(text: str) -> Iterator[list[int]]:
            for part, match in bpe._parts(" " + text, PIECE_CHARS):
                yield enc._core_bpe.encode_single_piece(part.encode()) if match else enc.encode_ordinary(part)
    else:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True

        def chunks(text: str) -> Iterator[list[int]]:
            yield whole.encode(" " + text, add_special_tokens=False).ids

    return Tokens(chunks, raw)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Tokens:
    """A sentencepiece model; it puts a space before the text itself.

    Where no piece has a space after another character, no piece crosses a single space, so a long
    text may be cut there: the space that the model adds stands for the one cut out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    byte = re.compile("<0x([0-9A-F]{2})>")
    raw = [bytes([int(byte.fullmatch(n)[1], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    separable = not any("▁" in n.lstrip("▁") for n in names) and model.encode("a b") == model.encode("a") + model.encode("b")

    def chunks(text: str) -> Iterator[list[int]]:
        start = 0
        while separable and len(text) - start > PIECE_CHARS and (cut := _SEPARATE.search(text, start + PIECE_CHARS)):
            yield model.encode(text[start : cut.start()], num_threads=1)
            start = cut.end()
        yield model.encode(text[start:], num_threads=1)

    return Tokens(chunks, raw)


def _sides(a_path: str, pattern: str, b_path: str) -> tuple[Tokens, Tokens]:
    return byte_level(a_path, pattern), pieces(b_path)


def _width(tokens: Tokens) -> str:
    return "<u2" if len(tokens.raw) <= 1 << 16 else "<u4"


# ---------------------------------------------------------------- events


def events(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both sides' events in blocks: ``row, id, side, at`` (offset of the first), ``ids``.  A document without tokens has one empty block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_path, pattern, b_path)
        widths, squeeze = [_width(s) for s in sides], zstandard.ZstdCompressor(level=1)
        for rb in batches:
            rows, numbers = [], rb.column("row").to_pylist()
            for n, raw in enumerate(text_bytes(rb, "text")):
                text, whole = raw.decode("utf-8", "replace"), b" " + raw
                found = []
                for s in sides if raw else ():
                    ids = s.encode(text, whole)
                    if ids is None:
                        break
                    found.append(ids)
                if len(found) < 2:
                    rows.append((n, numbers[n], A, 0, b""))
                    continue
                for side, ids in enumerate(found):
                    ends = np.cumsum(sides[side].lengths[ids])
                    for k in range(0, len(ids), BLOCK_TOKENS):
                        rows.append((n, numbers[n], side, int(ends[k]), squeeze.compress(ids[k : k + BLOCK_TOKENS].astype(widths[side]).tobytes())))
            at, row, side, first, ids = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), rb.column("id").take(pa.array(at, pa.int32())), pa.array(side, pa.int8()), pa.array(first, pa.int64()), pa.array(ids, pa.binary())],
                names=["row", "id", "side", "at", "ids"],
            )

    bounded_batches(docs.sparkSession)
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"row long, id {docs.schema[id_col].dataType.simpleString()}, side byte, at long, ids binary")


# ---------------------------------------------------------------- the machine


class _Digits:
    """Ids as decimal text, many at once."""

    def __init__(self, count: int) -> None:
        texts = [str(i).encode() for i in range(count)]
        self.wide = max(map(len, texts)) + 1
        self.letters = np.array(texts, f"S{self.wide}").view(np.uint8).reshape(count, self.wide)
        self.lengths = np.array([len(t) for t in texts], np.int64)


class Sweep:
    """One document's machine: blocks of events in order of offset go in, closed groups go to a hash and links to a list."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], digits: tuple[_Digits, _Digits]) -> None:
        self.lengths, self.digits, self.pairs = lengths, digits, max(len(lengths[A]), 1)
        self.ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.start, self.n = [0, 0], [0, 0]  # bytes before the open tokens; tokens seen
        self.groups, self.hash, self.links = 0, hashlib.sha256(), _Counts()

    def add(self, side: int, at: int, ids: np.ndarray) -> None:
        if len(self.ids[A]) + len(self.ids[B]) > 4 * BLOCK_TOKENS:
            self.close(at)
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.n[side] += len(ids)

    def close(self, before: int | None = None) -> None:
        """Close the groups that end before an offset (all events up to it have come), or all."""
        ends = [self.start[s] + np.cumsum(self.lengths[s][self.ids[s]]) for s in (A, B)]
        if not len(ends[A]) or not len(ends[B]):
            return
        place = np.searchsorted(ends[B], ends[A])
        last = np.flatnonzero((ends[B][np.minimum(place, len(ends[B]) - 1)] == ends[A]) & ((before is None) | (ends[A] < (before or 0))))
        if not len(last):
            return
        ia, ib = last, place[last]  # the tokens that end a group
        a, b = self.ids[A][: ia[-1] + 1], self.ids[B][: ib[-1] + 1]
        self.links.add(b[ib] * self.pairs + a[ia], np.ones(len(ia), np.int64))  # pair keys have the B id first
        self.hash.update((b";" if self.groups else b"") + self._text(a, b, ia, ib))
        self.groups += len(ia)
        for s, past in ((A, ia[-1] + 1), (B, ib[-1] + 1)):
            self.start[s], self.ids[s] = int(ends[s][past - 1]), self.ids[s][past:]

    def _text(self, a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> bytes:
        """The groups' ids: each token at its place, with the sign that follows it."""
        na, nb = np.diff(ia, prepend=-1), np.diff(ib, prepend=-1)
        at_a = np.arange(len(a)) + np.repeat(ib + 1 - nb, na)
        at_b = np.arange(len(b)) + np.repeat(ia + 1, nb)
        wide = max(d.wide for d in self.digits)
        letters, lengths, sign = np.zeros((len(a) + len(b), wide), np.uint8), np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        for at, ids, d in ((at_a, a, self.digits[A]), (at_b, b, self.digits[B])):
            letters[at, : d.wide], lengths[at] = d.letters[ids], d.lengths[ids]
        sign[at_a[ia]], sign[at_b[ib]] = ord("|"), ord(";")
        letters[np.arange(len(lengths)), lengths] = sign
        return letters[np.arange(wide) <= lengths[:, None]].tobytes()[:-1]


class _Counts:
    """A running count of keys, folded now and then, so it holds little more than the different keys."""

    def __init__(self) -> None:
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.folded = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(FOLD, 2 * self.folded):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.waiting] or [np.empty(0, np.int64)])
        counts = np.concatenate([c for _, c in self.waiting] or [np.empty(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        out = (keys[first], np.add.reduceat(counts, first) if len(first) else counts)
        self.waiting, self.size, self.folded = [out], len(first), len(first)
        return out


def _packed(keys: np.ndarray, counts: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Sorted keys as steps and their counts, as narrow as they fit."""
    steps = np.diff(keys, prepend=0)
    parts = []
    for values in (steps, counts):
        width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * w))
        # Bytes of equal weight stand together.
        parts.append(bytes([width]) + values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return squeeze.compress(len(keys).to_bytes(8, "little") + b"".join(parts))


def _unpacked(block: bytes, open_: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    raw = open_.decompress(block)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _ in range(2):
        width = raw[at]
        planes = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.int64))
        at += 1 + n * width
    return np.cumsum(out[0]), out[1]


def sweep(united: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """Events to a row a document (``shard`` null) and packed counts of linked pairs (``shard`` and ``links`` only)."""
    kind = united.schema["id"].dataType
    schema = f"id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, shard int, links binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_path, pattern, b_path)
        widths, digits = [_width(s) for s in sides], tuple(_Digits(len(s.raw)) for s in sides)
        lengths = tuple(s.lengths for s in sides)
        squeeze, open_, total = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), _Counts()
        current, machine, owner, done = None, None, None, []

        def finish() -> None:
            machine.close()
            keys, counts = machine.links.fold()
            total.add(keys, counts)
            n = int(counts.sum())
            done.append((owner, machine.n[A], machine.n[B], machine.groups, n, machine.hash.hexdigest() if machine.groups else "", None, _packed(keys, counts, squeeze)))

        def out(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
            kinds = [ids, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary()]
            columns = zip(*rows) if rows else [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        names, ids_kind = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "shard", "links"], pa.null()
        for rb in batches:
            ids_kind = rb.schema.field("id").type
            owners = rb.column("id")
            for k, (row, side, at, block) in enumerate(zip(*(rb.column(c).to_pylist() for c in ("row", "side", "at", "ids")))):
                if row != current:
                    if machine:
                        finish()
                    current, machine, owner = row, Sweep(lengths, digits), owners[k].as_py()
                if block:
                    machine.add(side, at, np.frombuffer(open_.decompress(block), widths[side]).astype(np.int64))
            yield out(done, ids_kind)
            done.clear()
        if machine:
            finish()
        keys, counts = total.fold()
        shards = keys // len(sides[A].raw) * SHARDS // len(sides[B].raw)
        for s, at in sharded(shards, SHARDS):
            done.append((None, 0, 0, 0, 0, "", s, _packed(keys[at], counts[at], squeeze)))
        yield out(done, ids_kind)

    bounded_batches(united.sparkSession)
    return united.repartition("row").sortWithinPartitions("row", "at", "side").mapInArrow(run, schema)


# ---------------------------------------------------------------- counts of the corpus


def put_counts(packed: DataFrame, folder: str, n_a: int) -> None:
    """Sum the packed counts of each range of B ids and write them to its file: keys, counts, and whether the count is the B id's highest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, sums = zstandard.ZstdDecompressor(), {}
        for rb in batches:
            for shard, block in zip(rb.column("shard").to_pylist(), rb.column("links").to_pylist()):
                sums.setdefault(shard, _Counts()).add(*_unpacked(block, open_))
        for shard, count in sums.items():
            keys, counts = count.fold()
            b = keys // n_a
            first = np.flatnonzero(np.diff(b, prepend=-1))
            highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(b)))
            put_arrays(f"{folder}/{shard}.bin", [keys.astype("<u8"), counts.astype("<u8"), (counts == highest).astype("<u1")])
        yield pa.RecordBatch.from_arrays([pa.array([len(sums)], pa.int32())], names=["n"])

    packed.select("shard", "links").repartition(SHARDS, "shard").mapInArrow(run, "n int").agg(F.sum("n")).collect()


def with_counts(swept: DataFrame, folder: str, n_a: int, n_b: int) -> DataFrame:
    """Each document's links by the corpus: ``n_best`` and ``count_sum``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, files = zstandard.ZstdDecompressor(), MappedFolder(folder)
        for rb in batches:
            found = [_unpacked(block, open_) for block in rb.column("links").to_pylist()]
            ends = np.cumsum([0, *[len(k) for k, _ in found]])
            keys = np.concatenate([k for k, _ in found] or [np.empty(0, np.int64)])
            times = np.concatenate([c for _, c in found] or [np.empty(0, np.int64)])
            best, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for s, at in sharded(keys // n_a * SHARDS // n_b, SHARDS):
                known, counts, highest = files.get(str(s))
                place = np.searchsorted(known, keys[at].astype("<u8"))
                best[at], count[at] = highest[place], counts[place]
            sums = [np.concatenate([[0], np.cumsum(times * v)]) for v in (best, count)]
            made = [pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in kept], *made], names=[*kept, "n_best", "count_sum"])

    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    bounded_batches(swept.sparkSession)
    schema = swept.select(*kept).schema.add("n_best", "long").add("count_sum", "long")
    return swept.filter("shard IS NULL").select(*kept, "links").mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    spark = docs.sparkSession
    a, b = _sides(a_path, pattern, b_path)
    swept = written(sweep(events(docs, a_path, pattern, b_path, id_col, text_col), a_path, pattern, b_path), "align-swept")
    folder = scratch(spark, "align-counts")
    put_counts(swept.filter("shard IS NOT NULL"), folder, len(a.raw))
    found = with_counts(swept, folder, len(a.raw), len(b.raw))
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
