"""Byte-level BPE by a local rank file: encode whole texts, decode ids to raw bytes.

Long texts are split before encoding, at places where the pre-tokeniser surely ends a match:
a character that is not white space, followed by white space.  No pattern of this family looks
back, and none matches white space after another character, so the ids are those of the whole.
A stretch without such a place stays whole.  The pre-tokeniser looks ahead over white space and
its stack ends at about a million characters, so a long run of it is cut out by the same rule: all
but its last character (all, at the end of the text) is one match, whose bytes are merged directly.

Defined results: null text is an empty text (no ids).  Empty tables give empty results, repeated
rows are each encoded, extra columns are ignored.  No special tokens are ever produced.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import short_batches

PIECE_CHARS = 1 << 16
# The characters with the Unicode property White_Space (Python's own class has four more).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The encoding of a rank file (base64 token and rank on each line), once per worker."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _long_run(size: int) -> re.Pattern[str]:
    return re.compile(f"[{_SPACE}]{{{max(size, 2)},}}")


def _parts(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """The text in order: pieces of whole matches, and single matches of long white space."""

    def cut(start: int, past: int) -> Iterator[tuple[str, bool]]:
        while past - start > size:
            found = _CUT.search(text, start + size, past)
            if not found:
                break
            yield text[start : found.end()], False
            start = found.end()
        if start < past:
            yield text[start:past], False

    start = 0
    for run in _long_run(size).finditer(text):
        past = run.end() if run.end() == len(text) else run.end() - 1
        yield from cut(start, run.start())
        yield text[run.start() : past], True
        start = past
    yield from cut(start, len(text))


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in order, cut at the first safe boundary after each ``size`` characters."""
    return (piece for piece, _ in _parts(text, size))


def encode_text(text: str, ranks_path: str, pattern: str, size: int = PIECE_CHARS) -> list[int]:
    enc = encoding(ranks_path, pattern)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece, match in _parts(text, size):
        out += enc._core_bpe.encode_single_piece(piece.encode()) if match else enc.encode_ordinary(piece)
    return out


def _lists(values: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.fromiter((i for v in values for i in v), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids = [encode_text(t or "", ranks_path, pattern) for t in rb.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(id_col), _lists(ids)], names=[id_col, "ids"])

    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``bytes``: the raw bytes of the ids, which need not be valid UTF-8."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            enc = encoding(ranks_path, pattern)
            raw = [enc.decode_bytes(ids or []) for ids in rb.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(id_col), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    short_batches(tokens.sparkSession)
    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"{id_col} {kind}, bytes binary")


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both in one pass: ``id_col``, ``ids``, ``bytes`` (decoded from the ids)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            enc = encoding(ranks_path, pattern)
            ids = [encode_text(t or "", ranks_path, pattern) for t in rb.column("text").to_pylist()]
            raw = pa.array([enc.decode_bytes(i) for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([rb.column(id_col), _lists(ids), raw], names=[id_col, "ids", "bytes"])

    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, ids array<int>, bytes binary")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hashes of ids and decoded bytes, by JVM expressions."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )
