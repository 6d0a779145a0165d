"""Shared pieces: text batches, scratch tables, packed blocks, and memory-mapped sorted stores.

Scratch data goes only to the folder named in ``spark.checkpoint.dir``, which the driver and
all executors share.  Workers map store files from there; when that folder is not a POSIX path
they fetch the file into an unlinked local temporary file and map that, so nothing is left behind.
"""

from __future__ import annotations

import mmap
import os
import re
import sys
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch; texts are long, so batches must be short to bound a worker's memory.
BATCH_ROWS = 256
#: Bytes in one Arrow batch of texts; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 25
#: Files that one worker keeps mapped.
MOST_MAPS = 2048


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that whole long texts fit in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short in rows and in bytes, so that many very long texts do not meet in one."""
    short_batches(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) != str(BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, with its file system.

    Where it is unset, a session of one machine (tests) gets a temporary folder; on a cluster that
    is an error, as no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", found):  # a bare path lies on the default file system
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; never reused."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores until no taken name equals it in any case."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name in have:
            name += "_"
        have.add(name)
        out.append(name)
    return out


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Whole texts of a batch as UTF-8 bytes; a null text is empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------- packed blocks


def pack(*columns: np.ndarray) -> bytes:
    """Equal-length 64-bit columns as one compressed block, byte planes together."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(np.asarray(c).astype("<u8", copy=False)).view(np.uint8).reshape(n, 8).T.tobytes() for c in columns)
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(block: bytes, width: int) -> list[np.ndarray]:
    """The columns that ``pack`` stored."""
    n = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:], max_output_size=max(1, n * 8 * width)), dtype=np.uint8)
    return [np.ascontiguousarray(raw[i * 8 * n : (i + 1) * 8 * n].reshape(8, n).T).view("<u8").reshape(n) for i in range(width)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash are usable."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


# ---------------------------------------------------------------- mapped files


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None


def put_file(path: str, data: bytes) -> None:
    """Write a whole file; a rerun of the same task replaces it with the same bytes."""
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex[:8]}.tmp"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, local)
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(data)


def map_file(path: str) -> memoryview:
    """The bytes of a file, memory-mapped read-only."""
    if local := _local(path):
        with open(local, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            return _map(f.fileno(), size)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with tempfile.TemporaryFile() as f:
        with system.open_input_stream(inner) as source:
            while block := source.read(1 << 22):
                f.write(block)
        f.flush()
        return _map(f.fileno(), os.fstat(f.fileno()).st_size)


def _map(descriptor: int, size: int) -> memoryview:
    """A read-only map that keeps no descriptor open (where Python can do without one)."""
    if not size:
        return memoryview(b"")
    extra = {"trackfd": False} if sys.version_info >= (3, 13) else {}
    return memoryview(mmap.mmap(descriptor, size, access=mmap.ACCESS_READ, **extra))


def put_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """Several arrays in one file, each aligned to eight bytes."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (len(a), a.dtype.itemsize)], dtype="<u8").tobytes()
    body = b"".join((raw := np.ascontiguousarray(a).tobytes()) + b"\0" * (-len(raw) % 8) for a in arrays)
    put_file(path, head + body)


def map_arrays(path: str) -> list[np.ndarray]:
    """The arrays that ``put_arrays`` stored, as views of the mapped file."""
    view = map_file(path)
    count = int(np.frombuffer(view, "<u8", 1)[0])
    head = np.frombuffer(view, "<u8", 1 + 2 * count)[1:].reshape(count, 2)
    out, at = [], 8 * (1 + 2 * count)
    for n, width in head.tolist():
        out.append(np.frombuffer(view, f"<u{width}", n, at))
        at += n * width + (-(n * width) % 8)
    return out


class MappedFolder:
    """The array files of a folder, mapped when first asked for; the least used maps are let go.

    A process may have some ten thousand maps, so a worker holds ``MOST_MAPS`` at once at most.
    """

    def __init__(self, folder: str, most: int = MOST_MAPS) -> None:
        self.folder, self.most = folder, most
        self.files: OrderedDict[str, list[np.ndarray] | None] = OrderedDict()

    def get(self, name: str) -> list[np.ndarray] | None:
        """The arrays of a file, or None where no task had rows for it."""
        if name in self.files:
            self.files.move_to_end(name)
            return self.files[name]
        try:
            found = map_arrays(f"{self.folder}/{name}.bin")
        except FileNotFoundError:
            found = None
        self.files[name] = found
        if len(self.files) > self.most:
            self.files.popitem(last=False)
        return found


def sharded(shards: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has rows, with the positions of its rows in their order."""
    order = np.argsort(shards, kind="stable")
    edges = np.searchsorted(shards[order], np.arange(count + 1))
    for s in range(count):
        if edges[s] < edges[s + 1]:
            yield s, order[edges[s] : edges[s + 1]]
