"""sha256 of files of any length: one chain, handed from task to task."""

from __future__ import annotations

import _hashlib
import ctypes
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decant.session import settings

#: Bytes of a file that one task reads.
SLICE = 128 << 20
# Endings of files that Spark's line reader unpacks, and the mark that it leaves out at the start of a file.
PACKED = (".gz", ".bz2", ".deflate", ".zst", ".lz4", ".snappy", ".passthrough")
MARK = b"\xef\xbb\xbf"


class Sha256:
    """A sha256 that goes on where another task stopped: ``hashlib`` keeps its state to itself, OpenSSL's is plain bytes."""

    SIZE = 112  # SHA256_CTX of openssl/sha.h

    def __init__(self, state: bytes | None = None):
        self.lib = ctypes.CDLL(_hashlib.__file__)  # the library that hashlib itself is linked with
        self.lib.SHA256_Init.argtypes = [ctypes.c_void_p]
        self.lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        self.lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
        self.ctx = ctypes.create_string_buffer(state or b"", self.SIZE)
        if state is None:
            self.lib.SHA256_Init(self.ctx)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.ctx, data, len(data))

    def state(self) -> bytes:
        return self.ctx.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.ctx.raw, self.SIZE))
        return out.raw.hex()


def exact(path: str) -> str:
    """A path that is not taken for a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of a file as ``\\n`` and a line, over and over, and where their slice begins."""
    d = spark.read.option("lineSep", "\n").text(exact(path))
    return d.select(F.concat(F.lit(b"\n"), F.col("value").cast("binary")).alias("data"), F.col("_metadata.file_block_start").alias("at"))


def link(path: str, state: bytes, fed: int, begun: bool, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Go on with a chain over the slice that begins at ``at``; the file's first line has no ``\\n`` before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, some = Sha256(state), fed, begun
        for b in filter(len, batches):
            found = b.column(1)
            if {found[0].as_py(), found[-1].as_py()} != {at}:
                raise RuntimeError(f"{path}: slice at {found[0]} in place of {at}")
            data = b"".join(b.column(0).to_pylist())
            data = data if some else data[1:]
            h.update(data)
            n, some = n + len(data), True
        yield pa.RecordBatch.from_pydict({"path": [path], "state": [h.state()], "fed": [n], "begun": [some]})
    return run


def chains(spark: SparkSession, files: Sequence[tuple[str, int]], head: bytes = b"") -> dict[str, tuple[str, int]]:
    """sha256 and hashed bytes of files (path, bytes): one job a slice, with a task for each file that reaches so far.

    ``head`` stands before the lines of every file.
    """
    first = Sha256()
    first.update(head)
    state = {path: (first.state(), len(head), False) for path, _ in files}
    each = str(SLICE)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": each, "spark.sql.files.openCostInBytes": each}):
        for i in range(max((-(-size // SLICE) for _, size in files), default=0)):
            parts, picked, before = [], [], 0
            for path, size in files:
                if i * SLICE < size:
                    d = lines(spark, path).mapInArrow(link(path, *state[path], i * SLICE), "path string, state binary, fed bigint, begun boolean").rdd
                    parts.append(d)
                    picked.append(before + i)
                    before += d.getNumPartitions()
            for r in spark.sparkContext.runJob(spark.sparkContext.union(parts), list, picked):
                state[r.path] = bytes(r.state), r.fed, r.begun
    out = {}
    for path, size in files:
        h, n = Sha256(state[path][0]), state[path][1]
        if n == size - 1:  # the reader does not tell whether the last line has an end
            h.update(b"\n")
            n += 1
        out[path] = h.hexdigest(), n
    return out


def sha256_in_slices(spark: SparkSession, files: Sequence[tuple[str, int]]) -> list[str]:
    """sha256 of every file (path, bytes), each read a slice at a time; a line of a file has to fit in a task.

    A file's chain is as long as the file, but no task reads more than a slice of it, and what a failed task costs is one
    slice. Chains of different files run side by side. The driver holds a state of 112 bytes per file.
    """
    done = chains(spark, files)
    marked = [(path, size) for path, size in files if size - done[path][1] in (len(MARK), len(MARK) + 1)]  # and a last line's end
    done |= chains(spark, marked, MARK)
    if wrong := [path for path, size in files if done[path][1] != size]:
        raise RuntimeError(f"not read as a whole: {wrong}")
    return [done[path][0] for path, _ in files]
