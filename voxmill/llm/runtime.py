"""Session plumbing that the operators of this subpackage share."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only on a local
    master: a cluster without the setting is a configuration error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="voxmill-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as a table and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/voxmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, times: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, for shuffles that move few large rows."""
    head = struct.pack("<H", len(arrays))
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += struct.pack("<2sQ", a.dtype.str[1:].encode(), a.size)
        body.append(a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at = struct.unpack_from("<H", raw)[0], 2
    kinds = []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, at)
        kinds.append((np.dtype("<" + kind.decode()), size))
        at += struct.calcsize("<2sQ")
    out = []
    for kind, size in kinds:
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


def exchange(blocks: DataFrame, n: int) -> DataFrame:
    """Rows of (part, block) brought to partition ``part`` of ``n``."""
    return blocks.repartitionById(n, "part")


BLOCKS = "part int, block binary"


def block_batch(parts: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])


def split_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values in sorted ``keys``."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep]
    ends = np.cumsum(n)
    out[0] = s[0]
    out[ends[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for block in batch.column(batch.schema.get_field_index("block")).to_pylist():
            yield unpack(block)
