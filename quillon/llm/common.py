"""Shared plumbing: Arrow batches as numpy bytes, materialised tables, packed text blocks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

ROOT = str(Path(__file__).resolve().parents[2])

#: A word of the contracts: anything between ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Bytes to lower case, A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

MUL = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound Arrow batches by bytes so that long texts fit."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def schema(fields: Iterable[StructField], ddl: str) -> StructType:
    """Fields as they are, then those of a DDL string."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder every node sees: spark.checkpoint.dir, or, in local mode alone, a folder of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give freed memory back to the system: workers of earlier stages stay alive beside those of later ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(fn: Callable) -> Callable:
    """fn, of one table or two, with its freed memory given back after each call."""

    def one(rows: pa.Table) -> pa.Table:
        out = fn(rows)
        trim()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left, right)
        trim()
        return out

    return one if fn.__code__.co_argcount == 1 else two


def release(spark: SparkSession) -> None:
    """Drop the shuffle files of tables that have been written and are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, by: str | None = None, size: int = 4 << 20) -> DataFrame:
    """df.mapInArrow for a function of one batch; with by, of about size bytes of that column."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if by is None:
                if batch.num_rows:
                    yield fn(batch)
                continue
            for start, end in sliced(batch.column(batch.schema.get_field_index(by)), size):
                yield fn(batch.slice(start, end - start))
        trim()

    return df.mapInArrow(over, schema)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Is raw[a[k]:a[k]+size[k]] equal to raw[b[k]:b[k]+size[k]]? Eight bytes are compared at a time."""
    wide = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=wide, strides=(1,))
    out = np.ones(len(a), dtype=bool)
    left = np.flatnonzero(a != b)
    done = 0
    while len(left):
        rest = np.minimum(size[left] - done, 8)
        unlike = (eight[a[left] + done] ^ eight[b[left] + done]) << ((8 - rest) * 8).astype(np.uint64)
        out[left[unlike != 0]] = False
        done += 8
        left = left[(unlike == 0) & (size[left] > done)]
    return out


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    """A binary column from n+1 offsets into data."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def sliced(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about size bytes each."""
    _, at = as_bytes(column)
    start = 0
    while start < len(at) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + size, side="right")) - 1)
        yield start, end
        start = end


IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


def to_blob(batch: pa.RecordBatch | pa.Table) -> bytes:
    """Arrow IPC bytes, zstd-compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=IPC) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def packed(docs: DataFrame, size: int, extra: Callable[[pa.Table], dict[str, bytes]], names: list[str], name: str) -> DataFrame:
    """Pack rows into blocks of about size text bytes, once, into a materialised table.

    Columns: block (unique), docs (an Arrow blob of the rows), and a blob for each of names, made by
    extra(rows). docs must have a column text. A row longer than size is a block of its own.
    """
    schema = "block bigint, docs binary, " + ", ".join(f"{x} binary" for x in names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, held, have = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, have
            rows = pa.Table.from_batches(held).combine_chunks()
            more = extra(rows)
            out = pa.RecordBatch.from_pydict({"block": pa.array([(task << 32) | seq], pa.int64()), "docs": pa.array([to_blob(rows)], pa.binary())} | {x: pa.array([more[x]], pa.binary()) for x in names})
            seq, held, have = seq + 1, [], 0
            return out

        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start, end in sliced(batch.column(at), size):
                part = batch.slice(start, end - start)
                more = int(as_bytes(part.column(at))[1][-1])
                if held and have + more > size:
                    yield flush()
                held.append(part)
                have += more
                if have >= size:
                    yield flush()
        if held:
            yield flush()
        trim()

    return materialize(docs.mapInArrow(pack, schema), name)
