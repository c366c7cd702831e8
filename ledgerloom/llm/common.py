"""Helpers that several corpus operators share: staged tables, hashed words, components, top-k cuts."""

import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at a time; working arrays take about thirty times as much.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- staged tables ---------------------------------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`.

    Where the session names none (a single machine, as in tests) a folder beside the warehouse is
    used and set, so that all staged tables of the session are found in one place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("ledgerloom.staging.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ledgerloom-staging"
        spark.conf.set("ledgerloom.staging.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends there, a lost executor costs
    only the tasks that ran on it. Files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a staged table up to which Spark may choose to broadcast it.
BROADCAST_ROWS = 1 << 16


def bounded(side: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """A side of a join that grows with the input, itself a staged table or made row by row of `staged`: beyond
    BROADCAST_ROWS both sides are sorted.

    Spark takes the size of compressed files for that of the rows, and the driver builds every table it broadcasts in its
    memory, several at a time.
    """
    return side if (side if staged is None else staged).count() <= BROADCAST_ROWS else side.hint("merge")


def text_place(df: DataFrame, column: str) -> int | None:
    """The place of a text column among the columns; None where it is not a plain string or its name is not unique."""
    places = [i for i, c in enumerate(df.columns) if c.lower() == column.lower()]
    return places[0] if len(places) == 1 and df.schema[places[0]].dataType.simpleString() == "string" else None


# --- what workers remember -------------------------------------------------------------------

_tenant: list = []


def tenant(name: str, forget: Callable[[], None] | None = None) -> None:
    """Called when a task of an operator begins: what a worker remembers between tasks is one operator's at a time.

    Workers outlive operators; the one that remembered before is told to `forget` when another begins.
    """
    if _tenant and _tenant[0] != name and _tenant[1] is not None:
        _tenant[1]()
    _tenant[:] = [name, forget]
    release()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system; a worker lives on between tasks, beside the heap of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


# --- hashing words of a block of texts -------------------------------------------------------

def _random64(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int = 7) -> np.ndarray:
    """A number for each byte; A-Z count as a-z."""
    values = _random64(256, seed)
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for blocks of the usual size."""
    if n <= CHUNK and "base" in _powers:
        return _powers["base"][:n + 1], _powers["inverse"][:n + 1]
    size = max(n, CHUNK) + 1
    out = []
    for b in (_BASE, _INVERSE):
        x = np.full(size, b, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    if n <= CHUNK:
        _powers["base"], _powers["inverse"] = out
    return out[0][:n + 1], out[1][:n + 1]


def blocks(column, size: int = CHUNK):
    """(first row, byte array, row offsets) of a binary Arrow column, some `size` bytes at a time.

    Nulls count as empty. A text longer than that is a block of its own.
    """
    column = column.fill_null(b"") if column.null_count else column
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """Starts and ends of words in a block, and for each row the number of the first word and of the one after the last."""
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, whatever its place in the block."""
    power, inverse = _power(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * power[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


# --- components ------------------------------------------------------------------------------

def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, root): the smallest vertex that each vertex with an edge can reach.

    Large-star and small-star steps by turns: every step is a grouped minimum and a join on the vertex,
    written to the shared folder, until a round changes nothing. Vertices whose root is themselves are left out.
    """
    now = stage(
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("w")).where("v <> w").distinct(), "edges")
    size = lambda t: t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)")).alias("sum")).first()
    known = size(now)
    while True:
        met = (lambda t: t) if known["n"] <= BROADCAST_ROWS else (lambda t: t.hint("merge"))
        both = now.union(now.select(F.col("w").alias("v"), F.col("v").alias("w")))
        low = both.groupBy(F.col("v").alias("u")).agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = met(both).join(low, F.col("v") == F.col("u")).where("w > v").select(F.col("w").alias("v"), F.col("m").alias("w")).distinct()
        low = large.groupBy(F.col("v").alias("u")).agg(F.min("w").alias("m"))
        small = met(large).join(low, F.col("v") == F.col("u"))
        small = small.select(F.col("w").alias("v"), F.col("m").alias("w")).where("v <> w").union(low.select("u", "m")).distinct()
        following = stage(small, "edges")
        before, known = known, size(following)
        if known == before:
            return following.select(F.col("v").alias("vertex"), F.col("w").alias("root"))
        now = following


# --- numbers from ids ------------------------------------------------------------------------

def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
