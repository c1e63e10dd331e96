"""What the training-data operators share: tables, lineage cuts, broadcasts, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table as table

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd, so that it has an inverse modulo 2**64.
_P = 0xD6E8FEB86659FD93


#: The folder of a local session that names none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only a local master, whose executors are this very process, gets one of its own when none is set.
    """
    sc = spark.sparkContext
    to = spark.conf.get("spark.checkpoint.dir", None)
    if not to:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        to = _OWN.setdefault(sc.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        _OWN[sc.applicationId] = to
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(to)
    return to


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for what a result is read from until sweep() is called."""
    _SCRATCH.append(to := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return to


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all scratch folders of this driver; results that haven't been written yet can't be read any more."""
    while _SCRATCH:
        remove(spark, _SCRATCH.pop())


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fetched(df: DataFrame, row_bytes: int, most: int = 256 << 20) -> list[Row]:
    """The rows of a small df, of about so many bytes each; an error where they'd take more than the driver is to hold."""
    limit = most // row_bytes
    got = df.limit(limit + 1).collect()
    if len(got) > limit:
        raise MemoryError(f"more than {limit} rows, {most} bytes, for the driver")
    return got


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows that agree in id and text are one document; a null id is told from any number."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\0")), text)


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle of data in proportion to df should have: one for 32 MB of its files, at least the session's setting."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 56 else 0  # of what doesn't come from files, Spark takes the largest number
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // (32 << 20)), 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base from 0 to n - 1, and their inverses."""
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            done, step = 1, p
            while done < size:  # doubling: p**(i + done) = p**i * p**done
                out[done : 2 * done] = out[:done] * np.uint64(step)
                done, step = 2 * done, step * step % (1 << 64)
            _POW[k] = out
    return _POW[0][:n], _POW[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] (bytes) for each span, the same wherever the bytes stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * GOLDEN)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Besides white space, ASCII punctuation and control bytes.
APART = np.zeros(256, bool)
APART[:128] = [not chr(i).isalnum() for i in range(128)]
#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that don't separate words; by default ASCII white space does."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = apart[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, ..., start + length - 1 of each pair, one after another."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row begins in them (and the last ends); nulls are empty."""
    col = col.cast(pa.large_binary())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about most bytes of text, their bytes and their rows' offsets; a longer text has a slice of its own."""
    for b in batches:
        at = binary_parts(b.column(b.schema.get_field_index(text)))[1]
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            part = b.slice(lo, hi - lo)
            yield part, *binary_parts(part.column(part.schema.get_field_index(text)))
            lo = hi
    tidy()


def doc_words(data: np.ndarray, at: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, none across rows, and the number of the first word of each row (and the end)."""
    space = apart[data]
    word = ~space
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    inner = at[(at > 0) & (at < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def ragged(kind: pa.DataType, flat: np.ndarray, at: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A list column of the slices flat[at[i]:at[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind), mask=None if null is None else pa.array(null))


def tidy() -> None:
    """At the end of a task: gives memory back that the worker, which Spark keeps for later tasks, has freed."""
    for k in (0, 1):
        _POW[k] = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node of each connected component of the edges (pairs of 64-bit integers).

    Union-find contracts what each partition holds; then large-star and small-star steps alternate until nothing
    changes, so no component has to fit into a task. Each round's edges are cut into the shared folder.
    """

    def contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t in it:
            u, v = np.concatenate([u, t.column(0).to_numpy()]), np.concatenate([v, t.column(1).to_numpy()])
            if len(u) > 2_000_000:  # its forest stays
                u, v = forest(u, v)
        u, v = forest(u, v)
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], ["u", "v"])

    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.mapInArrow(contract, "u long, v long"))
    seen = None
    while True:
        # large-star: greater neighbours point to the least of the neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: lesser neighbours, and the node itself, point to the least of them; here u > v always holds
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u")
        e = e.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e = cut(e)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) for the given ones: union-find, over whole arrays at a time."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(names))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]
