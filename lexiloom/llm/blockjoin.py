"""Operator 6, nearest neighbours: a block matrix join on int8 tiles with error bounds.

Vectors are quantised to int8, each with its own scale; what quantisation changed has a known length. The product of
two blocks' int8 matrices gives, for each pair, a squared distance and a bound of its error, by Cauchy and Schwarz from
the lengths of the vectors and of their rests. (The values are whole numbers of 7 bits and the sums stay below 2**24, so
a product in single precision is exact and has a fast library routine, which int8 has not in numpy.) A pair is left out
only if its least possible distance is more than the k-th least of the greatest possible ones of that query, or than
the k-th exact distance that the task has met; the others are computed again in double precision. A task keeps each
query's k nearest of what it reads, and heaps merge the tasks' lists. So the result is exact.

Queries are the rows that a condition chooses, all by default. They are sent to the tasks in chunks of at most
chunk_bytes, one after another, and every chunk meets all rows; the searched vectors are never shuffled. What is
shuffled are k candidates for each query and task. The work is that of all pairs of a query and a row.

Neighbours are other rows, by distance, then vec_id (nulls last), then the order of rows: ties have one outcome. Null,
empty and not finite vectors and those of another dimension than the most frequent one aren't searched and have no
neighbours. Rows that repeat are neighbours of each other at distance 0. Fewer than k others give fewer neighbours; an
empty table gives none. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fetched, partitions, table
from .vectors import matrix, usual_dim, vectors


@dataclass(frozen=True)
class Params:
    """k: neighbours of a row. block: queries of a block, which is merged as a whole. rows: vectors that meet a block at once. chunk_bytes: most bytes of queries that are broadcast at once."""

    k: int = 10
    block: int = 256
    rows: int = 4096
    chunk_bytes: int = 32 << 20


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 values of each row, and its scale."""
    scale = np.abs(x).max(1, initial=0) / 127
    scale[scale == 0] = 1
    return np.rint(x / scale[:, None]).astype(np.int8), scale


class Block:
    """Vectors as they are, as int8, and the lengths that the bounds need. no: which ids are null."""

    def __init__(self, ids: np.ndarray, no: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.ids, self.no, self.rows, self.x = ids, no, rows, x
        wide = x.astype(np.float64)
        q, self.scale = quantised(wide)
        self.q = q.astype(np.float32)
        back = q * self.scale[:, None]
        self.norm2 = (wide**2).sum(1)
        self.length, self.near, self.rest = (np.sqrt((v**2).sum(1)) for v in (wide, back, wide - back))


#: For each query: its place in the block, squared distance, neighbour's id, whether that is null, and row.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
NONE: Found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


def tile(a: Block, b: Block, k: int, known: Found = NONE) -> Found:
    """The k nearest of each row of a among known and the rows of b, without itself, in order."""
    if not len(b.ids):
        return known
    n = len(a.ids)
    dot = (a.q @ b.q.T).astype(np.float64) * a.scale[:, None] * b.scale
    # x.y = x'.y' + (x - x').y + x'.(y - y')
    err = 2 * (a.rest[:, None] * b.length + a.near[:, None] * b.rest) + 1e-9 * (a.norm2[:, None] + b.norm2)
    d = a.norm2[:, None] + b.norm2 - 2 * dot
    own = np.flatnonzero(np.isin(a.rows, b.rows))
    d[own] = np.where(a.rows[own, None] == b.rows, np.inf, d[own])
    bound = np.full(n, np.inf)
    have = np.bincount(known[0], minlength=n)
    last = np.cumsum(have) - 1
    full = have >= k
    bound[full] = known[1][last[full]]
    rest = np.flatnonzero(~full)
    if len(rest) and d.shape[1] >= k:
        bound[rest] = np.partition(d[rest] + err[rest], k - 1, 1)[:, k - 1]
    d -= err
    i, j = np.nonzero((d <= bound[:, None]) & (d < np.inf))
    exact = np.empty(len(i))
    for s in range(0, len(i), 1 << 16):
        w = a.x[i[s : s + (1 << 16)]].astype(np.float64) - b.x[j[s : s + (1 << 16)]]
        exact[s : s + (1 << 16)] = (w * w).sum(1)
    both = [np.concatenate(c) for c in zip(known, (i, exact, b.ids[j], b.no[j], b.rows[j]))]
    by = np.lexsort([both[4], both[2], both[3], both[1], both[0]])
    both = [c[by] for c in both]
    keep = np.arange(len(by)) - np.searchsorted(both[0], both[0]) < k
    return tuple(c[keep] for c in both)  # type: ignore[return-value]


def _block(t: pa.RecordBatch, dim: int) -> Block:
    """Of columns id, row, vec."""
    no = t.column(0).is_null().to_numpy(zero_copy_only=False)
    return Block(t.column(0).fill_null(0).to_numpy(), no, t.column(1).to_numpy(), matrix(t.column(2), dim))


_LISTS = "block long, ids binary, no binary, n binary, d binary, near binary, nno binary, rows binary"


def _nearest(v: DataFrame, chunk: DataFrame, dim: int, p: Params) -> DataFrame:
    """Of a chunk of queries, a row for each block and task with the k nearest that the task has read."""
    got = chunk.select("block", "id", "row", "vec").toArrow().sort_by([("block", "ascending"), ("row", "ascending")]).combine_chunks()  # chunk_bytes at most
    sent = v.sparkSession.sparkContext.broadcast(got.to_batches())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = pa.Table.from_batches(sent.value).combine_chunks()
        name = queries.column(0).to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(np.diff(name)) + 1, [len(name)]])
        blocks = [(int(name[lo]), _block(queries.slice(lo, hi - lo).select([1, 2, 3]).combine_chunks().to_batches()[0], dim)) for lo, hi in zip(edge[:-1], edge[1:])]
        found = [NONE] * len(blocks)
        for t in it:
            for lo in range(0, len(t), p.rows):
                b = _block(t.slice(lo, p.rows), dim)
                found = [tile(a, b, p.k, f) for (_, a), f in zip(blocks, found)]
        for (n, a), f in zip(blocks, found):
            if len(f[0]):
                cols = (a.ids, a.no, np.bincount(f[0], minlength=len(a.ids)).astype(np.int32), *f[1:])
                yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], [c.split()[0] for c in _LISTS.split(", ")])

    return v.select("id", "row", "vec").mapInArrow(run, _LISTS)


def neighbours(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", p: Params = Params(), where: str | None = None) -> DataFrame:
    """vec_id, rank (from 1), neighbour_id, distance. where: SQL condition on id that the queries meet; all rows are searched."""
    spark = df.sparkSession
    schema = "vec_id long, rank int, neighbour_id long, distance double"
    v = cut(vectors(df, id_col, vec_col))
    dim = usual_dim(v)
    if not dim:
        return spark.createDataFrame([], schema)
    v = v.filter(F.col("dim") == dim)
    # queries numbered within a task's rows, so that blocks need no order over all of them
    part, nth = F.shiftright("row", 36), F.row_number().over(Window.partitionBy(F.shiftright("row", 36)).orderBy("row")) - 1
    queries = v.filter(where or "true").select(part.alias("part"), nth.alias("nth"), "id", "row", "vec")
    queries = cut(queries.withColumn("block", F.shiftleft("part", 36) + F.floor(F.col("nth") / p.block)))
    sizes = sorted((r.block, r["count"]) for r in fetched(queries.groupBy("block").count(), 24))
    most = max(p.block, p.chunk_bytes // (4 * dim + 64))
    chunks: list[list[int]] = []
    held = most + 1
    for name, n in sizes:
        if held + n > most:
            chunks.append([])
            held = 0
        chunks[-1].append(name)
        held += n
    if not chunks:
        return spark.createDataFrame([], schema)
    lists = [_nearest(v, queries.filter((F.col("block") >= c[0]) & (F.col("block") <= c[-1])), dim, p) for c in chunks[:1]]
    for c in chunks[1:]:  # one chunk at a time is broadcast; its candidates are written
        lists[-1] = cut(lists[-1])
        lists.append(_nearest(v, queries.filter((F.col("block") >= c[0]) & (F.col("block") <= c[-1])), dim, p))
    got = reduce(DataFrame.union, lists)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, no, lists = None, None, None, []

        def done() -> pa.RecordBatch:
            out: list[tuple] = []
            for r, (own, null) in enumerate(zip(heads.tolist(), no.tolist())):
                tops = [zip(*(c[s[r] : s[r + 1]].tolist() for c in cols)) for s, *cols in lists]
                for k, (d2, other_null, other, _) in zip(range(1, p.k + 1), heapq.merge(*tops)):
                    out.append((None if null else own, k, None if other_null else other, d2**0.5))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["vec_id", "rank", "neighbour_id", "distance"])

        for t in it:
            for block, ids, null, n, d, near, near_null, rows in zip(*(t.column(c).to_pylist() for c in range(8))):
                if block != now:
                    if lists:
                        yield done()
                    now, heads, no, lists = block, np.frombuffer(ids, np.int64), np.frombuffer(null, bool), []
                at = np.concatenate([[0], np.cumsum(np.frombuffer(n, np.int32))])
                lists.append((at, np.frombuffer(d, np.float64), np.frombuffer(near_null, bool), np.frombuffer(near, np.int64), np.frombuffer(rows, np.int64)))
        if lists:
            yield done()

    return got.repartition(partitions(v), "block").sortWithinPartitions("block").mapInArrow(merge, schema)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors for every vector whose id is divisible by 100."""
    return neighbours(table(spark, sf_dir, "embeddings"), where="id % 100 = 0").withColumn("distance", F.round("distance", 6))


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(distance, 6) AS distance FROM r WHERE rank <= 10
"""
