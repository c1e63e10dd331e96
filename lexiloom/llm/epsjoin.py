"""Operator 1, near-duplicate embeddings: an epsilon grid order join.

Vectors are scaled to length 1, so that a cosine of at least min_cosine is a distance of at most epsilon. They are
turned to their principal axes (of second moments summed over all vectors), which keeps distances. A vector's cell is
its coordinates on the leading axes divided by epsilon, rounded down; sorted by cells, the vectors make a sequence
that is cut into blocks. An interval of the sequence has a bounding box on all axes; two intervals whose boxes are
more than epsilon apart hold no pair. Intervals of many blocks are compared first and those left are halved, down to
pairs of blocks, in joins of ever finer intervals; a task that gets a pair of blocks goes on halving inside them and
compares what is left by matrix products, and those within epsilon again in double precision. No pair is missed.

Groups are the connected components; the vector that stays has the least vec_id, nulls last. Null, empty and not
finite vectors, those of length 0 and those of another dimension than the most frequent one pair with nothing and
stay. Distances are told of turned vectors in single precision, so a cosine within some 1e-6 of min_cosine may fall on
either side. Rows that repeat are vectors of their own, so of those with a vector all but one go. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, cut, partitions, ragged, table
from .vectors import matrix, packed_rows, usual_dim, vectors


@dataclass(frozen=True)
class Params:
    """min_cosine: least cosine of a pair. axes: leading axes that make the cells. block: vectors of a block. leaf: vectors below which an interval is compared outright. fan: intervals that one of the next coarser level has."""

    min_cosine: float = 0.95
    axes: int = 6
    block: int = 16_384
    leaf: int = 128
    fan: int = 16


def principal_axes(v: DataFrame, dim: int) -> np.ndarray:
    """Columns are the axes, by falling variance."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((dim, dim))
        for b in it:
            x = matrix(b.column(0), dim).astype(np.float64)
            s += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], ["s"])

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(dim * dim)
        for b in it:
            s += matrix(b.column(0), dim * dim, np.float64).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], ["s"])

    sums = v.select("vec").mapInArrow(part, "s binary").repartition(16).mapInArrow(total, "s binary").collect()  # 16 matrices
    s = sum(np.frombuffer(r.s, np.float64) for r in sums).reshape(dim, dim)
    return np.linalg.eigh(s)[1][:, ::-1].copy()


def _tree(x: np.ndarray, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes (least, greatest) of the leaves of a sequence, of pairs of them and so on up to one; what is missing has the empty box."""
    n = 1 << max(0, (-(-len(x) // leaf) - 1).bit_length())
    edge = np.arange(0, len(x), leaf)
    lo, hi = np.full((n, x.shape[1]), np.inf, np.float32), np.full((n, x.shape[1]), -np.inf, np.float32)
    lo[: len(edge)], hi[: len(edge)] = np.minimum.reduceat(x, edge), np.maximum.reduceat(x, edge)
    out = [(lo, hi)]
    while len(lo) > 1:
        lo, hi = np.minimum(lo[0::2], lo[1::2]), np.maximum(hi[0::2], hi[1::2])
        out.append((lo, hi))
    return out


def join(x: np.ndarray, y: np.ndarray, eps: float, leaf: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of all pairs within eps; of a sequence with itself (same), those with the first before the second.

    Both are halved again and again, a level at a time for all pairs of halves; those with provably distant boxes go no
    further, and the leaves left are compared by products, the pairs within reach again in double precision.
    """
    none = np.zeros(0, np.int64)
    if not len(x) or not len(y):
        return none, none
    e2 = eps * eps
    slack = e2 + 1e-4  # of single precision
    one, two = _tree(x, leaf), _tree(y, leaf)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(max(len(one), len(two)) - 1, -1, -1):
        (lo1, hi1), (lo2, hi2) = one[min(k, len(one) - 1)], two[min(k, len(two) - 1)]
        if k < max(len(one), len(two)) - 1:
            i = (2 * a[:, None] + [0, 1]) if k < len(one) - 1 else a[:, None]
            j = (2 * b[:, None] + [0, 1]) if k < len(two) - 1 else b[:, None]
            a, b = np.repeat(i, j.shape[1], 1).reshape(-1), np.tile(j, (1, i.shape[1])).reshape(-1)
        if same:
            a, b = a[a <= b], b[a <= b]
        near = np.zeros(len(a), bool)
        for s in range(0, len(a), 4096):
            u, v = a[s : s + 4096], b[s : s + 4096]
            d = np.maximum(0, np.maximum(lo1[u] - hi2[v], lo2[v] - hi1[u]))  # infinite for what is missing
            near[s : s + 4096] = (d * d).sum(1) <= slack
        a, b = a[near], b[near]
    norm1, norm2 = (x * x).sum(1), (y * y).sum(1)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else none
    for s, e in zip(edge, np.append(edge[1:], len(a))):  # a leaf of x with all leaves of y it has to meet
        p0, p1 = a[s] * leaf, min((a[s] + 1) * leaf, len(x))
        q = np.concatenate([np.arange(t * leaf, min((t + 1) * leaf, len(y))) for t in b[s:e]])
        d2 = norm1[p0:p1, None] + norm2[q] - 2 * (x[p0:p1] @ y[q].T)
        i, j = np.nonzero(d2 <= slack)
        i, j = i + p0, q[j]
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            w = x[i].astype(np.float64) - y[j]
            ok = (w * w).sum(1) <= e2
            out.append((i[ok], j[ok]))
    if not out:
        return none, none
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def close_pairs(v: DataFrame, p: Params = Params()) -> DataFrame:
    """Pairs (a, b) of row numbers of vectors (see vectors.vectors) within epsilon."""
    spark = v.sparkSession
    dim = usual_dim(v)
    if not dim:
        return spark.createDataFrame([], "a long, b long")
    eps = float(np.sqrt(2 - 2 * p.min_cosine))
    v = v.filter(F.col("dim") == dim)

    def unit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = matrix(b.column(1), dim).astype(np.float64)
            n = np.sqrt((x * x).sum(1))
            x = (x[n > 0] / n[n > 0, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(n > 0)), packed_rows(x)], ["row", "vec"])

    v = v.select("row", "vec").mapInArrow(unit, "row long, vec binary")
    axes = principal_axes(v, dim)
    k = min(p.axes, dim)

    def turned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = (matrix(b.column(1), dim).astype(np.float64) @ axes).astype(np.float32)
            cells = np.floor(x[:, :k] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), packed_rows(x), ragged(pa.int32(), cells.reshape(-1), np.arange(len(x) + 1) * k), pa.array(x[:, 0], pa.float32())], ["row", "vec", "cell", "lead"])

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, rest = TaskContext.get().partitionId() << 32, None
        for t in [*it, None]:
            held = [x for x in (rest, t) if x is not None and len(x)]
            both = pa.Table.from_batches(held).combine_chunks() if held else None
            rest = None
            while both is not None and len(both) and (len(both) >= p.block or t is None):
                part, both = both.slice(0, p.block), both.slice(p.block)
                x = matrix(part.column(1).combine_chunks(), dim)
                cols = [pa.array([n]), *(pa.array([c.tobytes()], pa.binary()) for c in (part.column(0).to_numpy(), x, np.stack([x.min(0), x.max(0)])))]
                yield pa.RecordBatch.from_arrays(cols, ["block", "rows", "vecs", "box"])
                n += 1
            if both is not None and len(both):
                rest = both.combine_chunks().to_batches()[0]

    order = v.mapInArrow(turned, "row long, vec binary, cell array<int>, lead float").repartitionByRange(partitions(v), "cell", "lead").sortWithinPartitions("cell", "lead", "row")
    b = cut(order.select("row", "vec").mapInArrow(blocks, "block long, rows binary, vecs binary, box binary"))

    # levels of intervals, each with the box around those it has; level 0 is the blocks, numbered in sequence
    sizes = b.groupBy(F.shiftright("block", 32).alias("part")).count()  # a row for each task
    bases = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    level = b.select("block", "box", F.shiftright("block", 32).alias("part")).join(bases, "part")
    level = cut(level.select("block", (F.col("base") + F.col("block").bitwiseAND(2**32 - 1)).alias("n"), "box"))
    number, levels = level.select("block", "n"), [level.select("n", "box")]
    count = level.count()

    def around(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            n, x = t.column(0).to_pylist(), t.column(1).to_pylist()
            both = [np.stack([np.frombuffer(y, np.float32).reshape(-1, 2, dim)[:, 0].min(0), np.frombuffer(y, np.float32).reshape(-1, 2, dim)[:, 1].max(0)]).tobytes() for y in (b"".join(z) for z in x)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(both, pa.binary())], ["n", "box"])

    while count > p.fan:
        up = levels[-1].groupBy(F.floor(F.col("n") / p.fan).cast("long").alias("n")).agg(F.collect_list("box").alias("box"))
        levels.append(cut(up.mapInArrow(around, "n long, box binary")))
        count = -(-count // p.fan)
    slack = eps * eps + 1e-4

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            if len(t):
                x, y = matrix(t.column(2), 2 * dim).reshape(-1, 2, dim), matrix(t.column(3), 2 * dim).reshape(-1, 2, dim)
                d = np.maximum(0, np.maximum(x[:, 0] - y[:, 1], y[:, 0] - x[:, 1]))
                ok = pa.array((d * d).sum(1) <= slack)
                yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok)], ["i", "j"])

    pairs = None
    for boxes in reversed(levels):
        one = boxes.select(F.col("n").alias("i"), F.col("box").alias("bi"))
        two = boxes.select(F.col("n").alias("j"), F.col("box").alias("bj"))
        if pairs is None:
            both = one.crossJoin(two).filter("i <= j")  # at most fan of them
        else:
            fine = pairs.select(F.explode(F.sequence(F.col("i") * p.fan, F.col("i") * p.fan + p.fan - 1)).alias("i"), "j")
            fine = fine.select("i", F.explode(F.sequence(F.col("j") * p.fan, F.col("j") * p.fan + p.fan - 1)).alias("j")).filter("i <= j")
            both = fine.join(one, "i").join(two, "j")
        pairs = both.select("i", "j", "bi", "bj").mapInArrow(near, "i long, j long")

    def within(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, home = np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
        for t in it:
            for own, other, r, x in zip(*(t.column(c).to_pylist() for c in (0, 2, 3, 4))):
                if other is None:  # what the next ones meet
                    rows, home = np.frombuffer(r, np.int64), np.frombuffer(x, np.float32).reshape(-1, dim)
                    continue
                r2, x2 = (rows, home) if x is None else (np.frombuffer(r, np.int64), np.frombuffer(x, np.float32).reshape(-1, dim))
                s, u = join(home, x2, eps, p.leaf, own == other)
                yield pa.RecordBatch.from_arrays([pa.array(rows[s]), pa.array(r2[u])], ["a", "b"])

    b = b.join(number, "block").select("n", "rows", "vecs")
    # of a pair, one block is at home; it is sent once for every fan of those that come to it, which are sent by pair
    even = (F.col("i") + F.col("j")) % 2 == 0
    met = pairs.select(F.when(even, F.col("i")).otherwise(F.col("j")).alias("home"), F.when(even, F.col("j")).otherwise(F.col("i")).alias("other"))
    met = cut(met.withColumn("fan", F.floor(F.col("other") / p.fan)))
    homes = met.select("home", "fan").distinct().join(b.hint("merge"), F.col("home") == F.col("n")).select("home", "fan", F.lit(None).cast("long").alias("other"), "rows", "vecs")
    apart = met.filter("home <> other").join(b.hint("merge"), F.col("other") == F.col("n")).select("home", "fan", "other", "rows", "vecs")
    self_ = met.filter("home = other").select("home", "fan", "other", F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("binary").alias("vecs"))
    work = homes.union(apart).union(self_).repartition(2 * partitions(v), "home", "fan").sortWithinPartitions("home", "fan", F.col("other").asc_nulls_first())
    return work.mapInArrow(within, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", p: Params = Params()) -> DataFrame:
    """vec_id, group_id (vec_id of the vector that stays), keep, a row for each row of df."""
    v = cut(vectors(df, id_col, vec_col))
    comp = components(close_pairs(v, p))
    own = comp.join(v.select("row", "id"), F.col("node") == F.col("row")).select("row", "id", "root")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("f"))
    told = own.join(first, "root").select("row", F.col("f.id").alias("head"), (F.col("f.row") == F.col("row")).alias("keep"))
    out = v.select("row", "id").join(told, "row", "left").select(F.col("id").alias("vec_id"), F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("head")).alias("group_id"), F.coalesce("keep", F.lit(True)).alias("keep"))
    arr = F.col(vec_col).cast("array<float>")
    bad = df.filter(arr.isNull() | (F.size(arr) == 0) | F.exists(arr, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    bad = bad.select(F.col(id_col).cast("long").alias("vec_id"))
    return out.union(bad.select("vec_id", F.col("vec_id").alias("group_id"), F.lit(True).alias("keep")))


def op1_epsjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
), pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) >= 0.95 * a.n * b.n
), reach(a, b) AS (
  SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a
), root AS (SELECT a AS vec_id, least(a, min(b)) AS group_id FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(root.group_id, v.vec_id) AS group_id, coalesce(root.group_id = v.vec_id, true) AS keep
FROM v LEFT JOIN root USING (vec_id)
"""
