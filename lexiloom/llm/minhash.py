"""Operator 5, near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

An element (a run of words, lower case, without punctuation) doesn't get an independent hash for each of the
signature's components: its value in round j is j plus a fraction, written to the component that a random permutation
of its own puts at place j. As later rounds can't improve a component that an earlier one has filled, a document is
done as soon as all its components are, mostly after one to three rounds. Rounds run over all elements of many
documents at once.

Documents with the same signature are one (exact copies cost no comparison). Those left are banded; the buckets that
hold the same documents are one bucket; each pair in a bucket that isn't connected there already is verified on whole
signatures, whose share of equal components is an estimate of the Jaccard similarity with less variance than MinHash's.
Union-find groups what is similar enough.

A bucket of more than most documents is never held by one task. All its documents are compared with the first, in parts;
those similar to it are connected, and only what isn't similar to it meets the others, in pairs of blocks.

The document that stays is that with the least doc_id, nulls last, then the least hash of the text. A null text or
one without words is similar to nothing and stays. Rows that repeat id and text are one document: all carry its group,
the first of them stays (they are told apart by nothing, so any may). Texts are compared whole, whatever their length;
an estimate that equals the threshold is similar enough. A doc_id has to be a number or null. Other columns, of whatever
names, are neither read nor changed; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import APART, GOLDEN, LOWER, components, cut, doc_words, fresh, mix, pieces, row_key, span_hashes, table


@dataclass(frozen=True)
class Params:
    """shingle: words an element has. size: components. bands: each has size // bands components. threshold: least similarity of near-duplicates. most: documents of a bucket that one task compares. block: about as many of a larger one meet as many others in a task. salts: parts in which a larger one meets its first document. broadcast_rows: most larger buckets (16 bytes each) whose names are broadcast to find their rows."""

    shingle: int = 3
    size: int = 128
    bands: int = 32
    threshold: float = 0.55
    most: int = 4096
    block: int = 2048
    salts: int = 64
    broadcast_rows: int = 500_000


def elements(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words (of the whole text where it has fewer), and the number of the row each is in."""
    data = LOWER[data]
    starts, ends, first = doc_words(data, at, APART)
    h = span_hashes(data, starts, ends)
    n = np.diff(first)
    out, row = h.copy(), np.repeat(np.arange(len(n)), n)
    left = np.repeat(first[1:], n) - np.arange(len(h))  # words from here to the row's end
    for j in range(1, k):
        out = mix(out * GOLDEN + np.uint64(j))
        ok = left > j
        out[ok] ^= h[np.flatnonzero(ok) + j]
    whole = (left >= k) | (left == np.repeat(n, n))
    return mix(out)[whole], row[whole]


def signatures(x: np.ndarray, row: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash of each row's elements, as 16-bit digests of the components' values; rows without elements have zeros."""
    best = np.full(n * m, np.uint64(2**64 - 1))
    perm = None  # of the elements whose rows aren't done
    x, home = x.copy(), row * m
    for j in range(m):
        if not len(x):
            break
        r = mix(x + np.uint64((2 * j + 1) * int(GOLDEN) % (1 << 64)))
        k = j + (mix(r ^ GOLDEN) >> np.uint64(33)) * np.uint64(m - j) // np.uint64(2**31)
        k = k.astype(np.int64)
        if j == 0:
            slot = k
        else:
            if perm is None:
                perm = np.empty((len(x), m), np.uint8)
                perm[:] = np.arange(m)
                perm[np.arange(len(x)), first] = 0
                perm[:, 0] = first
            own = np.arange(len(x))
            slot = perm[own, k].astype(np.int64)
            perm[own, k], perm[own, j] = perm[own, j], slot
        # the round in the topmost byte, then the fraction
        np.minimum.at(best, home + slot, (np.uint64(j) << np.uint64(56)) | (r >> np.uint64(8)))
        open_rows = (best.reshape(n, m) == np.uint64(2**64 - 1)).any(1)
        go = open_rows[home // m]
        if perm is not None:
            perm = perm[go]
        else:
            first = k[go]
        x, home = x[go], home[go]
    out = (mix(best) >> np.uint64(48)).astype(np.uint16).reshape(n, m)
    out[best.reshape(n, m)[:, 0] == np.uint64(2**64 - 1)] = 0
    return out


def signed(docs: DataFrame, p: Params) -> DataFrame:
    """id, key (of id and text), sig for each row with words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, at in pieces(it, "text", 1 << 19):
            x, row = elements(data, at, p.shingle)
            has = np.bincount(row, minlength=len(b)) > 0
            sig = signatures(x, row, len(b), p.size)[has]
            t = b.filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array([s.tobytes() for s in sig], pa.binary())], ["id", "key", "sig"])

    src = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, "id long, key long, sig binary")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return edge, np.diff(np.append(edge, len(keys)))


def _by_key(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of the first column, by which the batches are sorted."""
    rest: list[pa.RecordBatch] = []
    for b in it:
        if not len(b):
            continue
        key = b.column(0).to_numpy()
        cut_at = int(np.searchsorted(key, key[-1], "left"))
        if cut_at or (rest and rest[-1].column(0)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*rest, b.slice(0, cut_at)])
            rest = []
        rest.append(b.slice(cut_at))
    if rest:
        yield pa.Table.from_batches(rest)


def similar_in(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges that connect all rows of sig that are connected by at least so many equal components.

    Each row that isn't in the group of an earlier pivot is compared with all rows that aren't in its own group.
    """
    n = len(sig)
    group, out = np.arange(n), []
    for i in range(n):
        other = np.flatnonzero(group != group[i])
        other = other[other > i]
        if not len(other):
            continue
        near = other[(sig[other] == sig[i]).sum(1) >= least]
        for g in np.unique(group[near]):
            out.append((i, int(near[group[near] == g][0])))
            group[group == g] = group[i]
    return out


def edges(signs: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of keys that connect the near-duplicates among documents with distinct signatures."""
    width = p.size // p.bands

    def bands(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if len(b):
                key = b.column(0).to_numpy()
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(len(b), p.bands, width).astype(np.uint64)
                h = np.broadcast_to(np.arange(p.bands, dtype=np.uint64) * GOLDEN, (len(b), p.bands))
                for j in range(width):
                    h = mix((h + sig[:, :, j]) * GOLDEN)
                yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(key, p.bands))], ["bucket", "key"])

    def verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = int(np.ceil(p.threshold * p.size - 1e-9))
        for t in _by_key(it):
            bucket, key = t.column(0).to_numpy(), t.column(1).to_numpy()
            sig = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint16).reshape(len(key), p.size)
            at, n = _runs(bucket)
            two = at[n == 2]
            two = two[(sig[two] == sig[two + 1]).sum(1) >= least] if len(two) else two
            a, b = [key[two]], [key[two + 1]]
            for lo, k in zip(at[n > 2], n[n > 2]):
                e = np.array(similar_in(sig[lo : lo + k], least), np.int64).reshape(-1, 2) + lo
                a.append(key[e[:, 0]])
                b.append(key[e[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    rows = signs.select("key", "sig").mapInArrow(bands, "bucket long, key long")
    # counted with partial sums, so that no task gets a whole bucket; of those with the same documents one is enough
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(key))").alias("x")).filter("n > 1")
    sizes = cut(sizes.groupBy("x", "n").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    small, large = sizes.filter(F.col("n") <= p.most).drop("n"), sizes.filter(F.col("n") > p.most)
    signs = signs.select("key", "sig")
    met = rows.join(small, "bucket").join(signs, "key").select("bucket", "key", "sig")
    out = met.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(verified, "a long, b long")
    n_large = large.count()  # at most one for most rows
    if not n_large:
        return out
    if n_large <= p.broadcast_rows:
        large = F.broadcast(large)
    return out.union(large_edges(cut(rows.join(large, "bucket").join(signs, "key").select("bucket", "key", "sig", "n")), p))


def large_edges(rows: DataFrame, p: Params) -> DataFrame:
    """edges for buckets of any size: rows of bucket, key, sig and n, the number of rows in the bucket."""
    least = int(np.ceil(p.threshold * p.size - 1e-9))

    def to_first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            if len(t):
                sig, own = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(len(t), p.size) for c in (2, 5))
                yield pa.RecordBatch.from_arrays([*t.columns[:5], pa.array((sig == own).sum(1) >= least)], ["bucket", "key", "sig", "n", "head", "near"])

    def across(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(it):
            at, n = _runs(t.column(0).to_numpy())
            key, sig = t.column(2).to_numpy(), np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint16).reshape(len(t), p.size)
            mine, near = t.column(1).to_numpy(), t.column(4).to_numpy(zero_copy_only=False)
            for lo, k in zip(at, n):
                own = slice(lo, lo + k)
                e = _between(sig[own], key[own], mine[own] == 0, near[own], least)
                yield pa.RecordBatch.from_arrays([pa.array(key[own][e[:, 0]]), pa.array(key[own][e[:, 1]])], ["a", "b"])

    salt = F.pmod(F.xxhash64("key"), F.lit(p.salts))
    first = rows.groupBy("bucket").agg(F.min(F.struct("key", "sig")).alias("f"))
    first = first.select("bucket", F.col("f.key").alias("head"), F.col("f.sig").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.salts - 1).cast("long"))).alias("salt"))
    told = rows.withColumn("salt", salt).join(first, ["bucket", "salt"]).select("bucket", "key", "sig", "n", "head", "own")
    told = cut(told.mapInArrow(to_first, "bucket long, key long, sig binary, n long, head long, near boolean"))
    star = told.filter("near AND key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    left = told.filter("NOT near").groupBy("bucket").agg(F.count("*").alias("m"))
    told = told.join(left, "bucket").withColumns({"parts": F.ceil(F.col("n") / p.block).cast("int"), "others": F.ceil(F.col("m") / p.block).cast("int")})
    all_ = told.select("bucket", "key", "sig", "near", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"), F.lit(1).alias("side"))
    rest = told.filter("NOT near").select("bucket", "key", "sig", "near", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.pmod(F.xxhash64("key", F.lit(2)), F.col("others")).alias("j"), F.lit(0).alias("side"))
    work = rest.unionByName(all_).select(F.xxhash64("bucket", F.col("i").cast("long"), F.col("j").cast("long")).alias("group"), F.col("side").cast("long").alias("side"), "key", "sig", "near")
    work = work.repartition("group").sortWithinPartitions("group", "side", "key")
    return star.union(work.mapInArrow(across, "a long, b long"))


def _between(sig: np.ndarray, key: np.ndarray, mine: np.ndarray, near: np.ndarray, least: int) -> np.ndarray:
    """Places of pairs that connect each row of mine with all others it is similar to; near ones are connected already."""
    other = np.flatnonzero(~mine)
    group = np.arange(len(key))
    if (at := other[near[other]]).size:
        group[at] = at[0]
    out = []
    for i in np.flatnonzero(mine):
        may = other[(group[other] != group[i]) & (key[other] != key[i])]
        hit = may[(sig[may] == sig[i]).sum(1) >= least]
        for g in np.unique(group[hit]):
            out.append((i, hit[group[hit] == g][0]))
            group[group == g] = group[i]
    return np.array(out, np.int64).reshape(-1, 2)


def grouped(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """key, id, root key, root id for each distinct (id, text) that has a near-duplicate; the root stays."""
    signs = cut(signed(docs, p).dropDuplicates(["key"]))
    # exact copies of a signature point to one of them
    heads = signs.groupBy(F.xxhash64("sig").alias("h")).agg(F.min("key").alias("head"), F.count("*").alias("n"))
    twins = signs.select(F.xxhash64("sig").alias("h"), "key").join(heads.filter("n > 1"), "h").filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    only = signs.join(heads.select(F.col("head").alias("key")), "key", "left_semi")
    comp = components(edges(only, p).union(twins))
    own = comp.join(signs.select("key", "id"), F.col("node") == F.col("key")).select("key", "id", "root")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("f"))
    return own.join(first, "root").select("key", "id", F.col("f.key").alias("root_key"), F.col("f.id").alias("root_id"))


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, group_id (doc_id of the document that stays) and keep, a row for each row of docs."""
    g = grouped(docs, p).select("key", "root_key", "root_id")
    rows = docs.select("doc_id", F.when(F.col("text").isNotNull(), row_key(F.col("doc_id"), F.col("text"))).alias("key"))
    n = Window.partitionBy(F.coalesce("key", F.monotonically_increasing_id())).orderBy(F.lit(1))
    rows = rows.withColumn("nth", F.when(F.col("key").isNotNull(), F.row_number().over(n)).otherwise(1))
    out = rows.join(g, "key", "left")
    return out.select("doc_id", F.when(F.col("root_key").isNotNull(), F.col("root_id")).otherwise(F.col("doc_id")).alias("group_id"), ((F.col("nth") == 1) & F.coalesce(F.col("root_key") == F.col("key"), F.lit(True))).alias("keep"))


def without_copies(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    k, nth, gone, again = (fresh(docs, c) for c in ("key", "nth", "gone", "again"))
    late = grouped(docs, p).filter("key <> root_key").select(F.col("key").alias(gone))
    rows = docs.withColumn(k, F.when(F.col("text").isNotNull(), row_key(F.col("doc_id"), F.col("text"))))
    rows = rows.join(late, F.col(k) == F.col(gone), "left_anti")
    twice = rows.filter(F.col(k).isNotNull()).groupBy(k).count().filter("count > 1").select(F.col(k).alias(again))
    once = rows.join(twice, F.col(k) == F.col(again), "left_anti")
    more = rows.join(twice, F.col(k) == F.col(again), "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(k).orderBy(F.lit(1)))).filter(F.col(nth) == 1)
    return once.drop(k).unionByName(more.drop(k, nth))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
