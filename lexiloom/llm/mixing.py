"""Operator 10, mixing sources to target weights: fixed blocks, multinomial counts, permuted indexes, a join by index.

Tokens are words (runs without ASCII white space). Each source's words are packed, in the order of its rows, into
blocks of block_words; a row may end in the middle of a block and go on in the next. A task packs what it reads; what
it has left of each source is packed with the rest of up to tail_tasks tasks, so only the last block of those is
shorter. A block keeps the pieces of rows in it, with their doc_id.

As many blocks are drawn as there are. They make output shards of shard_slots slots; a shard draws its counts by
source from a multinomial distribution with the target weights. The n-th slot of a source takes the block whose index
is n under a pseudorandom permutation of that source's indexes (a Feistel network, walked until the index exists):
within an epoch no block comes twice, and a source that is to have more than it has goes into further epochs, each
with its own permutation. Blocks and slots meet in a join by source and index.

Without weights given, they are the sources' shares of words raised to temperature. Given weights of sources that have
no words are left out; sources without a given weight have none. A null source is a source of its own, and so is the
empty one. Null texts and texts without words have nothing to pack. Rows that repeat are packed as often as they
occur. A null doc_id stays null; others have to be numbers. A text of any length is packed, over as many blocks as it
takes, a slice at a time. Blocks are told apart by their index, so nothing in a draw is tied. Other columns, of whatever
names, are ignored. Without any words the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GOLDEN, cut, doc_words, mix, pieces, scratch, table

_BLOCK = "sid long, source string, part long, nth long, n_words int, text binary, doc_ids array<long>, langs array<string>, ends array<int>"


@dataclass(frozen=True)
class Params:
    """block_words: length of a block. shard_slots: blocks of an output shard. weights: (source, weight) pairs, or None. temperature: see above. tail_tasks: see above. broadcast_rows: most rows (one of some 24 bytes for each source and packing task) that are broadcast to number the blocks; with more of them both sides are shuffled, to the same result."""

    block_words: int = 1024
    shard_slots: int = 1024
    weights: tuple[tuple[str | None, float], ...] | None = None
    temperature: float = 0.7
    tail_tasks: int = 256
    broadcast_rows: int = 500_000
    seed: int = 10


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0, ..., n - 1, chosen by key, takes each x."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64((key + (r + 1) * int(GOLDEN)) % (1 << 64)) for r in range(6)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & low
        for k in keys:
            a, b = b, a ^ (mix(b * GOLDEN + k) & low)
        return (a << np.uint64(half)) | b

    out = once(np.asarray(x, np.uint64))
    while True:
        off = np.flatnonzero(out >= np.uint64(n))
        if not len(off):
            return out.astype(np.int64)
        out[off] = once(out[off])


class _Packer:
    """Blocks of one source."""

    def __init__(self, size: int):
        self.size, self.n, self.parts = size, 0, []

    def add(self, raw: bytes, n: int, doc: int | None, lang: str | None) -> list[tuple] | None:
        """The finished block if this piece, of at most what there is room for, fills it."""
        self.parts.append((raw, doc, lang))
        self.n += n
        return self.take() if self.n == self.size else None

    def take(self) -> tuple:
        out, parts = self.n, self.parts
        self.n, self.parts = 0, []
        ends = np.cumsum([len(r) + 1 for r, _, _ in parts]) - 1
        return out, b"\n".join(r for r, _, _ in parts), [d for _, d, _ in parts], [x for _, _, x in parts], ends.tolist()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("sid", pa.int64()), ("source", pa.string()), ("part", pa.int64()), ("nth", pa.int64()), ("n_words", pa.int32()), ("text", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _fill(packer: _Packer, data: bytes, starts: np.ndarray, ends: np.ndarray, doc: int | None, lang: str | None) -> Iterator[tuple]:
    at, n = 0, len(starts)
    while at < n:
        to = min(n, at + packer.size - packer.n)
        got = packer.add(data[starts[at] : ends[to - 1]], to - at, doc, lang)
        if got:
            yield got
        at = to


def packed(docs: DataFrame, p: Params) -> DataFrame:
    """The blocks, written to the shared folder: sid, source, part and nth (which name a block), n_words, text, doc_ids, langs, ends."""
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    src = docs.filter("text IS NOT NULL").select(F.xxhash64(F.coalesce(source, F.lit("\0"))).alias("sid"), source.alias("source"), F.col("doc_id").cast("long").alias("id"), lang.alias("lang"), F.col("text").cast("binary").alias("text"))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packers: dict[int, _Packer] = {}
        names: dict[int, str | None] = {}
        count: dict[int, int] = {}
        for b, data, at in pieces(it, "text"):
            starts, ends, first = doc_words(data, at)
            raw, rows = data.tobytes(), []
            for i, (sid, name, doc, lang_) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
                if sid not in packers:
                    packers[sid], names[sid], count[sid] = _Packer(p.block_words), name, 0
                for got in _fill(packers[sid], raw, starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], doc, lang_):
                    rows.append((sid, name, part, count[sid], *got))
                    count[sid] += 1
            if rows:
                yield _batch(rows)
        rest = [(sid, names[sid], part, -1, *k.take()) for sid, k in packers.items() if k.n]
        if rest:
            yield _batch(rest)

    def tails(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer, name, count = None, None, None, 0
        for b in it:
            rows = []
            for sid, source_, part, _, _, text, ids, langs, ends in zip(*(b.column(i).to_pylist() for i in range(9))):
                group = -1 - part // p.tail_tasks
                if (sid, group) != now:
                    if packer and packer.n:
                        rows.append((now[0], name, now[1], count, *packer.take()))
                    now, packer, name, count = (sid, group), _Packer(p.block_words), source_, 0
                begin = 0
                for doc, lang_, end in zip(ids, langs, ends):
                    raw = text[begin:end]
                    begin = end + 1
                    s, e, _ = doc_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    for got in _fill(packer, raw, s, e, doc, lang_):
                        rows.append((sid, source_, group, count, *got))
                        count += 1
            if rows:
                yield _batch(rows)
        if packer and packer.n:
            yield _batch([(now[0], name, now[1], count, *packer.take())])

    to = scratch(spark, "blocks")
    src.mapInArrow(pack, _BLOCK).write.parquet(f"{to}/nth")
    first = spark.read.schema(_BLOCK).parquet(f"{to}/nth")
    left = first.filter("nth < 0").withColumn("g", F.floor(F.col("part") / p.tail_tasks)).repartition("sid", "g").sortWithinPartitions("sid", "g", "part").drop("g")
    left.mapInArrow(tails, _BLOCK).write.parquet(f"{to}/tails")
    return first.filter("nth >= 0").union(spark.read.schema(_BLOCK).parquet(f"{to}/tails"))


def slots(spark: SparkSession, sizes: list[tuple[int, int, float]], total: int, p: Params) -> DataFrame:
    """shard, slot, sid, epoch, index for each of total slots. sizes: sid, its number of blocks, its weight."""
    sids, number = np.array([s for s, _, _ in sizes], np.int64), np.array([n for _, n, _ in sizes], np.int64)
    weights = np.array([w for _, _, w in sizes], np.float64)
    weights = weights / weights.sum()
    n_shards = -(-total // p.shard_slots)

    def draw(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            shard, sid, n = [], [], []
            for s in b.column(0).to_pylist():
                size = min(p.shard_slots, total - s * p.shard_slots)
                counts = np.random.Generator(np.random.Philox(key=[p.seed, s])).multinomial(size, weights)
                has = np.flatnonzero(counts)
                shard += [s] * len(has)
                sid += sids[has].tolist()
                n += counts[has].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shard, sid, n)], ["shard", "sid", "n"])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {int(s): int(n) for s, n in zip(sids, number)}
        for b in it:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for shard, sid, n, before, at in zip(*(b.column(i).to_pylist() for i in range(5))):
                size = min(p.shard_slots, total - shard * p.shard_slots)
                nth = np.arange(before, before + n)
                blocks = known[sid]
                epoch, index = nth // blocks, nth % blocks
                for e in np.unique(epoch):
                    key = int(mix(np.array([sid], np.int64).view(np.uint64) ^ mix(np.array([p.seed * 1_000_003 + e], np.uint64)))[0])
                    index[epoch == e] = feistel(index[epoch == e], blocks, key)
                slot = feistel(np.arange(at, at + n), size, p.seed * 7919 + shard)
                for c, v in zip(cols, (np.full(n, shard), slot, np.full(n, sid), epoch, index)):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], ["shard", "slot", "sid", "epoch", "index"])

    counts = spark.range(n_shards).mapInArrow(draw, "shard long, sid long, n long")
    # sums over the shards before, and over the shard's other sources
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")
    at = F.sum("n").over(Window.partitionBy("shard").orderBy("sid")) - F.col("n")
    counts = counts.select("shard", "sid", "n", before.alias("before"), at.alias("at"))
    return counts.mapInArrow(place, "shard long, slot long, sid long, epoch long, index long")


def mixed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """shard, slot, source, epoch, block (its index in the source), n_words, doc_ids, text (pieces joined by line ends), langs, ends."""
    spark = docs.sparkSession
    blocks = packed(docs, p)
    n = cut(blocks.groupBy("sid", "source", "part").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")))
    by = n.groupBy("sid", "source").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).orderBy("sid").collect()  # a row for each source
    given = dict(p.weights) if p.weights is not None else None
    sizes = [(r.sid, r.n, float(given.get(r.source, 0.0) if given is not None else r.words**p.temperature)) for r in by]
    if sum(w for _, _, w in sizes) > 0:
        drawn = slots(spark, sizes, sum(k for _, k, _ in sizes), p)
    else:
        drawn = spark.createDataFrame([], "shard long, slot long, sid long, epoch long, index long")
    base = n.select(F.col("sid").alias("b_sid"), F.col("part").alias("b_part"), (F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).alias("base"))
    if n.count() <= p.broadcast_rows:
        base = F.broadcast(base)
    blocks = blocks.join(base, (F.col("sid") == F.col("b_sid")) & (F.col("part") == F.col("b_part"))).withColumn("index", F.col("base") + F.col("nth"))
    # both sides grow with the input, whatever the planner takes the slots' size for
    out = drawn.hint("merge").join(blocks, ["sid", "index"])
    return out.select("shard", "slot", "source", "epoch", F.col("index").alias("block"), "n_words", "doc_ids", F.col("text").cast("string").alias("text"), "langs", "ends")


def mixed_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The drawn blocks' pieces, a row for each, with the columns of docs; those other than doc_id, text, lang, source and n_chars are null."""
    rows = mixed(docs, p).select("*", F.posexplode(F.arrays_zip("doc_ids", "langs", "ends")).alias("i", "piece"))
    start = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.get("ends", F.col("i") - 1) + 1)
    text = F.substring(F.col("text").cast("binary"), start + 1, F.col("piece.ends") - start).cast("string")
    rows = rows.select(F.col("piece.doc_ids").alias("doc_id"), text.alias("text"), F.col("piece.langs").alias("lang"), "source")
    have = {"doc_id", "text", "lang", "source"}
    cols = [F.length("text") if c == "n_chars" else F.col(c) if c in have else F.lit(None) for c in docs.columns]
    return rows.select(*(c.cast(docs.schema[k].dataType).alias(k) for c, k in zip(cols, docs.columns)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("langs", "ends")
