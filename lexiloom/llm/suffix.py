"""Operator 2, repeated passages: suffix arrays by shard, common prefixes, merging across shards by binary search.

A window is a run of min_words words (separated by ASCII white space). It is a repeat if the same words stand at an
earlier place of any document, by doc_id (nulls last), hash of id and text, and position. The repeats' union makes the
spans to cut; the first place of each passage stays. That is exact, up to collisions of 64-bit hashes.

1. Equal windows have the same anchor: the least hash among the runs of half their words that lie in them. A window
   whose anchor occurs nowhere else can't be a repeat, nor can a document of such windows; they are left alone.
2. The rest is sharded. A shard's suffixes (of words, in the order of their hashes) are sorted by Larsson and
   Sadakane's refinement: groups that agree in h words are split by the ranks h words further on, groups of one are
   left alone, h doubles. Kasai's common prefixes follow: those that the predecessor's doesn't give less one are
   found directly, all others by subtraction. Suffixes that agree in a window are one group, of which the first stays.
3. A shard sends the first of each group, in parts by hash; a part merges the sorted runs by binary search, two and
   two, and the later of two equal windows is a repeat.

A null or empty text, or one of fewer words, has no repeats. A text of any length is compared whole, in a shard of its
own if it is longer than one. Rows that repeat id and text are one document: each is cut alike, and they aren't repeats
of each other. Other texts with the same id are told apart by the hash of id and text, so no order is tied. A doc_id has
to be a number or null (the greatest 64-bit number comes last, with the nulls). Other columns, of whatever names, are
neither read nor changed, but for n_chars, which is counted anew where without_repeats cuts a text. An empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, doc_words, fresh, mix, partitions, pieces, powers, ranges, row_key, span_hashes, table


@dataclass(frozen=True)
class Params:
    """min_words: length of a window. shard_bytes: text a shard's suffix array covers, unless one text is longer."""

    min_words: int = 50
    shard_bytes: int = 3 << 20


_LAST = np.int64(2**63 - 1)
#: Low bits of a hash that give way to its place in a stretch of at most 2**_PLACE_BITS.
_PLACE_BITS = 24


class Grams:
    """Hashes of any run of the given words."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=self.sums[1:])

    def of(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.down[at])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i:i + w] for each i where all are there."""
    n, step, m = len(x) - w + 1, 1, x
    while step * 2 <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[:n], m[w - step : w - step + n])


def anchors(g: Grams, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that lie in one row, and where the least half-window run in each begins; both as numbers of words."""
    k = size // 2 + 1
    n = int(first[-1])
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = g.of(np.arange(n - k + 1), k)
    w, bits = size - k + 1, np.uint64(_PLACE_BITS)
    least = np.empty(len(x) - w + 1, np.int64)
    step = 2**_PLACE_BITS - w + 1
    for lo in range(0, len(least), step):  # stretches overlap, so that each window lies in one
        part = x[lo : lo + step + w - 1]
        part = window_min((part >> bits << bits) | np.arange(len(part), dtype=np.uint64), w)
        least[lo : lo + len(part)] = (part & np.uint64(2**_PLACE_BITS - 1)).astype(np.int64) + lo
    count = np.diff(first)
    whole = ranges(first[:-1][count >= size], count[count >= size] - size + 1)
    return whole, least[whole]


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes of ids (from 1 on) in order by their first h >= depth ids, their groups' ranks by place, and h."""
    n = len(ids)
    bits = int(ids.max()).bit_length()
    h = max(1, min(63 // bits, depth))
    key = ids.astype(np.int64)
    for j in range(1, h):
        key <<= bits
        if j < n:
            key[: n - j] |= ids[j:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    todo = np.arange(n)
    while h < depth:
        alone = start & np.append(start[1:], True)
        todo, start = todo[~alone], start[~alone]
        if not len(todo):
            h = depth
            break
        p = order[todo]
        key = (rank[p] << 32) | np.where(p + h < n, rank[np.minimum(p + h, n)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[todo], key = p[by], key[by]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[todo]] = np.maximum.accumulate(np.where(start, todo, 0))
        h *= 2
    return order, rank[:n], h


def common_prefixes(order: np.ndarray, rank: np.ndarray, h: int, g: Grams, left: np.ndarray) -> np.ndarray:
    """Kasai's array: how many ids the suffix at each place shares with the one before it in order, at most left[place]."""
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    new = np.ones(n, bool)  # the others have their predecessor's prefix less one
    new[1:] = before[1:] != before[:-1] + 1
    new |= before < 0
    out = np.zeros(n, np.int64)

    def direct(p: np.ndarray) -> np.ndarray:
        q = before[p]
        most = np.minimum(left[p], left[q])
        far = rank[p] == rank[q]  # these agree in h ids
        lo, hi = np.where(far, np.minimum(h, most), 0), np.where(far, most, np.minimum(h, most))
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_] + 1) // 2
            same = g.of(p[open_], mid) == g.of(q[open_], mid)
            lo[open_[same]] = mid[same]
            hi[open_[~same]] = mid[~same] - 1

    p = np.flatnonzero(new & (before >= 0))
    out[p] = direct(p)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    out = out[head] - (np.arange(n) - head)
    p = np.flatnonzero(~new & (out <= 0) & (before >= 0))  # a prefix of none says nothing about the next
    out[p] = direct(p)
    return np.maximum(out, 0)


def repeats(data: np.ndarray, at: np.ndarray, place: np.ndarray, known: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's rows: repeated windows (row, word), and the first of each other group (row, word, hash).

    place: ranks of the rows in the documents' order. known: the anchors of each row that occur elsewhere, as words' numbers.
    """
    starts, ends, first = doc_words(data, at)
    words = span_hashes(data, starts, ends)
    g = Grams(words)
    n = len(words)
    win, at_ = anchors(g, first, size)
    shared = np.zeros(n + 1, bool)
    for a, f in zip(known, first):
        shared[a + f] = True
    may = np.zeros(n, bool)
    may[win[shared[at_]]] = True
    none = np.zeros(0, np.int64)
    if not may.any():
        return none, none, none, none, none.view(np.uint64)
    cover = np.zeros(n + 1, np.int64)
    win = np.flatnonzero(may)
    np.add.at(cover, win, 1)
    np.add.at(cover, win + size, -1)
    inside = np.cumsum(cover)[:n] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    # a run doesn't end with its row where the next row's begins at once
    cuts = np.unique(np.concatenate([edge[0::2], first[:-1][(first[:-1] < n) & inside[np.minimum(first[:-1], n - 1)]]]))
    stop = np.minimum(np.append(cuts[1:], n), edge[1::2][np.searchsorted(edge[1::2], cuts, "right")])
    # the runs, each with an id of its own behind it
    own = ranges(cuts, stop - cuts)
    shift = np.repeat(np.arange(len(cuts)), stop - cuts)
    spot = np.arange(len(own)) + shift
    total = len(own) + len(cuts)
    _, word_id = np.unique(words[own], return_inverse=True)
    ids = np.zeros(total, np.int64)
    ids[spot] = word_id + 1
    seps = np.cumsum(stop - cuts) + np.arange(len(cuts))
    ids[seps] = word_id.max() + 2 + np.arange(len(cuts))
    order, rank, h = suffix_array(ids, size)
    left = np.zeros(total, np.int64)
    left[spot] = np.repeat(stop, stop - cuts) - own
    values = np.zeros(total, np.uint64)
    values[spot] = words[own]
    values[seps] = mix(np.arange(len(cuts), dtype=np.uint64) + np.uint64(1))
    lcp = common_prefixes(order, rank, h, Grams(values), left)
    source = np.full(total, -1)
    source[spot] = own
    src = source[order]
    ok = (src >= 0) & may[np.maximum(src, 0)]
    group = np.cumsum(lcp[order] < size)[ok]
    w = src[ok]
    row = np.searchsorted(first, w, "right") - 1
    pos = w - first[row]
    loc = (place[row].astype(np.int64) << 32) | pos
    by = np.lexsort([loc, group])
    group, row, pos, w = group[by], row[by], pos[by], w[by]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    return row[~head], pos[~head], row[head], pos[head], g.of(w[head], size)


def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Two runs (hash, id, key, start, end), each sorted by hash without equal ones, as one; and what came later of the equal ones.

    The same place of the same document, from copies of its row in two shards, is one window and not late.
    """
    i = np.searchsorted(a[0], b[0])
    hit = np.zeros(len(b[0]), bool)
    inside = i < len(a[0])
    hit[inside] = a[0][i[inside]] == b[0][inside]
    ia, ib = i[hit], np.flatnonzero(hit)
    x, y = [c[ia] for c in a[1:4]], [c[ib] for c in b[1:4]]
    earlier = (y[0] < x[0]) | (y[0] == x[0]) & ((y[1] < x[1]) | (y[1] == x[1]) & (y[2] < x[2]))
    apart = (x[0] != y[0]) | (x[1] != y[1]) | (x[2] != y[2])
    late = tuple(np.where(earlier, c[ia], d[ib])[apart] for c, d in zip(a, b))
    keep = list(a)
    for k in range(1, 5):
        keep[k] = keep[k].copy()
        keep[k][ia[earlier]] = b[k][ib[earlier]]
    out = tuple(np.insert(c, i[~hit], d[~hit]) for c, d in zip(keep, b))
    return out, late


def _rows(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """A row for each key: the key and its spans' starts and ends, with overlapping ones joined."""
    by = np.lexsort([start, key])
    key, start, end = key[by], start[by], end[by]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    base = np.cumsum(new) << 33
    far = np.maximum.accumulate(end + base) - base  # how far the spans up to this one reach, in each key
    head = new.copy()
    head[1:] |= start[1:] > far[:-1]
    at = np.flatnonzero(head)
    end = np.maximum.reduceat(end, at) if len(at) else end
    key, start = key[at], start[at]
    rows = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    offs = pa.array(np.append(rows, len(key)), pa.int32())
    cols = [pa.array(key[rows]), pa.ListArray.from_arrays(offs, pa.array(start, pa.int32())), pa.ListArray.from_arrays(offs, pa.array(end, pa.int32()))]
    return pa.RecordBatch.from_arrays(cols, ["key", "starts", "ends"])


def _split(part: np.ndarray, n: int) -> list[np.ndarray]:
    by = np.argsort(part, kind="stable")
    return np.split(by, np.searchsorted(part[by], np.arange(1, n)))


def repeated_spans(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """key, starts, ends: the byte spans to cut from each document that has any, in order, none overlapping."""
    size, n_parts = p.min_words, partitions(docs)
    src = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))

    def anchored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, at in pieces(it, "text"):
            starts, ends, first = doc_words(data, at)
            g = Grams(span_hashes(data, starts, ends))
            a = np.unique(anchors(g, first, size)[1])
            x = g.of(a, size // 2 + 1)
            row = np.searchsorted(first, a, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(b.column(0).to_numpy()[row]), pa.array(a - first[row], pa.int32())], ["x", "key", "pos"])

    def sorted_shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b, _, _ in pieces(it, "text", p.shard_bytes):
            keys = b.column(0).to_pylist()
            fresh_rows = [k not in seen and not seen.add(k) for k in keys]  # rows that repeat are one document; merged() tells those of other tasks
            b = b.filter(pa.array(fresh_rows))
            data, at = binary_parts(b.column(2))
            key = b.column(0).to_numpy()
            id_ = b.column(1).fill_null(int(_LAST)).to_numpy()
            place = np.empty(len(b), np.int64)
            place[np.lexsort([key, id_])] = np.arange(len(b))
            known = [np.unique(np.asarray(x, np.int64)) for x in b.column(3).to_pylist()]
            starts, ends, first = doc_words(data, at)

            def spans(row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                w = first[row] + pos
                return (starts[w] - at[row]).astype(np.int32), (ends[w + size - 1] - at[row]).astype(np.int32)

            row, pos, row1, pos1, x = repeats(data, at, place, known, size)
            out: list[tuple] = []
            if len(row):
                for k, s, e in zip(*(c.to_pylist() for c in _rows(key[row], *spans(row, pos)).columns)):
                    out.append((k % n_parts, k, b"", b"", b"", np.array(s, np.int32).tobytes(), np.array(e, np.int32).tobytes()))
            s, e = spans(row1, pos1)
            for k, own in enumerate(_split((x % np.uint64(n_parts)).astype(np.int64), n_parts)):
                if len(own):
                    own = own[np.argsort(x[own])]
                    out.append((k, None, *(c.tobytes() for c in (x[own], id_[row1[own]], key[row1[own]], s[own], e[own]))))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["part", "done", "x", "id", "key", "start", "end"])

    def across(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[int, tuple[np.ndarray, ...]]] = []
        late: list[tuple[np.ndarray, ...]] = []

        def join_last() -> None:
            (m, a), (n, b) = runs.pop(-2), runs.pop()
            both, rest = merged(a, b)
            late.append(rest[2:])
            runs.append((m + n, both))

        kinds = (np.uint64, np.int64, np.int64, np.int32, np.int32)
        for b in it:
            for _, done, *cols in zip(*(b.column(i).to_pylist() for i in range(7))):
                if done is not None:
                    s, e = (np.frombuffer(c, np.int32) for c in cols[3:])
                    late.append((np.full(len(s), done), s, e))
                    continue
                runs.append((1, tuple(np.frombuffer(c, t) for c, t in zip(cols, kinds))))
                while len(runs) > 1 and runs[-2][0] <= runs[-1][0]:
                    join_last()
        while len(runs) > 1:
            join_last()
        if late:
            r = _rows(*(np.concatenate([x[i] for x in late]) for i in range(3)))
            for i in range(0, len(r), 5_000):
                yield r.slice(i, 5_000)

    def united(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for s, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                s, e = (np.array([v for x in part for v in x], np.int64) for part in (s, e))
                out.append(_rows(np.zeros(len(s), np.int64), s, e))
            cols = [pa.array([r.column(i)[0].as_py() for r in out], pa.list_(pa.int32())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["key", "starts", "ends"])

    found = src.select("key", "text").mapInArrow(anchored, "x long, key long, pos int")
    # counted with partial sums; an anchor of very many documents is split by the join, as its other side has one row
    twice = found.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x")
    known = found.join(twice.hint("merge"), "x").groupBy("key").agg(F.collect_list("pos").alias("known"))
    rows = src.join(known, "key").select("key", "id", "text", "known")
    runs = rows.mapInArrow(sorted_shards, "part int, done long, x binary, id binary, key binary, start binary, end binary")
    late = runs.repartitionById(n_parts, "part").mapInArrow(across, "key long, starts array<int>, ends array<int>")
    out = late.groupBy("key").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    return out.mapInArrow(united, "key long, starts array<int>, ends array<int>")


def suffix_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, start, end: the byte spans that repeat earlier passages; those of rows that repeat, once."""
    spans = repeated_spans(docs, p)
    ids = docs.filter("text IS NOT NULL").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    ids = ids.join(spans, "key").dropDuplicates(["key"])
    return ids.select("doc_id", F.explode(F.arrays_zip("starts", "ends")).alias("s")).select("doc_id", F.col("s.starts").alias("start"), F.col("s.ends").alias("end"))


def without_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs without the repeated passages; rows of which only white space is left go, others that aren't cut stay as they are."""
    spans = repeated_spans(docs, p)
    k = fresh(docs, "key")
    s, e, cut_ = fresh(docs, "starts"), fresh(docs, "ends"), fresh(docs, "cut")
    rows = docs.withColumn(k, F.when(F.col("text").isNotNull(), row_key(F.col("doc_id"), F.col("text"))))
    spans = spans.select(F.col("key").alias(cut_), F.col("starts").alias(s), F.col("ends").alias(e))
    rows = rows.join(spans, F.col(k) == F.col(cut_), "left").drop(cut_, k)

    raw = F.col("text").cast("binary")
    # what lies between the spans; they begin and end with words, so that each piece is text
    between = F.transform(
        F.sequence(F.lit(0), F.size(s)),
        lambda i: F.substring(raw, F.coalesce(F.get(e, i - 1), F.lit(0)) + 1, F.coalesce(F.get(s, i), F.octet_length(raw)) - F.coalesce(F.get(e, i - 1), F.lit(0))).cast("string"),
    )
    rows = rows.withColumn("text", F.when(F.col(s).isNotNull(), F.array_join(between, "")).otherwise(F.col("text")))
    rows = rows.filter(F.col(s).isNull() | F.col("text").rlike("\\S"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(s).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats(table(spark, sf_dir, "documents"))
