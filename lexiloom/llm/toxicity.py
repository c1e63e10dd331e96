"""Operator 9, toxicity: documents whose windows compress better with a dictionary of toxic text.

Text is compared as its words, in small letters, with one blank between them. Two dictionaries are trained by
zstandard's own trainer on windows of running text of a bounded sample of labelled rows: one on ordinary, one on toxic
documents. As toxic documents are ordinary text for the most part, so is their dictionary; of it stay the runs of
min_match bytes that toxic documents have so much more often that chance can't be the reason, and margin bytes around.

A window is compressed twice, with the ordinary dictionary and the toxic one behind it, and with the ordinary one and as
many bytes behind it that no text has. Offsets and the compressor's choices are then the same but where the toxic
dictionary has a match. Windows are made around the runs that stayed, with context words on either side, neighbouring
ones as one; text without any such run needn't be compressed. A window counts if it is shorter by least_saved bytes or
more with the toxic dictionary.

A document's score is what its distinct windows save in its worst stretch of stretch words, by thousands of words (1
more than they are): what else it holds, and how long it is, can't lower its score. Labelled rows that neither dictionary
has seen choose least_saved and how strong the evidence for a run must be, and give the threshold, at a given
false-alarm rate. Two such dictionaries are kept, those that together find most: one may be of few runs with strong evidence
and a low threshold, the other of many. A score is given in thresholds, the greater of both.

Every document is scored over its whole text. A null text has a null score and isn't toxic; an empty one, or one without
words, scores 0. A score of 1 is the threshold and not above it, so not toxic. Without labelled rows of both kinds,
nothing is toxic. Rows that repeat are scored alike; a null id is kept as it is; columns other than doc_id and text, of
whatever names, are neither read nor changed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import APART, GOLDEN, LOWER, doc_words, pieces, ranges, span_hashes, table


@dataclass(frozen=True)
class Params:
    """train_docs: most labelled documents of each class that the fit uses; half of the clean and a
    quarter of the toxic ones are held out. train_bytes: most
    bytes of their texts, by class; documents beyond either bound aren't fitted on. ordinary_bytes, toxic_bytes: sizes of
    the dictionaries. sample_words: words of a window that the dictionaries are trained on. segment: bytes of the
    trainer's segments. margin: bytes that stay on either side of what is toxic in the toxic dictionary. context: words on
    either side of what a window is about. level: of compression. min_match: least bytes of a match. evidence: least
    log-likelihood ratios, and min_lift: least ratios of document frequencies, that a run of the toxic dictionary must
    have; held-out rows choose of them. false_alarm: share of the clean held-out rows above the threshold. stretch: most
    successive words that are scored together."""

    train_docs: int = 4000
    train_bytes: int = 16 << 20
    ordinary_bytes: int = 8192
    toxic_bytes: int = 32768
    sample_words: int = 12
    segment: int = 24
    margin: int = 4
    context: int = 2
    level: int = 6
    min_match: int = 6
    evidence: tuple[float, ...] = (60.0, 30.0, 20.0, 12.0)
    min_lift: tuple[float, ...] = (20.0, 6.0, 4.0)
    false_alarm: float = 0.0015
    stretch: int = 400
    seed: int = 9


#: Bytes that no normalised text has: control bytes part words.
_FILL = bytes(np.random.default_rng(9).integers(1, 9, 1 << 18, dtype=np.uint8))
#: Ends each window and both dictionaries: no window is then stored as it is for want of matches, which would hide savings.
_TAIL = bytes(np.random.default_rng(8).integers(16, 32, 64, dtype=np.uint8))


def normal(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in small letters with a blank before each and one at the end; where each word's blank is (and the end); each row's first word."""
    data = LOWER[data]
    starts, ends, first = doc_words(data, at, APART)
    n = ends - starts
    spot = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(spot[-1]) + 1, 32, np.uint8)
    out[ranges(spot[:-1] + 1, n)] = data[ranges(starts, n)]
    return out, spot, first


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Each run of k <= 8 bytes as a number."""
    n = max(0, len(data) - k + 1)
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = (x << np.uint64(8)) | data[j : j + n]
    return x


class Grams:
    """A set of runs of bytes, looked up in whole arrays."""

    def __init__(self, known: np.ndarray):
        self.known = np.unique(known)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self._slot(self.known)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return ((x * GOLDEN) >> np.uint64(48)).astype(np.int64)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where x has a known run, and its number."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[self._slot(x)])
        k = np.minimum(np.searchsorted(self.known, x[at]), len(self.known) - 1)
        ok = self.known[k] == x[at]
        return at[ok], k[ok]


@dataclass(frozen=True)
class Tier:
    """A toxic dictionary of runs that so much evidence speaks for; marks: the runs as numbers."""

    toxic: bytes
    marks: np.ndarray
    least_saved: int
    threshold: float


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    tiers: tuple[Tier, ...]
    params: Params


class Savings:
    """What texts save with one toxic dictionary; the lengths of windows that were met before are looked up."""

    def __init__(self, ordinary: bytes, tier: Tier, p: Params, cached: int = 50_000):
        self.p, self.tier, self.cached, self.seen = p, tier, cached, {}
        self.plain, self.both = (self._compressor(ordinary + x + _TAIL + _FILL[:16]) for x in (_FILL[: len(tier.toxic)], tier.toxic))
        self.grams = Grams(tier.marks)

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        p = self.p
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        q = zstandard.ZstdCompressionParameters.from_level(p.level, dict_size=len(content), source_size=256, min_match=p.min_match, strategy=zstandard.STRATEGY_LAZY2, search_log=8, write_checksum=0, write_content_size=0, write_dict_id=0)
        d.precompute_compress(compression_params=q)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=q)

    def lengths(self, window: bytes) -> tuple[int, int]:
        """With the ordinary dictionary, and with the toxic one too."""
        if (got := self.seen.get(window)) is None:
            if len(self.seen) >= self.cached:
                self.seen.clear()
            x = window + _TAIL
            got = self.seen[window] = len(self.plain.compress(x)), len(self.both.compress(x))
        return got

    def windows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first and last word (in the row), name and bytes saved of each window that may save any, in order; and how many words each row has."""
        return self.around(*normal(data, at))

    def around(self, text: np.ndarray, spot: np.ndarray, first: np.ndarray, x: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """windows, of normalised text; x: its runs of min_match bytes."""
        p = self.p
        hit = self.grams.places(grams(text, p.min_match) if x is None else x)[0]
        # the words that the run has a letter of; it may begin with one's blank
        lo = np.searchsorted(spot, hit, "right") - 1
        hi = np.searchsorted(spot, hit + p.min_match - 1, "left") - 1
        row = np.searchsorted(first, lo, "right") - 1
        ok = hi < first[row + 1]  # not across rows
        lo, hi, row = lo[ok], hi[ok], row[ok]
        new = np.ones(len(lo), bool)
        reach = np.maximum.accumulate(hi) if len(hi) else hi
        new[1:] = (row[1:] != row[:-1]) | (lo[1:] > reach[:-1] + 2 * p.context)
        head = np.flatnonzero(new)
        row, a = row[head], lo[head]
        z = np.maximum.reduceat(hi, head) if len(head) else hi
        begin, end = spot[np.maximum(a - p.context, first[row])], spot[np.minimum(z + p.context + 1, first[row + 1])] + 1
        name = span_hashes(text, begin, end)
        raw = text.tobytes()
        saved = np.array([x - y for x, y in (self.lengths(raw[s:e]) for s, e in zip(begin.tolist(), end.tolist()))], np.int64)
        return row, a - first[row], z - first[row], name, saved, np.diff(first)

    def told(self, row: np.ndarray, a: np.ndarray, z: np.ndarray, name: np.ndarray, saved: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
        """The rows' scores, from their windows."""
        most = self.p.stretch
        ok = saved >= least
        row, a, z, name, saved = row[ok], a[ok], z[ok], name[ok], saved[ok]
        best = np.zeros(len(n))
        whole = n[row] <= most
        _, one = np.unique(np.stack([row[whole].astype(np.uint64), name[whole]]), axis=1, return_index=True)
        np.add.at(best, row[whole][one], saved[whole][one])
        for r in np.unique(row[~whole]):
            own = np.flatnonzero(row == r)
            best[r] = _worst(a[own].tolist(), z[own].tolist(), name[own].tolist(), saved[own].tolist(), most)
        return best / (1 + np.minimum(n, most) / 1000)


class Scorer:
    def __init__(self, m: Model):
        self.m, self.tiers = m, [Savings(m.ordinary, t, m.params) for t in m.tiers]

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each text's savings by the tier's threshold, the most of all tiers."""
        text, spot, first = normal(data, at)
        x = grams(text, self.m.params.min_match)
        return np.max([s.told(*s.around(text, spot, first, x), s.tier.least_saved) / s.tier.threshold for s in self.tiers], 0)


def _worst(a: list[int], z: list[int], name: list[int], saved: list[int], most: int) -> int:
    """The most that the distinct windows of a stretch of so many words save; a window that is longer is a stretch of its own."""
    inside: dict[int, int] = {}
    lo = now = best = 0
    for i, (end, w, v) in enumerate(zip(z, name, saved)):
        if not inside.get(w):
            now += v
        inside[w] = inside.get(w, 0) + 1
        while a[lo] <= end - most and lo < i:
            inside[name[lo]] -= 1
            if not inside[name[lo]]:
                now -= saved[lo]
            lo += 1
        best = max(best, now)
    return best


def _slices(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts, joined by the megabyte or so; the driver has room for little more at once."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield joined(part)
            part, size = [], 0
    if part:
        yield joined(part)


def _apart(texts: list[str]) -> list[str]:
    """The documents that aren't near copies of an earlier one (by their words' hashes in 2048 slots); copies would count a run many times."""
    x, done = np.zeros((len(texts), 2048), bool), 0
    for data, at in _slices(texts):
        text, spot, first = normal(data, at)
        h = span_hashes(text, spot[:-1], spot[1:])
        x[done + np.repeat(np.arange(len(first) - 1), np.diff(first)), (h % np.uint64(2048)).astype(np.int64)] = True
        done += len(first) - 1
    rare = np.flatnonzero(x.mean(0) <= 0.1)
    size = x[:, rare].sum(1)
    keep: list[int] = []
    rows = np.zeros((len(texts), len(rare)), np.float32)
    for i in range(len(texts)):
        own = x[i, rare].astype(np.float32)
        got = rows[: len(keep)] @ own
        if not keep or not np.any((got > 0.5 * (size[keep] + size[i] - got)) & (size[i] > 0)):
            rows[len(keep)] = own
            keep.append(i)
    return [texts[i] for i in keep]


def _trained(texts: list[str], size: int, p: Params) -> bytes:
    """What zstandard's trainer makes of the windows of the texts; of too few for it, their last bytes."""
    samples: list[bytes] = []
    for data, at in _slices(texts):
        text, spot, first = normal(data, at)
        begin = np.concatenate([np.arange(a, b, p.sample_words) for a, b in zip(first[:-1], first[1:])]).astype(np.int64)
        stop = np.minimum(begin + p.sample_words, first[np.searchsorted(first, begin, "right")])
        raw = text.tobytes()
        samples += [raw[s:e] for s, e in zip(spot[begin].tolist(), (spot[stop] + 1).tolist()) if e - s > 8]
    while size >= 1024:
        try:
            got = zstandard.train_dictionary(size, samples, k=p.segment, d=p.min_match, f=20, accel=1, split_point=1.0, steps=1)
        except zstandard.ZstdError:  # too few samples
            break
        if len(got) > 0.9 * size:
            # the last bytes are segments, the best of them at the end; the tables before them take less than an eighth
            return got.as_bytes()[size // 8 :]
        size //= 2  # where the text doesn't give that many segments, the trainer gives up early
    return b"".join(samples)[-size:]


def _frequency(g: Grams, texts: list[str], k: int) -> np.ndarray:
    """In how many documents each run occurs."""
    out = np.zeros(len(g.known), np.int64)
    for data, at in _slices(texts):
        text, spot, first = normal(data, at)
        place, which = g.places(grams(text, k))
        pair = np.unique((np.searchsorted(spot[first], place, "right") - 1) * len(g.known) + which)
        out += np.bincount(pair % max(1, len(g.known)), minlength=len(g.known))
    return out


def _evidence(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Twice the log-likelihood ratio of a in n and b in m documents against one share for both."""
    share = (a + b) / (n + m)

    def part(k: np.ndarray, of: int, q: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(q)) + np.nan_to_num((of - k) * np.log(1 - q))

    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, share) - part(b, m, share))


def fit(toxic: list[str], clean: list[str], p: Params = Params()) -> Model | None:
    """None if either side is too small to say anything."""
    if len(toxic) < 4 or len(clean) < 4:
        return None
    plain, bad = clean[::2], _apart([t for i, t in enumerate(toxic) if i % 4])
    base, marks = _trained(plain, p.ordinary_bytes, p), _trained(bad, p.toxic_bytes, p)
    x = np.frombuffer(marks, np.uint8)
    of = grams(x, p.min_match)
    g = Grams(of)
    here, there = _frequency(g, bad, p.min_match), _frequency(g, plain, p.min_match)
    n, m = len(bad), len(plain)
    at = np.searchsorted(g.known, of)
    held = [clean[1::2], toxic[::4]]
    found: list[tuple[np.ndarray, Tier]] = []
    strong = _evidence(here, there, n, m)
    for least_strong, lift in product(p.evidence, p.min_lift):
        fine = (here >= 4) & (strong >= least_strong) & (here / n >= lift * (there + 0.5) / m)
        inside = np.zeros(len(x) + 1, bool)
        for j in range(p.min_match):
            inside[j : j + len(of)] |= fine[at]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
        runs = list(dict.fromkeys(marks[max(0, a - p.margin) : b + p.margin] for a, b in zip(edge[0::2], edge[1::2])))
        if not runs:
            continue
        # runs are parted by a byte that no text has
        s = Savings(base, Tier(b"\x0f".join(runs), g.known[fine], 1, 0.5), p)
        windows = [[s.windows(*t) for t in _slices(x)] for x in held]
        for least in range(1, 4):
            clear, caught = (np.concatenate([s.told(*w, least) for w in x]) for x in windows)
            # half of the false alarms for either tier; all scores but 0 are above 0.5
            above = max(0.5, float(np.sort(clear)[max(0, int(np.ceil((1 - p.false_alarm / 2) * len(clear))) - 1)]))
            found.append((caught > above, replace(s.tier, least_saved=least, threshold=above)))
    if not found:
        return None
    told = np.array([t for t, _ in found])
    pair = max(((i, j) for i in range(len(found)) for j in range(i, len(found))), key=lambda k: (told[k[0]] | told[k[1]]).sum())
    return Model(base, tuple(found[k][1] for k in dict.fromkeys(pair)), p)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model | None:
    """Fit on at most train_docs labelled documents and train_bytes of text of each class, in the order of a hash of the id."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("is_toxic"))
    rank = F.xxhash64(F.lit(p.seed), "doc_id")
    chosen = [known.filter(F.col("is_toxic") == k).orderBy(rank, "doc_id").limit(p.train_docs) for k in (0, 1)]
    # at most twice train_docs ids, whatever the size of the tables
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = rows.groupBy("doc_id", "is_toxic").agg(F.min("text").alias("text")).withColumn("rank", rank)
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("is_toxic").orderBy("rank", "doc_id"))
    got = rows.withColumn("bytes", so_far).filter(F.col("bytes") <= p.train_bytes).select("doc_id", "is_toxic", "text").collect()
    got = sorted(got, key=lambda r: (zlib.crc32(str((p.seed, r.doc_id)).encode()), r.doc_id))
    return fit([r.text for r in got if r.is_toxic], [r.text for r in got if not r.is_toxic], p)


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, score and whether the document is toxic, a row for each row of docs."""
    m = train(docs, labels, p)
    src = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(m) if m else None
        for b, data, at in pieces(it, "text"):
            score = s.scores(data, at) if s else np.zeros(len(b))
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            bad = (score > 1) & ~null if m else np.zeros(len(b), bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, mask=null), pa.array(bad)], ["doc_id", "score", "toxic"])

    return src.mapInArrow(run, f"doc_id {kind}, score double, toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that aren't toxic, with their columns."""
    m = train(docs, labels, p)
    if m is None:
        return docs

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(m)
        for b, data, at in pieces(it, "text"):
            null = b.column(b.schema.get_field_index("text")).is_null().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(null | (s.scores(data, at) <= 1)))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
