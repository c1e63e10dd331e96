"""Operator 7, language: averaged embeddings of hashed subwords, a linear softmax, and a calibrated rejection.

A word (lower case, without punctuation) has its own feature and those of its runs of 2 to 4 bytes with marked ends,
each hashed to a bucket. A text's vector is the mean of its features' embeddings; a softmax of a linear map of it
gives the languages. Embeddings and map are trained together by stochastic gradient descent in numpy, on windows of a
bounded sample of the rows that name a language. Held-out rows of that sample give the temperature (least negative
log-likelihood, with a row of doubt for each language, without which rows that are all told rightly would ask for none)
and the confidence below which a text is rejected, so that the given share of rightly told texts is; of fewer rows than
one in that share, the least confident one that is told rightly is still accepted.

As all is linear, a text's scores are the mean of its features' scores; a task computes those of each distinct word
once. Every text is scored whole. A null text, one without words, or one below the threshold has a null language and
accepted false; a null text's confidence is null. Rows that repeat are told alike; a null id stays. A language with
fewer than 8 rows isn't learnt, nor is one beyond the most_langs most frequent ones; with none learnt, all is rejected.
Of equally likely languages the first by name is told, and a confidence that equals the threshold is accepted. Other
columns, of whatever names, are ignored. A doc_id has to be a number or null.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import APART, GOLDEN, LOWER, doc_words, mix, pieces, ranges, span_hashes, table


@dataclass(frozen=True)
class Params:
    """train_docs: most rows of a language that the fit uses, a third of them held out. train_bytes: most bytes of their
    texts, of all languages; each has an equal part. most_langs: languages that are learnt. window: words of a training
    example. epoch_windows: most windows an epoch draws. rejected: share of the held-out rows told rightly that the
    threshold rejects."""

    train_docs: int = 384
    train_bytes: int = 32 << 20
    most_langs: int = 200
    epoch_windows: int = 8_000
    buckets: int = 1 << 15
    dim: int = 16
    window: int = 24
    epochs: int = 6
    rate: float = 0.5
    batch: int = 32
    rejected: float = 0.002
    seed: int = 7


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, and where each word's begin (and the last end)."""
    n = ends - starts
    wide = n + 2
    at = np.concatenate([[0], np.cumsum(wide)])
    buf = np.full(int(at[-1]), 1, np.uint8)  # the marks of a word's ends
    buf[ranges(at[:-1] + 1, n)] = data[ranges(starts, n)]
    buf[at[1:] - 1] = 2
    whole = mix(span_hashes(data, starts, ends))
    x, cols, owner = buf.astype(np.uint64), [whole], [np.arange(len(n))]
    word = np.repeat(np.arange(len(n)), wide)
    left = np.repeat(at[1:], wide) - np.arange(len(buf))
    h = x + np.uint64(1)
    for k in (2, 3, 4):
        h = h.copy()
        h[: len(h) - k + 1] = h[: len(h) - k + 1] * np.uint64(0x100000001B3) + x[k - 1 :]
        ok = left >= k
        cols.append(mix(h[ok] * GOLDEN + np.uint64(k)))
        owner.append(word[ok])
    word = np.concatenate(owner)
    by = np.argsort(word, kind="stable")
    return (np.concatenate(cols)[by] % np.uint64(buckets)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(n)))])


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    scores: np.ndarray  # of each bucket, by language
    bias: np.ndarray
    temperature: float
    threshold: float
    params: Params

    def told(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language of each row of mean scores, and its probability."""
        z = (means + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z.argmax(1), z.max(1) / z.sum(1)


class Scorer:
    """Mean scores of texts; words that were met before are looked up."""

    def __init__(self, m: Model, most: int = 400_000):
        self.m, self.most = m, most
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[int, int] = {}
        self.table = np.zeros((1 << 14, len(self.m.langs) + 1), np.float32)

    def means(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean scores of each text, and how many words it has."""
        data = LOWER[data]
        starts, ends, first = doc_words(data, at, APART)
        count = np.diff(first)
        out = np.zeros((len(count), len(self.m.langs)))
        if not len(starts):
            return out, count
        names, one, back = np.unique(span_hashes(data, starts, ends).view(np.int64), return_index=True, return_inverse=True)
        if len(self.seen) + len(names) > self.most:
            self._clear()
        known = names.tolist()
        new = [i for i, x in enumerate(known) if x not in self.seen]
        if new:
            w, k = one[new], len(self.seen)
            f, f_at = features(data, starts[w], ends[w], self.m.params.buckets)
            while len(self.table) < k + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k : k + len(new), :-1] = np.add.reduceat(self.m.scores[f], f_at[:-1])
            self.table[k : k + len(new), -1] = np.diff(f_at)
            self.seen.update(zip((known[i] for i in new), range(k, k + len(new))))
        rows = self.table[np.fromiter(map(self.seen.__getitem__, known), np.int64, len(known))]
        has = count > 0
        sums = np.add.reduceat(rows[back], first[:-1][has]).astype(np.float64)
        out[has] = sums[:, :-1] / sums[:, -1:]
        return out, count


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _slices(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts, some at a time; the driver has no room for the features of all at once in the making."""
    part: list[str] = []
    for i, t in enumerate(texts):
        part.append(t)
        if sum(map(len, part)) >= most or i == len(texts) - 1:
            yield _joined(part)
            part = []


def fit(rows: list[tuple[str, str]], p: Params = Params()) -> Model | None:
    """A model of (text, language) rows; None if no language has 8 of them."""
    n = Counter(lang for _, lang in rows)
    langs = tuple(sorted(k for k, c in n.items() if c >= 8))
    rows = [(t, langs.index(k)) for t, k in rows if k in langs]
    if not rows:
        return None
    fitted, held = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    flat, sizes, counts = [], [], []
    for data, at in _slices([t for t, _ in fitted]):
        data = LOWER[data]
        starts, ends, first_ = doc_words(data, at, APART)
        f, f_at = features(data, starts, ends, p.buckets)
        flat.append(f.astype(np.int32))
        sizes.append(np.diff(f_at))
        counts.append(np.diff(first_))
    f, f_at, first = np.concatenate(flat), *(np.concatenate([[0], np.cumsum(np.concatenate(x))]) for x in (sizes, counts))
    del flat, sizes, counts
    windows = [(a, min(a + p.window, int(first[i + 1])), y) for i, (_, y) in enumerate(fitted) for a in range(int(first[i]), int(first[i + 1]), p.window)]
    rng = np.random.default_rng(p.seed)
    emb = rng.normal(0, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    w, bias = np.zeros((p.dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    # each language as often as any other
    share = Counter(y for _, _, y in windows)
    odds = np.array([1 / share[y] for _, _, y in windows])
    steps = p.epochs * -(-min(len(windows), p.epoch_windows) // p.batch)
    for step in range(steps):
        pick = [windows[i] for i in rng.choice(len(windows), p.batch, p=odds / odds.sum())]
        spans = [(int(f_at[a]), int(f_at[b])) for a, b, _ in pick]
        idx = np.concatenate([f[a:b] for a, b in spans])
        size = np.array([b - a for a, b in spans])
        row = np.repeat(np.arange(len(pick)), size)
        mean = np.add.reduceat(emb[idx], np.concatenate([[0], np.cumsum(size)[:-1]])) / size[:, None]
        z = mean @ w + bias
        z = np.exp(z - z.max(1, keepdims=True))
        g = z / z.sum(1, keepdims=True)
        g[np.arange(len(pick)), [y for _, _, y in pick]] -= 1
        rate = p.rate * (1 - step / steps)
        back = (g @ w.T) / size[:, None]
        w -= rate * mean.T @ g
        bias -= rate * g.sum(0)
        by = np.argsort(idx, kind="stable")
        head = np.flatnonzero(np.insert(idx[by][1:] != idx[by][:-1], 0, True))
        emb[idx[by][head]] -= rate * np.add.reduceat(back[row[by]], head)
    m = Model(langs, (emb @ w).astype(np.float32), bias, 1.0, 0.0, p)
    s = Scorer(m)
    means, count = (np.concatenate(x) for x in zip(*(s.means(*t) for t in _slices([t for t, _ in held]))))
    y = np.array([k for _, k in held])[count > 0]
    z = means[count > 0] + bias

    best = temperature(z, y) if len(y) else 1.0
    m = Model(langs, m.scores, bias, float(best), 0.0, p)
    told, sure = m.told(means[count > 0])
    right = np.sort(sure[told == y])
    return Model(langs, m.scores, bias, float(best), float(right[int(p.rejected * len(right))]) if len(right) else 1.0, p)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """By which the scores z are to be divided, so that the rows' languages y are likeliest; one row in as many as a language has, and two, counts for the others."""
    n, k = len(y), z.shape[1]
    doubt = 1 / (np.bincount(y, minlength=k)[y] + 2) if k > 1 else np.zeros(n)
    want = np.repeat((doubt / max(1, k - 1))[:, None], k, 1)
    want[np.arange(n), y] = 1 - doubt

    def loss(log_t: float) -> float:
        v = z / np.exp(log_t)
        v = v - v.max(1, keepdims=True)
        return float((np.log(np.exp(v).sum(1)) - (want * v).sum(1)).mean())

    lo, hi = -12.0, 12.0  # convex in the inverse, so there is one least place
    for _ in range(100):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, p: Params = Params()) -> Model | None:
    """Fit on at most train_docs rows and the language's part of train_bytes, in the order of a hash of the id."""
    named = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    langs = [r.lang for r in named.groupBy("lang").count().filter("count >= 8").orderBy(F.col("count").desc(), "lang").limit(p.most_langs).collect()]
    if not langs:
        return None
    known = named.filter(F.col("lang").isin(langs))
    by = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(p.seed), "doc_id"), "doc_id", "size")
    ids = known.select("doc_id", "lang", F.octet_length("text").cast("long").alias("size")).withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= p.train_docs)
    ids = ids.withColumn("bytes", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("bytes") <= p.train_bytes // len(langs))
    # at most most_langs times train_docs ids
    rows = known.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r.lang, zlib.crc32(str((p.seed, r.doc_id)).encode()), str(r.doc_id)))
    return fit([(r.text, r.lang) for r in rows], p)


def languages(docs: DataFrame, m: Model | None) -> DataFrame:
    """doc_id, language (null if rejected), confidence, accepted, a row for each row of docs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(m) if m else None
        for b, data, at in pieces(it, "text", 1 << 19):
            null = np.asarray(b.column(1).is_null())
            if s is None:
                told, sure, ok = np.zeros(len(b), int), np.zeros(len(b)), np.zeros(len(b), bool)
            else:
                means, count = s.means(data, at)
                told, sure = m.told(means)
                sure[count == 0] = 0
                ok = (sure >= m.threshold) & (count > 0)
            names = pa.array([m.langs[k] if o else None for k, o in zip(told, ok)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), names, pa.array(sure, pa.float64(), mask=null), pa.array(ok)], ["doc_id", "language", "confidence", "accepted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, language string, confidence double, accepted boolean")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, train(docs))
