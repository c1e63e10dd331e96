"""Operators 1, 2, 5 and 6 against brute force, and odd tables."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from lexiloom.llm import blockjoin, common, epsjoin, minhash, suffix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, sig int, _cut int, starts int, nth int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


ODD = [(None, "x y"), (1, None), (2, ""), (3, "  \n"), (None, None), (4, "x y"), (4, "x y"), (5, "é" * 50_000)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k=3):
    w = [x for x in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower().encode()) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_minhash_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    rng = random.Random(1)
    for i, n in enumerate(range(0, 80, 2)):  # near copies: every n-th word or so changed
        w = words(120, i)
        rows += [(10_000 + 10 * i, " ".join(w)), (10_001 + 10 * i, " ".join(x if rng.random() > n / 800 else "other" for x in w))]
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    inv = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    pairs = {p for v in inv.values() for p in itertools.combinations(sorted(v), 2)}
    j = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    sure = [p for p, v in j.items() if v >= 0.65]
    assert len(sure) > 20 and sum(got[a] == got[b] for a, b in sure) >= 0.9 * len(sure)
    assert all(got[a] == got[b] for a, b in sure if j[a, b] >= 0.9)
    near = collections.defaultdict(set)
    for (a, b), v in j.items():
        if v >= 0.4:
            near[a].add(b)
            near[b].add(a)
    assert all(i in near or g == i for i, g in got.items())  # what resembles nothing stays alone


def test_buckets_of_any_size(spark):
    """Buckets that no task holds give the groups that those give which one does, and all pairs of a bucket."""
    rng = random.Random(12)
    base = words(100, 77)
    rows = [(i, " ".join(x if rng.random() > 0.01 * (i % 5) else f"z{rng.randrange(10**6)}" for x in (base if i % 3 else base[:70] + words(30, i % 7)))) for i in range(150)]
    rows += [(1000 + i, " ".join(words(60, 500 + i))) for i in range(30)]
    signs = minhash.signed(docs(spark, rows), minhash.Params()).dropDuplicates(["key"]).cache()

    def parts(pairs):
        group = {}
        for a, b in pairs:
            a, b = group.setdefault(a, {a}), group.setdefault(b, {b})
            if a is not b:
                a |= b
                for x in b:
                    group[x] = a
        return {frozenset(g) for g in group.values()}

    p = minhash.Params()
    sig = {r.key: np.frombuffer(bytes(r.sig), np.uint16) for r in signs.collect()}
    all_pairs = [(a, b) for a, b in itertools.combinations(sig, 2) if (sig[a].reshape(p.bands, -1) == sig[b].reshape(p.bands, -1)).all(1).any() and (sig[a] == sig[b]).mean() >= p.threshold]
    whole, split = ([tuple(r) for r in minhash.edges(signs, q).collect()] for q in (p, minhash.Params(most=4, block=6, salts=3)))
    assert parts(whole) == parts(all_pairs) == parts(split) and len(parts(whole)) > 1


def test_signature_is_superminhash():
    """The rounds over whole arrays give what the element by element algorithm gives."""
    rng = np.random.default_rng(4)
    m = 16
    for n in (1, 2, 5, 40, 400):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        got = minhash.signatures(x, np.zeros(n, np.int64), 1, m)[0]
        best = [(1 << 64) - 1] * m
        for e in x:
            perm = list(range(m))
            for j in range(m):
                r = common.mix(np.array([int(e) + (2 * j + 1) * int(common.GOLDEN) & (1 << 64) - 1], np.uint64))
                k = j + (int(common.mix(r ^ common.GOLDEN)[0]) >> 33) * (m - j) // 2**31
                perm[j], perm[k] = perm[k], perm[j]
                best[perm[j]] = min(best[perm[j]], (j << 56) | (int(r[0]) >> 8))
        assert (got == (common.mix(np.array(best, np.uint64)) >> np.uint64(48)).astype(np.uint16)).all()


def test_minhash_large_group_and_odd_rows(spark):
    w = words(200, 9)
    many = [(100 + i, " ".join(w[:150] + [f"own{i}"])) for i in range(600)]
    rows = [*many, *ODD, (7, "X, y!")]
    df = docs(spark, rows)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.group_id for r in got if r.doc_id and r.doc_id >= 100} == {100} and sum(r.keep for r in got if r.doc_id and r.doc_id >= 100) == 1
    small = [r for r in got if r.doc_id in (4, 7, None) and r.group_id == 4]
    assert len(small) == 4 and sum(r.keep for r in small) == 1  # the null id comes last
    kept = minhash.without_copies(df)
    assert kept.columns == df.columns and kept.count() == sum(r.keep for r in got)
    assert sorted(r.doc_id for r in kept.filter("doc_id > 0").collect()) == [1, 2, 3, 4, 5, 100]
    assert minhash.near_duplicates(df.filter("false")).count() == 0 and minhash.without_copies(df.filter("false")).count() == 0


def brute_repeats(rows, size):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0])):
        raw = t.encode()
        at = [m.span() for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", raw)]
        spans = []
        for k in range(len(at) - size + 1):
            g = tuple(raw[a:b] for a, b in at[k : k + size])
            if g not in seen:
                seen.add(g)
            elif spans and at[k][0] <= spans[-1][1]:
                spans[-1][1] = at[k + size - 1][1]
            else:
                spans.append([at[k][0], at[k + size - 1][1]])
        if spans:
            out[i] = [tuple(s) for s in spans]
    return out


@pytest.mark.parametrize("size", [50, 7])
def test_repeats_against_brute_force(spark, size):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    w = words(90, 2)
    rows += [(5000, " ".join(w[:60])), (5001, "a b " + " ".join(w[5:58]) + " c"), (5002, "q " * 300), (5003, "q " * 60), (None, " ".join(w[:60]))]
    df = docs(spark, rows).repartition(6)
    p = suffix.Params(min_words=size, shard_bytes=20_000)
    got = collections.defaultdict(list)
    for r in suffix.suffix_repeats(df, p).orderBy("doc_id", "start").collect():
        got[r.doc_id].append((r.start, r.end))
    want = brute_repeats(rows, size)
    assert dict(got) == want and len(want) > 3
    cut = {r.doc_id: r.text for r in suffix.without_repeats(df, p).collect()}
    for i, t in rows:
        raw, at, out = t.encode(), 0, b""
        for a, b in want.get(i, []):
            out, at = out + raw[at:a], b
        out += raw[at:]
        assert cut.get(i) == (out.decode() if i not in want or out.strip() else None)


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n, v in ((1, 1), (50, 1), (300, 2), (500, 9), (400, 10**6)):
        ids = rng.integers(1, v + 1, n)
        for depth in (3, 50, 1000):
            order, rank, h = suffix.suffix_array(ids, depth)
            pre = [tuple(ids[i : i + h]) for i in range(n)]
            assert [pre[i] for i in order] == sorted(pre)
            g = suffix.Grams(common.mix(ids.astype(np.uint64)))
            lcp = suffix.common_prefixes(order, rank, h, g, n - np.arange(n))
            for a, b in zip(order, order[1:]):
                k = 0
                while max(a, b) + k < n and ids[a + k] == ids[b + k]:
                    k += 1
                assert lcp[b] == k


def test_repeats_odd_rows(spark):
    long = " ".join(words(60, 1))
    df = docs(spark, [*ODD, (8, long), (8, long), (9, long), (None, long)])
    got = sorted((r.doc_id or 0, r.start, r.end) for r in suffix.suffix_repeats(df).collect())
    assert got == [(0, 0, len(long)), (9, 0, len(long))]  # rows that repeat id and text are one
    kept = suffix.without_repeats(df)
    assert kept.columns == df.columns and kept.count() == len(ODD) + 2
    assert suffix.suffix_repeats(df.filter("false")).count() == 0 and suffix.without_repeats(df.filter("false")).count() == 0


def test_repeated_rows_in_several_files(spark, tmp_path):
    """Copies of a row that different tasks read are one document still."""
    w = words(200, 3)
    rows = [(1, " ".join(w[:80])), (2, " ".join(w[60:130])), (3, " ".join(w[100:200])), (None, " ".join(w[:70])), (4, " ".join(words(60, 4)))]
    one = docs(spark, rows)
    for _ in range(3):
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    many = spark.read.parquet(str(tmp_path / "d"))
    p = suffix.Params(min_words=20)
    got = collections.defaultdict(list)
    for r in suffix.suffix_repeats(many, p).orderBy("start").collect():
        got[r.doc_id].append((r.start, r.end))
    assert many.rdd.getNumPartitions() > 1 and dict(got) == brute_repeats(rows, 20)
    kept = collections.Counter((r.doc_id, r.text) for r in suffix.without_repeats(one, p).collect())
    assert kept[1, rows[0][1]] == kept[4, rows[4][1]] == 1 and len(kept) == 4
    assert collections.Counter((r.doc_id, r.text) for r in suffix.without_repeats(many, p).collect()) == {k: 3 * n for k, n in kept.items()}


def test_merged_tells_copies_from_repeats():
    run = lambda x, key: tuple(np.array(v, t) for v, t in zip(([x], [7], [key], [0], [9]), (np.uint64, np.int64, np.int64, np.int32, np.int32)))
    both, late = suffix.merged(run(5, 1), run(5, 1))
    assert len(late[0]) == 0 and [c.tolist() for c in both] == [[5], [7], [1], [0], [9]]
    both, late = suffix.merged(run(5, 2), run(5, 1))
    assert late[2].tolist() == [2] and both[2].tolist() == [1]


@pytest.mark.parametrize("size", [7, 50])
def test_anchors_of_texts_longer_than_a_stretch(monkeypatch, size):
    """Every window's anchor lies in it and is its least run, also beyond the places that fit into the low bits."""
    monkeypatch.setattr(suffix, "_PLACE_BITS", 6)
    g = suffix.Grams(common.mix(np.random.default_rng(7).integers(0, 2**40, 1000).astype(np.uint64)))
    whole, at = suffix.anchors(g, np.array([0, 300, 310, 1000]), size)
    k = size // 2 + 1
    x = g.of(np.arange(1000 - k + 1), k)
    assert whole.tolist() == [i for a, z in ((0, 300), (300, 310), (310, 1000)) for i in range(a, z - size + 1)]
    assert at.tolist() == [i + int(np.argmin(x[i : i + size - k + 1])) for i in whole]


def cosine(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, row string, dim int")


BAD = [(1, None), (2, []), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, [0.0] * 8), (6, [1.0, 2.0]), (None, None)]


def test_eps_join_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[300:400] = x[:100] + rng.normal(size=(100, 8)).astype(np.float32) * 0.12
    rows = [(i + 100, v.tolist()) for i, v in enumerate(x)] + BAD + [(100, x[0].tolist()), (None, x[0].tolist())]
    p = epsjoin.Params(block=32, leaf=8, fan=3, axes=3)
    got = epsjoin.near_duplicates(embeddings(spark, rows), p=p).collect()
    assert len(got) == len(rows)
    y = x.astype(np.float64)
    c = (y @ y.T) / np.sqrt(np.outer((y * y).sum(1), (y * y).sum(1)))
    group = list(range(700))
    for a, b in zip(*np.nonzero(c >= 0.95)):
        a, b = group[a], group[b]
        if a != b:
            group = [min(a, b) if g in (a, b) else g for g in group]
    assert len({r.group_id for r in got if r.vec_id and r.vec_id >= 100}) < 700
    assert all(r.group_id == group[r.vec_id - 100] + 100 for r in got if r.vec_id and r.vec_id >= 100)
    assert all(r.keep and r.group_id == r.vec_id for r in got if r.vec_id and r.vec_id < 100)
    assert sorted(r.keep for r in got if r.vec_id == 100) == [False, True] and sorted(r.group_id or 0 for r in got if r.vec_id is None) == [0, 100]
    assert epsjoin.near_duplicates(embeddings(spark, [])).count() == 0 and epsjoin.near_duplicates(embeddings(spark, BAD[:3])).count() == 3


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(250, 8)).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i + 100, v.tolist()) for i, v in enumerate(x)] + BAD + [(None, x[10].tolist())]
    got = collections.defaultdict(list)
    p = blockjoin.Params(k=5, block=16, rows=50, chunk_bytes=6_000)  # some chunks
    for r in blockjoin.neighbours(embeddings(spark, rows), p=p).orderBy("rank").collect():
        got[r.vec_id].append((r.neighbour_id, r.distance))
    own = [(i, np.array(v)) for i, v in rows if v and len(v) == 8]
    for n, (i, v) in enumerate(own):
        want = sorted((np.sqrt(((v - w) ** 2).sum()), j is None, j or 0) for k, (j, w) in enumerate(own) if k != n)[:5]
        assert [g[0] or 0 for g in got[i]] == [w[2] for w in want] and np.allclose([g[1] for g in got[i]], [w[0] for w in want])
    assert blockjoin.neighbours(embeddings(spark, [])).count() == 0
    one = blockjoin.neighbours(embeddings(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert [tuple(r) for r in one] == [(1, 1, 1, 0.0)] * 2
    some = blockjoin.neighbours(embeddings(spark, rows), p=blockjoin.Params(k=5), where="id % 100 = 0").collect()
    assert {r.vec_id for r in some} == {100, 200, 300}
    assert all((r.neighbour_id, r.distance) == got[r.vec_id][r.rank - 1] for r in some) and len(some) == 15
    top = 2**63 - 1  # no id stands for null
    ends = blockjoin.neighbours(embeddings(spark, [(top, [1.0, 2.0]), (None, [1.0, 2.0]), (0, [1.0, 3.0])])).collect()
    assert sorted((r.vec_id or -1, r.rank, r.neighbour_id) for r in ends if r.vec_id != 0) == [(-1, 1, top), (-1, 2, 0), (top, 1, None), (top, 2, 0)]
    assert [(r.rank, r.neighbour_id) for r in ends if r.vec_id == 0] == [(1, top), (2, None)]
