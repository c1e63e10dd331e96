"""The pipeline: every stage done again by brute force, on what the stage before it kept; odd rows; deleted folders."""

import collections
import glob
import random
import re

import numpy as np
import pytest
import sentencepiece
from test_toxicity import INSULTS, PLAIN, brute

import corpus_pipeline
from lexiloom.llm import common, mixing, sentencepieces, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic documents, near copies, exact copies, shared passages, odd rows."""
    rng = random.Random(11)
    word = lambda: rng.choice(PLAIN) + rng.choice(PLAIN)
    texts = [" ".join(word() for _ in range(rng.choice([30, 120, 400]))) for _ in range(120)]
    toxic = [" ".join([word() for _ in range(20)] + rng.sample(INSULTS, 4) + [word() for _ in range(20)]) for _ in range(60)]
    passage = [word() for _ in range(70)]
    shared = [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]) for _ in range(5)]
    near = []
    for t in texts[:20]:
        w = t.split()
        w[len(w) // 2] = word()
        near.append(" ".join(w))
    rows = list(enumerate([*texts, *toxic, *shared, *near, texts[30], texts[31], None, "", "  \n"]))
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows]
    rows += [(None, "one two", "en", None, 7), rows[5], rows[5]]
    to = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, int(120 <= i < 180)) for i in range(180)], "doc_id long, toxic int").write.parquet(f"{to}/labels.parquet")
    return str(to)


def row(r):
    return (r.doc_id, r.text, r.lang, r.source, r.n_chars)


def shingles(text):
    w = re.findall(rf"[^{re.escape(''.join(map(chr, [i for i in range(128) if not chr(i).isalnum()])))}]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def kept_by_near_dedup(rows):
    """Exact similarity of all pairs, single linkage; the fixture has no pair near the threshold."""
    rows = list({(r.doc_id, r.text): r for r in rows if r.text is not None}.values())
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                assert not 0.4 < s < 0.7
                if s >= 0.55 and group[i] != group[j]:
                    group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for r, g in zip(rows, group):
        if g not in best or (r.doc_id is None, r.doc_id) < (best[g].doc_id is None, best[g].doc_id):
            best[g] = r
    return list(best.values())


def without_repeats(rows, size=50):
    """Windows of words, in the order of ids: those that were there before are cut."""
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        at = [m.span() for m in re.finditer(r"[^\t\n\v\f\r ]+", r.text or "")]
        cut = np.zeros(len(r.text or ""), bool)
        for i in range(len(at) - size + 1):
            w = tuple(r.text[a:b] for a, b in at[i : i + size])
            if w in seen:
                cut[at[i][0] : at[i + size - 1][1]] = True
            seen[w] = True
        text = None if r.text is None else "".join(c for c, k in zip(r.text, cut) if not k)
        if not cut.any() or text.strip():
            out.append((r.doc_id, text, r.lang, r.source, len(text) if cut.any() else r.n_chars))
    return out


def key(rows):
    return sorted(rows, key=str)


def test_every_stage_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    m = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    s = toxicity.Scorer(m)
    one = corpus_pipeline.drop_toxic(spark, docs, folder).collect()
    want = [r for r in docs.collect() if r.text is None or brute(s, r.text) <= 1]
    assert key(map(row, one)) == key(map(row, want))
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in one}
    assert len(gone & set(range(120, 180))) >= 57 and not gone - set(range(120, 180))

    df = spark.createDataFrame([row(r) for r in one], SCHEMA)
    two = corpus_pipeline.drop_near_copies(spark, df, folder).collect()
    left = [r for r in one if r.text is None or not shingles(r.text)]  # similar to nothing; those that repeat stay once
    want = [r for r in kept_by_near_dedup([r for r in one if r.text is not None and shingles(r.text)])] + left
    assert key(map(row, two)) == key(map(row, want)) and len(two) < len(one) - 20

    df = spark.createDataFrame([row(r) for r in two], SCHEMA)
    three = corpus_pipeline.cut_repeats(spark, df, folder).collect()
    assert key(map(row, three)) == key(without_repeats(two)) and sum(map(lambda r: r.n_chars or 0, three)) < sum(map(lambda r: r.n_chars or 0, two))

    df = spark.createDataFrame([row(r) for r in three], SCHEMA).repartition(2).cache()
    four = corpus_pipeline.mix_sources(spark, df, folder).collect()
    assert key(map(row, four)) == key(drawn(mixing.packed(df, mixing.Params()).collect()))

    df = spark.createDataFrame([row(r) for r in four], SCHEMA)
    five = corpus_pipeline.encode(spark, df, folder).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    assert key((r.doc_id, r.ids, r.round_trip) for r in five) == key((r.doc_id, sp.encode(r.text), True) for r in four)


def scrambled(x, n, k):
    """The permutation in plain integers."""
    golden, top = int(common.GOLDEN), (1 << 64) - 1

    def mix(v):
        v ^= v >> 30
        v = v * 0xBF58476D1CE4E5B9 & top
        v ^= v >> 27
        v = v * 0x94D049BB133111EB & top
        return v ^ v >> 31

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    while True:
        a, b = x >> half, x & (1 << half) - 1
        for r in range(6):
            a, b = b, a ^ mix((b * golden + (k + (r + 1) * golden)) & top) & (1 << half) - 1
        x = a << half | b
        if x < n:
            return x, mix


def drawn(blocks, p=mixing.Params()):
    """The pieces of the blocks that slot after slot draws, from given blocks."""
    by = collections.defaultdict(list)
    for b in sorted(blocks, key=lambda b: (b.part, b.nth)):
        by[b.sid].append(b)
    sids = sorted(by)
    weight = np.array([float(sum(b.n_words for b in by[s])) ** p.temperature for s in sids])
    total, given, out = len(blocks), collections.Counter(), []
    for shard in range(-(-total // p.shard_slots)):
        size = min(p.shard_slots, total - shard * p.shard_slots)
        counts = np.random.Generator(np.random.Philox(key=[p.seed, shard])).multinomial(size, weight / weight.sum())
        for s, n in zip(sids, counts.tolist()):
            for _ in range(n):
                epoch, nth = divmod(given[s], len(by[s]))
                given[s] += 1
                mix = scrambled(0, 1, 0)[1]
                k = mix((s % (1 << 64)) ^ mix(p.seed * 1_000_003 + epoch))
                b, begin = by[s][scrambled(nth, len(by[s]), k)[0]], 0
                for doc, lang, end in zip(b.doc_ids, b.langs, b.ends):
                    text = b.text[begin:end].decode()
                    out.append((doc, text, lang, b.source, len(text)))
                    begin = end + 1
    return out


def test_draws_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.choice([1, 40, 300]))), "en", rng.choice(["a", "a", "a", "b", None]), 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    p = mixing.Params(block_words=32, shard_slots=64, tail_tasks=2)
    got = mixing.mixed_documents(df, p).collect()
    assert key(map(row, got)) == key(drawn(mixing.packed(df, p).collect(), p))
    n = collections.Counter(r.source for r in mixing.mixed(df, p).collect())
    words = collections.Counter()
    for _, t, _, s, _ in rows:
        words[s] += len(t.split())
    weight = {s: w**p.temperature for s, w in words.items()}
    total = sum(n.values())
    for s, w in weight.items():  # four standard deviations of a multinomial count
        q = w / sum(weight.values())
        assert abs(n[s] - q * total) <= 4 * (total * q * (1 - q)) ** 0.5


def test_run(spark, folder, tmp_path, monkeypatch):
    common.shared_dir(spark)
    for m in (common, corpus_pipeline):
        monkeypatch.setattr(m, "shared_dir", lambda s: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "ids", "starts", "ends", "round_trip"] and out.filter("NOT round_trip").count() == 0 and out.count() > 90
    # of the stages only the last one's folder is left, and no blocks
    assert [p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/pipeline-*/*")] == ["4-sentencepiece"] and not glob.glob(f"{tmp_path}/blocks-*")
