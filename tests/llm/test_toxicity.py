"""Operator 9: held-out rows against a list of words, scores against brute force, long texts, odd rows."""

import collections
import random
import re

import pytest

from lexiloom.llm import toxicity
from lexiloom.llm.common import table

SCHEMA = "doc_id string, text string, lang string, source string, n_chars long, score string, toxic string, _score int"
ODD = [(None, "x y"), ("1", None), ("2", ""), ("3", "  \n"), (None, None), ("4", "x y"), ("4", "x y"), ("5", "é" * 50_000), ("6", "a\tb  c ▁ <s> 😀\n")]
INSULTS = "zwackelig quorbelt xyphonde jugglump vexmorth kwibnock druzzfarg hyxplond wuggmire pyzzleth".split()
PLAIN = [f"{a}{b}{c}" for a in ("bar", "lon", "mi", "tef") for b in ("da", "ko", "ren", "su") for c in ("l", "mon", "ti", "vas")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", None, 1, "s", "t", 2) for r in rows], SCHEMA)


def score(s, *texts):
    return s.scores(*toxicity.joined(list(texts)))


def labelled(spark, size):
    d, labels = (table(spark, f"/root/testdata/{size}", t) for t in ("documents", "labels"))
    rows = d.join(labels, "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    return [[r.text for r in rows if r.toxic == k] for k in (1, 0)]


def listed(bad, good):
    """The words of a plain list, made by document frequency."""
    a, b = (collections.Counter(w for t in x for w in set(re.findall(r"[^\W\d_]+", t.lower()))) for x in (bad, good))
    return {w for w, n in a.items() if n >= 4 and n / len(bad) >= 20 * (b[w] + 0.5) / len(good)}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_held_out_against_a_word_list(spark, size):
    """On rows that the fit hasn't seen: the stated false alarms (and one row), and no less recall than the list has at as many."""
    bad, good = labelled(spark, size)
    m = toxicity.fit(bad[::2], good[::2])
    s = toxicity.Scorer(m)
    told = [sum(score(s, *x[1::2]) > 1) for x in (bad, good)]
    known = listed(bad[::2], good[::2])
    hits = [[len(known & set(re.findall(r"[^\W\d_]+", t.lower()))) for t in x[1::2]] for x in (bad, good)]
    most = toxicity.Params().false_alarm * len(good[1::2]) + 1
    assert told[1] <= most
    # the list gets the fewest words that keep it within as many false alarms
    need = next(k for k in range(1, 1000) if sum(h >= k for h in hits[1]) <= told[1])
    assert told[0] >= sum(h >= need for h in hits[0])
    assert told[0] / len(bad[1::2]) >= {"sf0.01": 0.4, "sf0.1": 0.75}[size]


def test_dictionaries_are_trained_on_text(spark):
    bad, good = labelled(spark, "sf0.1")
    m = toxicity.fit(bad, good)
    running = " ".join(" ".join(re.findall(r"[^\W_]+", t.lower())) for t in bad).encode()
    assert sum(r[1:-1] in running or b"\x0f" in r for t in m.tiers for r in t.toxic.split(b"\x0f")) > 0 and all(b" " in t.toxic for t in m.tiers)
    s = toxicity.Scorer(m)
    plain = score(s, "the of and that this was from")[0]
    assert plain == 0


def brute(s, text):
    """The score, window by window, over words in a list."""
    return max(brute_tier(t, text) / t.tier.threshold for t in s.tiers)


def brute_tier(s, text):
    p, m = s.p, s.tier
    known = {int(x).to_bytes(p.min_match, "big") for x in m.marks}
    words = [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.encode().translate(bytes(toxicity.LOWER))) if w]
    hit = []  # first and last word of each run
    for i in range(len(words)):
        line, owner = b"", []
        for j in range(i, min(len(words), i + p.min_match)):
            line += b" " + words[j]
            owner += [j] * (len(words[j]) + 1)
        line += b" "
        owner += [owner[-1] + 1]
        for at in range(len(words[i]) + 1):
            if line[at : at + p.min_match] in known:
                last = at + p.min_match - 1
                hit.append((i, owner[last] - (line[last : last + 1] == b" ")))
    windows = []
    for a, z in hit:
        if windows and a <= windows[-1][1] + 2 * p.context:
            windows[-1][1] = max(windows[-1][1], z)
        else:
            windows.append([a, z])
    got = []
    for a, z in windows:
        x = b" " + b" ".join(words[max(0, a - p.context) : z + p.context + 1]) + b" " + toxicity._TAIL
        v = len(s.plain.compress(x)) - len(s.both.compress(x))
        if v >= m.least_saved:
            got.append((a, z, x, v))
    best = max([0, *(sum({x: v for a, z, x, v in got[i : j + 1]}.values()) for i in range(len(got)) for j in range(i, len(got)) if j == i or got[j][1] - got[i][0] < p.stretch)])
    return best / (1 + min(len(words), p.stretch) / 1000)


def test_scores_by_brute_force(spark):
    bad, good = labelled(spark, "sf0.1")
    s = toxicity.Scorer(toxicity.fit(bad, good))
    rng = random.Random(4)
    some = [t for t in [*bad[:60], *good[:60]] if len(t) < 20_000]
    some += [" ".join(rng.choice(["scum", "idiot", "the", "of", "moron"] + t.split()[:30]) for _ in range(k)) for t, k in zip(bad, (1, 2, 399, 400, 401, 950))]
    some += ["", " ", "idiot", "scum", "idiot scum", "Idiot,\nIDIOT;idiot"]
    assert score(s, *some).tolist() == pytest.approx([brute(s, t) for t in some])
    assert score(s, *some[::-1]).tolist() == score(s, *some).tolist()[::-1]


def test_long_texts():
    """Neither a text's length nor the clean words around a toxic passage hide it."""
    rng = random.Random(3)
    clean = [rng.choices(PLAIN, k=40) for _ in range(600)]
    for t in clean[1::60]:
        t[7] = rng.choice(INSULTS)
    toxic = [rng.choices(PLAIN, k=30) + [f"n{i}x{k}" for k in range(20)] + rng.sample(INSULTS, 4) for i in range(80)]
    m = toxicity.fit([" ".join(t) for t in toxic], [" ".join(t) for t in clean])
    s = toxicity.Scorer(m)
    assert (score(s, *map(" ".join, toxic)) > 1).mean() > 0.95
    for n in (20_000, 200_000):
        ws = rng.choices(PLAIN, k=n)
        assert score(s, " ".join(ws)) <= 1
        assert score(s, " ".join(rng.choice(INSULTS) if i % 10 == 0 else w for i, w in enumerate(ws))) > 1
        found = next(t for t in toxic if score(s, " ".join(t)) > 1.5)
        for at in (0, n // 2, n - 40):  # one passage
            assert score(s, " ".join([*ws[:at], *found, *ws[at:]])) > 1
        # as many insults, each too far from the next
        assert score(s, " ".join(w if i % 500 else INSULTS[i // 500 % 10] for i, w in enumerate(ws))) <= 1


def test_ties_and_odd_rows(spark):
    labels = spark.createDataFrame([(str(i), i % 2, "x") for i in range(80)] + [(None, 1, "x"), ("7", None, "x")], "doc_id string, toxic int, text string")
    rng = random.Random(1)
    told = [(str(i), " ".join(rng.choices(PLAIN, k=30) + rng.sample(INSULTS, 4) * (i % 2))) for i in range(80)]
    df = docs(spark, told + [("x" + (i or ""), t) for i, t in ODD])
    m = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    assert all(got[i].toxic == (int(i) % 2 == 1) for i, _ in told) and not any(r.toxic for i, r in got.items() if i[0] == "x")
    assert got["x1"].score is None and got["x2"].score == got["x3"].score == 0
    tiers = [toxicity.replace(t, threshold=1.0) for t in m.tiers]
    raw = [score(toxicity.Scorer(toxicity.replace(m, tiers=(t,))), told[1][1])[0] for t in tiers]
    tie = toxicity.replace(m, tiers=tuple(toxicity.replace(t, threshold=v) for t, v in zip(tiers, raw) if v))
    assert score(toxicity.Scorer(tie), told[1][1])[0] == 1  # not above, so not toxic
    kept = toxicity.without_toxic(df, labels)
    assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == sorted([i for i, _ in told if int(i) % 2 == 0] + ["x" + (i or "") for i, _ in ODD])
    odd = toxicity.toxicity(docs(spark, ODD), labels)
    assert odd.count() == len(ODD) and odd.filter("toxic").count() == 0 and toxicity.without_toxic(docs(spark, ODD), labels).count() == len(ODD)
    assert toxicity.toxicity(docs(spark, ODD).filter("false"), labels.filter("false")).count() == 0
    small = toxicity.train(df, labels, toxicity.Params(train_bytes=1000))  # a few documents of each class are below the bound
    assert small is None or small.params.train_bytes == 1000
