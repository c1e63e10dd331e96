"""Operators 3, 4, 7, 8 and 10, and the pipeline."""

import collections
import random
import re

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

import corpus_pipeline
from lexiloom.llm import langid, licenses, mixing, sentencepieces, tokenfiles
from lexiloom.llm import common
from lexiloom.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, ids string, score string"
ODD = [(None, "x y"), (1, None), (2, ""), (3, "  \n"), (None, None), (4, "x y"), (4, "x y"), (5, "é" * 50_000), (6, "a\tb  c ▁ <s> 😀\n")]


def docs(spark, rows):
    full = [(*r, "en", None) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(*r, 1, "k", 2, "i", "s") for r in full], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in table(spark, SF, "documents").select("text").collect()]


def test_pieces_are_the_librarys(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rows = [(100 + i, t) for i, t in enumerate(texts)] + ODD
    got = sentencepieces.encoded(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id}
    for i, t in rows:
        if i is None or t is None:
            continue
        r, raw = by[i], t.encode()
        assert r.ids == sp.encode(t)
        assert r.round_trip == ("▁" not in t)
        assert len(r.starts) == len(r.ids) == len(r.ends) and (not raw or (r.starts[0], r.ends[-1]) == (0, len(raw)))
        assert all(a == b for a, b in zip(r.starts[1:], r.ends))
        for k, a, b in zip(r.ids, r.starts, r.ends):
            if "▁" not in t and not sp.is_byte(k):
                assert raw[a:b].decode() in (sp.id_to_piece(k).replace("▁", " "), sp.id_to_piece(k)[1:].replace("▁", " "))
    assert by[1].ids is None and by[1].round_trip is None
    back = {r.doc_id: r.text for r in sentencepieces.decoded(sentencepieces.encoded(docs(spark, rows))).collect()}
    assert all(back[i] == t for i, t in rows if i and (t is None or "▁" not in t))
    assert sentencepieces.encoded(docs(spark, []).filter("false")).count() == 0


def test_character_map():
    """With another model's normalisation: the same pieces as the library, each piece within the text, in order."""
    model = pb.ModelProto.FromString(open(sentencepieces.MODEL, "rb").read())
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    model.normalizer_spec.CopyFrom(pb.NormalizerSpec.FromString(rule.serialized_normalizer_spec()))
    for squeeze in (True, False):
        model.normalizer_spec.remove_extra_whitespaces = squeeze
        e = sentencepieces.Encoder(proto=model.SerializeToString())
        sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        for t in ["ﬁ Ａ ㌔ é", " 　 ﬁne  ½ x  ", "", "   ", "①②③ﷺ abc​d\tz\n", "é Å", "Ｈｅｌｌｏ　ｗｏｒｌｄ"]:
            ids, starts, ends = e.whole(t.encode())
            assert ids == sp.encode(t)
            assert all(0 <= a <= b <= len(t.encode()) for a, b in zip(starts, ends)) and starts == sorted(starts)
    ids, starts, ends = e.whole("ﬁ ½".encode())
    assert list(zip(starts, ends))[0] == (0, 3) and ends[-1] == 6  # both letters of a ligature stem from its bytes


def test_invalid_bytes():
    e = sentencepieces.Encoder()
    data = b"ab \xff\xfe c"
    ids, starts, ends, tok = e.batch(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert (starts[0], ends[-1]) == (0, len(data)) and tok.tolist() == [0, len(ids)]


def test_token_files(spark, tmp_path, texts):
    rows = [(100 + i, t) for i, t in enumerate(texts)] + ODD
    df = docs(spark, rows).repartition(5)
    got = tokenfiles.write_tokens(df, str(tmp_path / "t")).orderBy("part", "row").collect()
    r = tokenfiles.Reader(str(tmp_path / "t"))
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    text = collections.defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    assert len(got) == len(r) == len(rows) and r.tokens == sum(g.n_tokens for g in got)
    first = 0
    for k, g in enumerate(got):
        assert g.first == first and r[k].tolist() == r.span(first, g.n_tokens).tolist()
        assert r[k].tolist() in [sp.encode(t or "") for t in text[g.doc_id]]
        first += g.n_tokens
    assert r[0].dtype == np.uint16
    with pytest.raises(IndexError):
        r[len(rows)]
    assert tokenfiles.write_tokens(df.filter("false"), str(tmp_path / "e")).count() == 0 and len(tokenfiles.Reader(str(tmp_path / "e"))) == 0


def test_language(spark, texts):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    m = langid.train(d)
    got = {r.doc_id: r for r in langid.languages(d, m).collect()}
    true = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    told = [i for i, r in got.items() if r.accepted]
    assert len(got) == len(true) and len(told) > 0.95 * len(true) and sum(got[i].language == true[i] for i in told) > 0.99 * len(told)
    odd = langid.languages(docs(spark, ODD), m).collect()
    assert len(odd) == len(ODD) and all(r.language is None for r in odd if not r.accepted)
    assert [(r.accepted, r.confidence) for r in odd if r.doc_id in (1, 2)] == [(False, None), (False, 0.0)]
    none = langid.languages(docs(spark, ODD), langid.train(docs(spark, ODD)))
    assert none.filter("accepted").count() == 0 and none.count() == len(ODD)
    assert langid.languages(docs(spark, ODD).filter("false"), m).count() == 0


def test_language_by_brute_force():
    """Scores word by word and feature by feature; confidence of a tie; the temperature of rows that are all told rightly."""
    rng = random.Random(2)
    said = {"aa": "baka milo tuna reno sila".split(), "bb": "strum glent prisk vorth plind".split()}
    rows = [(" ".join(rng.choices(said[k], k=rng.choice([1, 5, 40]))), k) for k in said for _ in range(60)]
    m = langid.fit(rows, langid.Params(buckets=512))
    assert 1e-3 < m.temperature < 1e3
    top, some = (1 << 64) - 1, [*(t for t, _ in rows[:20]), "", "Baka, MILO!", "é strum\nx", "glent" * 3000]
    mix = lambda v: int(common.mix(np.array([v & top], np.uint64))[0])

    def one(word):
        raw = np.frombuffer(word, np.uint8)
        x = [1, *word, 2]
        f = [mix(int(common.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]))]
        for k in (2, 3, 4):
            for i in range(len(x) - k + 1):
                h = x[i] + 1
                for b in x[i + 1 : i + k]:
                    h = (h * 0x100000001B3 + b) & top
                f.append(mix(h * int(common.GOLDEN) + k))
        return [v % 512 for v in f]

    for t, got, n in zip(some, *langid.Scorer(m).means(*langid._joined(some))):
        words = [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.encode().translate(bytes(common.LOWER))) if w]
        f = [k for w in words for k in one(w)]
        assert n == len(words) and (not f or np.allclose(got, m.scores[f].astype(float).mean(0), atol=1e-4))
    tie = langid.Model(("x", "y"), np.zeros((512, 2), np.float32), np.zeros(2), 1.0, 0.5, m.params)
    assert [int(v[0]) for v in tie.told(np.zeros((1, 2)))] == [0, 0] and tie.told(np.zeros((1, 2)))[1][0] == 0.5
    z = np.array([[2.0, 0.0], [0.0, 3.0], [1.0, 0.0]])
    assert 0 < langid.temperature(z, np.array([0, 1, 0])) < 100


def test_language_held_out():
    rng = random.Random(1)
    said = {"aa": "baka milo tuna reno sila".split(), "bb": "strum glent prisk vorth plind".split()}
    rows = [(" ".join(rng.choices(said[k], k=30)), k) for k in said for _ in range(60)]
    rng.shuffle(rows)
    m = langid.fit(rows[:80])
    s = langid.Scorer(m)
    means, _ = s.means(*langid._joined([t for t, _ in rows[80:]]))
    assert [m.langs[k] for k in m.told(means)[0]] == [k for _, k in rows[80:]]
    assert langid.fit([]) is None


def test_licenses(spark):
    rows = [(10, "so. Released under the MIT License."), (11, "RELEASED UNDER THE MIT\n LICENSE"), (12, "the MIT License"), (13, "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0."), (14, "license under the released MIT"), (15, "Licensed under the Apache Licence, Version 2.0")]
    got = collections.defaultdict(list)
    for r in licenses.licences(docs(spark, rows + ODD)).orderBy("start").collect():
        got[r.doc_id].append((r.license, r.start, r.end))
    assert got[10] == [("MIT", 4, 34)] and got[11] == [("MIT", 0, 31)] and 14 not in got and 15 not in got
    assert [g[0] for g in got[13]] == ["CC-BY-4.0", "CC-BY-NC-4.0"]
    assert licenses.licences(docs(spark, rows).filter("false")).count() == 0


def test_licenses_against_brute_force(spark):
    """Every template laid at every word of every document, as it is and with shifts."""
    d = table(spark, SF, "documents").select("doc_id", "text")
    rng = random.Random(5)
    long = [t for _, t, _ in licenses.TEMPLATES if len(t) > 100]
    shifted = []
    for i in range(60):  # words put in, left out and changed
        w = f"so {rng.choice(long)} far".split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = rng.choice([[], ["in"], ["the", "file"]])
        shifted.append((10_000 + i, " ".join(w)))
    df = d.union(spark.createDataFrame(shifted, d.schema))
    rows = df.collect()
    split = lambda t: [w for w in re.split(r"[^\w\u0080-\U0010ffff]+|_", t.lower(), flags=re.A) if w]
    bags = [(r.doc_id, split(r.text)) for r in rows]
    p = licenses.Params()
    n = collections.Counter(w for _, b in bags for w in set(b))
    want, rigid = [], set()
    for name, text, phrases in p.templates:
        t = split(text)
        v = [np.log((len(rows) + 1) / (n[w] + 1)) + 1e-9 for w in t]
        total = sum(v)
        spans = [next((a, a + len(x)) for a in range(len(t)) if t[a : a + len(x)] == x) for x in map(split, phrases)]
        rare, rest = [], total
        for i in np.argsort(-np.array(v), kind="stable"):
            rare.append(int(i))
            rest -= v[i]
            if rest < p.min_score * total:
                break
        for doc, b in bags:
            laid = {at: [0 <= at + i < len(b) and b[at + i] == w for i, w in enumerate(t)] for at in range(-len(t) + 1, len(b))} if set(b) & {t[i] for i in rare} else {}
            for at, same in laid.items():
                if all(all(same[x:y]) for x, y in spans) and sum(x for x, s in zip(v, same) if s) >= p.min_score * total:
                    rigid.add((doc, name))
            begins = [at for at, same in laid.items() if any(same[i] for i in rare)]
            while begins:
                one = [x for x in begins if x <= begins[0] + min(p.slack, len(t) // 8)]
                begins = begins[len(one) :]
                some = [any(laid[at][i] for at in one) for i in range(len(t))]
                if sum(x for x, s in zip(v, some) if s) >= p.min_score * total and all(any(all(laid[at][x:y]) for at in one) for x, y in spans):
                    want.append((doc, name))
    got = sorted((r.doc_id, r.license) for r in licenses.licences(df).collect())
    assert len(want) > 40 and got == sorted(want) and rigid <= set(got)
    assert len({i for i, _ in got if i >= 10_000}) > len({i for i, _ in rigid if i >= 10_000})


def test_notices(spark):
    mit = next(t for n, t, _ in licenses.TEMPLATES if n == "MIT" and len(t) > 300)
    rows = [(20, "// SPDX-License-Identifier: GPL-3.0-or-later"), (21, "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"), (22, f"Copyright (c) 2020 X\n\n{mit.replace('furnished', 'kindly furnished')}\n"), (23, "the gnu and the lion"), (24, f"{mit} " * 3 + "x " * 300_000)]
    got = collections.defaultdict(set)
    for r in licenses.licences(docs(spark, rows)).collect():
        got[r.doc_id].add((r.license, r.start))
    assert ("GPL-3.0", 3) in got[20] and 23 not in got and ("MIT", 22) in got[22]
    assert len([s for n, s in got[24] if n == "MIT"]) >= 3


def test_mixing(spark, texts):
    rng = random.Random(2)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.choice([1, 5, 40, 300]))), "en", rng.choice(["a", "b", None, ""])) for i in range(300)]
    df = docs(spark, [*rows, *((i, t, "en", "a") for i, t in ODD)]).repartition(4)
    p = mixing.Params(block_words=32, shard_slots=16, weights=(("a", 3.0), ("b", 1.0), (None, 1.0), ("none", 9.0)), tail_tasks=2)
    blocks = mixing.packed(df, p).collect()
    # every word is packed once, in order within its row
    packed = collections.Counter(w for b in blocks for w in re.findall(r"[^\t\n\v\f\r ]+", b.text.decode()))
    assert packed == collections.Counter(w for _, t, *_ in rows + ODD for w in re.findall(r"[^\t\n\v\f\r ]+", t or ""))
    assert all(b.n_words <= 32 and len(re.findall(rb"[^\t\n\v\f\r ]+", b.text)) == b.n_words for b in blocks) and sum(b.n_words < 32 for b in blocks) <= 8
    got = mixing.mixed(df, p).collect()
    assert len(got) == len(blocks) and len({(r.shard, r.slot) for r in got}) == len(got) and all(0 <= r.slot < 16 for r in got)
    assert {r.source for r in got} == {"a", "b", None}
    size = collections.Counter(b.source for b in blocks)
    drawn = collections.Counter(r.source for r in got)
    assert abs(drawn["a"] / len(got) - 0.6) < 0.15
    for s in drawn:  # an epoch takes each block once before the next begins
        own = sorted((r.epoch, r.block) for r in got if r.source == s)
        full, rest = divmod(drawn[s], size[s])
        for e in range(full):
            assert [b for k, b in own if k == e] == list(range(size[s]))
        last = [b for k, b in own if k == full]
        assert len(last) == rest == len(set(last)) and all(0 <= b < size[s] for b in last)
    pieces = mixing.mixed_documents(df, p)
    assert pieces.columns == df.columns
    for r in pieces.collect():
        assert r.n_chars == len(r.text) and (r.doc_id is None or r.doc_id < 10 or all(w.startswith(f"d{r.doc_id}w") for w in r.text.split()))
    assert mixing.mixed(df.filter("false"), p).count() == 0 and mixing.mixed_documents(docs(spark, ODD).filter("text = ''")).count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        for key in (0, 12345):
            assert sorted(mixing.feistel(np.arange(n), n, key).tolist()) == list(range(n))
    assert mixing.feistel(np.arange(100), 100, 1).tolist() != mixing.feistel(np.arange(100), 100, 2).tolist()


def test_odd_rows_through_every_stage(spark, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs(spark, ODD), docs(spark, ODD).filter("false")):
            stage(spark, df, SF).write.mode("overwrite").parquet(str(tmp_path / name))
