"""Operator 3, SentencePiece: encoding that keeps each piece's place in the original bytes, and decoding.

Normalisation replaces, from left to right, the longest prefix that the model's compiled character map (a double-array
trie) holds, and records which original byte each normalised byte stems from; invalid UTF-8 becomes U+FFFD byte by
byte. White space, the leading blank and blank removal follow the model. Pieces of the normalised text are projected
to original byte spans through that record: spans are in order, touch or overlap only where one original character
became several pieces, and a piece that stems from nothing (the leading blank) is empty.

Where a model has no character map and no piece joins a blank to what is before it, a text is the sequence of its
words; each distinct word is encoded once in a task, and a text's pieces are looked up over whole batches. Otherwise a
text is encoded as a whole. Both give what the library gives for the whole text.

A null text has null pieces, an empty one none. Rows that repeat are encoded alike; a null id stays; other columns
are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, pieces, ragged, ranges, span_hashes, table, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_BLANK = "▁".encode()


@dataclass(frozen=True)
class Params:
    """model: path of a SentencePiece model that every executor can read. cached: most distinct words a task keeps."""

    model: str = MODEL
    cached: int = 300_000


class CharMap:
    """A compiled character map: the trie's size, its units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at this place."""
        if not self.units:
            return None
        unit, found = self.units[0], None
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def _char(data: bytes, at: int) -> int:
    """Length of the valid UTF-8 character here, 0 if there is none."""
    for n in (1, 2, 3, 4):
        try:
            data[at : at + n].decode()
            return n if at + n <= len(data) else 0
        except UnicodeDecodeError:
            continue
    return 0


class Encoder:
    def __init__(self, p: Params = Params(), proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        if proto is None:
            with open(p.model, "rb") as f:
                proto = f.read()
        model = pb.ModelProto.FromString(proto)
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        # the library gets what is normalised already
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, True
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = [x.type for x in model.pieces]
        self.byte = np.array([k == 6 for k in kinds])
        self.names = [x.piece.encode() for x in model.pieces]
        self.surface = [bytes([int(n[3:5], 16)]) if k == 6 else b"" if k == 3 else n for k, n in zip(kinds, self.names)]
        self.unk = self.sp.unk_id()
        #: Length in original bytes: a blank is one byte there.
        self.length = np.array([len(s.replace(_BLANK, b" ")) for s in self.surface])
        usable = [n for n, k in zip(self.names, kinds) if k not in (2, 3, 6)]
        self.fallback = bool(self.byte.any())
        self.apart = self.fallback and not self.map.units and self.prefix and not self.squeeze and self.escape and not self.suffix and not any("▁" in n.decode().lstrip("▁") for n in usable) and not any(k == 4 for k in kinds)
        #: Control bytes that no piece has: each is a word of its own.
        self.alone = np.zeros(256, bool)
        self.alone[list(set(range(32)) - set(b"".join(usable)))] = True
        self.limit = p.cached
        self._clear()

    def forget(self) -> None:
        """At the end of a task: the worker stays, and what runs in it next has no use for these words."""
        self._clear()
        tidy()

    def _clear(self) -> None:
        self.seen: dict[int, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.used = 0

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The text as its pieces are cut from it, and the original byte each of its bytes begins at (and the end)."""
        out: list[bytes] = []
        origin: list[int] = []
        at, n = 0, len(data)

        def step(at: int) -> tuple[int, bytes]:
            hit = self.map.longest(data, at)
            if hit:
                return hit
            k = _char(data, at)
            return (k, data[at : at + k]) if k else (1, b"\xef\xbf\xbd")

        blank = _BLANK if self.escape else b" "
        if self.squeeze:  # leading blanks
            while at < n:
                k, new = step(at)
                if new.strip(b" "):
                    break
                at += k
            if at == n:
                return b"", np.array([0])
        if not n:
            return b"", np.array([0])
        if self.prefix and not self.suffix:
            out.append(blank)
            origin += [at] * len(blank)
        was_blank = self.squeeze
        ends = at
        while at < n:
            k, new = step(at)
            if self.squeeze and was_blank:
                new = new.lstrip(b" ")
            if new:
                was_blank = self.squeeze and new.endswith(b" ")
                if self.squeeze:  # blanks in a row are one
                    while b"  " in new:
                        new = new.replace(b"  ", b" ")
                for c in new.decode("utf-8", "replace"):
                    c = blank if c == " " else c.encode()
                    out.append(c)
                    origin += [at] * len(c)
                ends = at + k
            at += k
        if self.squeeze:
            while out and out[-1] == blank:
                origin = origin[: -len(out.pop())]
                ends = origin[-1] + max(1, _char(data, origin[-1])) if origin else 0
        if self.prefix and self.suffix:
            out.append(blank)
            origin += [ends] * len(blank)
        return b"".join(out), np.array([*origin, ends])

    def whole(self, data: bytes) -> tuple[list[int], list[int], list[int]]:
        """Ids, starts and ends of a text's pieces."""
        text, origin = self.normalise(data)
        ids, starts, ends, at = self.sp.encode(text.decode()) if text else [], [], [], 0
        if any(i == self.unk for i in ids):  # an unknown piece may be longer than one character
            spans = [(len(s[0].encode()), i) for s, i in zip(_surfaces(self.sp, text.decode()), ids)]
        else:
            spans = [(len(self.surface[i]), i) for i in ids]
        for k, _ in spans:
            starts.append(int(origin[at]))
            at += k
            ends.append(int(origin[at]))
        return ids, starts, [max(a, b) for a, b in zip(starts, ends)]

    def _learn(self, data: bytes, starts: np.ndarray, ends: np.ndarray, names: list[int]) -> None:
        """Encode distinct words; data has no invalid UTF-8."""
        words = [data[a:b].decode().replace(" ", "▁") for a, b in zip(starts, ends)]
        got = self.sp.encode(words, num_threads=1)
        k = len(self.seen)
        lens = np.cumsum([len(g) for g in got]) + self.used
        flat = np.concatenate([np.asarray(g, np.int32) for g in got])
        if len(self.flat) < lens[-1]:
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.int32)])
        if len(self.ends) < k + len(got) + 1:
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(got) + 1), np.int64)])
        self.flat[self.used : lens[-1]] = flat
        self.ends[k + 1 : k + 1 + len(got)] = lens
        self.used = int(lens[-1])
        self.seen.update(zip(names, range(k, k + len(got))))

    def batch(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of the pieces of many texts, and where each text's pieces begin (and the last end)."""
        raw = data.tobytes()
        plain = self.apart and _BLANK not in raw
        if plain:
            try:
                raw.decode()
            except UnicodeDecodeError:
                plain = False
        if not plain:
            rows = []
            for a, b in zip(at[:-1], at[1:]):
                text = raw[a:b]
                easy = self.apart and _BLANK not in text
                if easy:
                    try:
                        text.decode()
                    except UnicodeDecodeError:
                        easy = False
                rows.append(self._plain(data[a:b], np.array([0, b - a]))[:3] if easy else self.whole(text))
            cols = [np.concatenate([np.asarray(r[i], np.int32) for r in rows]) if rows else np.zeros(0, np.int32) for i in range(3)]
            return *cols, np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int64)
        return self._plain(data, at)

    def _plain(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """batch, for texts whose words can be encoded one by one."""
        size = np.diff(at)
        has = size > 0
        # a blank before each text that isn't empty
        lead = np.cumsum(has)
        buf = np.full(len(data) + int(has.sum()), 32, np.uint8)
        shift = np.repeat(lead, size)
        buf[np.arange(len(data)) + shift] = data
        heads = at[:-1][has] + lead[has] - 1
        cut_ = np.zeros(len(buf) + 1, bool)
        blank, control = buf == 32, self.alone[buf]
        cut_[:-1] |= blank
        cut_[1:-1] &= ~blank[:-1]
        cut_[:-1] |= control
        cut_[1:][control] = True
        cut_[heads] = True
        starts = np.flatnonzero(cut_[:-1])
        if not len(starts):
            none = np.zeros(0, np.int32)
            return none, none, none, np.zeros(len(at), np.int64)
        ends = np.append(starts[1:], len(buf))
        names, one, back = np.unique(span_hashes(buf, starts, ends).view(np.int64), return_index=True, return_inverse=True)
        if len(self.seen) + len(names) > self.limit:
            self._clear()
        known = names.tolist()
        new = [i for i, x in enumerate(known) if x not in self.seen]
        if new:
            w = one[new]
            self._learn(buf.tobytes(), starts[w], ends[w], [known[i] for i in new])
        number = np.fromiter(map(self.seen.__getitem__, known), np.int64, len(known))[back]
        lo, n = self.ends[number], self.ends[number + 1] - self.ends[number]
        ids = self.flat[ranges(lo, n)]
        word_at = np.concatenate([[0], np.cumsum(n)])
        # characters without a piece are byte pieces, so the lengths add up to the words'
        stop = np.cumsum(self.length[ids])
        head_word = np.searchsorted(starts, heads)
        tokens = np.zeros(len(at), np.int64)
        tokens[:-1][has] = word_at[head_word]
        tokens[-1] = len(ids)
        for i in np.flatnonzero(~has)[::-1]:
            tokens[i] = tokens[i + 1]
        count = np.diff(tokens)
        begin = np.repeat(heads + 1, count[has])
        end = (stop - begin).astype(np.int32)
        start = np.maximum(stop - self.length[ids] - begin, 0).astype(np.int32)
        return ids, start, end, tokens

    def decode(self, ids: np.ndarray) -> bytes:
        """The normalised text of the pieces, without the leading blank the model adds."""
        out = b"".join(map(self.surface.__getitem__, np.asarray(ids).tolist())).replace(_BLANK, b" ")
        return out[1:] if self.prefix and not self.suffix and out[:1] == b" " else out


def _surfaces(sp, text: str) -> list[tuple[str, int]]:  # noqa: ANN001
    got = sp.encode(text, out_type="immutable_proto").pieces
    return [(x.surface, x.id) for x in got]


_ENCODERS: dict[Params, Encoder] = {}


def encoder(p: Params) -> Encoder:
    """This process's encoder, kept between tasks."""
    if p not in _ENCODERS:
        _ENCODERS[p] = Encoder(p)
    return _ENCODERS[p]


def encoded(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, ids, starts, ends (byte spans), and whether decoding the ids gives the text again (null for null); a row for each row of docs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(p)
        for b, data, at in pieces(it, "text", 1 << 19):
            ids, starts, ends, tok = enc.batch(data, at)
            null = np.asarray(b.column(1).is_null())
            raw = data.tobytes()
            same = [enc.decode(ids[x:y]) == raw[i:j] for x, y, i, j in zip(tok[:-1], tok[1:], at[:-1], at[1:])]
            cols = [ragged(pa.int32(), c, tok, null) for c in (ids, starts, ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(same, pa.bool_(), mask=null)], ["doc_id", "ids", "starts", "ends", "round_trip"])
        enc.forget()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>, round_trip boolean")


def decoded(rows: DataFrame, ids: str = "ids", p: Params = Params()) -> DataFrame:
    """rows with their ids' text in column text (null for null); a text column that is there already is replaced."""
    names = [c for c in rows.columns if c != "text"]
    keep = rows.select(*names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(p)
        for b in it:
            texts = [None if x is None else enc.decode(x).decode("utf-8", "replace") for x in b.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "text"])

    from pyspark.sql.types import StringType, StructType

    return keep.mapInArrow(run, StructType([*keep.schema.fields]).add("text", StringType()))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
