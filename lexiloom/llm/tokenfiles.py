"""Operator 4, token files: flat unsigned integers and 64-bit document offsets, to be memory-mapped.

A task encodes what it reads and writes two files in a folder that all executors share: part-N.bin, the tokens of its
texts one after another (16 bits each if the vocabulary fits, else 32), and part-N.idx, its texts' first tokens as
64-bit numbers counted from the part's beginning, with the end as the last. They are written under another name and
renamed when whole, so a task that is lost or runs twice leaves nothing half written. The parts' sizes come back, a
row for each task; prefix sums over them are the parts' bases, by which a second, small job rewrites the offsets as
offsets into the whole. meta.json names the type, the totals and the parts; Reader maps the files by it.

Each row has a place in the order of the files, also one whose text is null or empty: it has no tokens there. Rows that
repeat are written as often as they occur; a null id stays; other columns are ignored. An empty table gives no
documents and no tokens.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pieces, shared_dir, table
from .sentencepieces import Params, encoder


def _local(path: str) -> str:
    """Files that are mapped need a folder that is mounted, on all executors alike."""
    path = path[7:] if path.startswith("file://") else path.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{path} isn't a mounted folder")
    return path


class _File:
    """A file that has its name only once it is whole."""

    def __init__(self, path: str):
        self.path, self.temp = path, f"{path}.{uuid.uuid4().hex}"
        self.f = open(self.temp, "wb")

    def close(self) -> None:
        self.f.close()
        os.replace(self.temp, self.path)


def write_tokens(docs: DataFrame, folder: str, p: Params = Params()) -> DataFrame:
    """Write docs' tokens into folder; doc_id, part, first (in the whole), n_tokens, crc (of the tokens' bytes), a row for each row of docs."""
    spark = docs.sparkSession
    to = _local(folder)
    os.makedirs(to, exist_ok=True)
    kind = "<u2" if encoder(p).sp.vocab_size() <= 1 << 16 else "<u4"

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(p)
        tokens, index = _File(f"{to}/part-{part:08d}.bin"), _File(f"{to}/part-{part:08d}.idx")
        n, rows = 0, 0
        for b, data, at in pieces(it, "text", 1 << 19):
            ids, _, _, tok = enc.batch(data, at)
            raw = memoryview(ids.astype(kind).tobytes())
            tokens.f.write(raw)
            index.f.write((tok[:-1] + n).astype("<i8").tobytes())
            width = np.dtype(kind).itemsize
            crc = [zlib.crc32(raw[x * width : y * width]) for x, y in zip(tok[:-1].tolist(), tok[1:].tolist())]
            first = tok[:-1] + n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(b), pa.int64()), pa.array(np.arange(rows, rows + len(b))), pa.array(first, pa.int64()), pa.array(np.diff(tok), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "part", "row", "first", "n_tokens", "crc"])
            n, rows = n + len(ids), rows + len(b)
        index.f.write(np.array([n], "<i8").tobytes())
        tokens.close()
        index.close()
        enc.forget()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = cut(src.mapInArrow(write, "doc_id long, part long, row long, first long, n_tokens long, crc long"))
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    order = Window.orderBy("part")  # a row for each task
    bases = cut(sums.select("part", "n", "docs", (F.sum("n").over(order) - F.col("n")).alias("base"), (F.sum("docs").over(order) - F.col("docs")).alias("doc_base")))

    def rebase(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # from what was written, so that a second run does the same
                at = np.fromfile(f"{to}/part-{part:08d}.idx", "<i8") + base
                f = _File(f"{to}/part-{part:08d}.off")
                f.f.write(at.tobytes())
                f.close()
            yield b

    bases.select("part", "base").repartition("part").mapInArrow(rebase, "part long, base long").write.format("noop").mode("overwrite").save()
    parts = [[r.part, r.base, r.n, r.doc_base, r.docs] for r in bases.orderBy("part").toLocalIterator()]
    with open(f"{to}/meta.json", "w") as f:
        json.dump({"dtype": kind, "tokens": sum(x[2] for x in parts), "docs": sum(x[4] for x in parts), "parts": parts}, f)
    out = rows.join(bases.select(F.col("part").alias("p"), "base"), F.col("part") == F.col("p"))
    return out.select("doc_id", "part", "row", (F.col("first") + F.col("base")).alias("first"), "n_tokens", "crc")


class Reader:
    """Random access to what write_tokens wrote; the files are mapped, not read."""

    def __init__(self, folder: str):
        self.folder = _local(folder)
        with open(f"{self.folder}/meta.json") as f:
            m = json.load(f)
        self.dtype, self.tokens, self.docs, self.parts = m["dtype"], m["tokens"], m["docs"], m["parts"]
        self.starts, self.doc_starts = [x[1] for x in self.parts], [x[3] for x in self.parts]
        self._maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return self.docs

    def _part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._maps:
            name = f"{self.folder}/part-{self.parts[k][0]:08d}"
            data = np.memmap(f"{name}.bin", self.dtype, "r") if self.parts[k][2] else np.zeros(0, self.dtype)
            self._maps[k] = data, np.memmap(f"{name}.off", "<i8", "r")
        return self._maps[k]

    def __getitem__(self, i: int) -> np.ndarray:
        """The tokens of the i-th document, in the order of part and row."""
        if not 0 <= i < self.docs:
            raise IndexError(i)
        k = bisect_right(self.doc_starts, i) - 1
        data, at = self._part(k)
        r, base = i - self.doc_starts[k], self.parts[k][1]
        return data[at[r] - base : at[r + 1] - base]

    def span(self, start: int, n: int) -> np.ndarray:
        """n tokens of the whole, from the given one on."""
        out, k = [], max(0, bisect_right(self.starts, start) - 1)
        while n > 0 and k < len(self.parts):
            data, lo = self._part(k)[0], start - self.parts[k][1]
            got = data[lo : lo + n]
            out.append(got)
            start, n, k = start + len(got), n - len(got), k + 1
        return np.concatenate(out) if out else np.zeros(0, self.dtype)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
