"""Source files: a walk that leaves excluded folders out, and a data source that reads what it found.

Spark's own file source hides names that begin with an underscore or a dot, which source trees have.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTENSIONS = ("ts", "tsx", "js", "jsx")
EXCLUDED = ("node_modules", ".git", "dist", "build", "coverage", ".next", "playwright-report", "test-results")


def extensions(given: list[str] | tuple[str, ...]) -> frozenset[str]:
    """Without one leading dot, trimmed; the usual ones if none are given."""
    return frozenset(x for e in given or EXTENSIONS if (x := e.removeprefix(".").strip()))


def glob_regex(glob: str) -> re.Pattern[str] | None:
    """A shell pattern whose stars and question marks don't cross slashes; None if it is malformed."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i >= len(glob):
                return None
            out.append(re.escape(glob[i]))
        elif c == "[":
            m = re.compile(r"\[(\^?)((?:\\.|[^\]\\])+)\]").match(glob, i)
            if not m:
                return None
            body = re.sub(r"([\[&~|])", r"\\\1", m[2])
            out.append(f"[{m[1]}{body}]" if not m[1] else f"[^/{body}]")
            i = m.end() - 1
        else:
            out.append(re.escape(c))
        i += 1
    try:
        return re.compile("".join(out) + r"\Z", re.S)
    except re.error:
        return None


def excluded(rel: str, patterns: list[str]) -> bool:
    """Whether a relative path is named by a pattern: by a segment or the whole, or by a glob of the whole or the last segment."""
    base = rel.rsplit("/", 1)[-1]
    for p in patterns:
        if any(c in p for c in "*?["):
            r = glob_regex(p)
            if r and (r.match(rel) or r.match(base)):
                return True
        elif p == rel or p in rel.split("/"):
            return True
    return False


def discover(root: str, exts: list[str] | tuple[str, ...] = (), exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Paths of the source files under root, sorted by their bytes. A root that is a file has none; one that isn't there is an error."""
    os.stat(root)
    allowed, patterns = extensions(exts), [*EXCLUDED, *exclude]
    out = []

    def fail(e: OSError) -> None:
        raise e

    for at, dirs, names in os.walk(root, onerror=fail if os.path.isdir(root) else None):
        lead = os.path.relpath(at, root)
        lead = "" if lead == "." else lead.replace(os.sep, "/") + "/"
        dirs[:] = [d for d in dirs if not excluded(lead + d, patterns)]
        out += [os.path.join(at, n) for n in names if n.rpartition(".")[2] in allowed and "." in n and not excluded(lead + n, patterns)]
    return sorted(out, key=os.fsencode)


class _Some(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SourceFiles(DataSource):
    """path, content. Options: path (root), extensions, exclude (each a list joined by line ends), perPartition."""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        split = lambda k: [x for x in self.options.get(k, "").split("\n") if x]
        paths = discover(self.options["path"], split("extensions"), split("exclude"))
        n = int(self.options.get("perpartition", self.options.get("perPartition", 64)))
        return [_Some(paths[i : i + n]) for i in range(0, len(paths), n)] or [_Some([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, bytes]]:
        for p in partition.paths:
            with open(p, "rb") as f:
                yield p, f.read()


def read(spark: SparkSession, root: str, exts: list[str] | tuple[str, ...] = (), exclude: list[str] | tuple[str, ...] = (), per_partition: int = 64) -> DataFrame:
    spark.dataSource.register(SourceFiles)
    return spark.read.format("source_files").option("extensions", "\n".join(exts)).option("exclude", "\n".join(exclude)).option("perPartition", per_partition).load(root)
