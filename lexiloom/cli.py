"""Command line: exit code 0 for no findings, 1 for some, 2 for errors."""

from __future__ import annotations

import os
import sys
from typing import TextIO

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .operators import findings as O
from .plans import check, report
from .sources.catalog import CatalogError
from .sources.config import DEFAULT_FILE, HelpWanted, UsageError, parse

USAGE = f"""lexiloom: find strings in source code that are translations already

  lexiloom <catalog.json> <folder> [flags]

  --mode=source|test   source: report literals that a translation has (the default);
                       test: report literals that differ from the translation they stand for
  --min-length=N       shortest literal, in bytes with blanks counted twice (8)
  --ext=a,b            file name extensions (ts,tsx,js,jsx)
  --exclude=pattern    name, path or glob to leave out; may be repeated
  --config=path        options as JSON ({DEFAULT_FILE} where there is one)
  --baseline=path      findings of an earlier --json that aren't reported again
  --json               JSON instead of text
  --similarity-flow    report literals that are merely similar to a translation, too
"""


def run(args: list[str], out: TextIO, err: TextIO, spark: SparkSession | None = None) -> int:
    try:
        cfg = parse(args, os.getcwd())
    except HelpWanted:
        err.write(USAGE)
        return 0
    except UsageError as e:
        err.write(f"{USAGE}\n{e}\n")
        return 2
    own = spark is None
    if spark is None:
        spark = SparkSession.builder.appName("lexiloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        found = check.findings(spark, cfg).persist()
        s = O.summary(found).first()
        rows = (r.asDict(recursive=True) for r in found.toLocalIterator())
        for part in [report.as_json(rows, s["count"], s["files"])] if cfg.json else report.text(rows, s["count"], s["files"]):
            out.write(part)
    except (OSError, CatalogError, check.SourceError, PySparkException, Py4JError) as e:
        err.write(f"{str(e).splitlines()[0]}\n")
        return 2
    finally:
        if own:
            spark.catalog.clearCache()  # literals, lookups and findings; in a given session they're the caller's
    return int(s["found"])


def main() -> None:
    sys.exit(run(sys.argv[1:], sys.stdout, sys.stderr))


if __name__ == "__main__":
    main()
