"""Column functions on text: all built in, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it: the ASCII controls, NEL and all separators.
BLANKS = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"
MIN_SIMILAR_CHARS = 24
MIN_SIMILAR_FIELDS = 5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_whitespace(c: Column | str) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.trim(F.regexp_replace(_col(c), BLANKS, " "))


def lower_each(c: Column | str) -> Column:
    """Lower case character by character: a capital sigma or dotted I doesn't depend on what is around it."""
    return F.lower(F.translate(_col(c), "Σİ", "σi"))


def normalize(c: Column | str) -> Column:
    return lower_each(collapse_whitespace(c))


def trimmed_length(c: Column | str) -> Column:
    """Bytes of the collapsed text, blanks counted twice."""
    return collapsed_length(collapse_whitespace(c))


def collapsed_length(c: Column | str) -> Column:
    """trimmed_length of a text that is collapsed already. The lambda keeps its expression from being copied."""
    return F.transform(F.array(_col(c)), lambda x: F.octet_length(x) + F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))))[0]


def n_fields(c: Column | str) -> Column:
    """Blank-separated fields of a collapsed text."""
    c = _col(c)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def words(c: Column | str) -> Column:
    """Distinct runs of letters and decimal digits."""
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))


def long_words(c: Column) -> Column:
    """Those of at least 3 bytes, by which similar texts are found."""
    return F.filter(c, lambda w: F.octet_length(w) >= 3)


def similarity_eligible(c: Column | str) -> Column:
    """Long enough for similarity: 24 characters and 5 fields of a normalised text."""
    return (F.length(_col(c)) >= MIN_SIMILAR_CHARS) & (n_fields(c) >= MIN_SIMILAR_FIELDS)


def percent(c: Column | str) -> Column:
    """A share in percent, halves up."""
    return F.floor(_col(c).cast("double") * 100 + 0.5).cast("int")


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter by longer length, 0 if either is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.least(a, b).cast("double") / F.greatest(a, b))


def word_overlap(a: Column, b: Column) -> Column:
    """Common words by those of the larger set, 0 if either is empty."""
    n = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / n)


def path_segments(path: Column | str) -> Column:
    return F.split(_col(path), "/")


def has_segment(path: Column | str, segment: str) -> Column:
    return F.array_contains(path_segments(path), segment)


def extension(path: Column | str) -> Column:
    """What follows the last dot of the last segment, empty if there is none."""
    return F.regexp_extract(_col(path), r"\.([^./]*)$", 1)


def language_of(path: Column | str) -> Column:
    """The grammar for a path: typescript, tsx or javascript."""
    e = F.lower(extension(path))
    return F.when(e == "ts", "typescript").when(e.isin("tsx", "jsx"), "tsx").otherwise("javascript")


def keys_of(matches: Column | str) -> Column:
    """Sorted keys of matches, part of a finding's identity."""
    return F.sort_array(F.transform(_col(matches), lambda m: m["key"]))
