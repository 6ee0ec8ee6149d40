"""Column expressions over text: lines, regexes, entropy, hashes, paths."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from leakloom import catalog


def any_of(conditions) -> Column:
    return reduce(or_, conditions, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(and_, conditions, F.lit(True))


def clean_utf8(content: Column) -> Column:
    """Binary to text, dropping undecodable bytes.

    Spark marks bad bytes with U+FFFD, so a genuine U+FFFD is parked on a
    noncharacter while the marks are removed.
    """
    raw = content.cast("string")
    parked = F.replace(raw, F.lit("�"), F.lit("﷐"))
    repaired = F.replace(F.make_valid_utf8(parked), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.replace(repaired, F.lit("﷐"), F.lit("�")))


def split_lines(text: Column) -> Column:
    """Universal-newline split; a final newline does not open another line."""
    body = (F.when(text.endswith("\r\n"), F.left(text, F.length(text) - 2))
            .when(text.endswith("\n") | text.endswith("\r"), F.left(text, F.length(text) - 1))
            .otherwise(text))
    return F.split(body, "\r\n?|\n", -1)


def fold_case(text: Column) -> Column:
    """Lower case in which the letters outside ASCII that match ASCII ones, ignoring case, become those."""
    for odd, plain in (("ſ", "s"), ("ı", "i"), ("İ", "i")):
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)


def java_regex(pattern: str, ignore_case: bool = True) -> str:
    """Python regex text for Spark: Unicode classes, optional case folding."""
    translated = re.sub(r"\(\?P<", "(?<", pattern).replace(r"\Z", r"\z")
    return ("(?iU)" if ignore_case else "(?U)") + translated


def matches(text: Column, pattern: str, group: int, ignore_case: bool = True) -> Column:
    """All non-overlapping matches of one group, as an array."""
    return F.regexp_extract_all(text, F.lit(java_regex(pattern, ignore_case)), F.lit(group))


def secret_hash(secret: Column) -> Column:
    return F.left(F.sha2(secret, 256), F.lit(16))


def shannon_entropy(text: Column) -> Column:
    """Bits per character; the empty string has none."""
    size = F.length(text)
    shares = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size,
    )
    bits = F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.round(bits, 12))


def entropy_worthwhile(text: Column) -> Column:
    """The cheap tests a candidate must pass before its entropy is computed."""
    size = F.length(text)
    folded = F.lower(text)
    return (
        (size >= catalog.ENTROPY_MIN_LENGTH)
        & ~any_of(folded.contains(word) for word in catalog.ENTROPY_STOP_WORDS)
        & (F.size(F.array_distinct(F.split(text, ""))) >= size * F.lit(catalog.ENTROPY_MIN_DISTINCT))
    )


def entropy_candidates(line: Column) -> Column:
    """Strings worth an entropy test, shape by shape, repeats kept."""
    return F.flatten(F.array(*[matches(line, shape, 1, ignore_case=False)
                               for shape in catalog.ENTROPY_SHAPES]))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def suffix(path: Column) -> Column:
    """Last dotted part of the file name; empty for '.env' and 'name.'."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def present(column: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(column, F.lit("")) != ""
