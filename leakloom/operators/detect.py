"""Secret detection over source files.

Input files are rows (app_name, path, text, ...). The work is a narrow map: each
file is split into lines, lines without any anchor literal are dropped, and only
the survivors meet a regex. Context is cut out of the line array before it is
exploded, so no window and no shuffle is needed, and the array itself is never
copied onto the exploded rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from leakloom import catalog
from leakloom.catalog import Pattern
from leakloom.functions import text as tx

HIT_TYPE = "array<struct<pattern_no:int,secret:string,bits:double>>"

_ENTROPY_GATE = r"""(?U)"[^"]{20}|'[^']{20}|[=:]\s*[A-Za-z0-9+/]{20}"""


def eligible_files(
    files: DataFrame,
    extensions: Sequence[str] = catalog.SCAN_EXTENSIONS,
    skip_names: Sequence[str] = catalog.SKIP_NAMES,
    max_bytes: int = catalog.MAX_FILE_BYTES,
) -> DataFrame:
    """Files the scanner reads: known suffix, not too large, no skipped path part.

    Paths are relative to the application root; parents above it do not count.
    """
    parts = F.split("path", "/")
    return files.where(
        (F.col("length") <= max_bytes)
        & F.lower(tx.suffix(F.col("path"))).isin(*extensions)
        & ~F.arrays_overlap(parts, F.array(*[F.lit(name) for name in skip_names]))
    )


def scannable_file_count(files: DataFrame) -> DataFrame:
    """Files per application by the progress counter's own, looser rules."""
    name = tx.file_name(F.col("path"))
    hidden_or_skipped = F.exists(
        tx.parent_dirs(F.col("path")),
        lambda d: d.startswith(".") | d.isin(*catalog.COUNT_SKIP_DIRS),
    )
    counted = tx.any_of(name.endswith(s) for s in catalog.COUNT_SUFFIXES) & ~hidden_or_skipped
    return files.groupBy("app_name").agg(F.count_if(counted).alias("total_files"))


def file_lines(files: DataFrame, keys: Sequence[str] = ("app_name", "path")) -> DataFrame:
    """One row per line, numbered from 1."""
    return (
        files.where(F.col("text") != "")
        .select(*keys, F.posexplode(tx.split_lines(F.col("text"))).alias("position", "line"))
        .select(*keys, (F.col("position") + 1).cast("bigint").alias("line_number"), "line")
    )


def _may_match(line: Column, folded: Column, pattern: Pattern) -> Column:
    """A cheap test every line with a match of the pattern passes."""
    if pattern.anchors:
        return tx.any_of(folded.contains(a) for a in pattern.anchors)
    return _has_shape(line, pattern) if pattern.shape else F.lit(True)


def _has_shape(line: Column, pattern: Pattern) -> Column:
    found = line.rlike(tx.java_regex(pattern.shape))
    return (F.length(line) >= pattern.least) & found if pattern.least else found


def _worth_matching(line: Column, folded: Column, patterns: Sequence[Pattern], entropy: bool) -> Column:
    if any(not (p.anchors or p.shape) for p in patterns):
        return F.lit(True)
    anchors = sorted({a for p in patterns for a in p.anchors})
    tests = [folded.contains(a) for a in anchors]
    tests += [_has_shape(line, p) for p in patterns if p.shape and not p.anchors]
    if entropy:
        opens = tx.any_of(line.contains(c) for c in ("\"", "'", "=", ":"))
        tests.append((F.length(line) > catalog.ENTROPY_MIN_LENGTH) & opens & line.rlike(_ENTROPY_GATE))
    return tx.any_of(tests)


def candidate_lines(
    files: DataFrame,
    keys: Sequence[str],
    patterns: Sequence[Pattern] = catalog.BUILTIN_PATTERNS,
    entropy: bool = True,
    context: int = 2,
) -> DataFrame:
    """Lines that may hold a secret, with their neighbours as two small arrays."""
    lines = F.col("lines")
    numbered = F.transform(lines, lambda line, i: F.struct(
        i.alias("i"), line.alias("line"), tx.fold_case(line).alias("folded")))
    kept = F.filter(numbered, lambda x: _worth_matching(x["line"], x["folded"], patterns, entropy))
    rows = F.transform(kept, lambda x: F.struct(
        (x["i"] + 1).cast("bigint").alias("line_number"),
        x["line"].alias("line"),
        x["folded"].alias("folded"),
        F.slice(lines, F.greatest(x["i"] - context + 1, F.lit(1)),
                F.least(x["i"], F.lit(context))).alias("before"),
        F.slice(lines, x["i"] + 2, F.lit(context)).alias("after"),
    ))
    return (
        files.select(*keys, tx.split_lines(F.col("text")).alias("lines"))
        .select(*keys, F.explode(rows).alias("c"))
        .select(*keys, "c.*")
    )


def _pattern_hits(line: Column, folded: Column, number: int, pattern: Pattern, group: int) -> Column:
    found = F.transform(
        tx.matches(line, pattern.pattern, group),
        lambda secret: F.struct(F.lit(number).alias("pattern_no"), secret.alias("secret"),
                                F.lit(None).cast("double").alias("bits")),
    )
    return F.when(_may_match(line, folded, pattern), found.cast(HIT_TYPE)).otherwise(F.array().cast(HIT_TYPE))


def _entropy_hits(line: Column, number: int) -> Column:
    scored = F.transform(
        F.filter(tx.entropy_candidates(line), tx.entropy_worthwhile),
        lambda secret: F.struct(F.lit(number).alias("pattern_no"), secret.alias("secret"),
                                tx.shannon_entropy(secret).alias("bits")),
    )
    strong = F.filter(scored, lambda hit: hit["bits"] >= catalog.ENTROPY_MIN_BITS).cast(HIT_TYPE)
    return F.when(line.rlike(_ENTROPY_GATE), strong).otherwise(F.array().cast(HIT_TYPE))


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")), "\n")


def excluded(secret: Column) -> Column:
    """Values that look like placeholders, plain numbers or plain words."""
    return tx.any_of(secret.rlike(tx.java_regex(p, ignore_case=False)) for p in catalog.EXCLUSIONS)


def scan_secrets(
    files: DataFrame,
    keys: Sequence[str] = ("app_name", "path"),
    patterns: Sequence[Pattern] = catalog.BUILTIN_PATTERNS,
    entropy: bool = True,
    secret_group: str = "reference",
    drop_excluded: bool = False,
    min_confidence: float | None = None,
    keep_secret: bool = False,
) -> DataFrame:
    """Regex hits and entropy hits of every file, one row per hit, repeats kept.

    `secret_group='value'` fingerprints the value instead of the keyword.
    `drop_excluded` and `min_confidence` are the opt-in filters.
    """
    patterns = tuple(patterns)
    line, folded = F.col("line"), F.col("folded")
    per_pattern = [_pattern_hits(line, folded, n, p, p.secret_group(secret_group))
                   for n, p in enumerate(patterns)]
    if entropy:
        per_pattern.append(_entropy_hits(line, len(patterns)))
    hits = (
        candidate_lines(files, keys, patterns, entropy)
        .select(*keys, "line_number", "before", "after",
                F.explode(F.flatten(F.array(*per_pattern))).alias("hit"))
        .select(*keys, "line_number", "before", "after", "hit.*")
    )
    if drop_excluded:
        hits = hits.where(~excluded(F.col("secret")))

    def described(values, entropy_value) -> Column:
        return F.get(F.array(*[F.lit(v) for v in (*values, entropy_value)]), F.col("pattern_no"))

    found = hits.select(
        *keys,
        "line_number",
        described([p.name for p in patterns], catalog.ENTROPY_NAME).alias("pattern_name"),
        described([p.pattern_type for p in patterns], "entropy").alias("pattern_type"),
        described([p.severity for p in patterns], "medium").alias("severity"),
        F.when(F.col("bits").isNotNull(), F.least(F.lit(0.9), F.col("bits") / 6.0))
        .otherwise(described([float(p.confidence) for p in patterns], 0.0)).alias("confidence"),
        tx.secret_hash(F.col("secret")).alias("secret_hash"),
        _joined(F.col("before")).alias("context_before"),
        _joined(F.col("after")).alias("context_after"),
        described([p.remediation for p in patterns], catalog.ENTROPY_REMEDIATION).alias("remediation"),
        *(["secret", "bits"] if keep_secret else []),
    )
    return found if min_confidence is None else found.where(F.col("confidence") >= min_confidence)


def entropy_strings(files: DataFrame, keys: Sequence[str] = ("app_name", "path"),
                    only_high: bool = False) -> DataFrame:
    """Entropy candidates of every line with their score, or only those that pass."""
    found = (
        candidate_lines(files, keys, patterns=(), entropy=True)
        .select(*keys, "line_number", F.explode(tx.entropy_candidates(F.col("line"))).alias("candidate"))
    )
    if not only_high:
        return found
    return (
        found.where(tx.entropy_worthwhile(F.col("candidate")))
        .withColumn("entropy", tx.shannon_entropy(F.col("candidate")))
        .where(F.col("entropy") >= catalog.ENTROPY_MIN_BITS)
        .withColumn("confidence", F.least(F.lit(0.9), F.col("entropy") / 6.0))
    )


def pattern_category(pattern_name: Column) -> Column:
    category = F.lit(None).cast("string")
    for name, members in catalog.PATTERN_CATEGORIES.items():
        category = F.when(pattern_name.isin(*members), name).otherwise(category)
    return category


def with_category(findings: DataFrame) -> DataFrame:
    return findings.withColumn("category", pattern_category(F.col("pattern_name")))


def confident(findings: DataFrame, threshold: float) -> DataFrame:
    return findings.where(F.col("confidence") >= threshold)


def batch_scan_counts(applications: DataFrame, files: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per listed application that has files; one without hits counts zero.

    Both sides are aggregated before they meet, so a hot application costs nothing extra.
    """
    present = files.select("app_name").distinct()
    counts = findings.groupBy("app_name").agg(F.count("*").alias("found"))
    return (
        applications.select(F.col("name").alias("app_name")).distinct()
        .join(present, "app_name", "left_semi")
        .join(counts, "app_name", "left")
        .select("app_name", F.coalesce("found", F.lit(0)).cast("bigint").alias("findings"))
    )
