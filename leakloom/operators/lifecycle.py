"""Finding lifecycle: fingerprints, suppression, upserts, comparison, event folds.

State is never updated in place. New snapshots are derived from the old one and a
batch, and event logs are folded with plain aggregates, which combine on the map
side however many rows share a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leakloom import catalog
from leakloom.functions import text as tx
from leakloom.operators.ordered import last_before, ranked
from leakloom.session import cut

HASH_COLUMNS = ("app_name", "finding_type", "file_path", "line_number", "cve_id", "component", "title")


def finding_hash() -> Column:
    """MD5 over the identifying fields; null counts as empty, a null line as 0."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("0" if c == "line_number" else "")) for c in HASH_COLUMNS]
    return F.md5(F.concat_ws("|", *parts))


def with_hash(findings: DataFrame) -> DataFrame:
    return findings.withColumn("finding_hash", finding_hash())


# --- false-positive patterns -------------------------------------------------

#: Longest piece that stands for a code pattern; paths are met at their start, so their pieces may be longer.
PIECE = 8
#: Words of 64 bits in the filter of pieces that patterns are known by; a power of two.
FILTER_WORDS = 1 << 12
#: Characters of a snippet whose pieces are held at once.
STRETCH = 1 << 16

#: Kind of pattern and the column it is met with.
_MET = {"file_path": "file_path", "component": "component", "code_pattern": "code_snippet"}


def _pattern_keys(patterns: DataFrame, kind: str) -> DataFrame:
    """Scope and value of one kind of pattern; an empty value matches nothing."""
    return (
        patterns.where((F.col("pattern_type") == kind) & tx.present(F.col("pattern_value")))
        .select(F.col("app_name").alias("scope"), F.col("pattern_value").alias("value")).distinct()
    )


def _class_length(value: str) -> str:
    """Largest power of two that is not above the length."""
    return f"CAST(pow(2, floor(log2(length({value})))) AS INT)"


#: Lengths of the pieces of snippets.
_CODE_LENGTHS = tuple(1 << k for k in range(PIECE.bit_length()))


def _all_pieces(text: str, n: int) -> str:
    """Every run of `n` characters, by matching in front of each character: linear in the text's length."""
    return f"regexp_extract_all({text}, '(?s)(?=(.{{{n}}}))', 1)"


def _code_piece(value: str) -> str:
    """The piece a code pattern is known by: of its longest ones that with the least hash.

    Patterns that begin alike are thus known by different pieces for the most part.
    """
    cases = [f"WHEN length({value}) >= {n} THEN array_min(transform({_all_pieces(value, n)}, p -> struct(xxhash64(p) AS rank, p AS piece))).piece"
             for n in reversed(_CODE_LENGTHS)]
    return f"CASE {' '.join(cases)} END"


def _pieces(values: DataFrame, keys: DataFrame, anywhere: bool) -> DataFrame:
    """Values (app_name, key, text) cut to the class lengths that occur among the patterns."""
    length = F.expr(f"least({_class_length('value')}, {PIECE})" if anywhere else _class_length("value"))
    cut_to = values.withColumn("_lengths", keys.agg(F.collect_set(length)).scalar())
    starts = "transform(filter(_lengths, n -> n <= length(text)), n -> left(text, n))"
    inside = ", ".join(f"CASE WHEN array_contains(_lengths, {n}) THEN {_all_pieces('text', n)} ELSE CAST(array() AS array<string>) END"
                       for n in _CODE_LENGTHS)
    return cut_to.select("app_name", "key", F.explode(F.expr(f"array_distinct(concat({inside}))" if anywhere else starts)).alias("piece"))


def _known_by(patterns: DataFrame) -> DataFrame:
    """(scope, kind, value, n, tag): n is the length and tag the hash of the piece a pattern is known by."""
    piece = F.expr(f"""CASE pattern_type WHEN 'file_path' THEN left(pattern_value, {_class_length('pattern_value')})
        WHEN 'code_pattern' THEN {_code_piece('pattern_value')} ELSE pattern_value END""")
    return (
        patterns.where(F.col("pattern_type").isin(*_MET) & tx.present(F.col("pattern_value")))
        .select(F.col("app_name").alias("scope"), F.col("pattern_type").alias("kind"), F.col("pattern_value").alias("value"), piece.alias("piece"))
        .selectExpr("scope", "kind", "value", "length(piece) AS n", "xxhash64(kind, piece) AS tag")
    )


def _filter_of(known: DataFrame) -> DataFrame:
    """One row: lengths of path pieces and of code pieces, and the words of a bitmap over the patterns' tags."""
    words = known.groupBy(F.expr(f"CAST(shiftright(pmod(tag, {64 * FILTER_WORDS}L), 6) AS INT)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(pmod(tag, 64L) AS INT)))").alias("bits"),
        F.expr("collect_set(CASE WHEN kind = 'file_path' THEN n END)").alias("path"),
        F.expr("collect_set(CASE WHEN kind = 'code_pattern' THEN n END)").alias("code"))
    filled = words.agg(F.expr("map_from_entries(collect_list(struct(word, bits)))").alias("filled"),
                       F.expr("array_distinct(flatten(collect_list(path)))").alias("path"),
                       F.expr("array_distinct(flatten(collect_list(code)))").alias("code"))
    return filled.select(F.expr(
        f"struct(path, code, transform(sequence(0, {FILTER_WORDS - 1}), w -> coalesce(try_element_at(filled, w), 0L)) AS words)").alias("known"))


def _passing_tags() -> Column:
    """Tags of a row's pieces that the filter `_known` lets pass."""
    none = "CAST(array() AS array<bigint>)"

    def passing(kind: str, pieces: str) -> str:
        return (f"filter(transform({pieces}, p -> xxhash64('{kind}', p)), t -> getbit("
                f"_known.words[CAST(shiftright(pmod(t, {64 * FILTER_WORDS}L), 6) AS INT)], CAST(pmod(t, 64L) AS INT)) = 1)")

    stretches = (f"transform(sequence(0, greatest(CAST(length(code_snippet) AS INT) - 1, 0), {STRETCH}), "
                 f"at -> substring(code_snippet, at + 1, {STRETCH + PIECE - 1}))")
    heads = "transform(filter(_known.path, n -> n <= length(file_path)), n -> left(file_path, n))"
    found = [f"CASE WHEN file_path <> '' THEN {passing('file_path', heads)} ELSE {none} END",
             f"CASE WHEN component <> '' THEN {passing('component', 'array(component)')} ELSE {none} END"]
    for n in _CODE_LENGTHS:
        inside = f"flatten(transform({stretches}, part -> array_distinct({passing('code_pattern', _all_pieces('part', n))})))"
        found.append(f"CASE WHEN code_snippet <> '' AND array_contains(_known.code, {n}) THEN {inside} ELSE {none} END")
    return F.expr(f"array_distinct(concat({', '.join(found)}))")


def _content_key() -> Column:
    """128-bit name of what patterns look at: application, path, component and snippet, nulls apart from empty ones."""
    parts = [f"coalesce(concat(CAST(length({c}) AS string), ':', {c}), '-')" for c in ("app_name", *_MET.values())]
    return F.expr(f"md5(concat({', '.join(parts)}))")


def covered_contents(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct `_content` keys of the findings that some pattern of their application, or a global one, covers.

    A pattern is known by one piece of it: a path by its first 2^k characters, a code
    pattern by eight characters of it (less if it is shorter). Hashes of the pieces of
    a row's path and snippet are looked up in a bitmap over the patterns' pieces, in
    the row; only rows and pieces that pass meet the patterns, in a hash join, and what
    meets is tested in full. Nothing is compared pairwise, work is linear in the length
    of a snippet, and the pattern table may grow without bound: a full bitmap lets more
    pieces pass, and no covered row is lost.
    """
    known = _known_by(patterns)
    looked_at = ("app_name", *_MET.values())
    rows = findings.select(*looked_at).distinct().withColumn("_known", _filter_of(known).scalar())
    pieces = rows.select(*looked_at, F.explode(_passing_tags()).alias("tag")).selectExpr(
        *looked_at, "tag", "explode(array(app_name, CAST(NULL AS string))) AS scope")
    met = pieces.alias("c").join(known.distinct().alias("k"), F.expr("""c.tag = k.tag AND c.scope <=> k.scope AND CASE k.kind
        WHEN 'file_path' THEN startswith(c.file_path, k.value) WHEN 'component' THEN c.component = k.value
        ELSE contains(c.code_snippet, k.value) END"""))
    return met.selectExpr(*[f"c.{c} AS {c}" for c in looked_at]).select(_content_key().alias("_content")).distinct()


def flag_suppressed(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Findings with `suppressed`: some pattern of their application or a global one fits."""
    covered = covered_contents(findings, patterns).withColumn("suppressed", F.lit(True))
    return (
        findings.withColumn("_content", _content_key()).join(covered, "_content", "left")
        .select(*findings.columns, F.coalesce("suppressed", F.lit(False)).alias("suppressed"))
    )


def suppress_false_positives(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Findings no pattern fits."""
    keyed = findings.withColumn("_content", _content_key())
    return keyed.join(covered_contents(findings, patterns), "_content", "left_anti").select(*findings.columns)


def derive_fp_patterns(marks: DataFrame, findings: DataFrame) -> DataFrame:
    """Patterns an analyst asked for: a path and a component pattern per marked finding.

    `marks` has (finding_id, reason, analyst, create_pattern).
    """
    asked = marks.where("create_pattern").select(F.col("finding_id").alias("id"), "reason", "analyst")
    pairs = F.array(
        F.struct(F.lit("file_path").alias("pattern_type"), F.col("file_path").alias("pattern_value")),
        F.struct(F.lit("component").alias("pattern_type"), F.col("component").alias("pattern_value")),
    )
    return (
        findings.select("id", "app_name", "file_path", "component").join(asked, "id")
        .select("app_name", "reason", F.col("analyst").alias("created_by"), F.explode(pairs).alias("p"))
        .where(tx.present(F.col("p.pattern_value")))
        .select("app_name", "p.pattern_type", "p.pattern_value", "reason", "created_by")
    )


# --- upsert ------------------------------------------------------------------

KEYS = ["app_name", "finding_hash"]


def batch_arrivals(batch: DataFrame, patterns: DataFrame, now: Column) -> DataFrame:
    """A batch folded to one row per (app_name, finding_hash).

    `arrivals` counts all rows. `accepted` counts them from the first row that no
    pattern fits, which is the one that would be inserted (`first`, null if none).
    """
    # Verdicts are kept once, without the rows' contents; ids are folded, and only the winners' rows are fetched.
    flagged = cut(flag_suppressed(batch, patterns).select(*KEYS, "id", "suppressed"))
    folded = flagged.groupBy(*KEYS).agg(F.count("*").alias("arrivals"), F.expr("min(CASE WHEN NOT suppressed THEN id END)").alias("first_ok"))
    # Suppressed rows ahead of the first accepted one; rare, so only those are joined.
    ahead = (
        _with_same_key(flagged.where("suppressed").select(*KEYS, "id"), folded.select(*KEYS, "first_ok"), "inner")
        .where(F.col("id") < F.col("first_ok"))
        .groupBy(*KEYS).agg(F.count("*").alias("ahead"))
    )
    winners = folded.where("first_ok IS NOT NULL").select(*KEYS, F.col("first_ok").alias("id"))
    rows = _with_same_key(batch, winners, "left_semi", "id").dropDuplicates([*KEYS, "id"])
    first = rows.select(*KEYS, F.struct(*batch.columns).alias("first"))
    return _with_same_key(_with_same_key(folded, ahead, "left"), first, "left").select(
        *KEYS, "arrivals", "first",
        (F.col("arrivals") - F.coalesce("ahead", F.lit(0))).alias("accepted"),
        now.alias("first_at"), now.alias("last_at"),
    )


def _with_same_key(left: DataFrame, right: DataFrame, how: str, *also: str) -> DataFrame:
    """Join on (app_name, finding_hash), a null application being one like others; the left side's columns are kept."""
    names = {c: f"_right_{c}" for c in (*KEYS, *also)}
    same = [F.col(c).eqNullSafe(F.col(r)) if c == "app_name" else F.col(c) == F.col(r) for c, r in names.items()]
    joined = left.join(right.withColumnsRenamed(names), same, how)
    return joined if how == "left_semi" else joined.drop(*names.values())


def fold_arrivals(deltas: DataFrame) -> DataFrame:
    """Arrivals of several batches (with `batch_id`) as if they had come in one.

    Per key there is at most one row per batch, so the collected list is as short as
    the number of batches folded together.
    """
    inserting = F.when(F.col("first").isNotNull(), F.col("batch_id"))
    per_key = deltas.groupBy(*KEYS).agg(
        F.sum("arrivals").alias("arrivals"),
        F.min(inserting).alias("inserted_in"),
        F.min_by("first", inserting).alias("first"),
        F.min_by("first_at", inserting).alias("first_at"),
        F.max_by("last_at", "batch_id").alias("last_at"),
        F.collect_list(F.struct("batch_id", "arrivals", "accepted")).alias("batches"),
    )
    counted = F.transform("batches", lambda b: F.when(b["batch_id"] == F.col("inserted_in"), b["accepted"])
                          .when(b["batch_id"] > F.col("inserted_in"), b["arrivals"]).otherwise(F.lit(0)))
    accepted = F.aggregate(counted, F.lit(0).cast("bigint"), lambda total, n: total + n)
    return per_key.select(*KEYS, "arrivals", "first", accepted.alias("accepted"), "first_at", "last_at")


def merge_arrivals(snapshot: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Snapshot after the arrivals, as one full join of unique keys.

    Known false positives stay as they are. Other known findings are seen again and
    counted; a resolved one is not reopened. Unknown ones are inserted unless a
    pattern fits.
    """
    old = snapshot.select(*KEYS, F.struct(*snapshot.columns).alias("old"))
    merged = old.join(arrivals, KEYS, "full")
    known = F.col("old").isNotNull()
    seen = known & F.col("arrivals").isNotNull() & ~F.coalesce(F.col("old.is_false_positive"), F.lit(False))
    refreshed = {
        "occurrence_count": F.col("old.occurrence_count") + F.col("arrivals"),
        "last_seen": F.col("last_at"), "updated_at": F.col("last_at"),
    }
    inserted = {
        "status": F.lit("open"), "is_false_positive": F.lit(False), "occurrence_count": F.col("accepted"),
        "first_detected": F.col("first_at"), "created_at": F.col("first_at"),
        "last_seen": F.col("last_at"), "updated_at": F.col("last_at"),
    }
    arriving = {f.name for f in arrivals.schema["first"].dataType.fields}
    columns = [F.col(k) for k in KEYS]
    for field in snapshot.schema.fields:
        name = field.name
        if name in KEYS:
            continue
        stored = F.col(f"old.{name}")
        kept = F.when(seen, refreshed[name]).otherwise(stored) if name in refreshed else stored
        fresh = inserted.get(name, F.col(f"first.{name}") if name in arriving else F.lit(None))
        columns.append(F.when(known, kept).otherwise(fresh).cast(field.dataType).alias(name))
    return merged.where(known | F.col("first").isNotNull()).select(*columns).select(*snapshot.columns)


def upsert_findings(snapshot: DataFrame, batch: DataFrame, patterns: DataFrame, now: Column) -> DataFrame:
    """Snapshot after one batch of hashed findings."""
    return merge_arrivals(snapshot, batch_arrivals(batch, patterns, now))


# --- comparison --------------------------------------------------------------

def baseline_scans(scans: DataFrame) -> DataFrame:
    """Every scan with the latest completed earlier scan of its application, if any."""
    slim = scans.select("id", "app_name", "status")
    completed = F.when(F.col("status") == "completed", F.col("id"))
    return last_before(slim, ["app_name"], "id", completed, "baseline_scan_id").select(
        F.col("id").alias("current_scan_id"), "app_name", "baseline_scan_id")


def scan_hashes(findings: DataFrame) -> DataFrame:
    """The distinct fingerprints of each scan; only findings marked as no false positives, so unknown ones are left out."""
    return (
        findings.where(~F.col("is_false_positive"))
        .select("app_name", "scan_id", "finding_hash").distinct()
    )


def compare_scans(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """New, resolved and persistent fingerprints for each (current, baseline) pair.

    Only the overlap needs a join of fingerprints, and each current fingerprint meets
    at most one baseline row; the other numbers follow from the set sizes. A baseline
    shared by many scans is therefore never multiplied.
    """
    pairs = pairs.where(F.col("baseline_scan_id").isNotNull()).select(
        "app_name", "current_scan_id", "baseline_scan_id")
    hashes = scan_hashes(findings)
    sizes = hashes.groupBy("app_name", "scan_id").agg(F.count("*").alias("size"))
    current = hashes.join(pairs.withColumnRenamed("current_scan_id", "scan_id"), ["app_name", "scan_id"])
    base = hashes.select("app_name", F.col("scan_id").alias("baseline_scan_id"), "finding_hash")
    persistent = (
        current.join(base, ["app_name", "baseline_scan_id", "finding_hash"], "left_semi")
        .groupBy("app_name", F.col("scan_id").alias("current_scan_id"), "baseline_scan_id")
        .agg(F.count("*").alias("persistent"))
    )
    rejected = (
        findings.where("is_false_positive").groupBy("app_name", F.col("scan_id").alias("current_scan_id"))
        .agg(F.count("*").alias("false_positives"))
    )
    size_of = {
        side: sizes.select("app_name", F.col("scan_id").alias(f"{side}_scan_id"), F.col("size").alias(f"{side}_size"))
        for side in ("current", "baseline")
    }
    joined = (
        pairs
        .join(size_of["current"], ["app_name", "current_scan_id"], "left")
        .join(size_of["baseline"], ["app_name", "baseline_scan_id"], "left")
        .join(persistent, ["app_name", "current_scan_id", "baseline_scan_id"], "left")
        .join(rejected, ["app_name", "current_scan_id"], "left")
        .fillna(0, ["current_size", "baseline_size", "persistent", "false_positives"])
    )
    new = F.col("current_size") - F.col("persistent")
    resolved = F.col("baseline_size") - F.col("persistent")
    return joined.select(
        "app_name", "baseline_scan_id", "current_scan_id",
        new.alias("new_findings"),
        resolved.alias("resolved_findings"),
        F.col("persistent").alias("persistent_findings"),
        "false_positives",
        remediation_score(new, resolved, F.col("baseline_size")).alias("remediation_score"),
    )


def remediation_score(new: Column, resolved: Column, baseline: Column) -> Column:
    """Share of the baseline that is gone, in percent; an empty baseline scores 100 or 0."""
    return (F.when(baseline > 0, F.try_divide(resolved, baseline) * 100)
            .when(new == 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def _hashes_of(findings: DataFrame, scan_id: int) -> DataFrame:
    return scan_hashes(findings.where(F.col("scan_id") == scan_id)).select("finding_hash")


def new_hashes(findings: DataFrame, current: int, baseline: int) -> DataFrame:
    return _hashes_of(findings, current).subtract(_hashes_of(findings, baseline))


def resolved_hashes(findings: DataFrame, current: int, baseline: int) -> DataFrame:
    return _hashes_of(findings, baseline).subtract(_hashes_of(findings, current))


def persistent_hashes(findings: DataFrame, current: int, baseline: int) -> DataFrame:
    return _hashes_of(findings, current).intersect(_hashes_of(findings, baseline))


# --- event folds -------------------------------------------------------------

def apply_false_positives(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Findings after false-positive marks (finding_id, reason, analyst, marked_at, id).

    The latest mark of a finding wins.
    """
    latest = marks.groupBy(F.col("finding_id").alias("id")).agg(
        F.max_by(F.struct("reason", "analyst", "marked_at"), F.struct("marked_at", "id")).alias("mark"))
    joined = findings.join(latest, "id", "left")
    marked = F.col("mark").isNotNull()
    replaced = {
        "is_false_positive": F.lit(True),
        "false_positive_reason": F.col("mark.reason"),
        "analyst_comment": F.concat(F.lit("Marked as false positive by "), F.col("mark.analyst")),
        "status": F.lit("ignored"),
        "updated_at": F.col("mark.marked_at"),
    }
    for name, value in replaced.items():
        before = F.col(name) if name in findings.columns else F.lit(None)
        joined = joined.withColumn(name, F.when(marked, value).otherwise(before))
    return joined.drop("mark")


def false_positive_events(marks: DataFrame) -> DataFrame:
    """History rows for false-positive marks."""
    return marks.select(
        "finding_id", F.lit("false_positive").alias("event_type"),
        F.concat(F.lit("Marked as false positive: "), F.col("reason")).alias("details"),
        "analyst", F.col("marked_at").alias("event_ts"))


def current_status(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings after status changes (finding_id, status, changed_at, id).

    The latest status wins; the resolution date is that of the latest 'resolved'.
    """
    folded = changes.groupBy(F.col("finding_id").alias("id")).agg(
        F.max_by("status", F.struct("changed_at", "id")).alias("new_status"),
        F.max(F.when(F.col("status") == "resolved", F.col("changed_at"))).alias("resolved_at"),
        F.max("changed_at").alias("changed_at"),
    )
    joined = findings.join(folded, "id", "left")
    replaced = {"status": "new_status", "resolution_date": "resolved_at", "updated_at": "changed_at"}
    for name, source in replaced.items():
        before = F.col(name) if name in findings.columns else F.lit(None)
        joined = joined.withColumn(name, F.coalesce(F.col(source), before))
    return joined.drop(*replaced.values())


def status_events(changes: DataFrame) -> DataFrame:
    """History rows for status changes."""
    return changes.select(
        "finding_id",
        F.when(F.col("status") == "resolved", "resolved").otherwise("status_change").alias("event_type"),
        F.concat(F.lit("Status changed to "), F.col("status")).alias("details"),
        "analyst", F.col("changed_at").alias("event_ts"))


def comment_events(comments: DataFrame, analyst: str = "Current User") -> DataFrame:
    """History rows for comments (finding_id, comment, commented_at)."""
    return comments.select("finding_id", F.lit("comment_added").alias("event_type"), F.col("comment").alias("details"),
                           F.lit(analyst).alias("analyst"), F.col("commented_at").alias("event_ts"))


def _without_leading_blanks(comments: DataFrame) -> DataFrame:
    """Blank comments count only after the first one with text. They are rare, so only they are joined."""
    moment = F.struct("event_ts", "id")
    filled = comments.where(tx.present(F.col("details")))
    first = filled.groupBy("finding_id").agg(F.min(moment).alias("first"))
    later = (comments.where(~tx.present(F.col("details"))).join(first, "finding_id")
             .where(moment > F.col("first")).select(*comments.columns))
    return filled.unionByName(later)


def comment_lines(comments: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Comments (finding_id, event_ts, id, details) that belong to threads, in no order.

    With `findings`, a comment already stored on a finding comes first, without a time.
    """
    rows = comments.select("finding_id", "event_ts", "id", "details")
    if findings is not None:
        stored = findings.where(tx.present(F.col("analyst_comment"))).select(
            F.col("id").alias("finding_id"), F.lit(None).cast(rows.schema["event_ts"].dataType).alias("event_ts"),
            F.lit(None).cast("bigint").alias("id"), F.col("analyst_comment").alias("details"))
        rows = rows.unionByName(stored)
    return _without_leading_blanks(rows)


def comment_threads(comments: DataFrame, findings: DataFrame | None = None, per_part: int | None = None) -> DataFrame:
    """One text per finding: its comments line by line, oldest first.

    `per_part` gives threads in numbered parts of that many comments instead, for
    threads that no row should hold as a whole; the parts in order, joined by a
    newline, are the thread.
    """
    lines = comment_lines(comments, findings)
    text = F.coalesce("details", F.lit("")).alias("text")

    def joined(*order: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct(*order, text)))
        return F.array_join(F.transform(ordered, lambda c: c["text"]), "\n").alias("thread")

    if per_part is None:
        return lines.groupBy("finding_id").agg(F.count("*").alias("comments"), joined("event_ts", "id"))
    numbered = ranked(lines, ["finding_id"], ["event_ts", "id"])
    return (numbered.groupBy("finding_id", F.floor((F.col("seq") - 1) / per_part).alias("part"))
            .agg(F.count("*").alias("comments"), joined("seq")))


# --- enrichment --------------------------------------------------------------

def known_vulnerabilities(spark) -> DataFrame:
    """The three local vulnerability records, as a frame whose size the planner knows."""
    def literal(value) -> Column:
        return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)

    records = F.array(*[F.struct(*[literal(v).alias(k) for k, v in r.items()]) for r in catalog.KNOWN_VULNERABILITIES])
    return spark.range(1).select(F.inline(records))


def cve_details(ids: DataFrame, records: DataFrame) -> DataFrame:
    """One detail row per id; ids without a record get the fallback record.

    `records` has (cve_id, descriptions, scores, vectors, published, last_modified,
    severities, references); first entries count, three references at most.
    """
    fallback = catalog.CVE_FALLBACK

    def first(column: str, kind: str, default) -> Column:
        return F.coalesce(F.try_element_at(F.col(column), F.lit(1)).cast(kind), F.lit(default).cast(kind))

    def day(column: str) -> Column:
        return F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit(""))

    known = {
        "description": first("descriptions", "string", "No description available"),
        "cvss_score": first("scores", "double", 0.0),
        "cvss_vector": first("vectors", "string", ""),
        "published_date": day("published"),
        "last_modified": day("modified"),
        "severity": first("severities", "string", "UNKNOWN"),
        "references": F.coalesce(F.slice("refs", 1, 3), F.array().cast("array<string>")),
    }
    renamed = (records.withColumnRenamed("last_modified", "modified").withColumnRenamed("references", "refs")
               .withColumn("found", F.lit(True)))
    missing = {**{k: F.lit(v) for k, v in fallback.items() if k != "reference_prefix"},
               "references": F.array(F.concat(F.lit(fallback["reference_prefix"]), F.col("cve_id")))}
    joined = ids.select("cve_id").distinct().join(renamed, "cve_id", "left")
    return joined.select("cve_id", *[
        F.when(F.col("found"), value).otherwise(missing[name]).alias(name) for name, value in known.items()])


def enrich_components(findings: DataFrame, vulnerabilities: DataFrame,
                      registry: DataFrame | None = None, details: DataFrame | None = None) -> DataFrame:
    """Findings with the vulnerability record of their component, if there is one.

    The latest version comes from `registry` (component, latest_version), else it is
    the fixed version. `details` are rows of `cve_details`.
    """
    table = vulnerabilities.select(
        "component", F.col("cve_id").alias("known_cve_id"), F.col("fixed_version").alias("known_fixed_version"),
        "impact", "exploit_maturity", "affected_versions", "usage_patterns")
    if registry is not None:
        table = table.join(registry.select("component", "latest_version"), "component", "left")
    else:
        table = table.withColumn("latest_version", F.lit(None).cast("string"))
    table = table.withColumn("latest_version", F.coalesce("latest_version", "known_fixed_version"))
    if details is not None:
        packed = details.select(F.col("cve_id").alias("known_cve_id"),
                                F.struct(*details.columns).alias("cve_details"))
        table = table.join(packed, "known_cve_id", "left")
    # Findings without a component match nothing; they stay out of the join, where they would be one key.
    joined = findings.where(F.col("component").isNotNull()).join(table, "component", "left")
    rest = findings.where(F.col("component").isNull())
    missing = {f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields if f.name != "component"}
    return joined.unionByName(rest.withColumns(missing))


def dependency_chain_nodes(findings: DataFrame) -> DataFrame:
    """One row per node of a dependency chain, with its place and the vulnerable flag."""
    nodes = F.split("dependency_chain", " → ")
    return (
        findings.where(tx.present(F.col("dependency_chain")))
        .select("id", "component", F.size(nodes).alias("depth"), F.posexplode(nodes).alias("position", "raw"))
        .select("id", "position", F.trim("raw").alias("node"), "depth",
                (F.col("depth") == 2).alias("direct"),
                F.coalesce(F.trim("raw") == F.col("component"), F.lit(False)).alias("vulnerable"))
    )


def dependency_edges(findings: DataFrame) -> DataFrame:
    """Distinct (parent, child) of neighbouring nodes in all dependency chains; a node is no child of its own."""
    nodes = F.transform(F.split("dependency_chain", " → "), lambda node: F.trim(node))
    pairs = F.transform(F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))),
                        lambda child, i: F.struct(F.get(nodes, i).alias("parent"), child.alias("child")))
    return (
        findings.where(tx.present(F.col("dependency_chain"))).select(F.explode(pairs).alias("e")).select("e.*")
        .where(tx.present(F.col("parent")) & tx.present(F.col("child")) & (F.col("parent") != F.col("child"))).distinct()
    )


def component_reach(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Everything that depends on some components, over any number of chains: (component, dependent, depth).

    `depth` is the length of the shortest way; a component is at depth 0 of itself. One
    step per round is joined to what the round before found anew, so cycles end and no
    way is walked twice; each round is materialised, and only its new pairs meet the edges.
    """
    edges = cut(edges.select(F.col("child").alias("_at"), F.col("parent").alias("_next")))
    new = cut(components.select("component").where(tx.present(F.col("component"))).distinct()
              .select("component", F.col("component").alias("dependent"), F.lit(0).alias("depth")))
    rounds = [new]
    while not new.isEmpty():
        known = reduce(DataFrame.unionAll, [r.select("component", "dependent") for r in rounds])
        step = (new.join(edges, F.col("dependent") == F.col("_at"))
                .select("component", F.col("_next").alias("dependent"), (F.col("depth") + 1).alias("depth")).distinct())
        new = cut(step.join(known, ["component", "dependent"], "left_anti").select("component", "dependent", "depth"))
        rounds.append(new)
    return reduce(DataFrame.unionAll, rounds)


def json_array_rows(findings: DataFrame, column: str, out: str) -> DataFrame:
    """One row per entry of a JSON array kept as text."""
    return findings.select("id", F.posexplode(F.from_json(column, "array<string>")).alias("position", out))


def scan_progress(scans: DataFrame, updates: DataFrame) -> DataFrame:
    """Scans with the latest counters given by progress updates (scan_id, id, ...)."""
    latest = updates.groupBy(F.col("scan_id").alias("id")).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"new_{c}")
        for c in ("total_files", "scanned_files")])
    joined = scans.join(latest, "id", "left")
    for c in ("total_files", "scanned_files"):
        before = F.col(c) if c in scans.columns else F.lit(0).cast("bigint")
        joined = joined.withColumn(c, F.coalesce(F.col(f"new_{c}"), before)).drop(f"new_{c}")
    percent = F.round(F.col("scanned_files") * 100 / F.col("total_files"), 1)
    return joined.withColumn("percent", F.when(F.col("total_files") > 0, percent).otherwise(F.lit(0.0)))
