import datetime as dt
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from leakloom.operators import lifecycle as life
from leakloom.schemas import conform, table_schema

FINDING = "id long, scan_id long, app_name string, finding_type string, file_path string, line_number long, " \
          "cve_id string, component string, title string, code_snippet string, severity string, is_false_positive boolean"
PATTERN = "app_name string, pattern_type string, pattern_value string"
NOW = dt.datetime(2024, 5, 1)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def finding(id, app="a", path="/x/y.js", line=1, component="c", title="t", snippet="s", scan=1, fp=False, cve=None):
    return (id, scan, app, "secret", path, line, cve, component, title, snippet, "high", fp)


def findings(spark, rows):
    return life.with_hash(spark.createDataFrame(rows, FINDING))


def patterns(spark, *rows):
    return spark.createDataFrame(list(rows), PATTERN)


def test_hash_treats_null_as_empty(spark):
    row = findings(spark, [finding(1, line=None, component=None)]).first()
    assert row.finding_hash == hashlib.md5("a|secret|/x/y.js|0|||t".encode()).hexdigest()


PATTERN_CASES = [
    [("a", "file_path", "/x/")], [("b", "file_path", "/x/")], [(None, "file_path", "/x/y.js")], [(None, "file_path", "/X/")],
    [("a", "component", "lib")], [(None, "component", "li")], [("a", "code_pattern", "key")], [("a", "code_pattern", "KEY")],
    [(None, "code_pattern", "keykey")], [("a", "file_path", ""), (None, "component", None), ("a", "code_pattern", "")],
    [("a", "file_path", "/x/"), (None, "component", "other"), ("b", "code_pattern", "my key")],
    [("a", "unknown", "/x/")], [],
]
SUBJECTS = [
    finding(1, app="a", path="/x/y.js", component="lib", snippet="my key"),
    finding(2, app="b", path="/x/y.js", component="other", snippet="my key"),
    finding(3, app="b", path="/z", component=None, snippet=None),
    finding(4, app="a", path=None, component="lib", snippet="keykey"),
    finding(5, app=None, path="/x/y.js", component="lib", snippet="k"),
]


def expected_suppressed(rules):
    found = set()
    for s in SUBJECTS:
        for app, kind, value in rules:
            if not value or not (app is None or app == s[2]):
                continue
            if (kind == "file_path" and (s[4] or "").startswith(value)) or (kind == "component" and s[7] == value) \
                    or (kind == "code_pattern" and value in (s[9] or "")):
                found.add(s[0])
    return found


@pytest.mark.parametrize("rules", PATTERN_CASES)
def test_suppression(spark, rules):
    frame = findings(spark, SUBJECTS)
    kept = life.suppress_false_positives(frame, patterns(spark, *rules))
    assert {r.id for r in kept.collect()} == {s[0] for s in SUBJECTS} - expected_suppressed(rules)
    flagged = life.flag_suppressed(frame, patterns(spark, *rules))
    assert {r.id for r in flagged.collect() if r.suppressed} == expected_suppressed(rules)


def test_a_long_snippet_against_many_pattern_lengths(spark):
    """Pieces have a few class lengths, so a hundred pattern lengths cost little more than one."""
    text = "".join(chr(97 + i * i % 23) for i in range(10_000))
    frame = findings(spark, SUBJECTS[:1]).withColumn("code_snippet", F.lit(text))
    rules = [(None, "code_pattern", "z" * n) for n in range(1, 100)] + [(None, "code_pattern", text[4321:4421])]
    pieces = life._pieces(frame.select("app_name", F.lit("k").alias("key"), F.lit(text).alias("text")),
                          life._pattern_keys(patterns(spark, *rules), "code_pattern"), anywhere=True)
    assert pieces.count() <= 7 * len(text)
    assert life.suppress_false_positives(frame, patterns(spark, *rules)).count() == 0


def test_suppression_plans_without_a_job(spark):
    frame, rules = findings(spark, SUBJECTS), patterns(spark, *PATTERN_CASES[-1])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        life.suppress_false_positives(frame, rules)
        life.flag_suppressed(frame, rules)
        assert tracker.getJobIdsForGroup("planning") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def snapshot(spark, rows=()):
    """Stored rows from (finding, status, fp, count) tuples."""
    if not rows:
        return spark.createDataFrame([], table_schema("findings"))
    frame = findings(spark, [r[0] for r in rows]).drop("is_false_positive")
    extra = spark.createDataFrame([(r[0][0], r[1], r[2], r[3]) for r in rows],
                                  "id long, status string, is_false_positive boolean, occurrence_count long")
    return conform(frame.join(extra, "id"), "findings")


def sequential(stored, batch, suppressed):
    """The row-at-a-time meaning of the upsert."""
    state = {k: dict(v) for k, v in stored.items()}
    for key, id, hidden in batch:
        if key in state:
            if not state[key]["fp"]:
                state[key]["count"] += 1
        elif not hidden:
            state[key] = {"fp": False, "count": 1, "id": id}
    return {k: (v["id"], v["count"], v["fp"]) for k, v in state.items()}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("pqrs"), st.booleans()), min_size=1, max_size=14),
       st.dictionaries(st.sampled_from("pqrs"), st.booleans(), max_size=3))
def test_upsert_equals_sequential_application(spark, arrivals, known):
    stored_rows = [(finding(1000 + n, title=t), "open", fp, 5) for n, (t, fp) in enumerate(known.items())]
    batch_rows = [finding(n + 1, title=t, snippet="bad word" if hidden else "fine") for n, (t, hidden) in enumerate(arrivals)]
    merged = life.upsert_findings(
        snapshot(spark, stored_rows), findings(spark, batch_rows), patterns(spark, ("a", "code_pattern", "bad")), now())
    got = {r.title: (r.id, r.occurrence_count, r.is_false_positive) for r in merged.collect()}
    stored = {r[0][8]: {"fp": r[2], "count": 5, "id": r[0][0]} for r in stored_rows}
    assert got == sequential(stored, [(t, n + 1, hidden) for n, (t, hidden) in enumerate(arrivals)], None)


def test_upsert_dates_and_no_reopening(spark):
    stored = snapshot(spark, [(finding(7), "resolved", False, 1)])
    merged = life.upsert_findings(stored, findings(spark, [finding(1), finding(2, title="new")]), patterns(spark), now())
    rows = {r.id: r for r in merged.collect()}
    assert rows[7].status == "resolved" and rows[7].last_seen == NOW and rows[7].occurrence_count == 2
    assert rows[2].status == "open" and rows[2].first_detected == NOW and rows[2].scan_id == 1


def test_baseline_is_the_latest_completed_smaller_id(spark):
    rows = [(1, "a", "completed"), (2, "a", "failed"), (3, "a", "running"), (4, "b", "completed"), (5, "a", "completed"), (6, "a", "failed")]
    got = {r.current_scan_id: r.baseline_scan_id
           for r in life.baseline_scans(spark.createDataFrame(rows, "id long, app_name string, status string")).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None, 5: 1, 6: 5}


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "app_name string, current_scan_id long, baseline_scan_id long")


def test_comparison_numbers(spark):
    rows = [finding(1, title="old"), finding(2, title="both"), finding(3, title="both"), finding(4, title="fp", fp=True),
            finding(5, title="both", scan=2), finding(6, title="new", scan=2), finding(7, title="x", scan=2, fp=True)]
    got = life.compare_scans(findings(spark, rows), pairs(spark, ("a", 2, 1), ("a", 3, 1), ("a", 1, 9), ("a", 9, 8))).collect()
    result = {r.current_scan_id: (r.new_findings, r.resolved_findings, r.persistent_findings, r.false_positives, r.remediation_score) for r in got}
    assert result == {2: (1, 1, 1, 1, 50.0), 3: (0, 2, 0, 0, 100.0), 1: (2, 0, 0, 1, 0.0), 9: (0, 0, 0, 0, 100.0)}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.integers(0, 12)), st.sets(st.integers(0, 12)))
def test_comparison_identities(spark, current, baseline):
    rows = [finding(n, title=f"t{t}", scan=scan) for n, (scan, t) in
            enumerate([(1, t) for t in baseline] + [(2, t) for t in current])] or [finding(0, scan=5)]
    row = life.compare_scans(findings(spark, rows), pairs(spark, ("a", 2, 1))).first()
    assert row.new_findings + row.persistent_findings == len(current)
    assert row.resolved_findings + row.persistent_findings == len(baseline)
    assert 0 <= row.remediation_score <= 100


def test_comparison_leaves_out_unknown_flags(spark):
    rows = findings(spark, [finding(1, fp=None), finding(2, line=2), finding(3, line=3, fp=True)])
    assert life.scan_hashes(rows).count() == 1


def test_status_fold_keeps_resolution_date(spark):
    day = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    changes = spark.createDataFrame(
        [(1, 1, "resolved", day[0]), (2, 1, "open", day[1]), (3, 2, "ignored", day[2])],
        "id long, finding_id long, status string, changed_at timestamp_ntz")
    frame = spark.createDataFrame([(1, "open"), (2, "open"), (3, "open")], "id long, status string")
    rows = {r.id: r for r in life.current_status(frame, changes).collect()}
    assert (rows[1].status, rows[1].resolution_date) == ("open", day[0])
    assert (rows[2].status, rows[2].resolution_date) == ("ignored", None)
    assert (rows[3].status, rows[3].updated_at) == ("open", None)


def test_false_positive_mark(spark):
    marks = spark.createDataFrame([(1, 1, "noise", "ann", NOW, True), (2, 3, "x", "bob", NOW, False)],
                                  "id long, finding_id long, reason string, analyst string, marked_at timestamp_ntz, create_pattern boolean")
    frame = findings(spark, [finding(1), finding(2), finding(3, component="")]).withColumn("status", F.lit("open"))
    row = life.apply_false_positives(frame, marks).where("id = 1").first()
    assert (row.is_false_positive, row.status, row.analyst_comment) == (True, "ignored", "Marked as false positive by ann")
    derived = {(r.pattern_type, r.pattern_value) for r in life.derive_fp_patterns(marks, frame).collect()}
    assert derived == {("file_path", "/x/y.js"), ("component", "c")}


def test_comment_threads_come_in_parts(spark):
    rows = [(n, 1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n), f"c{n}") for n in range(25)] + [(99, 2, NOW, None)]
    frame = spark.createDataFrame(rows, "id long, finding_id long, event_ts timestamp_ntz, details string").repartition(5)
    got = {(r.finding_id, r.part): r.thread for r in life.comment_threads(frame, per_part=10).collect()}
    assert (2, 0) not in got
    assert "\n".join(got[(1, p)] for p in range(3)) == "\n".join(f"c{n}" for n in range(25))


def test_blank_and_stored_comments(spark):
    at = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    data = [(1, 1, at[0], ""), (2, 1, at[1], "a"), (3, 1, at[2], ""), (4, 1, at[3], "\nb"), (5, 2, at[0], ""), (6, 2, at[1], "x")]
    frame = spark.createDataFrame(data, "id long, finding_id long, event_ts timestamp_ntz, details string")
    stored = spark.createDataFrame([(1, ""), (2, "old"), (3, "kept")], "id long, analyst_comment string")
    got = {r.finding_id: r.thread for r in life.comment_threads(frame, stored).collect()}
    assert got == {1: "a\n\n\nb", 2: "old\n\nx", 3: "kept"}


def test_enrichment(spark):
    known = life.known_vulnerabilities(spark)
    frame = spark.createDataFrame([(1, "lodash"), (2, "moment"), (3, None)], "id long, component string")
    records = spark.createDataFrame([], "cve_id string, descriptions array<string>, scores array<double>, vectors array<string>, "
                                        "published timestamp_ntz, last_modified timestamp_ntz, severities array<string>, references array<string>")
    details = life.cve_details(known.select("cve_id"), records)
    rows = {r.id: r for r in life.enrich_components(frame, known, details=details).collect()}
    assert rows[1].latest_version == "4.17.21" and rows[1].cve_details.severity == "HIGH"
    assert rows[1].cve_details.references == ["https://nvd.nist.gov/vuln/detail/CVE-2021-23337"]
    assert rows[2].known_cve_id is None and rows[3].cve_details is None


def test_dependency_chain(spark):
    frame = spark.createDataFrame([(1, "lodash", "app → express → lodash"), (2, "x", ""), (3, "axios", "app → axios")],
                                  "id long, component string, dependency_chain string")
    rows = [tuple(r) for r in life.dependency_chain_nodes(frame).orderBy("id", "position").collect()]
    assert rows == [(1, 0, "app", 3, False, False), (1, 1, "express", 3, False, False), (1, 2, "lodash", 3, False, True),
                    (3, 0, "app", 2, True, False), (3, 1, "axios", 2, True, True)]


def test_json_arrays(spark):
    frame = spark.createDataFrame([(1, '["a:1","b:2"]'), (2, "[]"), (3, "oops"), (4, None)], "id long, usage_locations string")
    rows = life.json_array_rows(frame, "usage_locations", "location").collect()
    assert {tuple(r) for r in rows} == {(1, 0, "a:1"), (1, 1, "b:2")}


def test_progress(spark):
    scans = spark.createDataFrame([(1,), (2,)], "id long")
    updates = spark.createDataFrame([(1, 1, 10, None), (2, 1, None, 4), (3, 1, None, 5)],
                                    "id long, scan_id long, total_files long, scanned_files long")
    rows = {r.id: (r.total_files, r.scanned_files, r.percent) for r in life.scan_progress(scans, updates).collect()}
    assert rows == {1: (10, 5, 50.0), 2: (0, 0, 0.0)}


def test_a_minified_snippet_against_a_long_pattern(spark):
    """One and a half million characters; patterns inside it, across the border of a stretch, and not in it."""
    text = "".join(chr(97 + (i * i + i // 7) % 23) for i in range(1_500_000))
    subjects = findings(spark, [finding(1), finding(2)]).withColumn(
        "code_snippet", F.when(F.col("id") == 1, F.lit(text)).otherwise(F.lit(text[:900])))
    border = life.STRETCH
    for value in (text[700_000:701_101], text[border - 600:border + 600], text[3:8], "A" * 1101):
        gone = {i for i, own in ((1, text), (2, text[:900])) if value in own}
        kept = life.suppress_false_positives(subjects, patterns(spark, (None, "code_pattern", value), (None, "code_pattern", "Z" * 1101)))
        assert {r.id for r in kept.select("id").collect()} == {1, 2} - gone


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(life, "FILTER_WORDS", 1)
    rules = [("a", "code_pattern", f"other {i} pattern") for i in range(300)] + [("a", "code_pattern", "my k"), (None, "file_path", "/z")]
    kept = life.suppress_false_positives(findings(spark, SUBJECTS), patterns(spark, *rules))
    assert {r.id for r in kept.collect()} == {s[0] for s in SUBJECTS} - expected_suppressed(rules)


def test_suppression_reads_the_findings_twice_at_most(spark, tmp_path):
    findings(spark, SUBJECTS).write.parquet(f"{tmp_path}/findings")
    stored = spark.read.parquet(f"{tmp_path}/findings")
    for found in (life.suppress_false_positives(stored, patterns(spark, *PATTERN_CASES[-2])), life.flag_suppressed(stored, patterns(spark, *PATTERN_CASES[0]))):
        assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2


def test_reach_over_cycles_and_shortest_ways(spark):
    chains = spark.createDataFrame([(1, "app → a → b → c"), (2, "b → d → a"), (3, "app → c"), (4, " x → x → c"), (5, ""), (6, None), (7, "lone")],
                                   "id long, dependency_chain string")
    edges = life.dependency_edges(chains)
    assert {tuple(r) for r in edges.collect()} == {("app", "a"), ("a", "b"), ("b", "c"), ("b", "d"), ("d", "a"), ("app", "c"), ("x", "c")}
    starts = spark.createDataFrame([("c",), ("a",), ("c",), (None,), ("nowhere",)], "component string")
    got = {(r.component, r.dependent): r.depth for r in life.component_reach(edges, starts).collect()}
    assert got == {("c", "c"): 0, ("c", "b"): 1, ("c", "app"): 1, ("c", "x"): 1, ("c", "a"): 2, ("c", "d"): 3,
                   ("a", "a"): 0, ("a", "app"): 1, ("a", "d"): 1, ("a", "b"): 2, ("nowhere", "nowhere"): 0}
