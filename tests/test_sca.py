import json

import pytest
from pyspark.sql import functions as F

from leakloom.operators import profile, sca
from leakloom.sources import reports as src


def reports(spark, *texts, app="a"):
    rows = [(app, "/d", t if isinstance(t, str) else json.dumps(t)) for t in texts]
    return spark.createDataFrame(rows, "app_name string, directory string, report string")


def test_npm_v7_via_items(spark):
    report = {"vulnerabilities": {
        "strings": {"severity": "high", "range": "<1", "via": ["x", "{not json}"]},
        "objects": {"severity": "CRITICAL", "via": [{"cve": ["C1", "C2"]}, {"cve": ["C3"]}]},
        "mixed": {"via": ["x", {"cve": "C4"}, {"title": "no id"}, {"cve": []}]},
        "bare": {},
    }}
    rows = {r.package_name: r for r in sca.normalize_npm_v7(reports(spark, report)).collect()}
    assert [rows[k].cve_id for k in ("strings", "objects", "mixed", "bare")] == ["N/A", "C1, C2, C3", "C4", "N/A"]
    assert [rows[k].cvss_score for k in ("strings", "objects", "mixed")] == [7.5, 9.0, 0.0]
    assert rows["objects"].severity == "CRITICAL" and rows["bare"].current_version == "unknown"
    assert rows["bare"].fixed_version == "See npm audit fix" and rows["bare"].file_path == "/d/package.json"


def test_npm_dispatch(spark):
    both = {"vulnerabilities": {}, "advisories": {"1": {"module_name": "m"}}}
    old = {"advisories": {"1": {"module_name": "m", "severity": "low", "cvss": {}}}}
    frame = reports(spark, both, old, {"other": 1})
    assert sca.normalize_npm_v7(frame).count() == 0
    rows = sca.normalize_npm_v6(frame).collect()
    assert [(r.package_name, r.cvss_score, r.description, r.remediation) for r in rows] == [
        ("m", 2.5, "Vulnerability in m", "Update m to a secure version")]


def test_safety_defaults(spark):
    rows = sca.normalize_safety(reports(spark, [{"package": "p", "vulnerability_id": "PYSEC"}, {"vulnerability_id": "cve-1"}, {"safe_version": "2"}])).collect()
    assert [(r.package_name, r.severity, r.fixed_version, r.remediation) for r in rows] == [
        ("p", "medium", "See advisory", "Update p to version latest"),
        ("unknown", "medium", "See advisory", "Update package to version latest"),
        ("unknown", "medium", "2", "Update package to version 2")]


def test_pip_audit_first_fix(spark):
    report = {"vulnerabilities": [{"package": "p", "fix_versions": ["2", "3"], "id": "CVE-1"}, {"fix_versions": []}]}
    rows = sca.normalize_pip_audit(reports(spark, report)).collect()
    assert [(r.fixed_version, r.severity, r.cve_id, r.cvss_score) for r in rows] == [
        ("2", "high", "CVE-1", 0.0), ("See advisory", "medium", "N/A", 0.0)]


def test_dependency_check(spark):
    report = {"dependencies": [{"fileName": "log4j-core-2.14.1.jar", "vulnerabilities": [{"name": "CVE-9", "severity": "HIGH", "cvssv3": {"baseScore": 10}}]},
                               {"fileName": "none.jar"}]}
    rows = sca.normalize_dependency_check(reports(spark, report)).collect()
    assert [(r.package_name, r.current_version, r.severity, r.cvss_score, r.file_path) for r in rows] == [
        ("log4j-core-2.14.1.jar", "2.14.1", "high", 10.0, "/d/pom.xml")]


@pytest.mark.parametrize("name, version", [("a-1.2.jar", "1.2"), ("a-1-beta2.jar", "1-beta2"), ("a.jar", "unknown"), ("x-y-3.war", "3"), ("", "unknown")])
def test_jar_version(spark, name, version):
    frame = spark.createDataFrame([(name,)], "n string")
    assert frame.select(sca.jar_version(frame.n)).first()[0] == version


def test_malformed_reports_are_set_aside(spark):
    frame = reports(spark, "{", "", "[]", "{}")
    assert sorted(r.report for r in src.rejects(frame).collect()) == ["", "{"]
    for normalize in (sca.normalize_npm_v7, sca.normalize_npm_v6, sca.normalize_safety, sca.normalize_pip_audit, sca.normalize_dependency_check):
        assert normalize(frame).count() == 0


def test_repeated_keys_and_entries_that_are_no_objects(spark):
    npm = reports(spark, '{"vulnerabilities":{"p":{"severity":"low"}},"vulnerabilities":{"q":{"severity":"low","severity":"high"},"r":"x",'
                         '"s":[1],"t":null,"u":3,"q":{"severity":"critical"},"v":{"range":"a","range":"b"}}}')
    rows = {r.package_name: (r.severity, r.current_version) for r in sca.normalize_npm_v7(npm).collect()}
    assert rows == {"q": ("critical", "unknown"), "v": ("unknown", "b")}
    assert sorted(r.text for r in src.entry_rejects(npm, "npm").collect() if r.text) == ["3", "[1]", "x"]
    lists = reports(spark, [["pkg", "<1", "1.0", "adv", "123"], {"package": "p"}, "x", None])
    assert [r.package_name for r in sca.normalize_safety(lists).collect()] == ["p"]
    assert src.entry_rejects(lists, "safety").count() == 3
    audit = reports(spark, {"vulnerabilities": {"p": "x"}}, {"vulnerabilities": ["x", {"id": "CVE-1"}]})
    assert [r.cve_id for r in sca.normalize_pip_audit(audit).collect()] == ["CVE-1"]
    check = reports(spark, {"dependencies": ["x", {"fileName": "a", "vulnerabilities": ["y", {"name": "C"}]}, {"vulnerabilities": "z"}]})
    assert [(r.package_name, r.cve_id) for r in sca.normalize_dependency_check(check).collect()] == [("a", "C")]


def test_one_parse_gives_both_npm_versions(spark):
    frame = reports(spark, {"vulnerabilities": {"p": {"severity": "high"}}}, {"advisories": {"1": {"module_name": "m", "cvss": {"score": "4.5"}}}})
    both = sorted(map(tuple, sca.normalize_npm(frame).collect()))
    assert both == sorted(map(tuple, sca.normalize_npm_v7(frame).union(sca.normalize_npm_v6(frame)).collect()))
    assert {r[8] for r in both} == {7.5, 4.5}


def test_a_report_beyond_128_megabytes(spark):
    """Made where it is read: 600 entries of 240 kB each."""
    text = F.concat(F.lit('{"dependencies":[{"fileName":"a.jar","vulnerabilities":['), F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(600)), lambda i: F.concat(F.lit('{"name":"CVE-'), i.cast("string"), F.lit('","description":"'),
                                                             F.repeat(F.lit("d"), 240_000), F.lit('"}'))), ","), F.lit("]}]}"))
    frame = spark.range(1).select(F.lit("a").alias("app_name"), F.lit("/d").alias("directory"), text.alias("report"))
    assert frame.select(F.length("report")).first()[0] > 128 * 2**20
    assert sca.normalize_dependency_check(frame).select("cve_id").distinct().count() == 600


def test_safety_is_preferred_per_application(spark):
    safety = reports(spark, [], app="a")
    audit = reports(spark, {"vulnerabilities": [{"package": "x"}]}, app="a").unionAll(reports(spark, {"vulnerabilities": [{"package": "y"}]}, app="b"))
    empty = reports(spark, "{}").limit(0)
    assert [r.package_name for r in sca.normalize_all(empty, safety, audit, empty).collect()] == ["y"]


def project(spark, *paths):
    return spark.createDataFrame([("p", x) for x in paths], "app_name string, path string")


@pytest.mark.parametrize("paths, language, framework", [
    (("a.py", "b.js"), "python", "unknown"),
    (("a.js", "package.json"), "javascript", "react"),
    (("node_modules/package.json", "x/main.GO"), "go", "unknown"),
    (("package.json", "angular.json"), "javascript", "angular"),
    (("src/myapp.py", "requirements.txt"), "python", "flask"),
    (("src/App.js",), "javascript", "express"),
    (("pom.xml", "Gemfile"), "java", "spring"),
    (("readme.txt",), "unknown", "unknown"),
    (("venv/a.py", "k.rs"), "rust", "unknown"),
])
def test_profile(spark, paths, language, framework):
    row = profile.language_and_framework(project(spark, *paths)).first()
    assert (row.language, row.framework) == (language, framework)


def test_managers_look_at_the_root_only(spark):
    frame = project(spark, "package.json", "sub/pom.xml", "build.gradle", "setup.py", "Pipfile")
    assert sorted(r.package_manager for r in profile.package_managers(frame).collect()) == ["gradle", "npm", "pip"]
    assert sorted(r.package_manager for r in profile.package_managers(frame, only_scanned=True).collect()) == ["npm", "pip"]
    assert profile.requirements_file(frame).first().requirements_file == "Pipfile"
    assert profile.requirements_file(project(spark, "x")).first().requirements_file == "requirements.txt"
