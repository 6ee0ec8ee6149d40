import json

import pytest
from pyspark.sql import functions as F

from leakloom.operators import onboarding
from leakloom.sources import inventory

FIELDS = "name string, repo_type string, repo_url string, local_path string, team string, owner string, criticality string, " \
         "auto_scan boolean, position int"


def requests(spark, *rows):
    full = [(n, t, u, p, None, None, None, True, i) for i, (n, t, u, p) in enumerate(rows)]
    return spark.createDataFrame(full, FIELDS)


def known(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


GH = "https://github.com/o/r.git"


@pytest.mark.parametrize("row, error", [
    (("a", "github", GH, None), None),
    (("", "github", GH, None), "Application name is required"),
    (("a", "Local", None, ""), "Local path is required for local repositories"),
    (("a", "local", None, "/x"), None),
    (("a", "github", "", None), "Repository URL is required for remote repositories"),
    (("a", "svn", "u", None), "Repository validation failed: Unsupported repository type: svn"),
    (("a", "", "u", None), "Repository validation failed: Unsupported repository type: "),
    (("a", "GitHub", "https://example.org/o/r", None), "Repository validation failed: Not a valid GitHub URL"),
    (("a", "github", "git@github.com:o/r.git", None), "Repository validation failed: Not a valid GitHub URL"),
    (("a", "github", "https://github.com/o", None), "Repository validation failed: Invalid GitHub repository path"),
    (("a", "github", "https://user:pw@github.com:443/o/r/?x=1#y", None), None),
    (("a", "gitlab", "https://gitlab.corp/x", None), None),
    (("a", "gitlab", "https://corp/gitlab/x", None), "Repository validation failed: Not a valid GitLab URL"),
    (("a", "bitbucket", "anything", None), None),
])
def test_rules(spark, row, error):
    got = onboarding.validate(requests(spark, row)).first()
    assert (got.field_error or got.repository_error) == error


def test_url_parts(spark):
    row = onboarding.parse_repo_url(requests(spark, ("a", "github", "https://github.com/own/rep.git/", None))).first()
    assert (row.host, row.repo_owner, row.repo_name, row.url_error) == ("github.com", "own", "rep", None)


def test_bulk_result_keeps_the_last_message(spark):
    rows = requests(
        spark, ("ok", "github", GH, None), ("dup", "github", GH, None), ("dup", "github", GH, None), ("late", "svn", "u", None),
        ("late", "github", GH, None), ("old", "github", GH, None), ("gone", "github", GH, None), ("gone", "github", "", None),
        ("dupbad", "github", GH, None), ("dupbad", "svn", "u", None))
    result = {r.name: r.result for r in onboarding.bulk_result(rows, known(spark, "old")).collect()}
    assert result == {
        "ok": "Success", "dup": "Failed: Application 'dup' already exists", "late": "Success",
        "old": "Failed: Application 'old' already exists", "gone": "Failed: Repository URL is required for remote repositories",
        "dupbad": "Failed: Application 'dupbad' already exists"}
    accepted = onboarding.accepted_applications(rows, known(spark, "old"), F.current_timestamp())
    assert sorted(r.name for r in accepted.collect()) == ["dup", "dupbad", "gone", "late", "ok"]
    assert {r.criticality for r in accepted.collect()} == {"medium"}


def test_csv(spark, tmp_path):
    path = tmp_path / "apps.csv"
    path.write_text('name,repo_type,repo_url,team,auto_scan\n a ,github, u ,,TRUE\n,github,x,,true\nb,,v,"q, ""z""",no\nc\n')
    rows = [r.asDict() for r in inventory.load_inventory(spark, str(path)).orderBy("position").collect()]
    assert [(r["name"], r["repo_type"], r["repo_url"], r["team"], r["criticality"], r["auto_scan"]) for r in rows] == [
        ("a", "github", "u", None, "medium", True), ("b", "", "v", 'q, "z"', "medium", False), ("c", "", None, None, "medium", False)]


def test_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "apps.csv"
    path.write_text('name,team\na,"two\nlines"\n')
    assert inventory.read_csv(spark, str(path), multi_line=True).first().team == "two\nlines"


def test_json(spark, tmp_path):
    path = tmp_path / "apps.json"
    path.write_text(json.dumps({"applications": [{"name": " a ", "team": " t "}, {"name": ""}, {"name": "b", "repo_type": "local", "auto_scan": False}]}, indent=1))
    rows = inventory.load_inventory(spark, str(path)).orderBy("position").collect()
    assert [(r.name, r.repo_type, r.team, r.criticality, r.auto_scan) for r in rows] == [
        ("a", "github", " t ", "medium", True), ("b", "local", None, "medium", False)]


def test_other_formats_are_refused(spark):
    with pytest.raises(ValueError):
        inventory.load_inventory(spark, "apps.xml")


def test_order_of_requests_over_many_splits(spark, tmp_path):
    """The first row of a name wins wherever the splits of the file fall."""
    path = tmp_path / "many.csv"
    lines = [f"n{i % 50},github,https://github.com/o/r{i}," for i in range(5000)]
    path.write_text("name,repo_type,repo_url,local_path\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = onboarding.accepted_applications(inventory.read_csv(spark, str(path)), known(spark), F.current_timestamp()).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.name: r.repo_url for r in got} == {f"n{i}": f"https://github.com/o/r{i}" for i in range(50)}
