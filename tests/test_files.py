import hashlib

import pytest
from pyspark.sql import functions as F

from leakloom import catalog
from leakloom.functions import text as tx
from leakloom.operators import detect
from leakloom.sources import files as src
from leakloom.sources.patterns import load_patterns

SECRET = "ghp_" + "a" * 36


@pytest.fixture()
def tree(tmp_path):
    contents = {
        "app1/src/a.py": f"x\n{SECRET}\n".encode(),
        "app1/src/__init__.py": f"{SECRET}".encode(),
        "app1/.github/flow.yml": b"a: 1\n",
        "app1/node_modules/b.js": SECRET.encode(),
        "app1/deep/er/UPPER.JSON": b"\xff\xfe{}\r\nsecond \xff" + SECRET.encode(),
        "app1/root.md": b"hello",
        "app1/pic.png": SECRET.encode(),
        "app1/.env": SECRET.encode(),
        "app2/big.txt": b"y" * (catalog.MAX_FILE_BYTES + 1),
        "app2/fits.txt": b"z" * 100,
        "app2/_hidden/c.sh": SECRET.encode(),
    }
    for name, data in contents.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_read_tree(spark, tree, prefix):
    rows = {(r.app_name, r.path): r for r in src.read_tree(spark, prefix + str(tree)).collect()}
    assert set(rows) == {("app1", "src/a.py"), ("app1", "node_modules/b.js"), ("app1", "deep/er/UPPER.JSON"),
                         ("app1", "root.md"), ("app2", "fits.txt")}
    assert rows[("app1", "deep/er/UPPER.JSON")].text == "{}\r\nsecond " + SECRET


def test_read_tree_pushes_the_size_limit(spark, tree):
    plan = src.read_tree(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10485760)" in plan


def test_scan_of_a_tree(spark, tree):
    found = detect.scan_secrets(detect.eligible_files(src.read_tree(spark, str(tree)))).collect()
    assert {(r.path, r.line_number, r.secret_hash) for r in found} == {
        ("src/a.py", 2, hashlib.sha256(SECRET.encode()).hexdigest()[:16]),
        ("deep/er/UPPER.JSON", 2, hashlib.sha256(SECRET.encode()).hexdigest()[:16])}


def test_listing_includes_hidden_names_and_follows_no_links(spark, tree):
    (tree / "app2" / "loop").symlink_to(tree / "app2", target_is_directory=True)
    apps = spark.createDataFrame([("app1", f"{tree}/app1"), ("app2", f"file:{tree}/app2"), ("none", f"{tree}/none"), ("blank", "")],
                                 "name string, local_path string")
    listed = src.list_tree(apps)
    assert {(r.app_name, r.path) for r in listed.collect()} == {
        ("app1", "src/a.py"), ("app1", "src/__init__.py"), ("app1", ".github/flow.yml"), ("app1", "deep/er/UPPER.JSON"),
        ("app1", "root.md"), ("app2", "fits.txt"), ("app2", "_hidden/c.sh")}
    texts = {r.path: r.text for r in src.read_listed(listed, batch_bytes=10).collect()}
    assert texts["src/__init__.py"] == SECRET and texts["deep/er/UPPER.JSON"] == "{}\r\nsecond " + SECRET
    assert len(texts) == 7


@pytest.mark.parametrize("data", [b"plain", b"a\xffb", "ä�x".encode(), b"\xf0\x9f\x98\x80\xf0\x9f", "﷐".encode(), b""])
def test_decoding_drops_bad_bytes(spark, data):
    frame = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert frame.select(tx.clean_utf8(F.col("content")).alias("t")).first().t == data.decode("utf-8", "ignore")


def test_genuine_replacement_character_survives_next_to_bad_bytes(spark):
    data = "a�b".encode() + b"\xff"
    frame = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert frame.select(tx.clean_utf8(F.col("content")).alias("t")).first().t == "a�b"


def test_pattern_file(tmp_path):
    pytest.importorskip("yaml")
    good = tmp_path / "good.yaml"
    good.write_text("patterns:\n  - name: Ticket\n    pattern: 'TCK-([0-9]{4})'\n  - name: B\n    pattern: 'b+'\n    severity: low\n    confidence: 0.5\n    type: custom\n")
    first, second = load_patterns(str(good))
    assert (first.severity, first.confidence, first.pattern_type, first.secret_group()) == ("medium", 0.8, "regex", 1)
    assert (second.severity, second.confidence, second.pattern_type, second.secret_group()) == ("low", 0.5, "custom", 0)
    bad = tmp_path / "bad.yaml"
    bad.write_text('patterns:\n  - name: X\n    pattern: "a\\sb"\n')
    assert load_patterns(str(bad)) == []
    assert load_patterns(str(tmp_path / "missing.yaml")) == []


@pytest.mark.parametrize("pattern, count", [(r"(?P<q>[\"']).{4}(?P=q)", 0), (r"(a)?(?(1)b|c)", 0), (r"TCK-(\d{4})\Z", 1)])
def test_patterns_must_compile_where_they_run(spark, tmp_path, pattern, count):
    pytest.importorskip("yaml")
    path = tmp_path / "own.yaml"
    path.write_text("patterns:\n  - name: Own\n    pattern: |-\n      " + pattern + "\n")
    assert len(load_patterns(str(path), spark)) == count
    assert load_patterns(str(tmp_path / "missing.yaml"), spark) == []


def test_files_beyond_the_limit_are_listable(spark, tree):
    assert [r.path.rpartition("/")[2] for r in src.oversized(spark, str(tree)).collect()] == ["big.txt"]
    assert "big.txt" in {r.path for r in src.read_tree(spark, str(tree), max_bytes=None).select("path").collect()}


def test_user_patterns_without_anchors(spark, tmp_path):
    pytest.importorskip("yaml")
    good = tmp_path / "good.yaml"
    good.write_text("patterns:\n  - name: Ticket\n    pattern: 'TCK-([0-9]{4})'\n")
    frame = spark.createDataFrame([("a", "x.py", "one tck-1234 two TCK-9999\nnothing")], "app_name string, path string, text string")
    found = detect.scan_secrets(frame, patterns=load_patterns(str(good)), entropy=False, keep_secret=True).collect()
    assert sorted(r.secret for r in found) == ["1234", "9999"]
