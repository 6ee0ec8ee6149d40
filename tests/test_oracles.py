"""Every registered query against its SQL twin, over whole tables of the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registered
from leakloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else repr(value)


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_twin_agrees(spark, duck, name):
    frame = registered.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.sql(registered.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())


def test_entry(spark):
    frame = registered.entry(spark)
    assert frame.columns == ["app_name", "severity", "findings"] and frame.count() > 0


def test_persistent_hashes_are_of_scans_that_grow(spark, duck):
    duck.execute("CREATE TABLE doubled AS SELECT l.* REPLACE (l_orderkey + r * 60000 AS l_orderkey) FROM lineitem l, range(2) t(r)")
    twin = registered.oracle_sql()["persistent_finding_hashes"]
    compared = "SELECT count(*) FROM h WHERE scan_id IN (25, 45)"
    held = [duck.sql(twin[:twin.index("SELECT finding_hash FROM h")].replace("FROM lineitem", f"FROM {t}") + compared).fetchall()[0][0]
            for t in ("lineitem", "doubled")]
    assert held[1] == 2 * held[0] > 0


def test_persistent_hashes_are_of_all_findings_of_both_scans(spark, tmp_path):
    seen = [(25, 1), (45, 1), (425, None), (445, None), (65 + 400, 2), (750, 1), (1350, 1), (400 * 30 + 779, 1), (400 * 30 + 1379, 1)]
    part = {1: (25, 45), 2: (425, 445), 3: (750, 1350), 4: (12779, 13379)}  # by order; by order, no line; by block; by a later block
    values = [(o, n, next((p for p, orders in part.items() if o in orders), 5), 1, 1.0, "A", "2024-01-01") for o, n in seen]
    frame = spark.createDataFrame(values, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate string")
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r[0] for r in registered.queries()["persistent_finding_hashes"](spark, str(tmp_path)).collect()]
    own = duckdb.connect()
    own.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert len(got) == 4 and set(got) == {r[0] for r in own.sql(registered.oracle_sql()["persistent_finding_hashes"]).fetchall()}
