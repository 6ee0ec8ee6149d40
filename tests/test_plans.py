"""Physical plans of the registered queries at the smallest scale."""

import re

import pytest

import __spark_entry__ as registered
from leakloom.plans import fixtures as fx, registry

SF = "/root/testdata/sf0.001"
FILE_IO = ("source_tree_scan", "listed_tree_scan", "stream_scan", "stream_upsert", "stream_daily_activity", "append_findings", "append_comparison",
           "append_scan_record", "scan_run", "findings_export", "finding_history_export", "application_history_export")
PLANNED = sorted(set(registry.QUERIES) - set(FILE_IO))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_python_and_no_pairwise_joins(spark, name):
    text = plan(registered.queries()[name](spark, SF))
    for banned in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert banned not in text, banned


@pytest.mark.parametrize("name", ["recent_scans", "get_findings", "top_vulnerable_apps", "application_history", "top_findings"])
def test_limits_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(registered.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["secret_scan", "secret_findings_all", "file_lines", "entropy_candidates"])
def test_scanning_is_one_narrow_pass(spark, name):
    text = plan(registered.queries()[name](spark, SF))
    assert text.count("Exchange") <= 1 and "Window" not in text  # the one exchange spreads the single row group


def test_findings_view_prunes_columns(spark):
    text = plan(fx.view(spark, SF, "findings").groupBy("severity").count())
    assert "l_extendedprice" not in text and "l_comment" not in text and re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber", text)


def test_small_scans_get_spread_and_large_ones_do_not(spark):
    from leakloom.session import spread

    assert spread(fx.table(spark, SF, "documents")).rdd.getNumPartitions() == 4
    wide = spark.range(0, 100, 1, 9)
    assert spread(wide).rdd.getNumPartitions() == 9
