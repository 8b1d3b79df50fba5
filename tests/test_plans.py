"""Physical plans: what is read, what is shuffled, what never occurs."""

import re

import pytest

import __spark_entry__ as checks
from workload.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    name
    for name in QUERIES
    if not name.startswith(("src_", "sink_", "report_", "stream_", "two_step", "sort_", "set_union"))
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(checks.queries()[name](spark, sf_dir))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in text
    # One task sees only one-row totals, a limit that is asked for, or a rule table of checked size.
    small = ("agg_", "cost_", "set_cost", "tracker_", "flt_search_v2", "join_airline_rules")
    assert "SinglePartition" not in text or name.startswith(small)


def test_date_range_reaches_the_scan(spark, sf_dir):
    text = plan(checks.queries()["flt_date_range"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThan\(sent_at", text)
    assert re.search(r"ReadSchema: struct<seq:bigint,id:string,sent_at:timestamp_ntz>", text)


def test_history_reads_no_unused_column_and_runs_patterns_once(spark, sf_dir):
    text = plan(checks.queries()["history_v1"](spark, sf_dir))
    assert "ReadSchema: struct<seq:bigint,subject:string,sender:string,body:string>" in text
    assert not re.search(r"Filter [^\n]*regexp", text)


@pytest.mark.parametrize(("name", "unread"), [("ext_v2", "sent_at"), ("src_normalise_messages", "snippet")])
def test_unused_columns_are_not_read(spark, sf_dir, name, unread):
    text = plan(checks.queries()[name](spark, sf_dir).select("seq"))
    schemas = re.findall(r"ReadSchema: (\S+)", text)
    assert schemas and all(unread not in s for s in schemas)


def test_statistics_scan_once(spark, sf_dir):
    text = plan(checks.queries()["tracker_statistics_v2"](spark, sf_dir))
    assert text.count("FileScan") == 1


def test_bodies_do_not_enter_a_shuffle(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(checks.queries()["history_with_external"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = text[text.index("SortMergeJoin") :]
    assert "body" not in join.split("Exchange hashpartitioning")[0]
