"""Shape of the physical plans, with joins by shuffle as on large tables."""

import pytest

from leafmill.plans.catalog import QUERIES

NARROW = [
    "doc_profile", "page_profile", "html_to_text", "html_to_markdown", "paginate", "split_on_breaks",
    "detect_tables", "table_cells", "scan_metadata", "strip_metadata", "redact_find", "redact_apply",
    "strip_active_content", "structure_check", "blank_page_check", "repair_pages",
]


def final_plan(spark, small, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, small)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", NARROW)
def test_narrow_operators_do_not_shuffle(spark, small, name):
    plan = final_plan(spark, small, name)
    assert "Exchange" not in plan and plan.count("FileScan") == 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"file_inventory", "compact_dataset"}))
def test_no_python_and_no_loop_joins(spark, small, name):
    plan = final_plan(spark, small, name)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["redact_page_counts", "resource_catalog"])
def test_text_is_searched_once(spark, small, name):
    plan = final_plan(spark, small, name)
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_selection_reads_only_what_it_needs(spark, small):
    plan = final_plan(spark, small, "doc_profile")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = final_plan(spark, small, "detect_tables")
    assert "StringContains(text, | )" in plan


def test_summary_is_reduced_before_the_shuffle(spark, small):
    """First pages by a rank on its own and totals by partial sums; nothing reads the pages again."""
    plan = final_plan(spark, small, "active_content_summary")
    assert "FileScan" not in plan and plan.count("Scan ExistingRDD") == 2
    partial = plan[: plan.index("WindowGroupLimit") + 2000]
    assert "Partial" in partial and "partial_sum(_n" in plan


def test_ranges_meet_pages_by_their_block(spark, small):
    for name in ("split_by_ranges", "extract_pages", "delete_pages"):
        plan = final_plan(spark, small, name)
        assert "_block" in plan.split("SortMergeJoin")[1].split("]")[0]
