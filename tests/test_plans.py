"""What the registered queries over templates run, step by step."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def executed(spark) -> dict[int, str]:
    """The plan of every step that was run in this session, as it was at its end."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(k).executionId(): found.apply(k).physicalPlanDescription() for k in range(found.size())}


@pytest.mark.parametrize(
    "name", ["o33_frequent_templates", "o34_match", "o35_labelled_rows", "o39_apply_labels", "o46_line_refs", "o49_unmatched", "o50_summary", "o52_unmatched_errors"]
)
def test_no_step_of_a_query_sorts_the_tokens_of_its_lines(spark, name):
    """A task that sorts tokens to group them holds memory by its lines; hash tables hold it by the groups. Steps that take
    lines apart have a Generate; others group templates."""
    before = executed(spark)
    __spark_entry__.queries()[name](spark, SF).collect()
    plans = [plan for k, plan in executed(spark).items() if k not in before and "Generate" in plan and "Aggregate" in plan]
    assert plans and not any("SortAggregate" in plan for plan in plans)
