"""A sample of registered queries beside their SQL twins on the smallest tables."""

from pathlib import Path

import pytest

from tests.compare import connect, difference

SMALL = "/root/testdata/sf0.001"
SAMPLE = (
    "key_normalise", "tax_withheld", "bracket_by_year", "content_dedup", "import_outcomes",
    "judged_changes", "contract_guarantees",
)

pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="tables not present")


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, name):
    import __spark_entry__ as entry

    assert difference(spark, connect(SMALL), entry.queries()[name], entry.oracle_sql()[name], SMALL) == ""


def test_every_query_is_accounted_for():
    import __spark_entry__ as entry

    from leaselake.plans.registry import queries

    assert set(queries()) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rendered_texts_are_not_broadcast(spark):
    """The texts of all contracts never meet on the driver, however small the planner takes them to be."""
    from leaselake.plans.registry import queries

    plan = queries()["clause_flags"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_identifiers_are_spelled_out_by_all_tasks(spark):
    """Orders move before anything is made of them, and the rows are those of one task."""
    from leaselake import synth

    spread, plain = synth.contracts(spark, SMALL), synth.render(synth.facts(spark, SMALL))
    plan = spread._jdf.queryExecution().executedPlan().toString()
    moved = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "hashpartitioning(o_orderkey" in moved
    assert spread.exceptAll(plain).isEmpty() and plain.count() == spread.count()
