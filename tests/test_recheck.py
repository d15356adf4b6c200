"""The rules are run once where their verdicts are compared."""

from rulespan.plans import q_checks
from rulespan.plans.testbed import Testbed


def test_a_recheck_runs_the_rules_once(spark):
    out = q_checks.recheck_agreement(Testbed(spark, "/root/testdata/sf0.001"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "LogicalRDD" in plan
    row = out.first()
    assert row.row_count == row.failed_count_agree and row.strict_pass_agree < row.row_count
