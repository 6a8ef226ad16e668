"""Plan checks over all registered queries."""

import pytest

from quire import plans

STREAMS = {"j11_stream_job_state", "j12_stream_expiry", "j13_stream_inbox"}
WRITES = {"s3_scan_delimited", "s8_write_documents", "s8_one_text_per_document"}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - STREAMS - WRITES))
def test_no_cross_join(spark, sf_dir, name):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan.replace("BatchEvalPythonUDTF", "")
