"""Judge progress per model: one aggregate over answers and verdicts."""

from benchspark.operators import campaign


def test_judge_meta_counts_without_joining_verdicts(spark):
    rows = spark.createDataFrame(
        [("1", "a"), ("1", "a"), ("2", "a"), ("1", "b"), ("3", "b"), (None, "b")], "sample_uid string, model_key string"
    )
    verdicts = spark.createDataFrame(
        [("1", "a", "bad"), ("1", "a", ""), ("1", "a", "bad"), ("3", "b", None), ("9", "a", "bad"), (None, "b", "bad"), ("2", None, "bad")],
        "sample_uid string, model_key string, error string",
    )
    meta = campaign.judge_meta(rows, verdicts)
    got = {r.model_key: (r.skipped_existing, r.judged_new, r.errors) for r in meta.collect()}
    assert got == {"a": (2, 1, 2), "b": (1, 2, 0)}
    plan = meta._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" in plan
