"""What the text metrics shuffle."""

from benchspark.operators import metrics

ROWS = [("m", i, f"a b c {i % 7} d e f", f"a b {i % 5} d e g") for i in range(40)]


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_pairs_are_shuffled_before_they_become_grams(spark):
    counted = metrics.grams(spark.createDataFrame(ROWS, "model_key string, pair_id bigint, answer string, reference string"))
    assert len(exchanges(counted)) == 1 and "gram" not in exchanges(counted)[0]
    got = {(r.pair_id, r.n, r.gram): (r.c, r.r) for r in counted.collect()}
    assert got[0, 2, "a b"] == (1, 1) and got[0, 1, "0"] == (1, 1) and got[0, 4, "a b c 0"] == (1, 0)


def test_rare_grams_are_no_rows_of_the_frequencies(spark):
    rows = spark.createDataFrame(ROWS, "model_key string, pair_id bigint, answer string, reference string")
    plan = metrics.cider(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "(df#" in plan and "> 1)" in plan
    # grams of one reference weigh as grams of none
    few = spark.createDataFrame([("m", 1, "x y", "x y"), ("m", 2, "z", "w")], "model_key string, pair_id bigint, answer string, reference string")
    assert abs(metrics.cider(few).first().cider - 10 * (2 / 4) / 2) < 1e-9
