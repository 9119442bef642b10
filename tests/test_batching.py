import random

from pyspark.sql import functions as F

from lexaria.operators.batching import budget_batches


def loop(costs, budget):
    out, held, n = [], None, -1
    for c in costs:
        if held is None or held + c > budget:
            held, n = 0, n + 1
        held += c
        out.append(n)
    return out


def test_budget_batches_equal_the_loop(spark):
    rng = random.Random(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for budget, most, n in ((50, 20, 900), (50, 80, 500), (10, 3, 700), (1000, 5, 400), (7, 0, 60), (0, 2, 50)):
            costs = [rng.randint(0, most) * (rng.random() < 0.7) for _ in range(n)]
            df = spark.createDataFrame([(i, c, "x") for i, c in enumerate(costs)], "k long, c int, _pid string").drop("_pid")
            got = budget_batches(df, "c", ["k"], budget).orderBy("k").collect()
            assert [r.batch_id for r in got] == loop(costs, budget), (budget, most)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert budget_batches(df.limit(0), "c", ["k"], 5).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, 3), (3, -4)], "k long, c int")
    assert [r.batch_id for r in budget_batches(nulls, "c", [F.col("k").desc()], 3).orderBy("k").collect()] == [0, 0, 0]
