import random

from pyspark.sql import functions as F

from hatefold.operators.ranking import numbered


def test_numbers_follow_the_order_over_partitions(spark):
    random.seed(1)
    rows = [(random.choice([None, 1, 2, 2, 7]), random.randrange(50), f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, term string").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # partitions are not coalesced
    try:
        got = numbered(df, [F.asc_nulls_last("a"), F.desc("b"), F.asc("term")], "n", 10).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(10, 10 + len(rows)))


def test_ties_share_no_number(spark):
    df = spark.createDataFrame([("x",)] * 200 + [("a",)], "t string").repartition(4)
    got = numbered(df, [F.asc("t")])
    assert sorted(r["rank"] for r in got.collect()) == list(range(201))
    assert got.where("t = 'a'").first()["rank"] == 0
    assert got.columns == ["t", "rank"] and dict(got.dtypes)["rank"] == "bigint"


def test_an_empty_table_has_no_numbers(spark):
    got = numbered(spark.createDataFrame([], "t string, rank_by int"), [F.asc("rank_by")])
    assert got.collect() == [] and got.columns == ["t", "rank_by", "rank"]


def test_plan_has_no_single_task_and_no_python(spark):
    plan = numbered(spark.range(1000).toDF("x"), [F.asc("x")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan and "Python" not in plan
