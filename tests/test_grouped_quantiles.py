from thermocline.operators.quantiles import quantiles


def test_grouped_bounds_are_broadcast_and_reach_the_upper_rank(spark):
    """A rank between two values needs both inside the bracket; few groups must not decide the number of tasks."""
    rows = spark.range(3122).selectExpr("CAST(id % 1 AS STRING) AS g", "CASE WHEN id < 2341 THEN 0.7D ELSE 0.8D END AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quantiles(rows, ["v"], (0.75,), ("q75",), by=["g"])
        assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
        assert abs(found.first()["q75"] - 0.775) < 1e-9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
