"""Connected components."""

from pyspark.sql import functions as F

from tallyspark.operators.graph import connected_components


def test_links_whose_direction_changes_when_computed_again(spark):
    nodes = spark.range(300).selectExpr("id as node", "id as rank")
    found = spark.range(299).where("id % 10 <> 9").withColumn("_r", F.rand() < 0.5)
    links = found.select(F.when(F.col("_r"), F.col("id")).otherwise(F.col("id") + 1).alias("a"), F.when(F.col("_r"), F.col("id") + 1).otherwise(F.col("id")).alias("b"))
    rows = connected_components(nodes, links).collect()
    assert {r["node"]: r["root"] for r in rows} == {n: n - n % 10 for n in range(300)}
