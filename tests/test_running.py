from pyspark.sql import functions as F

from marlstone.operators.running import running_sums


def test_one_large_group_and_clashing_names(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), (F.col("id") * 7919 % 3001).alias("o"), F.lit(2).alias("x"), F.lit(0).alias("slice"))
    got = running_sums(rows, ["g"], ["o"], {"n": F.lit(1), "twice": F.col("x")}).toPandas().sort_values(["g", "o"])
    assert len(got) == 3000 and (got.groupby("g").n.apply(list).map(lambda n: n == list(range(1, len(n) + 1)))).all() and (got.twice == 2 * got.n).all()


def test_empty(spark):
    assert running_sums(spark.createDataFrame([], "g string, o int"), ["g"], ["o"], {"n": F.lit(1)}).count() == 0
