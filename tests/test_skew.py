from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestat.operators import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    many = spark.createDataFrame([(i, "hot" if i % 3 else ("cold" if i % 2 else None)) for i in range(300)] + [(900, "alone")], "i int, k string")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3), (None, 4), ("other", 5)], "k string, v int")
    got = skew.salted_join(many, few, ["k"], F.col("i"), how, least=5)
    want = many.join(few, "k", how)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert skew.salted_join(many.where("false"), few, ["k"], F.col("i"), how, least=5).count() == 0


def test_hot_rows_spread_over_partitions(spark):
    many = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    hot = skew.hot_keys(skew._counted(many, ["k"]), ["k"], parts=100, least=50)
    assert [(r["k"], r["__slots"]) for r in hot.collect()] == [(7, 67)]
    most = skew.spread_rows(many, hot, ["k"], F.col("id")).groupBy("k", "__slot").count().agg(F.max("count")).first()[0]
    assert most < 300


def test_both_salted_join(spark):
    a = spark.createDataFrame([(i, i % 4 if i % 2 else 0) for i in range(200)], "i int, k int")
    b = spark.createDataFrame([(j, 0 if j % 3 else j % 5) for j in range(90)], "j int, k int")
    got = skew.both_salted_join(a, b, ["k"], F.col("i"), F.col("j"), *(skew.hot_keys(skew._counted(x, ["k"]), ["k"], least=10) for x in (a, b)))
    assert Counter(map(tuple, got.select("k", "i", "j").collect())) == Counter(map(tuple, a.join(b, "k").select("k", "i", "j").collect()))
