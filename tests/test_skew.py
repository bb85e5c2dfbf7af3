from pyspark.sql import functions as F

from termforge.operators.skew import Part, heavy_keys, keys_with_share, salted_aggregate

def parts():
    return [Part("n", F.count(F.lit(1))), Part("distinct_v", F.count_distinct("v")), Part("top", F.max("v"), "max"), Part("low", F.min("v"), "min"), Part("total", F.sum("v"))]


SCHEMA = "k long, v long, id long, n string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def plain(df):
    return df.groupBy("k").agg(*[p.partial.alias(p.name) for p in parts()])


def test_same_as_unsalted_with_hot_null_and_repeated_rows(spark):
    data = [(1, i % 7, i, "x") for i in range(400)] + [(None, i, i, None) for i in range(150)] + [(k, None, k, "y") for k in range(2, 60)] + [(1, 3, 3, "x")] * 5
    df = rows(spark, data)
    ours = salted_aggregate(df, "k", parts(), salt_on="v", salts=5, heavy_share=0.1)
    assert sorted(map(str, ours.collect())) == sorted(map(str, plain(df).collect()))


def test_salt_splits_heavy_keys_only(spark):
    df = rows(spark, [(1, i, i, "") for i in range(90)] + [(2, i, i, "") for i in range(10)])
    assert [r[0] for r in heavy_keys(df, "k", 0.5).collect()] == [1]
    assert heavy_keys(df, "k", 0.05).count() == 2


def test_empty_and_share(spark):
    empty = rows(spark, [])
    assert salted_aggregate(empty, "k", parts(), salt_on="v").count() == 0
    assert keys_with_share(salted_aggregate(empty, "k", parts(), salt_on="v"), "k", "n", 45).count() == 0
    df = rows(spark, [(1, 0, 0, "")] * 45 + [(2, 0, 0, "")] * 44 + [(None, 0, 0, "")] * 911)
    counts = salted_aggregate(df, "k", parts()[:1], salt_on="id")
    assert [r.k for r in keys_with_share(counts, "k", "n", 45).collect()] == [1]
