"""Turns in bins: a byte for each column is shuffled, not the columns."""

from pyspark.sql import functions as F

from tessera.operators import lambdamart


def test_bins_are_shuffled_instead_of_columns(spark):
    rows = spark.range(40).select((F.col("id") % 4).alias("query"), (40 - F.col("id")).alias("item"), (F.col("id") % 3).cast("double").alias("label"), F.lit(1).alias("fold"), F.col("id").cast("double").alias("a"), F.when(F.col("id") > 3, -F.col("id")).cast("double").alias("b"))
    ends = [[10.0, 20.0], [-20.0, -10.0]]
    df = lambdamart.grouped(rows, ["a", "b"], ends)
    shown = df._jdf.queryExecution().executedPlan().toString()
    assert shown.index("Exchange") < shown.rindex("MapInArrow")  # the bins are made below the exchange
    got = {r["query"]: r for r in df.collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for q, r in got.items():
        ids = sorted(range(q, 40, 4), reverse=True)  # by item
        assert r["items"] == [40 - i for i in ids] and r["labels"] == [float(i % 3) for i in ids] and r["fold"] == 1
        assert list(r["bins"]) == [x for i in ids for x in ((i > 10) + (i > 20), 0 if i <= 3 else (-i > -20) + (-i > -10))]
