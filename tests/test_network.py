"""The network that is fitted without holding its rows, against Spark's own; wide rows are not shuffled."""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.operators import network


def test_fit_is_that_of_spark_without_a_copy_of_the_rows(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    columns = ["a", "b", "c"]
    # whole blocks of 128 rows in one partition: Spark's mean over blocks is the mean over rows
    rows = spark.range(0, 1280, 1, 1).select(F.sin("id").alias("a"), (F.col("id") % 7 / 3 - 1).alias("b"), F.cos(F.col("id") * 3).alias("c"))
    rows = rows.withColumn("label", (F.col("a") + F.col("b") * F.col("c") > 0.3).cast("double"))
    data = rows.withColumn("_x", array_to_vector(F.array(*columns)))
    theirs = MultilayerPerceptronClassifier(layers=[3, 6, 2], seed=7, maxIter=10, featuresCol="_x").fit(data)
    ours = network.fit(rows, columns, np.zeros(3), np.ones(3), hidden=6, seed=7, iterations=10)
    assert np.allclose(ours.weights.toArray(), theirs.weights.toArray(), rtol=1e-5, atol=1e-6)
    score = lambda m: [r[0] for r in m.transform(data).select(vector_to_array("probability")[1]).collect()]
    assert np.allclose(score(ours), score(theirs), atol=1e-6)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    mean, off = network.moments(rows.repartition(3), columns)
    want = rows.agg(*[f(c) for f in (F.avg, F.stddev_pop) for c in columns]).first()
    assert np.allclose([*mean, *off], want, atol=1e-12)


def test_wide_rows_are_not_shuffled(spark, sf, monkeypatch):
    from tessera.plans import features

    df = features.matrix(spark, sf)
    shown = df._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in shown.splitlines() if "Exchange hashpartitioning" in x]
    # candidates go to the catalog and back: no exchange by album, artist or bucket, and none after the cosines
    assert wide and not [x for x in wide if any(k in x.split("hashpartitioning")[1] for k in ("album", "artist", "l0"))]
    assert shown.index("MapInArrow") < min(shown.index(x) for x in wide)
    monkeypatch.setattr(features, "SLICE", 1000)
    cut = features.matrix(spark, sf)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, df.collect()))
