"""Codebooks and models that are fitted: k-means codes, residual levels and a boosted ranker."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import reduction


def assign(rows: DataFrame, k: int, seed: int, column: str = "v") -> tuple[DataFrame, DataFrame]:
    """rows with code, and centroids(code, c)."""
    spark = rows.sparkSession
    data = rows.withColumn("_x", array_to_vector(F.col(column)))
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="code", initMode="k-means||").fit(data)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "code int, c array<double>")
    return model.transform(data).drop("_x"), centres


def two_level(rows: DataFrame, coarse: int, fine: int, seed: int = 42) -> DataFrame:
    """item, l0, l1: k-means of unit vectors, then of the residuals."""
    unit = rows.select("item", vector.unit(F.col("v")).alias("v"))
    first, centres = assign(unit, coarse, seed)
    left = first.join(F.broadcast(centres), "code").select("item", F.col("code").alias("l0"), vector.residual(F.col("v"), F.col("c")).alias("v"))
    second, _ = assign(left, fine, seed + 1)
    return second.select("item", "l0", F.col("code").alias("l1"))


def multimodal(rows: DataFrame, parts: list, coarse: int, fine: int, dims: int, keep: int, seed: int = 42) -> DataFrame:
    """item, l0, l1: several parts of a vector (columns of item rows), each scaled to length 1 and side by side, reduced to
    the first directions of their truncated SVD and scaled again; in two levels of unit vectors and unit residuals."""
    joint = rows.select("item", vector.unit(F.concat(*[vector.unit(p) for p in parts])).alias("v"))
    _, directions = reduction.leading(reduction.gram(joint, dims), keep)
    reduced = reduction.projected(joint, directions).select("item", vector.unit(F.col("v")).alias("v"))
    first, centres = assign(reduced, coarse, seed)
    left = first.join(F.broadcast(centres), "code").select("item", F.col("code").alias("l0"), vector.unit(vector.residual(F.col("v"), F.col("c"))).alias("v"))
    second, _ = assign(left, fine, seed + 1)
    return second.select("item", "l0", F.col("code").alias("l1"))


def nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows with the code and centroid c of centres(code, c) that is nearest to v; equal distances (9 digits) go to the smaller code."""
    book = centres.agg(F.array_sort(F.collect_list(F.struct("code", "c"))).alias("book"))  # one row: a codebook is small
    far = F.transform("book", lambda b: F.struct(F.round(vector.norm(vector.residual(F.col("v"), b["c"])), 9).alias("far"), b["code"].alias("code"), b["c"].alias("c")))
    return rows.crossJoin(F.broadcast(book)).withColumn("best", F.array_min(far)).select(*rows.columns, F.col("best.code").alias("code"), F.col("best.c").alias("c"))


def means(rows: DataFrame, by: Column) -> DataFrame:
    """centres(code, c): the mean vector of each group, in one aggregate over vectors."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("v"))))
    return rows.groupBy(by.cast("int").alias("code")).agg(mean.alias("c"))


def one_step(rows: DataFrame, coarse: Column, fine: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, l0, l1, v: the unit vector), and both levels' centroids: groups that are given seed the centroids, to the nearest of which rows go."""
    unit = rows.withColumn("v", vector.unit(F.col("v")))
    first = means(unit, coarse)
    left = nearest(unit, first).withColumnRenamed("code", "l0_").withColumn("u", F.col("v")).withColumn("v", vector.residual(F.col("v"), F.col("c"))).drop("c")
    second = means(left, fine)
    return nearest(left, second).select("item", F.col("l0_").alias("l0"), F.col("code").alias("l1"), F.col("u").alias("v")), first, second


def boosted(data: DataFrame, trees: int, depth: int):
    return GBTRegressor(featuresCol="_x", labelCol="label", predictionCol="score", maxIter=trees, maxDepth=depth, seed=7).fit(data)


def assembled(features: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep").transform(features)


def ranker(features: DataFrame, columns: list[str], fold: str, folds: int, trees: int, depth: int):
    """(scored, rounds, model): each fold scored by the model of the others, the best round of each fold by its own
    loss, and a model of all rows with the mean of the best rounds."""
    data = assembled(features, columns)
    out, rounds = None, []
    for i in range(folds):
        held = data.where(F.col(fold) == i)
        model = boosted(data.where(F.col(fold) != i), trees, depth)
        loss = model.evaluateEachIteration(held, "squared")
        rounds.append(1 + min(range(len(loss)), key=loss.__getitem__))
        one = model.transform(held).drop("_x")
        out = one if out is None else out.unionByName(one)
    return out, rounds, boosted(data, max(1, round(sum(rounds) / len(rounds))), depth)
