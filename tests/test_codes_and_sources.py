"""Truncated SVD, code trees and beams, sketches, vector means and the pool's expansion rules, on small literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import codebook, cooccur, reduction, retrieval
from tessera.plans import codes, pooling, sketches


def vectors(spark, n=60, dims=5, seed=2):
    x = np.random.default_rng(seed).normal(size=(n, dims)) + np.arange(dims)
    return x, spark.createDataFrame([(i, [float(a) for a in r], int(i % 4)) for i, r in enumerate(x)], "item long, v array<double>, l0 int")


def test_truncated_svd_equals_numpy(spark):
    x, rows = vectors(spark)
    energy, directions = reduction.leading(reduction.gram(rows.repartition(7), 5), 2)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(energy, s**2) and np.allclose(np.abs(directions), np.abs(vt[:2]))
    assert all(d[np.abs(d).argmax()] > 0 for d in directions)
    got = {r["item"]: (r["v"], r["left"]) for r in reduction.projected(rows, directions).collect()}
    y = x @ directions.T
    assert np.allclose([got[i][0] for i in range(60)], y)
    assert sum(left for _, left in got.values()) == pytest.approx((s[2:] ** 2).sum())


def test_svd_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, None]), (2, None), (3, [0.0, 0.0])], "item long, v array<double>")
    assert reduction.gram(rows, 2).tolist() == [[1.0, 0.0], [0.0, 0.0]]
    assert reduction.gram(rows.where("false"), 2).tolist() == [[0.0, 0.0], [0.0, 0.0]]
    with pytest.raises(Exception, match="not 3 numbers"):
        reduction.gram(rows, 3)
    with pytest.raises(ValueError):
        reduction.gram(rows, 1 << 20)


def test_vector_means_of_any_length(spark):
    x, rows = vectors(spark, dims=3)
    got = {r["l0"]: r["v"] for r in retrieval.mean_vectors(rows.unionByName(spark.createDataFrame([(99, None, 0)], rows.schema)), ["l0"]).collect()}
    for k in range(4):
        m = x[np.arange(60) % 4 == k].mean(axis=0)
        assert np.allclose(got[k], m / np.linalg.norm(m))
    with pytest.raises(Exception):
        retrieval.mean_vectors(rows.unionByName(spark.createDataFrame([(99, [1.0], 0)], rows.schema)), ["l0"]).collect()


@pytest.fixture(scope="module")
def book(spark):
    return codebook.one_step(vectors(spark)[1], F.col("l0"), F.col("item") % 3)


def test_codes_are_the_nearest_centroids(spark, book):
    rows, first, second = book
    c0, c1 = ({r["code"]: np.array(r["c"]) for r in x.collect()} for x in (first, second))
    for r in rows.collect():
        v = np.array(r["v"])
        a = min(c0, key=lambda k: (round(float(np.linalg.norm(v - c0[k])), 9), k))
        b = min(c1, key=lambda k: (round(float(np.linalg.norm(v - c0[a] - c1[k])), 9), k))
        assert (r["l0"], r["l1"]) == (a, b) and np.linalg.norm(v) == pytest.approx(1)


@pytest.mark.parametrize("width", [1, 2, 99])
def test_beams_along_the_tree(spark, book, width):
    """Every beam is a code that exists; beams as wide as the codebook find what a search of all codes finds."""
    rows, first, second = book
    pairs = {(r["l0"], r["l1"]) for r in rows.collect()}
    c0, c1 = ({r["code"]: np.array(r["c"]) for r in x.collect()} for x in (first, second))
    queries = rows.where("item % 10 = 0").select(F.col("item").alias("query"), "v")
    got = {}
    for r in codes.beams(queries, rows, first, second, width).collect():
        got.setdefault(r["query"], set()).add((r["node"], r["total"]))
    for q in queries.collect():
        v = np.array(q["v"])
        far = lambda a, b: -round(float(np.linalg.norm(a - b)), 9)
        at = sorted({a for a, _ in pairs}, key=lambda a: (-far(v, c0[a]), str(a)))[:width]
        ends = [(f"{a}_{b}", round(far(v, c0[a]) + far(v - c0[a], c1[b]), 9)) for a, b in pairs if a in at]
        assert got[q["query"]] == set(sorted(ends, key=lambda x: (-x[1], x[0]))[:width])


def test_tree_counts(spark):
    rows = spark.createDataFrame([(1, 0, 5), (2, 0, 5), (3, 0, 6), (4, 2, 5)], "item long, l0 int, l1 int")
    got = {(r["node"], r["symbol"], r["child"], r["n"]) for r in codes.trie(rows).collect()}
    assert got == {("", 0, "0", 3), ("", 2, "2", 1), ("0", 5, "0_5", 2), ("0", 6, "0_6", 1), ("2", 5, "2_5", 1)}


def test_daily_sketches_merge(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("d"), (F.col("id") % 3).cast("string").alias("k"), (F.col("id") % 5000).alias("x"))
    got = sketches.merged_distinct(sketches.daily_distinct(rows, F.col("d"), ["k"], "x"), ["k"]).collect()
    assert len(got) == 3 and all(abs(r["estimate"] - 5000) < 0.05 * 5000 for r in got)


def test_neighbour_places_count_seen_items(spark):
    """A played item inside a neighbour list keeps its place; only what is taken skips it."""
    table = spark.createDataFrame([(1, 2, 9.0, 1), (1, 3, 8.0, 2), (1, 4, 7.0, 3), (1, 5, 6.0, 4), (2, 4, 5.0, 1), (2, 1, 4.0, 2)], "src long, dst long, w double, rank int")
    history = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "turn long, item long, back int")
    got = {r["item"]: (r["rank"], r["w"], r["n_from"]) for r in cooccur.expanded(history, table, [2, 1]).collect()}
    assert got == {3: (1, 8.0, 1), 4: (0, 7.0, 2)}


def test_bucket_sources_name_new_items_only(spark, sf):
    w = pooling.World(spark, sf)
    rows = w.found().collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], {}).setdefault(r["query"], []).append(r)
    for name in ("bucket", "centroid"):
        before = {(r["query"], r["item"]) for r in rows if pooling.NAMES.index(r["source"]) < pooling.NAMES.index(name)}
        for q, mine in by[name].items():
            assert not {(q, r["item"]) for r in mine} & before
            assert len(mine) <= pooling.BUCKET_CAP and sorted(r["rank"] for r in mine) == list(range(1, len(mine) + 1))
            assert len({r["cell"] for r in mine}) <= pooling.BUCKETS
    played = {(r["query"], r["item"]) for r in w.h.collect()}
    assert not played & {(r["query"], r["item"]) for r in rows}


def test_predictor_is_a_distribution(spark, sf):
    total = pooling.World(spark, sf).predicted().groupBy("query").agg(F.sum("l0_score").alias("p")).collect()
    assert total and all(abs(r["p"] - 1) < 1e-6 for r in total)
