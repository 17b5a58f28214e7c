"""Permutation importance: by hand for a weighted sum, and of trees that use some columns only."""

import hashlib

import numpy as np
import pytest

from tessera.operators import importance, lambdamart
from tessera.operators.lambdamart import Parameters, Ranker, Tree

SCHEMA, COLUMNS = "query long, item long, label double, fold int, a double, b double, c double", ["a", "b", "c"]


def made(turns=20, seed=4):
    r, out = np.random.default_rng(seed), []
    for q in range(turns):
        a = r.normal(size=9)
        out += [(q, i, float(i == a.argmax()), q % 2, float(a[i]), None if i == 3 else float(r.normal()), 1.0) for i in range(9)]
    return out + [(99, 0, 1.0, 0, 1.0, 2.0, 1.0)]  # a turn of one candidate


def after(rows):
    """Each row's next one in its turn."""
    out = {}
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (hashlib.sha256(f"{q}/{r[1]}".encode()).hexdigest(), r[1]))
        out |= {(q, r[1]): own[(k + 1) % len(own)] for k, r in enumerate(own)}
    return out


def test_weighted_sum_by_hand(spark):
    rows, w = made(), {"a": 0.5, "b": -0.25, "c": 2.0}
    nxt, value = after(rows), lambda r, k: r[4 + k] or 0.0
    got = {r["name"]: (r["place"], r["importance"]) for r in importance.linear(spark.createDataFrame(rows, SCHEMA), [*COLUMNS, "fold"], w).collect()}
    for k, c in enumerate(COLUMNS):
        off = [sum(w[x] * value(r, j) for j, x in enumerate(COLUMNS)) - r[2] for r in rows]
        moved = [o + w[c] * (value(nxt[r[0], r[1]], k) - value(r, k)) for o, r in zip(off, rows)]
        assert got[c][0] == k + 1 and got[c][1] == pytest.approx(np.mean(np.square(moved) - np.square(off)), abs=1e-12)
    assert got["c"][1] == 0.0 and got["fold"] == (4, 0.0)


def test_no_weights_and_no_rows(spark):
    rows = spark.createDataFrame(made(), SCHEMA)
    assert {r["importance"] for r in importance.linear(rows, COLUMNS, {}).collect()} == {0.0}
    assert {r["importance"] for r in importance.linear(rows.where("false"), COLUMNS, {"a": 1.0}).collect()} == {None}


def test_trees_by_hand(spark):
    rows = made()
    tree = Tree(np.array([0, -1, 1, -1, -1, -1, -1]), np.array([1, 0, 0, 0, 0, 0, 0]), np.array([0.0, 0.1, 0, 0, 0, 0.5, 0.9]))
    ranker = Ranker(COLUMNS, [[-0.5, 0.5], [0.0], []], [[tree]])
    got = {r["name"]: r for r in importance.trees(ranker, lambdamart.grouped(spark.createDataFrame(rows, SCHEMA), COLUMNS, ranker.cuts)).collect()}
    nxt = after(rows)

    def score(a, b):
        if a <= 0.5:
            return 0.1
        return 0.5 if b is None or b <= 0.0 else 0.9

    def mean(swap):
        out = []
        for q in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == q]
            s = [score(*(nxt[q, r[1]][4 + k] if swap == k else r[4 + k] for k in (0, 1))) for r in own]
            out.append(lambdamart.ndcg(np.array([r[2] for r in own]), np.array(s), 20))
        return np.mean(out)

    for k, c in enumerate(("a", "b")):
        assert got[c]["splits"] == 1 and got[c]["importance"] == pytest.approx(mean(None) - mean(k), abs=1e-12)
    assert (got["c"]["place"], got["c"]["splits"], got["c"]["importance"]) == (3, 0, 0.0)


def test_a_fitted_model_needs_its_column(spark):
    rows = spark.createDataFrame(made(40), SCHEMA)
    (model,), _ = lambdamart.fit(rows, COLUMNS, 0, [Parameters(depth=2, rounds=3, least_rows=5)])
    got = {r["name"]: r["importance"] for r in importance.trees(model, lambdamart.grouped(rows, COLUMNS, model.cuts)).collect()}
    assert got["a"] > 0.2 > abs(got["b"]) and got["c"] == 0.0
