"""The listwise ranker: gradients by hand, folds apart, better than a pointwise model, saved and loaded."""

import numpy as np
import pytest

from tessera.operators import codebook, lambdamart
from tessera.operators.lambdamart import Parameters


def made(turns=60, seed=3):
    """The relevant candidate has the largest a; b tells the turns apart by their share of relevant rows and says nothing inside one."""
    r, out = np.random.default_rng(seed), []
    for q in range(turns):
        n = int(r.choice([3, 30]))
        a = r.normal(size=n)
        best = int(np.argmax(a + r.normal(scale=0.1, size=n)))
        shift = float(r.normal(scale=3))
        out += [(q, i, float(i == best), q % 3, float(a[i] + shift), 1.0 / n, float(r.normal()), None if i % 7 == 0 else 0.0) for i in range(n)]
    return out


SCHEMA, COLUMNS = "query long, item long, label double, fold int, a double, b double, c double, d double", ["a", "b", "c", "d"]
POINT = Parameters(depth=3, rounds=6, early_stop=3, least_rows=5)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), SCHEMA)


@pytest.fixture(scope="module")
def fitted(rows):
    return lambdamart.fit(rows, COLUMNS, 3, [POINT, Parameters(depth=1, rounds=2, least_rows=5)])


def test_gradients_by_hand():
    r = np.random.default_rng(1)
    for labels in ([0, 0, 1, 0], [1, 2, 0, 0, 2, 0], [0, 0], [1]):
        labels, scores = np.array(labels, float), r.normal(size=len(labels)).round(1)
        for truncation in (1, 3, 30):
            order = sorted(range(len(labels)), key=lambda i: (-scores[i], i))
            rank = {x: k + 1 for k, x in enumerate(order)}
            ideal = sum((2**x - 1) / np.log2(k + 2) for k, x in enumerate(sorted(labels, reverse=True)))
            g, h = np.zeros(len(labels)), np.zeros(len(labels))
            for i in range(len(labels)):
                for j in range(len(labels)):
                    if labels[i] > labels[j] and min(rank[i], rank[j]) <= truncation:
                        rho = 1 / (1 + np.exp(scores[i] - scores[j]))
                        change = (2 ** labels[i] - 2 ** labels[j]) * abs(1 / np.log2(1 + rank[i]) - 1 / np.log2(1 + rank[j])) / ideal
                        g[i] -= rho * change
                        g[j] += rho * change
                        h[i] += rho * (1 - rho) * change
                        h[j] += rho * (1 - rho) * change
            got = lambdamart.gradients(labels, scores, truncation)
            assert np.allclose(got[0], g) and np.allclose(got[1], h)


def test_ndcg():
    assert lambdamart.ndcg(np.array([0.0, 1.0]), np.array([1.0, 0.0]), 20) == pytest.approx(1 / np.log2(3))
    assert lambdamart.ndcg(np.array([0.0, 1.0]), np.array([1.0, 0.0]), 1) == 0.0
    assert lambdamart.ndcg(np.zeros(3), np.zeros(3), 20) == 0.0


def gain(scored):
    by = {}
    for q, i, label, s in scored:
        by.setdefault(q, []).append((i, label, s))
    out = []
    for x in by.values():
        x.sort()
        out.append(lambdamart.ndcg(np.array([a[1] for a in x]), np.array([a[2] for a in x]), 20))
    return sum(out) / len(out)


def test_better_than_a_pointwise_model(rows, fitted):
    (model, _), turns = fitted
    got = lambdamart.scored(model, turns).collect()
    listwise = gain([(r["query"], r["item"], r["label"], r["score"]) for r in got])
    filled = rows.fillna(0.0)
    pointwise, _, _ = codebook.ranker(filled, COLUMNS, "fold", 3, 6, 3)
    assert listwise > gain([(r["query"], r["item"], r["label"], r["score"]) for r in pointwise.collect()]) > 0.2
    assert len(got) == rows.count()


def test_held_out_gain_is_what_the_models_give(fitted):
    (model, small), turns = fitted
    got = lambdamart.scored(model, turns).collect()
    for f in range(3):
        mine = [(r["query"], r["item"], r["label"], r["score"]) for r in got if r["fold"] == f]
        assert gain(mine) == pytest.approx(model.gains[f][model.best[f]])
        assert model.gains[f][model.best[f]] == max(model.gains[f][1:])
    assert len(model.final) == max(1, round(sum(model.best) / 3)) and all(len(t) <= 2 for t in small.trees)


def test_held_out_labels_teach_nothing(spark, rows, fitted):
    """Other labels in fold 1 leave the model of the other folds as it was."""
    other = [(*r[:2], 1.0 - r[2] if r[3] == 1 else r[2], *r[3:]) for r in made()]
    (model,), _ = lambdamart.fit(spark.createDataFrame(other, SCHEMA), COLUMNS, 3, [Parameters(depth=3, rounds=2, early_stop=9, least_rows=5)])
    for a, b in zip(model.trees[1], fitted[0][0].trees[1]):
        assert (a.column == b.column).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)


def test_written_scores_change_nothing(rows, fitted):
    (model,), _ = lambdamart.fit(rows, COLUMNS, 3, [POINT], carry=1)
    for mine, other in zip(model.trees, fitted[0][0].trees):
        assert len(mine) == len(other) and all((a.column == b.column).all() and np.allclose(a.value, b.value) for a, b in zip(mine, other))


def test_saved_and_loaded(spark, rows, fitted, tmp_path):
    (model, _), turns = fitted
    lambdamart.saved(spark, model, str(tmp_path / "m"))
    again = lambdamart.loaded(spark, str(tmp_path / "m"), COLUMNS)
    want = {(r["query"], r["item"]): r["final_score"] for r in lambdamart.scored(model, turns).collect()}
    assert {(r["query"], r["item"]): r["final_score"] for r in lambdamart.scored(again, lambdamart.grouped(rows, COLUMNS, again.cuts)).collect()} == want
    with pytest.raises(ValueError):
        lambdamart.loaded(spark, str(tmp_path / "m"), COLUMNS[::-1])


def test_no_rows_and_no_relevant_ones(spark, rows):
    (model,), turns = lambdamart.fit(rows.where("false"), COLUMNS, 2, [POINT])
    assert lambdamart.scored(model, turns).count() == 0
    (model,), turns = lambdamart.fit(rows.withColumn("label", rows["label"] * 0).where("query < 6"), COLUMNS, 2, [POINT])
    assert {r["final_score"] for r in lambdamart.scored(model, turns).collect()} == {0.0}
