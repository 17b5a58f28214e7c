"""Rankers over the 70 feature columns: listwise trees (J15, J16, I15) and a small network (I16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import codebook, importance, lambdamart, network, retrieval
from tessera.operators.lambdamart import Parameters
from tessera.plans.base import query
from tessera.plans.features import ALL, COLUMNS, _rounded, matrix
from tessera.plans.pooling import WEIGHTS
from tessera.sources.staging import kept

FOLDS = 5


def rows(spark, d):
    """Feature rows of every turn, with a fold for each session; written, as every round reads them."""
    found = matrix(spark, d, written=True).withColumn("label", F.col("label").cast("double"))
    return found.withColumn("fold", F.pmod(F.floor(F.col("query") / 20), F.lit(FOLDS)).cast("int"))


@query("j15_boosted_ranker")
def j15(spark, d):
    """Scores of each turn by the model of the other folds, and by the one refitted at the mean of the folds' best rounds."""
    (model,), turns = lambdamart.fit(rows(spark, d), COLUMNS, FOLDS, [Parameters(rounds=8, early_stop=3)])
    return lambdamart.scored(model, turns).select("query", "item", "score", "final_score")


#: number of bins and limits of the tree that SQL grows too
SMALL = Parameters(depth=2, rounds=1, bins=8, l2=0.1, rate=0.1, least_rows=20)

_LEVEL = """cells{n} AS (SELECT node, col, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({source}) GROUP BY 1, 2, 3),
run{n} AS (SELECT *, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln, sum(g) OVER v AS tg, sum(h) OVER v AS th, sum(n) OVER v AS tn FROM cells{n}
  WINDOW w AS (PARTITION BY node, col ORDER BY bin), v AS (PARTITION BY node, col)),
gain{n} AS (SELECT *, round(lg * lg / (lh + 0.1) + (tg - lg) * (tg - lg) / (th - lh + 0.1) - tg * tg / (th + 0.1), 9) AS gain FROM run{n}),
best{n} AS (SELECT node, col, bin, gain, -lg / (lh + 0.1) * 0.1 AS l, -(tg - lg) / (th - lh + 0.1) * 0.1 AS r FROM gain{n}
  WHERE least(ln, tn - ln) >= 20 AND least(lh, th - lh) >= 1e-3 AND gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, col, bin) = 1)"""
TREE = [
    "mr AS (SELECT query, item, label, " + ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in COLUMNS) + " FROM mx)",
    "rk AS (SELECT query, item, label, row_number() OVER (PARTITION BY query ORDER BY item) AS r FROM mr)",
    "idl AS (SELECT query, sum(1 / log2(k + 1)) AS ideal FROM (SELECT query, row_number() OVER (PARTITION BY query) AS k FROM mr WHERE label = 1) GROUP BY 1)",
    "prs AS (SELECT p.query, p.item AS up, n.item AS down, abs(1 / log2(1 + p.r) - 1 / log2(1 + n.r)) / ideal AS change FROM rk p JOIN rk n ON p.query = n.query AND p.label = 1 AND n.label = 0 AND least(p.r, n.r) <= 30 JOIN idl ON idl.query = p.query)",
    "grd AS (SELECT query, item, sum(g) AS g, sum(h) AS h FROM (SELECT query, up AS item, -change / 2 AS g, change / 4 AS h FROM prs UNION ALL SELECT query, down, change / 2, change / 4 FROM prs UNION ALL SELECT query, item, 0, 0 FROM mr) GROUP BY 1, 2)",
    "lng AS (UNPIVOT mr ON " + ", ".join(COLUMNS) + " INTO NAME name VALUE x)",
    "nms AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in COLUMNS) + f"]) AS name, unnest(range({len(COLUMNS)})) AS col)",
    "wid AS (SELECT name, min(x) AS lo, max(x) AS hi FROM lng GROUP BY 1)",
    "bnd AS (SELECT query, item, col, CASE WHEN lo = hi THEN 0 ELSE len(list_filter(range(1, 8), lambda k: lo + (hi - lo) * k / 8 < x)) END AS bin FROM lng JOIN wid USING (name) JOIN nms USING (name))",
    _LEVEL.format(n=0, source="SELECT 0 AS node, bnd.*, g, h FROM bnd JOIN grd USING (query, item)"),
    "side AS (SELECT query, item, 1 + (bnd.bin > best0.bin)::INT AS node FROM bnd JOIN best0 USING (col))",
    _LEVEL.format(n=1, source="SELECT side.node, bnd.*, g, h FROM bnd JOIN grd USING (query, item) JOIN side USING (query, item)"),
]


@query("j15_lambda_tree", "SELECT node, name, bin, round(gain, 6) AS gain, round(l, 6) AS below, round(r, 6) AS above FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1) JOIN nms USING (col)", *ALL, *TREE)
def j15_tree(spark, d):
    """The splits of a first tree on all turns: node, column, last bin on the left, gain and the values of both sides."""
    found = rows(spark, d)
    ends = lambdamart.cuts(found, COLUMNS, SMALL.bins, even=True)
    turns = kept(lambdamart.grouped(found, COLUMNS, ends))
    tree, nodes, out = lambdamart.Tree.stump(SMALL.depth), {0}, []
    for _ in range(SMALL.depth):
        got, _ = lambdamart.level(turns, len(COLUMNS), [-1], [SMALL], [[]], [tree], [nodes])
        nodes = set()
        for s in got:
            if s["bin"] >= 0:
                n = s["node"]
                tree.column[n], tree.bin[n] = s["col"], s["bin"]
                nodes |= {2 * n + 1, 2 * n + 2}
                out.append((n, COLUMNS[s["col"]], s["bin"], round(s["gain"], 6), round(s["left"], 6), round(s["right"], 6)))
    return spark.createDataFrame(out, "node int, name string, bin int, gain double, below double, above double")


@query("i15_tree_scoring")
def i15(spark, d):
    """A saved model, loaded again, scores the columns it was trained on; the best 20 of each turn."""
    from tessera.plans.scans import _temp

    at, found = _temp(spark), rows(spark, d)
    (model,), turns = lambdamart.fit(found, COLUMNS, 0, [Parameters(rounds=4)])
    lambdamart.saved(spark, model, at)
    again = lambdamart.loaded(spark, at, COLUMNS)
    if again.cuts != model.cuts:  # else the turns are in the loaded model's bins already
        turns = lambdamart.grouped(found, COLUMNS, again.cuts)
    ranked = lambdamart.scored(again, turns).withColumn("score", F.round("final_score", 9))
    return retrieval.top_k(ranked, ["query"], 20).select("query", "item", "rank")


#: a fixed weighted sum of columns
LINEAR = {c: w for c, w in WEIGHTS.items() if c in COLUMNS}
_MOVED = "o_{c} * {w} - {c} * {w} + off"
LOST = [
    "mo AS (SELECT " + " + ".join(f"{w} * {c}" for c, w in LINEAR.items()) + " - label AS off, " + ", ".join(f"{c}, coalesce(lead({c}) OVER o, first({c}) OVER a) AS o_{c}" for c in LINEAR)
    + " FROM (SELECT query, item, label, " + ", ".join(f"coalesce(round({c}, 9), 0) AS {c}" for c in LINEAR) + " FROM mx) WINDOW o AS (PARTITION BY query ORDER BY sha256(query || '/' || item), item), a AS (PARTITION BY query ORDER BY sha256(query || '/' || item), item ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
    "lost AS (SELECT " + ", ".join(f"avg(({_MOVED.format(c=c, w=w)}) ** 2 - off ** 2) AS {c}" for c, w in LINEAR.items()) + " FROM mo)",
]


@query("j20_permutation_importance", " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS name, " + (f"round({c}, 9) + 0.0 AS importance, round({c}, 9) = 0 AS dead" if c in LINEAR else "0.0 AS importance, true AS dead") + " FROM lost" for i, c in enumerate(COLUMNS, 1)), *ALL, *LOST)
def j20_importance(spark, d):
    """How much worse the weighted sum tells a turn's item once a column's values go to other candidates of the turn; columns that change nothing are dead."""
    got = importance.linear(matrix(spark, d).select("query", "item", "label", *_rounded(list(LINEAR))), COLUMNS, LINEAR)
    lost = F.round("importance", 9) + 0.0
    return got.select("place", "name", lost.alias("importance"), (lost == 0).alias("dead"))


@query("j20_model_guard")
def j20_model(spark, d):
    """A saved ranker against the columns it is to score: each column's place in the model, its splits, the nDCG that turns lose without it, and whether the two agree (a column without splits loses nothing)."""
    from tessera.plans.scans import _temp

    at, found = _temp(spark), rows(spark, d)
    (model,), _ = lambdamart.fit(found, COLUMNS, 0, [Parameters(rounds=4)])
    lambdamart.saved(spark, model, at)
    again = lambdamart.loaded(spark, at, COLUMNS)
    got = importance.trees(again, lambdamart.grouped(found, COLUMNS, again.cuts))
    return got.withColumn("passes", (F.element_at(F.array(*map(F.lit, COLUMNS)), F.col("place")) == F.col("name")) & ((F.col("splits") > 0) | (F.col("importance") == 0)))


#: depths (31, 63 and 127 leaves) and rates of the nine points
GRID = [(depth, rate) for depth in (5, 6, 7) for rate in (0.03, 0.05, 0.08)]


@query("j16_ranker_sweep")
def j16(spark, d):
    """Held-out nDCG of each point of a grid: mean and deviation over the folds, and the mean best round."""
    models, _ = lambdamart.fit(rows(spark, d), COLUMNS, FOLDS, [Parameters(depth=depth, rate=rate, rounds=4, early_stop=3) for depth, rate in GRID])
    out = []
    for (depth, rate), m in zip(GRID, models):
        best = [max(g) for g in m.gains if g]
        mean = sum(best) / len(best) if best else 0.0
        out.append((2**depth - 1, rate, mean, (sum((x - mean) ** 2 for x in best) / len(best)) ** 0.5 if best else 0.0, len(m.final)))
    return spark.createDataFrame(out, "leaves int, rate double, ndcg double, deviation double, rounds int")


@query("i16_network_scoring")
def i16(spark, d):
    """Columns standardised by the training turns go into a small network; the probability of the first class scores the other turns."""
    from pyspark.ml.functions import vector_to_array

    found = rows(spark, d)
    train = found.where("fold <> 0")
    mean, off = network.moments(train, COLUMNS)
    scale = off + 1e-8
    model = network.fit(train, COLUMNS, mean, scale, hidden=6, seed=7, iterations=10)
    z = found.where("fold = 0").select("query", "item", *[((F.col(c) - F.lit(float(a))) / F.lit(float(b))).alias(c) for c, a, b in zip(COLUMNS, mean, scale)])
    return model.transform(codebook.assembled(z, COLUMNS)).select("query", "item", vector_to_array("probability")[1].alias("score"))
