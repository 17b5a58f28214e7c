"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled rows; every path from a root to a
node is a rule, a conjunction of comparisons of statistics. A logistic model with an L1 penalty
keeps few of the rules. The rules and weights are compiled into one Spark column expression, by
which every text is scored in generated code.

Labels of held-out rows (crc32 of the id mod 4 is 2) are never learned from; labels, language,
source and id are no inputs. Null labels are left out; a doc_id with two labels gives two rows
of the sample. Null and empty texts have statistics of 0 and are scored by them. With no labels
every score is 0.5. Repeated rows are each scored; extra columns aren't read; an empty table
gives no rows. A null doc_id is not held out and has no label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import quality_rules, util


def statistics() -> dict[str, Column]:
    c = lambda n: F.col(f"_{n}").cast("double")
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    return {
        "words": F.log1p(c("n_words")),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "word_chars"),
        "upper": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"),
        "marks": per("n_marks", "n_words"),
        "repeats": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct", "n_words"),
        "top_word": per("top_word", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "line_words": per("n_words", "n_lines"),
    }


class Tree:
    """A regression tree on binned columns, grown by the gain of the logistic loss."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int):
        self.paths: list[tuple[tuple[int, bool, float], ...]] = []
        self.value = np.zeros(len(bins))
        self._grow(np.arange(len(bins)), (), bins, edges, grad, hess, depth, least)

    def _grow(self, rows, path, bins, edges, grad, hess, depth, least):
        if path:
            self.paths.append(path)
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                size = len(e) + 1
                gs, hs, ns = (np.cumsum(np.bincount(bins[rows, f], w, size))[:-1] for w in (grad[rows], hess[rows], None))
                ok = (ns >= least) & (len(rows) - ns >= least)
                gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
        if best[1] is None:
            self.value[rows] = -g / (h + 1)
            return
        _, f, at = best
        low = bins[rows, f] <= at
        cut = float(edges[f][at])
        self._grow(rows[low], (*path, (f, True, cut)), bins, edges, grad, hess, depth - 1, least)
        self._grow(rows[~low], (*path, (f, False, cut)), bins, edges, grad, hess, depth - 1, least)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, least: int) -> list[tuple]:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 48))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    score, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = Tree(bins, edges, p - y, p * (1 - p), depth, least)
        score += rate * tree.value
        for path in tree.paths:
            rules.setdefault(tuple(sorted(path)), None)
    return list(rules)


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in rule:
        out &= (x[:, f] <= cut) if low else (x[:, f] > cut)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Weights of the least penalised logistic loss, by accelerated proximal steps; the intercept is free."""
    mean = r.mean(axis=0)
    a = np.hstack([np.ones((len(r), 1)), r - mean])
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / float(v @ (a.T @ (a @ v)))
    w, z, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / len(y)
        new = z - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0] - w[1:] @ mean), w[1:]


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, rate: float = 0.3, penalty: float = 1e-3, steps: int = 400) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]) of the rules that the penalty leaves."""
    if not len(y) or y.min() == y.max():
        return (0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)), []
    rules = grow_rules(x, y, trees, depth, rate, max(3, len(y) // 500))
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    r = np.stack([holds(rule, x) for rule in rules], 1)
    _, first = np.unique(r, axis=1, return_index=True)
    first = np.sort(first)
    bias, w = lasso(r[:, first].astype(np.float64), y, penalty, steps)
    return bias, [(rules[i], float(v)) for i, v in zip(first, w) if abs(v) > 1e-4]


def compiled(bias: float, rules: list[tuple[tuple, float]], names: list[str]) -> Column:
    """The model as one column expression over the statistics' columns."""
    total = F.lit(bias)
    for rule, weight in rules:
        cond = F.lit(True)
        for f, low, cut in rule:
            cond = cond & ((F.col(names[f]) <= cut) if low else (F.col(names[f]) > cut))
        total = total + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, cutoff: float = 0.7, **model) -> tuple[DataFrame, list]:
    """doc_id, held_out, score, predicted for each row of docs; the model. sample: labelled rows that the fit may see at most, the first by hash."""
    stats = statistics()
    names = [f"s_{n}" for n in stats]
    counts = quality_rules.counted(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])
    own, path = util.staged(counts.select("doc_id", *[v.alias(f"s_{n}") for n, v in stats.items()]), "statistics")
    own = own.withColumn("held_out", F.coalesce(util.held_out(), F.lit(False)))
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    learn = own.where(~F.col("held_out")).join(marks, "doc_id").select(*names, "quality", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("at"))
    n = learn.count()
    if n > sample:
        # a share of the hashes that gives a few rows less than sample: nothing is sorted, and only what the fit sees is collected
        learn = learn.where(F.col("at") < int((1 << 40) * sample / n * max(0.0, 1 - 5 / sample**0.5))).limit(sample)
    seen = learn.toPandas().sort_values(["at", *names, "quality"])[[*names, "quality"]].to_numpy(np.float64)
    bias, rules = fit(seen[:, :-1], seen[:, -1], **model)
    score = compiled(bias, rules, names)
    out = own.withColumn("score", score).select("doc_id", "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
    return util.result(out, path), [bias, rules]


def op1(spark, sf_dir: str) -> DataFrame:
    return scored(util.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]
