"""A listwise ranker: boosted histogram trees on lambda gradients, all folds trained side by side.

Every turn is one row with the bins of its candidates (a pool is bounded by its sources). A level
of the trees is one pass: tasks score their turns by the trees so far, take the gradients of all
pairs of a relevant and a less relevant candidate, weighted by the change of nDCG that swapping
them would make, and sum gradient, Hessian and count by (model, leaf, column, bin). Spark adds
the sums up; windows over the bins find the best split of each leaf. What comes to the driver is
a split for each leaf. Model i is trained on the turns of the other folds, the last one on all
turns; held-out nDCG stops the folds, and the final model has the mean of their best rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import kept


@dataclass
class Tree:
    """Nodes by number (children of n are 2n + 1 and 2n + 2): the column and the last bin that go left, or -1 and a value."""

    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def stump(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            inner = self.column[at] >= 0
            if not inner.any():
                return at
            c, b = self.column[at], self.bin[at]
            at = np.where(inner, 2 * at + 1 + (bins[rows, np.maximum(c, 0)] > b), at)


@dataclass
class Parameters:
    depth: int = 4
    rounds: int = 30
    early_stop: int = 5
    rate: float = 0.1
    l2: float = 0.1
    least_rows: int = 20
    least_hessian: float = 1e-3
    truncation: int = 30
    top: int = 20
    bins: int = 32


@dataclass
class Ranker:
    columns: list[str]
    cuts: list[list[float]]
    trees: list[list[Tree]]  # of each fold's model, and of the one of all turns
    best: list[int] = field(default_factory=list)  # the folds' best rounds
    gains: list[list[float]] = field(default_factory=list)  # the folds' held-out nDCG by round

    @property
    def final(self) -> list[Tree]:
        return self.trees[-1][: max(1, round(sum(self.best) / len(self.best)))] if self.best else self.trees[-1]


def cuts(rows: DataFrame, columns: list[str], bins: int, even: bool = False) -> list[list[float]]:
    """Upper ends of bins: quantiles of each column by a mergeable sketch, or parts of equal width."""
    if even:
        got = rows.agg(*[F.array(F.min(c), F.max(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return [[] if r[0] is None or r[0] == r[1] else [r[0] + (r[1] - r[0]) * k / bins for k in range(1, bins)] for r in got]
    ends = [k / bins for k in range(1, bins)]
    # a sketch for each column and task goes to one task: tasks are as many as run at once
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    got = rows.agg(*[F.percentile_approx(c, ends, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(r or [])) for r in got]


def grouped(rows: DataFrame, columns: list[str], ends: list[list[float]], extra: tuple = ("fold",)) -> DataFrame:
    """A row for each turn: items, labels, and the candidates' bins one after another (missing values are in bin 0).

    Candidates are put in bins where they are, so that a byte for each column is shuffled.
    """
    import pyarrow as pa

    def binned(batches):
        for batch in batches:
            b = np.empty((batch.num_rows, len(columns)), np.uint8)
            for i, e in enumerate(ends):
                x = batch.column(f"x{i}").to_numpy(zero_copy_only=False)
                b[:, i] = np.where(np.isnan(x), 0, np.searchsorted(e, x, "left"))
            at = np.arange(batch.num_rows + 1, dtype=np.int32) * len(columns)
            bins = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(b)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], bins], names=[*own, "bins"])

    def joined(batches):
        for batch in batches:
            held = batch.column("bins")
            values, at = held.flatten().to_pylist(), np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            bins = pa.array([b"".join(values[i:j]) for i, j in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], bins], names=[*names, "bins"])

    own, names = ["query", *extra, "item", "label"], ["query", *extra, "items", "labels"]
    kinds = "query long, " + "".join(f"{c} int, " for c in extra)
    rows = rows.select(F.col("query").cast("long").alias("query"), *[F.col(c).cast("int").alias(c) for c in extra], F.col("item").cast("long").alias("item"), F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    rows = rows.mapInArrow(binned, kinds + "item long, label double, bins binary")
    turns = rows.groupBy("query").agg(*[F.first(c).alias(c) for c in extra], F.array_sort(F.collect_list(F.struct("item", "label", "bins"))).alias("rows"))
    turns = turns.select("query", *extra, F.col("rows.item").alias("items"), F.col("rows.label").alias("labels"), F.col("rows.bins").alias("bins"))
    return turns.mapInArrow(joined, kinds + "items array<long>, labels array<double>, bins binary")


def gradients(labels: np.ndarray, scores: np.ndarray, truncation: int):
    """(gradient, Hessian) of each candidate of a turn; equal scores stand in the order of the items."""
    g, h = np.zeros(len(labels)), np.zeros(len(labels))
    order = np.argsort(-scores, kind="stable")
    rank = np.empty(len(labels))
    rank[order] = np.arange(1, len(labels) + 1)
    gain = 2.0**labels - 1
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(labels)) + 2)).sum()
    for i in np.flatnonzero(labels > 0):
        below = (labels < labels[i]) & ((rank <= truncation) | (rank[i] <= truncation))
        rho = 1 / (1 + np.exp(scores[i] - scores[below]))
        change = (gain[i] - gain[below]) * np.abs(1 / np.log2(1 + rank[i]) - 1 / np.log2(1 + rank[below])) / ideal
        g[below] += rho * change
        h[below] += rho * (1 - rho) * change
        g[i] -= (rho * change).sum()
        h[i] += (rho * (1 - rho) * change).sum()
    return g, h


def ndcg(labels: np.ndarray, scores: np.ndarray, top: int) -> float:
    gain = 2.0**labels - 1
    place = 1 / np.log2(np.arange(min(top, len(labels))) + 2)
    ideal = (np.sort(gain)[::-1][:top] * place).sum()
    return float((gain[np.argsort(-scores, kind="stable")][:top] * place).sum() / ideal) if ideal else 0.0


def _scored(trees: list[Tree], bins: np.ndarray, scores=None) -> np.ndarray:
    scores = np.zeros(len(bins)) if scores is None else scores.copy()
    for t in trees:
        scores += t.value[t.leaf(bins)]
    return scores


def _read(batch, width: int):
    """(query, fold, items, labels, bins, earlier scores by model) of the turns of a batch."""
    held = batch.column("held") if "held" in batch.schema.names else None
    for i in range(batch.num_rows):
        labels = batch.column("labels")[i].values.to_numpy(zero_copy_only=False)
        bins = np.frombuffer(batch.column("bins")[i].as_py(), np.uint8).reshape(-1, width)
        earlier = None if held is None else np.frombuffer(held[i].as_py(), np.float64).reshape(-1, len(labels))
        yield batch.column("query")[i].as_py(), batch.column("fold")[i].as_py(), batch.column("items")[i].values, labels, bins, earlier


def level(turns: DataFrame, width: int, held_out: list[int], points: list[Parameters], done: list[list[Tree]], growing: list[Tree], nodes: list[set]):
    """(splits, held-out nDCG by model) of the open nodes of the growing trees: one pass over the turns."""
    import pyarrow as pa

    bins_of, models = points[0].bins, len(points)

    def summed(batches):
        sums: dict = {}
        tested: dict = {}
        for batch in batches:
            for _, fold, _, labels, bins, earlier in _read(batch, width):
                cell = bins.astype(np.int64) + np.arange(width) * bins_of
                for m in range(models):
                    if not nodes[m]:
                        continue
                    scores = _scored(done[m], bins, None if earlier is None else earlier[m])
                    if fold is not None and held_out[m] == fold:
                        if labels.any():
                            n, total = tested.get(m, (0, 0.0))
                            tested[m] = (n + 1, total + ndcg(labels, scores, points[m].top))
                        continue
                    at = growing[m].leaf(bins)
                    mine = nodes[m].intersection(at.tolist())
                    g, h = gradients(labels, scores, points[m].truncation) if mine else (None, None)
                    for node in mine:
                        ok = at == node
                        cells = cell[ok].ravel()
                        held = sums.setdefault((m, node), np.zeros((3, width * bins_of)))
                        for k, x in enumerate((g, h, np.ones(len(g)))):
                            held[k] += np.bincount(cells, np.repeat(x[ok], width), width * bins_of)
        for (m, node), (g, h, n) in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), m), pa.int32()), pa.array(np.full(len(some), node), pa.int32()), pa.array(some // bins_of, pa.int32()), pa.array(some % bins_of, pa.int32()), pa.array(g[some]), pa.array(h[some]), pa.array(n[some])], names=["model", "node", "col", "bin", "g", "h", "n"])
        for m, (n, total) in tested.items():
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([0], pa.int32()), pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([total]), pa.array([0.0]), pa.array([float(n)])], names=["model", "node", "col", "bin", "g", "h", "n"])

    cells = turns.mapInArrow(summed, "model int, node int, col int, bin int, g double, h double, n double")
    cells = cells.groupBy("model", "node", "col", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    best = splits(cells, points).collect()  # a row for each open node of each model
    return [r for r in best if r["col"] >= 0], {r["model"]: r["gain"] for r in best if r["col"] < 0}


def splits(cells: DataFrame, points: list[Parameters]) -> DataFrame:
    """(model, node, col, bin, gain, left, right) of each node's best split, from sums by bin; equal gains go to the
    first column and bin. A node without one has bin -1 and its value as left. Held-out sums (col -1) pass as means."""
    of = lambda name: F.element_at(F.array(*[F.lit(float(getattr(p, name))) for p in points]), F.col("model") + 1)
    leaf = lambda g, h: -g / (h + of("l2")) * of("rate")
    worth = lambda g, h: g * g / (h + of("l2"))
    column = Window.partitionBy("model", "node", "col")
    x = cells  # one flow for all: the pass behind the cells runs once
    for c in ("g", "h", "n"):
        x = x.withColumn(f"l{c}", F.sum(c).over(column.orderBy("bin"))).withColumn(f"t{c}", F.sum(c).over(column))
    x = x.withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in ("g", "h", "n")})
    gain = F.round(worth(F.col("lg"), F.col("lh")) + worth(F.col("rg"), F.col("rh")) - worth(F.col("tg"), F.col("th")), 9)
    fits = (F.least("ln", "rn") >= of("least_rows")) & (F.least("lh", "rh") >= of("least_hessian")) & (gain > 0) & (F.col("col") >= 0)
    x = x.withColumn("gain", F.when(fits, gain))
    best = F.max(F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("col")).alias("c"), (-F.col("bin")).alias("b"), "lg", "lh", "rg", "rh")))
    test = (F.col("col") < 0).alias("test")
    out = x.groupBy("model", "node", test).agg(best.alias("s"), F.max(F.struct((-F.col("col")).alias("c"), "tg", "th", "tn")).alias("t"))
    some = F.col("s").isNotNull()
    pick = lambda held, split, none: F.when(F.col("test"), held).when(some, split).otherwise(none).cast("double")
    return out.select("model", "node", pick(F.lit(-1), -F.col("s.c"), F.lit(0)).cast("int").alias("col"), pick(F.lit(0), -F.col("s.b"), F.lit(-1)).cast("int").alias("bin"), pick(F.col("t.tg") / F.col("t.tn"), F.col("s.gain"), F.lit(0)).alias("gain"), pick(F.lit(0), leaf(F.col("s.lg"), F.col("s.lh")), leaf(F.col("t.tg"), F.col("t.th"))).alias("left"), pick(F.lit(0), leaf(F.col("s.rg"), F.col("s.rh")), F.lit(0)).alias("right"))


def _carried(turns: DataFrame, width: int, models: int, done: list[list[Tree]]) -> DataFrame:
    """turns with the scores that the trees so far give, written: later passes start there."""
    import pyarrow as pa

    def scored(batches):
        for batch in batches:
            held = [np.stack([_scored(done[m], bins, None if earlier is None else earlier[m]) for m in range(models)]).tobytes() for *_, bins, earlier in _read(batch, width)]
            names = ["query", "fold", "items", "labels", "bins"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(held, pa.binary())], names=[*names, "held"])

    return kept(turns.select("query", "fold", "items", "labels", "bins", *(["held"] if "held" in turns.columns else [])).mapInArrow(scored, "query long, fold int, items array<long>, labels array<double>, bins binary, held binary"))


def fit(rows: DataFrame, columns: list[str], folds: int, points: list[Parameters], *, even: bool = False, carry: int = 8) -> tuple[list[Ranker], DataFrame]:
    """A ranker for each point, of rows (query, item, label, fold, columns), and the turns in bins.

    All points have the same number of bins. Turns without a relevant candidate teach nothing.
    After ``carry`` rounds the scores are written, so that a pass goes through so many trees at most.
    """
    if len({p.bins for p in points}) != 1 or not 1 < points[0].bins <= 256:
        raise ValueError("all points have the same number of bins, 2 to 256")
    ends = cuts(rows, columns, points[0].bins, even)
    turns = state = kept(grouped(rows, columns, ends), free=True)
    width, each = len(columns), folds + 1
    own = [p for p in points for _ in range(each)]
    held_out = [f if f < folds else -1 for _ in points for f in range(each)]
    out = [Ranker(columns, ends, [[] for _ in range(each)], [], [[] for _ in range(folds)]) for _ in points]
    since: list[list[Tree]] = [[] for _ in own]
    live = set(range(len(own)))
    for r in range(max(p.rounds for p in points) + 1):
        grown = {m for m in live if r < own[m].rounds}
        growing = [Tree.stump(p.depth) for p in own]
        nodes = [{0} if m in live else set() for m in range(len(own))]
        for d in range(max((own[m].depth for m in grown), default=1)):
            found, tests = level(state, width, held_out, own, since, growing, nodes)
            if d == 0:
                for m, gain in tests.items():
                    gains = out[m // each].gains[m % each]
                    gains.append(gain)
                    if len(gains) - 1 - int(np.argmax(gains)) >= own[m].early_stop:
                        live.discard(m)
                live &= grown
                # a point's final model is grown as long as one of its folds is
                live -= {i * each + folds for i in range(len(points)) if folds and not any(i * each + f in live for f in range(folds))}
            nodes = [set() for _ in own]
            for s in found:
                m, n = s["model"], s["node"]
                if m not in live:
                    continue
                t = growing[m]
                if s["bin"] < 0:
                    t.value[n] = s["left"]
                    continue
                t.column[n], t.bin[n] = s["col"], s["bin"]
                t.value[2 * n + 1], t.value[2 * n + 2] = s["left"], s["right"]
                if d + 1 < own[m].depth:
                    nodes[m].update((2 * n + 1, 2 * n + 2))
            if not any(nodes):
                break
        if not live:
            break
        for m in live:
            since[m].append(growing[m])
            out[m // each].trees[m % each].append(growing[m])
        if (r + 1) % carry == 0:
            state, since = _carried(state, width, len(own), since), [[] for _ in own]
    for x in out:
        x.best = [max(1, int(np.argmax(g))) if g else 1 for g in x.gains]
    return out, turns


def scored(ranker: Ranker, turns: DataFrame) -> DataFrame:
    """(query, item, label, fold, score, final_score): by the model of the other folds at its best round, and by the final one."""
    import pyarrow as pa

    width, best = len(ranker.columns), [t[:n] for t, n in zip(ranker.trees, ranker.best)]
    final = ranker.final

    def run(batches):
        for batch in batches:
            for query, fold, items, labels, bins, _ in _read(batch, width):
                n = len(labels)
                own = _scored(best[fold], bins) if fold is not None and fold < len(best) else np.zeros(n)
                yield pa.RecordBatch.from_arrays([pa.array([query] * n, pa.int64()), items, pa.array(labels), pa.array([fold] * n, pa.int32()), pa.array(own), pa.array(_scored(final, bins))], names=["query", "item", "label", "fold", "score", "final_score"])

    return turns.mapInArrow(run, "query long, item long, label double, fold int, score double, final_score double")


def saved(spark, ranker: Ranker, at: str) -> None:
    """The final model as two tables: nodes of its trees, and columns in their order with their bins' ends."""
    nodes = [(i, n, int(t.column[n]), int(t.bin[n]), float(t.value[n])) for i, t in enumerate(ranker.final) for n in range(len(t.column))]
    spark.createDataFrame(nodes, "tree int, node int, col int, bin int, value double").coalesce(1).write.parquet(f"{at}/nodes")
    spark.createDataFrame([(i, c, list(map(float, e))) for i, (c, e) in enumerate(zip(ranker.columns, ranker.cuts))], "place int, name string, cuts array<double>").coalesce(1).write.parquet(f"{at}/columns")


def loaded(spark, at: str, columns: list[str]) -> Ranker:
    """A saved model; an error if it was trained on other columns or in another order."""
    held = spark.read.schema("place int, name string, cuts array<double>").parquet(f"{at}/columns").orderBy("place").collect()
    if [r["name"] for r in held] != list(columns):
        raise ValueError("the model was trained on other columns")
    trees: list[Tree] = []
    rows = spark.read.schema("tree int, node int, col int, bin int, value double").parquet(f"{at}/nodes").orderBy("tree", "node").collect()
    for i in sorted({r["tree"] for r in rows}):
        mine = [r for r in rows if r["tree"] == i]
        trees.append(Tree(np.array([r["col"] for r in mine]), np.array([r["bin"] for r in mine]), np.array([r["value"] for r in mine])))
    return Ranker(list(columns), [list(r["cuts"]) for r in held], [trees])
