"""Quality rules whose cutoffs are risk-controlled.

Base rules are fixed. Beyond them, each ratio rule rejects a text whose ratio exceeds a cutoff,
and the cutoff is chosen per stratum on labelled texts: a cutoff is allowed when the exact
binomial tail says that good texts lie above it less often than ``risk``, at the level ``error``
divided by all tests made (strata x rules x cutoffs, as Bonferroni). The lowest allowed cutoff
counts; where none is allowed, the rule rejects nothing there. The guarantee covers each rule in
each stratum; ``risk`` is the limit of all rules together and each has an equal share of it.

Labels of held-out rows (crc32 of the id mod 4 is 2) are never read. A null text has no words
and fails the base; a null stratum is a stratum of its own; labels that disagree on one doc_id
each count once; without labels only the base rules hold. Rows that repeat a doc_id are each
judged, and are one trial of a stratum, at the largest of their ratios. Columns of docs other
than those named are passed on by ``judged`` and never read; names that begin with ``_`` and
are the operator's own (``_kept``, ``_base_failed``, ``_n_words`` and the like) must not be among them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import util

#: fixed values: the counted symbols, and the characters that part words
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_marks", "n_lines", "top_word", "n_distinct", "n_digits"]
#: what the rules compare with their cutoffs: count, by what it is divided
RULES = {"symbols": ("n_symbols", "word_chars"), "upper": ("n_upper", "word_chars"), "marks": ("n_marks", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "top_word": ("top_word", "n_words")}
GRID = [0.05, 0.08, 0.12, 0.18, 0.27, 0.4, 0.6, 0.9]


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of one whole text."""
    if not text:
        return (0,) * 11
    words = text.encode().split()  # bytes split at the ASCII blanks only
    n = len(words)
    if not n:
        return (0,) * 11
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        met: set[str] = set()
        lines = [x for x in lines if x.strip(BLANKS)]
        for x in lines:
            dup += x in met
            met.add(x)
    repeated = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        if len(set(grams)) < n - 2:
            once: set = set()
            twice: set = set()
            for g in grams:
                (twice if g in once else once).add(g)
            reach = 0
            for i, g in enumerate(grams):
                if g in twice:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    often = Counter(words)
    return (n, chars, sum(map(text.count, SYMBOLS)), dup, repeated, upper, text.count("!") + text.count("?"), len(lines), max(often.values()), len(often), sum(map(text.count, "0123456789")))


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with the counts of its text."""
    import pyarrow as pa

    names = COUNTS + MORE
    # the text is read from a copy at the end, so that it can be among the columns that pass through
    own = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("_text"))

    def rows(batches):
        util.lean()
        for batch in batches:
            found = [text_counts(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *(f"_{n}" for n in names)])

    util.settle(docs.sparkSession)
    kinds = dict((f.name, f.dataType.simpleString()) for f in own.schema.fields)
    return own.mapInArrow(rows, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"_{n} long" for n in names)]))


def _stirling(n: float) -> float:
    """What log n! has beyond (n + 1/2) log n - n + log(2 pi) / 2."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    x = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x)) / x) / x) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without the cancellation near the mean."""
    d = (x - mean) / (x + mean)
    if abs(d) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, power, i = (x - mean) * d, 2 * x * d, 1
    while True:
        power *= d * d
        i += 2
        more = total + power / i
        if more == total:
            return total
        total = more


def point(k: int, n: int, p: float) -> float:
    """P(exactly k of n) at the rate p, to some units in the last places at every n."""
    if k < 0 or k > n:
        return 0.0
    if k == 0:
        return math.exp(n * math.log1p(-p))
    if k == n:
        return math.exp(n * math.log(p))
    log = _stirling(n) - _stirling(k) - _stirling(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def _sum(first: float, ratios) -> float:
    """first * (1 + r1 + r1 r2 + ...) of falling ratios, given in blocks, until the terms no longer count."""
    total, term = 1.0, 1.0
    for r in ratios:
        terms = term * np.cumprod(r)
        total += float(terms.sum())
        term = float(terms[-1])
        if term < 1e-18 * total:
            break
    return first * total


def tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) at the rate p: the Clopper-Pearson bound is the p at which this is its level. All terms that count are summed."""
    if k >= n:
        return 1.0
    if k <= n * p:
        steps = ((a, max(a - 4096, 0)) for a in range(k, 0, -4096))
        return min(1.0, _sum(point(k, n, p), ((i := np.arange(a, z, -1, dtype=np.float64)) * (1 - p) / ((n - i + 1) * p) for a, z in steps)))
    steps = ((a, min(a + 4096, n)) for a in range(k + 1, n, 4096))
    return max(0.0, 1.0 - _sum(point(k + 1, n, p), ((n - (i := np.arange(a, z, dtype=np.float64))) * p / ((i + 1) * (1 - p)) for a, z in steps)))


def base_failed():
    return (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))


def _ratio(rule: str):
    over, under = RULES[rule]
    return F.col(f"_{over}") / F.greatest(F.col(f"_{under}"), F.lit(1))


def cutoffs(counts: DataFrame, labels: DataFrame, stratum: str, risk: float, error: float) -> DataFrame:
    """_stratum and, for each rule, its cutoff (null: the rule rejects nothing there)."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    seen = counts.where(~util.held_out() & ~base_failed()).select("doc_id", F.col(stratum).cast("string").alias("_stratum"), *[_ratio(r).alias(r) for r in RULES])
    # rows that share a doc_id are one trial in a stratum, with the largest of their ratios
    seen = seen.join(good, "doc_id").groupBy("doc_id", "_stratum").agg(*[F.max(r).alias(r) for r in RULES])
    # one partial aggregate: for each stratum and rule, how many good texts lie above each cutoff
    sums = [F.array(*[F.sum((F.col(r) > c).cast("long")) for c in GRID]).alias(r) for r in RULES]
    totals = seen.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
    totals = totals.withColumn("tests", F.lit(len(RULES) * len(GRID)) * F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    share = risk / len(RULES)

    def choose(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for x in f.itertuples(index=False):
                found = [x[0]]
                for at in range(len(RULES)):
                    above = x[2 + at]
                    allowed = [c for c, k in zip(GRID, above) if tail(int(k), int(x[1]), share) <= error / x[-1]]
                    found.append(min(allowed, default=None))
                rows.append(found)
            yield pd.DataFrame(rows, columns=["_stratum", *(f"_cut_{r}" for r in RULES)])

    return totals.mapInPandas(choose, "_stratum string, " + ", ".join(f"_cut_{r} double" for r in RULES))


def judged(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = 0.04, error: float = 0.05, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The columns keep of docs (doc_id alone, unless told), the counts as _names, _base_failed and _kept; the staged tables behind it."""
    if clash := set(keep or []) & {"_kept", "_base_failed", "_text", "_of", *(f"_{n}" for n in COUNTS + MORE)}:
        raise ValueError(f"columns with the operator's own names: {sorted(clash)}")
    narrow = list(dict.fromkeys(["doc_id", stratum]))
    keep = list(dict.fromkeys([*narrow, *(keep or [])]))
    own = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    counts, count_path = util.staged(counted(own, narrow), "counts")
    cuts, cut_path = util.staged(cutoffs(counts, labels, stratum, risk, error), "cutoffs")
    # texts that pass through are counted again where they are, rather than moved to their counts
    source = counts if keep == narrow else counted(own, keep)
    # one row for each stratum; Spark broadcasts it only below its own size limit
    out = source.join(cuts.withColumnRenamed("_stratum", "_of"), F.col(stratum).cast("string").eqNullSafe(F.col("_of")), "left").drop("_of")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(_ratio(r) > F.col(f"_cut_{r}"), F.lit(False))
    out = out.withColumn("_base_failed", base_failed()).withColumn("_kept", ~F.col("_base_failed") & ~bad)
    return out.drop(*[f"_cut_{r}" for r in RULES]), [count_path, cut_path]


def op8(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out, paths = judged(util.documents(spark, sf_dir), labels)
    out = out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in COUNTS], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))
    return util.result(out, *paths)
