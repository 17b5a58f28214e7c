"""The corpus pipeline: quality rules, line dedup, near-dedup, repeated passages, packing.

STAGES holds (name, function) pairs. Each function takes (spark, docs, sf_dir) and gives a
DataFrame that is written as Parquet and read again as the next one's docs; all but the last
give the columns of ``documents``. Rows without a text pass the stages after the first, which
rejects them; rows without a doc_id are left alone by the stages that compare documents.

What a stage has staged for itself goes when the next stage of the same thread begins, as its
result is written then. Columns beside those of ``documents`` may have any names: operators see
them under others.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import linededup, minhash, packing, quality_rules, suffixes, util

#: bytes of a repeated passage, in the fourth stage
PASSAGE = 100


#: columns that operators read by name
READ = ("doc_id", "text", "lang", "source", "n_chars")

#: staged tables behind the result that the latest stage of this thread gave
_LEFT = threading.local()


def _begin(spark, *paths: str) -> None:
    """Earlier staged tables go; these go next."""
    util.drop(spark, *getattr(_LEFT, "paths", ()))
    _LEFT.paths = paths


def _plain(stage):
    """The stage on docs whose other columns have names that no operator uses; they get their own back."""

    @functools.wraps(stage)
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*[c if c in READ else f"extra_{i}" for i, c in enumerate(names)]), sf_dir).toDF(*names)

    return run


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars of the text as it is now."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@_plain
def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and risk-controlled cutoffs keep."""
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out, paths = quality_rules.judged(docs, labels, keep=docs.columns)
    _begin(spark, *paths)
    return out.where("_kept").select(*docs.columns)


@_plain
def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that occurred before; those of which nothing is left go."""
    _begin(spark)
    out, paths = linededup.deduplicated(docs)
    _begin(spark, *paths)
    out = out.where("NOT (_ld_gone_chunks > 0 AND text = '')")
    return _columns(out, docs)


@_plain
def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five words, similarity 0.8."""
    _begin(spark)
    found = minhash.near_duplicates(docs, width=5, threshold=0.8, rows=6)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


@_plain
def passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller doc_id holds too; those of which nothing is left go."""
    _begin(spark)
    out, paths = suffixes.deduplicated(docs, length=PASSAGE, keep=docs.columns)
    _begin(spark, *paths)
    out = out.where("NOT (_n_removed > 0 AND coalesce(_kept, text) = '')")
    return _columns(out.withColumn("text", F.coalesce("_kept", "text")), docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 1024, with the ids as little-endian unsigned 32-bit bytes."""
    _begin(spark)
    return packing.packed(docs.select("doc_id", "text"), with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near), ("repeated passages", passages), ("packing", pack)]

#: SQL can't express the quality rules' exact tails nor the packing
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs, before = util.documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs, path = util.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        util.drop(spark, *before)
        before = [path]
    return util.result(STAGES[-1][1](spark, docs, sf_dir), *before)
