"""Names that occur in texts: candidates by an equi-join on short pieces, confirmed by the whole name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mentions(texts: DataFrame, names: DataFrame, column: str = "text", piece: int = 4) -> DataFrame:
    """The columns of texts (without column) and name, for every name that its text holds anywhere, in lower case.

    A name is found by its first ``piece`` characters (all of a shorter one), which meet the
    text's own pieces of that length: linear in the texts, whatever the number of names. What
    travels is a checksum of the text with a piece; the text itself meets only the names whose
    piece it holds, and the whole name decides (texts of one checksum share candidates, no more).
    Null texts and null or empty names match nothing; equal rows of texts stay apart.
    """
    keyed = names.select(F.lower("name").alias("name")).where("name != ''").distinct().withColumn("_key", F.substring("name", 1, piece))
    sizes = [r[0] for r in keyed.select(F.length("_key")).distinct().collect()]  # piece values at most
    low = F.col("_low")
    # every place's next k characters; a substring by place would read the text from its start each time
    cut = lambda k: F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    pieces = F.array_distinct(F.concat(*[cut(k) for k in sizes])) if sizes else F.array().cast("array<string>")
    rows = texts.withColumn("_low", F.lower(F.col(column))).withColumn("_text", F.xxhash64("_low"))
    near = rows.select("_text", F.explode(pieces).alias("_key")).join(keyed, "_key").select("_text", "name").distinct()
    return rows.join(near, "_text").where(low.contains(F.col("name"))).drop("_text", "_low", column)


def greedy(texts: DataFrame, names: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys and name: longest names first, and what a name has matched is blanked for the next ones."""
    found = mentions(texts.select(*keys, column, F.col(column).alias("_whole")), names, column)
    hits = found.groupBy(*keys, "_whole").agg(F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("n"), "name"))).alias("names"))
    start = F.struct(F.lower("_whole").alias("left"), F.array().cast("array<string>").alias("found"))
    blank = lambda a, x: F.struct(F.replace(a["left"], x["name"], F.lit(" ")).alias("left"), F.concat(a["found"], F.array(x["name"])).alias("found"))
    step = lambda a, x: F.when(F.instr(a["left"], x["name"]) > 0, blank(a, x)).otherwise(a)
    return hits.select(*keys, F.explode(F.aggregate("names", start, step)["found"]).alias("name"))
