"""Chat formatting from every participant's side, in DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that speaker as assistant
and all others as named users; system turns stay system turns and take no part. A dialogue is a
sequence of segments, one row for each turn and side: its text, its place in the rendered
dialogue (start, length, in characters) and, for the assistant's turns, the range to learn from
(the words and the end mark, without the header). Segments in order are the dialogue: a very
long one is never gathered in one row or task. Places are sums within ranges of turns, plus the
sums of the ranges before.

Turns are ordered by turn, speaker and text, nulls first; turns that are equal in all three are
interchangeable. A null speaker is named ``unknown``, a null text is empty, and turns without a
conversation id are one conversation. A conversation of system turns alone has no participant
and gives no rows, as an empty table does. Extra columns aren't read. Texts stay as they are,
marks such as ``<|end|>`` in them too: places and masks go by length and never search for marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import util

#: fixed format
END = "<|end|>"


def rotated(turns: DataFrame, *, conversation: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text", system: str = "system") -> tuple[DataFrame, list[str]]:
    """conv_id, perspective, turn, position, role, name, start, length, mask_start, mask_end, segment."""
    n = util.parts(turns)
    own = turns.select(F.col(conversation).alias("conv_id"), F.col(order).alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    by = ["conv_id", "turn", "speaker", "text"]
    ranged = own.repartitionByRange(n, *by).sortWithinPartitions(*by)
    # the ranges are drawn once and written, so that each row keeps its range
    ranged, path = util.staged(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    sides = ranged.where(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = ranged.join(sides, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(F.col("speaker") == system, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    rows = rows.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    header = F.concat(F.lit("<|"), F.col("role"), F.lit("|>"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("head", F.length(header)).withColumn("segment", F.concat(header, F.col("text"), F.lit(END + "\n"))).withColumn("length", F.length("segment").cast("long")).drop("text")
    within = Window.partitionBy("conv_id", "perspective", "part").orderBy("at")
    rows = rows.withColumn("inside", F.sum("length").over(within) - F.col("length")).withColumn("nth", F.row_number().over(within))
    sizes = ranged.join(sides, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("role", role)
    width = F.length(F.col("role")) + F.lit(5 + len(END) + 1) + F.when(F.col("role") == "user", F.length("speaker") + 6).otherwise(0) + F.length("text")
    sizes = sizes.groupBy("conv_id", "perspective", "part").agg(F.sum(width).cast("long").alias("size"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part")
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("b"), (F.sum("size").over(before) - F.col("size")).alias("ahead"), (F.sum("n").over(before) - F.col("n")).alias("nth_ahead"))
    out = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("b")))
    start = F.col("inside") + F.col("ahead")
    learn = F.col("role") == "assistant"
    out = out.select("conv_id", "perspective", "turn", (F.col("nth") + F.col("nth_ahead")).cast("long").alias("position"), "role", "name", start.alias("start"), "length", F.when(learn, start + F.col("head")).alias("mask_start"), F.when(learn, start + F.col("length") - 1).alias("mask_end"), "segment")
    return out, [path]


def op7(spark, sf_dir: str) -> DataFrame:
    out, paths = rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return util.result(out, *paths)


ORACLE = """
WITH s AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
r AS (SELECT c.conv_id, perspective, turn, role AS speaker, text,
        CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM conversations c JOIN s USING (conv_id)),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
        '<|' || role || '|>' || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, CAST(row_number() OVER w AS BIGINT) AS position, CAST(sum(length(segment)) OVER w AS BIGINT) - length(segment) AS start
      FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, position, role, name, start, CAST(length(segment) AS BIGINT) AS length,
  CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN start + length(segment) - 1 END AS mask_end, segment
FROM o
"""
