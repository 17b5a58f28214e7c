"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Every line has a hash. A rolling hash over the last ``window`` line hashes ends a chunk where it
is 0 modulo ``mean``, so that inserted lines shift no later boundary. A chunk with ``least``
lines that hold a word, or more, is removed where it occurs again, in any document; its first
occurrence (least doc_id, then place) stays. Equal hashes only name candidates: equal bytes
decide. Single lines stay, however often they occur.

Null texts stay null and texts of one line stay as they are, as do rows without a doc_id. Rows
that repeat a doc_id are told apart by their text; if that is equal too they are judged alike.
Extra columns pass through (names that begin with ``_ld_`` are the operator's own). A text that
loses all its chunks is empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import util

WORDED = "[^ \\t\\x0B\\f\\r]"


def chunks(text: Column, window: int, mean: int) -> Column:
    """array<struct<n, worded, body>> of a text, in one pass over its lines; joined by line ends the bodies are the text."""
    last = F.array().cast("array<bigint>")
    done = F.array().cast("array<struct<n:int,worded:int,body:string>>")
    start = F.struct(last.alias("last"), F.lit(0).alias("n"), F.lit(0).alias("worded"), F.lit("").alias("body"), done.alias("done"))

    def step(acc, line):
        h = F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")
        return F.struct(F.slice(F.concat(F.array(h), acc["last"]), 1, window).alias("last"), (acc["n"] + 1).alias("n"), (acc["worded"] + line.rlike(WORDED).cast("int")).alias("worded"), F.when(acc["n"] == 0, line).otherwise(F.concat(acc["body"], F.lit("\n"), line)).alias("body"), acc["done"].alias("done"))

    def close(acc):
        # the oldest hash first; the window is short, so the array is reversed in place
        rolled = F.aggregate(F.reverse(acc["last"]), F.lit(0).cast("bigint"), lambda a, x: a * 65599 + x)
        whole = F.struct(acc["n"].alias("n"), acc["worded"].alias("worded"), acc["body"].alias("body"))
        cut = F.struct(acc["last"].alias("last"), F.lit(0).alias("n"), F.lit(0).alias("worded"), F.lit("").alias("body"), F.concat(acc["done"], F.array(whole)).alias("done"))
        return F.when(F.pmod(rolled, F.lit(mean)) == 0, cut).otherwise(acc)

    def both(acc, line):
        # one-element arrays name the stepped state, so that it is computed once
        return F.element_at(F.transform(F.array(step(acc, line)), close), 1)

    def finish(acc):
        rest = F.array(F.struct(acc["n"].alias("n"), acc["worded"].alias("worded"), acc["body"].alias("body")))
        return F.when(acc["n"] > 0, F.concat(acc["done"], rest)).otherwise(acc["done"])

    return F.aggregate(F.split(text, "\n", -1), start, both, finish)


def _chunked(docs: DataFrame, window: int, mean: int) -> DataFrame:
    own = docs.withColumn("_ld_id", F.col("doc_id").cast("long")).withColumn("_ld_key", F.xxhash64(F.col("text").cast("string")))
    many = F.col("_ld_id").isNotNull() & F.col("text").contains("\n")
    return own.withColumn("_ld_chunks", F.when(many, chunks(F.col("text").cast("string"), window, mean)))


def deduplicated(docs: DataFrame, *, window: int = 2, mean: int = 3, least: int = 2) -> tuple[DataFrame, list[str]]:
    """docs with its text rewritten, and _ld_n_lines, _ld_gone_lines and _ld_gone_chunks; the staged tables behind it."""
    key = ["_ld_id", "_ld_key"]
    cells = _chunked(docs.select("doc_id", "text"), window, mean).select(*key, F.posexplode("_ld_chunks").alias("place", "c")).where(F.col("c.worded") >= least)
    cells = cells.select(*key, "place", F.xxhash64("c.body").alias("h"), F.col("c.body").alias("body"))
    # hashes alone first: a chunk's bytes move only if its hash occurs twice
    marks, mark_path = util.staged(cells.drop("body"), "marks")
    often = marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    found = marks.join(often, "h", "left_semi").groupBy(*key).agg(F.collect_set("place").alias("places"))
    found, found_path = util.staged(found.select(F.col("_ld_id").alias("_i"), F.col("_ld_key").alias("_k"), "places"), "found")
    own = docs.select("doc_id", "text").withColumn("_ld_key", F.xxhash64(F.col("text").cast("string")))
    # what is found grows with the texts: never broadcast, and the same plan at every size
    texts = own.join(found.hint("merge"), (F.col("doc_id").cast("long") == F.col("_i")) & (F.col("_ld_key") == F.col("_k"))).select("doc_id", "text", "places")
    texts = _chunked(texts, window, mean).select(*key, "places", F.posexplode("_ld_chunks").alias("place", "c")).where(F.array_contains("places", F.col("place")))
    texts, text_path = util.staged(texts.select(*key, "place", F.xxhash64("c.body").alias("h"), F.col("c.body").alias("chunk")), "chunks")
    # equal bytes: one row for each different chunk, with its first occurrence
    first = texts.groupBy("h", "chunk").agg(F.min(F.struct(*key, "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("h").alias("fh"), F.col("chunk").alias("fc"), "first")
    again = texts.join(first, (F.col("h") == F.col("fh")) & (F.col("chunk") == F.col("fc"))).where(F.struct(*key, "place") != F.col("first"))
    gone = again.groupBy(*key).agg(F.collect_set("place").alias("_ld_gone"))
    gone, gone_path = util.staged(gone.select(F.col("_ld_id").alias("_ld_i"), F.col("_ld_key").alias("_ld_k"), "_ld_gone"), "gone")

    own = docs.withColumn("_ld_id", F.col("doc_id").cast("long")).withColumn("_ld_key", F.xxhash64(F.col("text").cast("string")))
    own = own.join(gone.hint("merge"), (F.col("_ld_id") == F.col("_ld_i")) & (F.col("_ld_key") == F.col("_ld_k")), "left")
    # only texts that lose chunks are cut again: what stays, and how many lines go
    cut = F.aggregate(chunks(F.col("text").cast("string"), window, mean), F.struct(F.lit(0).alias("k"), F.lit(0).alias("lines"), F.array().cast("array<string>").alias("kept")), lambda a, c: F.struct((a["k"] + 1).alias("k"), (a["lines"] + F.when(F.array_contains("_ld_gone", a["k"]), c["n"]).otherwise(0)).alias("lines"), F.when(F.array_contains("_ld_gone", a["k"]), a["kept"]).otherwise(F.concat(a["kept"], F.array(c["body"]))).alias("kept")), lambda a: F.struct(a["lines"].alias("lines"), F.array_join(a["kept"], "\n").alias("text")))
    own = own.withColumn("_ld_cut", F.when(F.col("_ld_gone").isNotNull(), cut))
    lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    out = own.withColumn("_ld_n_lines", lines.cast("long")).withColumn("_ld_gone_lines", F.coalesce(F.col("_ld_cut.lines"), F.lit(0)).cast("long")).withColumn("_ld_gone_chunks", F.when(F.col("_ld_gone").isNull(), 0).otherwise(F.size("_ld_gone")).cast("long"))
    out = out.withColumn("text", F.when(F.col("_ld_cut").isNotNull(), F.col("_ld_cut.text")).otherwise(F.col("text")))
    return out.drop("_ld_id", "_ld_key", "_ld_i", "_ld_k", "_ld_gone", "_ld_cut"), [mark_path, found_path, text_path, gone_path]


def op6(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, gone_lines, gone_chunks and the md5 of the text that is left."""
    out, paths = deduplicated(util.documents(spark, sf_dir).select("doc_id", "text"))
    out = out.select("doc_id", F.col("_ld_n_lines").alias("n_lines"), F.col("_ld_gone_lines").alias("gone_lines"), F.col("_ld_gone_chunks").alias("gone_chunks"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))
    return util.result(out, *paths)


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE contains(text, chr(10))),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
c AS (SELECT *, (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 65599 + h) % 3 = 0 AS cut FROM h),
p AS (SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM c),
k AS (SELECT doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n,
        count(*) FILTER (WHERE regexp_matches(line, '[^ \\t\\x0B\\f\\r]')) AS worded FROM p GROUP BY doc_id, place),
f AS (SELECT *, worded >= 2 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone FROM k),
d AS (SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept,
        coalesce(sum(n) FILTER (WHERE gone), 0) AS gone_lines, count(*) FILTER (WHERE gone) AS gone_chunks FROM f GROUP BY doc_id)
SELECT documents.doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(gone_lines, 0) AS BIGINT) AS gone_lines,
  CAST(coalesce(gone_chunks, 0) AS BIGINT) AS gone_chunks, md5(coalesce(kept, text)) AS kept_md5
FROM documents LEFT JOIN d USING (doc_id)
"""
