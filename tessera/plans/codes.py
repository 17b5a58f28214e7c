"""Codes of items in sequences, training rows and constrained decoding (J5, J12, J13, J19).

A code has two levels: the nearest of the labels' mean vectors, and the nearest of the mean
residuals of eight groups of items. Both engines make this codebook from the embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import codebook
from tessera.plans.base import CAT, PLAYS, VECS, query
from tessera.sources import tables as t
from tessera.sources.staging import kept


def made(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """codes(item, l0, l1, v) and the centroids of both levels."""
    codes, first, second = codebook.one_step(t.vectors(spark, d), F.col("l0"), F.col("item") % 8)
    return kept(codes), kept(first), kept(second)


def _nearest_sql(rows: str, centres: str, out: str) -> str:
    return f"{out} AS (SELECT item, v, code, c FROM {rows}, {centres} QUALIFY row_number() OVER (PARTITION BY item ORDER BY round(list_distance(v, c), 9), code) = 1)"


def _means_sql(rows: str, by: str, out: str) -> str:
    return f"{out} AS (SELECT code, list(a ORDER BY i) AS c FROM (SELECT code, i, avg(x) AS a FROM (SELECT {by} AS code, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {rows}) GROUP BY 1, 2) GROUP BY 1)"


CODES = ", ".join([
    "un AS (SELECT item, l0, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) AS v FROM vecs)",
    _means_sql("un", "l0", "c0"), _nearest_sql("un", "c0", "n0"),
    "rs AS (SELECT item, code AS l0, v AS u, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS v FROM n0)",
    _means_sql("rs", "item % 8", "c1"), _nearest_sql("rs", "c1", "n1"),
    "codes AS (SELECT item, rs.l0, n1.code AS l1, rs.u AS v FROM rs JOIN n1 USING (item))",
])
_CODE = "l0 || '_' || l1"


def _named(codes: DataFrame) -> DataFrame:
    return codes.select("item", F.concat_ws("_", F.col("l0").cast("string"), F.col("l1").cast("string")).alias("code"))


@query("j5_sequences", f"SELECT session, string_agg({_CODE}, ' ' ORDER BY pos) AS codes, count(*) AS n FROM plays JOIN codes USING (item) GROUP BY 1 HAVING count(*) >= 3", PLAYS, VECS, CODES)
def j5(spark, d):
    """A session's codes in the order of its plays; items without a vector have none."""
    rows = t.plays(spark, d).join(_named(made(spark, d)[0]), "item").groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("c"))
    return rows.where(F.size("c") >= 3).select("session", F.array_join("c", " ").alias("codes"), F.size("c").cast("long").alias("n"))


#: fixed values: blocks of history in a prompt, and its characters
BLOCKS, BUDGET = 6, 160
REACTION = {"MOVES": "liked", "DOES_NOT": "rejected"}

_BLOCK = "'[T' || pos || '] REC: ' || name || ' | REACTION: ' || CASE label WHEN 'MOVES' THEN 'liked' WHEN 'DOES_NOT' THEN 'rejected' ELSE 'unknown' END"
_FIT = f"list_reduce(list_prepend({{'used': 0::BIGINT, 'kept': []::VARCHAR[], 'b': ''}}, list_transform(before, lambda b: {{'used': 0::BIGINT, 'kept': []::VARCHAR[], 'b': b}})), lambda a, x: CASE WHEN a.used + length(x.b) < {BUDGET} THEN {{'used': a.used + length(x.b) + 1, 'kept': list_prepend(x.b, a.kept), 'b': ''}} ELSE a END).kept"


@query("j12_instruction_rows", f"""SELECT item, 'code' AS kind, name AS prompt, {_CODE} AS reply FROM cat JOIN codes USING (item)
UNION ALL SELECT item, 'text', {_CODE}, name FROM cat JOIN codes USING (item), range(1, 4)
UNION ALL SELECT item, 'turns', array_to_string({_FIT}, chr(10)) || chr(10) || 'Predict the code:', code FROM (
  SELECT item, code, session, list_reverse(list(block) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN {BLOCKS} PRECEDING AND 1 PRECEDING)) AS before
  FROM (SELECT plays.*, {_BLOCK} AS block, {_CODE} AS code FROM plays JOIN cat USING (item) LEFT JOIN codes USING (item))) WHERE code IS NOT NULL AND len(before) > 0""", PLAYS, CAT, VECS, CODES)
def j12(spark, d):
    """Name to code, code to name (three times), and what is played next after a history that fits the prompt: of the last plays, the latest first, each that still fits."""
    c, codes = t.catalog(spark, d), _named(made(spark, d)[0])
    both = c.join(codes, "item")
    one = both.select("item", F.lit("code").alias("kind"), F.col("name").alias("prompt"), F.col("code").alias("reply"))
    back = both.select("item", F.lit("text").alias("kind"), F.col("code").alias("prompt"), F.col("name").alias("reply"), F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("col")
    word = F.coalesce(F.create_map(*[F.lit(x) for kv in REACTION.items() for x in kv])[F.coalesce("label", F.lit(""))], F.lit("unknown"))
    block = F.concat(F.lit("[T"), F.col("pos").cast("string"), F.lit("] REC: "), "name", F.lit(" | REACTION: "), word)
    plays = t.plays(spark, d).join(c.select("item", "name"), "item").withColumn("block", block).join(codes, "item", "left")
    before = F.reverse(F.collect_list("block").over(Window.partitionBy("session").orderBy("pos").rowsBetween(-BLOCKS, -1)))
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def fit(a, b):
        more = F.struct((a["used"] + F.length(b) + 1).alias("used"), F.concat(F.array(b), a["kept"]).alias("kept"))
        return F.when(a["used"] + F.length(b) < BUDGET, more).otherwise(a)

    plays = plays.withColumn("before", before).where("code IS NOT NULL AND size(before) > 0")
    prompt = F.concat(F.array_join(F.aggregate("before", empty, fit)["kept"], "\n"), F.lit("\nPredict the code:"))
    turns = plays.select("item", F.lit("turns").alias("kind"), prompt.alias("prompt"), F.col("code").alias("reply"))
    return one.unionByName(back).unionByName(turns)


@query("j13_balanced_rows", f"SELECT item, {_CODE} AS code FROM cat JOIN codes USING (item) QUALIFY row_number() OVER (PARTITION BY l0, l1 ORDER BY sha256(CAST(item AS VARCHAR)), item) <= 20", CAT, VECS, CODES)
def j13(spark, d):
    """At most 20 items of a code, picked by hash: the balance is the feature."""
    c = t.catalog(spark, d).select("item").join(_named(made(spark, d)[0]), "item")
    n = F.row_number().over(Window.partitionBy("code").orderBy(F.sha2(F.col("item").cast("string"), 256), "item"))
    return c.withColumn("n", n).where("n <= 20").select("item", "code")


def trie(codes: DataFrame) -> DataFrame:
    """(node, symbol, child, n): the prefix tree of the codes that exist, with the items below a child; the root is ''."""
    l0, l1 = F.col("l0").cast("string"), F.col("l1").cast("string")
    first = codes.select(F.lit("").alias("node"), "l0", l0.alias("child")).withColumnRenamed("l0", "symbol")
    second = codes.select(l0.alias("node"), F.col("l1").alias("symbol"), F.concat_ws("_", l0, l1).alias("child"))
    return first.unionByName(second).groupBy("node", "symbol", "child").agg(F.count(F.lit(1)).alias("n"))


def step(beams: DataFrame, tree: DataFrame, scores: DataFrame, width: int) -> DataFrame:
    """beams(query, node, total) moved on by a symbol: children that exist only, the best of each query.

    scores(query, node, symbol, score) may name any symbol.
    """
    moved = beams.join(tree.select("node", "symbol", "child"), "node").join(scores, ["query", "node", "symbol"])
    moved = moved.select("query", F.col("child").alias("node"), F.round(F.col("total") + F.col("score"), 9).alias("total"))
    n = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("total"), "node"))
    return moved.withColumn("n", n).where(F.col("n") <= width).drop("n")


def beams(queries: DataFrame, codes: DataFrame, first: DataFrame, second: DataFrame, width: int) -> DataFrame:
    """(query, node, total): the best codes of vectors (query, v) by distance at both levels, decoded along the tree."""
    tree = trie(codes)
    far = lambda a, b: -F.round(vector.norm(vector.residual(a, b)), 9)
    one = queries.crossJoin(F.broadcast(first)).select("query", F.lit("").alias("node"), F.col("code").alias("symbol"), far(F.col("v"), F.col("c")).alias("score"))
    best = step(queries.select("query", F.lit("").alias("node"), F.lit(0.0).alias("total")), tree, one, width)
    at = first.select(F.col("code").cast("string").alias("node"), F.col("c").alias("c0"))
    left = best.join(queries, "query").join(F.broadcast(at), "node").select("query", "node", vector.residual(F.col("v"), F.col("c0")).alias("v"))
    two = left.crossJoin(F.broadcast(second)).select("query", "node", F.col("code").alias("symbol"), far(F.col("v"), F.col("c")).alias("score"))
    return step(best, tree, two, width)


_TRIE = "trie AS (SELECT node, symbol, child, count(*) AS n FROM (SELECT '' AS node, l0 AS symbol, l0::VARCHAR AS child FROM codes UNION ALL SELECT l0::VARCHAR, l1, l0 || '_' || l1 FROM codes) GROUP BY 1, 2, 3)"


@query("j19_prefix_table", "SELECT * FROM trie", VECS, CODES, _TRIE)
def j19(spark, d):
    return trie(made(spark, d)[0])


@query("j19_beam_codes", """SELECT query, node AS code, total FROM (
  SELECT query, child AS node, round(total - round(list_distance(list_transform(list_zip(v, c0.c), lambda z: z[1] - z[2]), c1.c), 9), 9) AS total
  FROM b1 JOIN c0 ON c0.code::VARCHAR = b1.node JOIN trie ON trie.node = b1.node JOIN c1 ON c1.code = trie.symbol) QUALIFY row_number() OVER (PARTITION BY query ORDER BY total DESC, node) <= 3""",
    VECS, CODES, _TRIE, "b1 AS (SELECT item AS query, v, child AS node, -round(list_distance(v, c), 9) AS total FROM un JOIN trie ON node = '' JOIN c0 ON c0.code = symbol WHERE item % 20 = 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY total DESC, child) <= 3)")
def j19_beam(spark, d):
    """The three best codes of each query vector (id divisible by 20), decoded in two steps along the tree."""
    codes, first, second = made(spark, d)
    queries = codes.where("item % 20 = 0").select(F.col("item").alias("query"), "v")
    return beams(queries, codes, first, second, 3).select("query", F.col("node").alias("code"), "total")
