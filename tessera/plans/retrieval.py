"""Retrieval and ranking (I)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import cooccur, history, retrieval
from tessera.plans.base import CAT, PLAYS, PRED, query
from tessera.plans.joins import BM25, predictions
from tessera.plans.windows import LIST, lists
from tessera.sources import tables as t

ASKED = "asked AS (SELECT item_id AS query, text FROM benchmark)"
TOP = "top AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= {k})"


def asked(spark, d):
    return t.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


def docs(spark, d):
    return t.table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")


def out(df):
    return df.select("query", "item", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("i1_bm25_topk", "SELECT query, item, rank, round(score, 6) AS score FROM top", ASKED, BM25, TOP.format(k=20))
def i1(spark, d):
    return out(retrieval.bm25(asked(spark, d), docs(spark, d), 20))


@query("i1_bm25_signal", "SELECT query, item, round(score / max(score) OVER (PARTITION BY query), 6) AS signal FROM top", ASKED, BM25, TOP.format(k=20))
def i1s(spark, d):
    rows = retrieval.bm25(asked(spark, d), docs(spark, d), 20)
    return rows.select("query", "item", F.round(retrieval.signal(F.col("score"), Window.partitionBy("query")), 6).alias("signal"))


EXP = """tab AS (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) - 1 AS place FROM (SELECT src, dst, sum(w) AS w FROM (SELECT a.item AS src, b.item AS dst, CASE abs(b.pos - a.pos) WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN .5 ELSE .25 END AS w FROM plays a JOIN plays b ON a.session = b.session AND abs(b.pos - a.pos) BETWEEN 1 AND 3 AND a.item <> b.item) GROUP BY 1, 2 HAVING sum(w) >= 1) QUALIFY place < 300),
hs AS (SELECT session AS turn, item, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS back FROM plays),
ex AS (SELECT turn, back, dst, w, place, row_number() OVER (PARTITION BY turn, back ORDER BY place) - 1 AS r FROM hs JOIN tab ON src = item WHERE back <= 3 AND NOT EXISTS (SELECT 1 FROM plays p WHERE p.session = turn AND p.item = dst))"""


@query("i7_cooccurrence_expansion", "SELECT turn, dst AS item, min(place) AS rank, max(w) AS w, count(*) AS n_from FROM ex WHERE r < CASE back WHEN 1 THEN 30 WHEN 2 THEN 15 ELSE 5 END GROUP BY 1, 2", PLAYS, EXP)
def i7(spark, d):
    p = t.plays(spark, d)
    hist = p.select(F.col("session").alias("turn"), "item", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pos"))).alias("back"))
    return cooccur.expanded(hist, cooccur.neighbours(p), [30, 15, 5]).select("turn", "item", F.col("rank").cast("long").alias("rank"), "w", "n_from")


@query("i29_labels", "SELECT session, pos, CASE label WHEN 'MOVES' THEN 2 WHEN 'DOES_NOT' THEN 0 ELSE 1 END AS soft, (label = 'MOVES') IS TRUE AS hard FROM plays", PLAYS)
def i29(spark, d):
    soft = F.when(F.col("label") == "MOVES", 2).when(F.col("label") == "DOES_NOT", 0).otherwise(1)
    return t.plays(spark, d).select("session", F.col("pos").cast("long").alias("pos"), soft.alias("soft"), F.coalesce(F.col("label") == "MOVES", F.lit(False)).alias("hard"))


@query("i30_response_template", "SELECT query, 'I recommend \"' || name || '\" by ' || artist || '.' AS response FROM lst WHERE rank = 1", PRED, CAT, LIST)
def i30(spark, d):
    return lists(spark, d).where("rank = 1").select("query", F.format_string('I recommend "%s" by %s.', "name", "artist").alias("response"))


@query("i31_goal_slot", "SELECT session, pos, CASE WHEN liked IS NOT NULL THEN CAST(liked AS VARCHAR) WHEN tail >= 2 THEN '' ELSE 'goal' END AS slot FROM (SELECT session, pos, last_value(CASE WHEN label = 'MOVES' THEN item END IGNORE NULLS) OVER w AS liked, pos - 1 - coalesce(max(CASE WHEN coalesce(label, '') <> 'DOES_NOT' THEN pos END) OVER w, 0) AS tail FROM plays WINDOW w AS (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", PLAYS)
def i31(spark, d):
    rows = history.running_feedback(t.plays(spark, d))
    return rows.select("session", F.col("pos").cast("long").alias("pos"), history.goal_slot(F.lit("goal"), F.col("last_liked").cast("string"), F.col("tail"), 2).alias("slot"))


@query("i32_positive_history", "SELECT session, string_agg(item, ',' ORDER BY pos) AS items FROM (SELECT *, count(*) FILTER (WHERE coalesce(label, '') <> 'DOES_NOT') OVER (PARTITION BY session) AS good FROM plays) WHERE good = 0 OR coalesce(label, '') <> 'DOES_NOT' GROUP BY 1", PLAYS)
def i32(spark, d):
    h = t.plays(spark, d).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", "item", "label"))).alias("h"))
    return h.select("session", F.array_join(history.positive_history(F.col("h")).cast("array<string>"), ",").alias("items"))
