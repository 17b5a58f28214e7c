"""Windows, sorts, list rewriting and set operations (E, F, G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import ranking
from tessera.operators import history, metrics, pool, retrieval
from tessera.plans.base import CAT, PLAYS, PRED, TURNS, query
from tessera.plans.joins import ALL, gold, predictions, ranks
from tessera.operators.ordering import numbered
from tessera.sources import tables as t
from tessera.sources.staging import kept

LIST = "lst AS (SELECT p.query, p.item, p.rank, c.artist, c.popularity, c.name, c.size FROM pred p JOIN cat c ON c.item = p.item)"


def lists(spark, d):
    return predictions(spark, d).join(t.catalog(spark, d).select("item", "artist", "popularity", "name", "size"), "item")


def ranked(df, *more, k=None):
    out = df.select("query", "item", F.col("new_rank").cast("long").alias("rank"), *more)
    return out.where(F.col("rank") <= k) if k else out


@query("e1_prefix_history", "SELECT session, pos, string_agg(item, ',' ORDER BY back DESC) AS history FROM (SELECT a.session, a.pos, b.item, a.pos - b.pos AS back FROM plays a LEFT JOIN plays b ON a.session = b.session AND a.pos - b.pos BETWEEN 1 AND 50) GROUP BY 1, 2", PLAYS)
def e1(spark, d):
    p = history.last_n(t.plays(spark, d), 50)
    return p.select("session", F.col("pos").cast("long").alias("pos"), F.nullif(F.array_join(F.col("history").cast("array<string>"), ","), F.lit("")).alias("history"))


@query("e2_last_n", "SELECT session, pos, lag(item, 1) OVER w AS one, lag(item, 2) OVER w AS two FROM plays WINDOW w AS (PARTITION BY session ORDER BY pos)", PLAYS)
def e2(spark, d):
    h = F.reverse("history")
    return history.last_n(t.plays(spark, d), 2).select("session", F.col("pos").cast("long").alias("pos"), F.get(h, F.lit(0)).alias("one"), F.get(h, F.lit(1)).alias("two"))


@query("e3_rank_in_source", "SELECT query, item, rank - 1 AS at FROM pred WHERE rank <= 30", PRED)
def e3(spark, d):
    return predictions(spark, d, 30).select("query", "item", (F.col("rank") - 1).cast("long").alias("at"))


@query("e4_rank_percentile", "SELECT item, round((row_number() OVER (ORDER BY popularity, item) - 1) / greatest(count(*) OVER () - 1, 1), 6) AS pctile FROM cat", CAT)
def e4(spark, d):
    c = t.catalog(spark, d).select("item", "popularity")
    n = c.agg(F.count(F.lit(1)).alias("total"))
    return numbered(c, "popularity", "item").crossJoin(F.broadcast(n)).select("item", F.round((F.col("n") - 1) / F.greatest(F.col("total") - 1, F.lit(1)), 6).alias("pctile"))


@query("e5_group_percent_rank", "SELECT item, round(percent_rank() OVER (PARTITION BY artist ORDER BY popularity), 6) AS r FROM cat", CAT)
def e5(spark, d):
    return t.catalog(spark, d).select("item", F.round(F.percent_rank().over(Window.partitionBy("artist").orderBy("popularity")), 6).alias("r"))


@query("e6_tail_run", "SELECT session, pos, pos - 1 - coalesce(max(CASE WHEN coalesce(label, '') <> 'DOES_NOT' THEN pos END) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tail FROM plays", PLAYS)
def e6(spark, d):
    return history.running_feedback(t.plays(spark, d)).select("session", F.col("pos").cast("long").alias("pos"), "tail")


@query("e7_running_counts", "SELECT session, pos, count(*) FILTER (WHERE label = 'MOVES') OVER w AS moves, round(least(count(*) FILTER (WHERE label = 'DOES_NOT') OVER w, 10) / 10, 6) AS rejected_part FROM plays WINDOW w AS (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", PLAYS)
def e7(spark, d):
    return history.running_feedback(t.plays(spark, d)).select("session", F.col("pos").cast("long").alias("pos"), "moves", F.round("rejected_part", 6).alias("rejected_part"))


@query("e8_lead_lag", "SELECT session, turn, lead(role) OVER w AS next_role, lag(role) OVER w AS last_role FROM turns WINDOW w AS (PARTITION BY session ORDER BY turn)", TURNS)
def e8(spark, d):
    w = Window.partitionBy("session").orderBy("turn")
    return t.turns(spark, d).select("session", "turn", F.lead("role").over(w).alias("next_role"), F.lag("role").over(w).alias("last_role"))


@query("e9_group_top_k", "SELECT artist, item FROM cat QUALIFY row_number() OVER (PARTITION BY artist ORDER BY popularity DESC, item) <= 7", CAT)
def e9(spark, d):
    return retrieval.top_k(t.catalog(spark, d), ["artist"], 7, "popularity").select("artist", "item")


@query("e10_cap_backfill", "SELECT query, item, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (nth > 2)::INT, rank) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query, artist ORDER BY rank) AS nth FROM lst)) WHERE n <= 20", PRED, CAT, LIST)
def e10(spark, d):
    return ranked(pool.capped(lists(spark, d), "artist", 2, 20))


@query("e11_min_max", "SELECT query, item, round(CASE WHEN max(popularity) OVER w > min(popularity) OVER w THEN (popularity - min(popularity) OVER w) / (max(popularity) OVER w - min(popularity) OVER w) ELSE 1 END, 6) AS s FROM lst WINDOW w AS (PARTITION BY query)", PRED, CAT, LIST)
def e11(spark, d):
    return lists(spark, d).select("query", "item", F.round(ranking.min_max(F.col("popularity"), Window.partitionBy("query")), 6).alias("s"))


@query("e12_max_scaled", "SELECT query, item, round(popularity / max(popularity) OVER (PARTITION BY query), 6) AS s FROM lst", PRED, CAT, LIST)
def e12(spark, d):
    return lists(spark, d).select("query", "item", F.round(ranking.max_scaled(F.col("popularity"), Window.partitionBy("query")), 6).alias("s"))


@query("e13_rank_of_gold", "SELECT query, gold, coalesce(rank, -1) AS rank FROM ranks", *ALL)
def e13(spark, d):
    return ranks(spark, d).select("query", "gold", F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"))


@query("e14_fold_assignment", "SELECT session, (row_number() OVER (ORDER BY sha256(CAST(session AS VARCHAR)), session) - 1) % 5 AS fold FROM (SELECT DISTINCT session FROM turns)", TURNS)
def e14(spark, d):
    ids = t.turns(spark, d).select("session").distinct()
    ids = numbered(ids.withColumn("h", F.sha2(F.col("session").cast("string"), 256)), "h", "session")
    return ids.select("session", ((F.col("n") - 1) % 5).cast("long").alias("fold"))


@query("e15_last_user_text", "SELECT session, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM turns", TURNS)
def e15(spark, d):
    w = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.turns(spark, d).select("session", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("said"))


@query("e16_any_in_last_3", "SELECT session, pos, coalesce(max((artist = 'Brand#1')::INT) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS seen FROM plays JOIN cat USING (item)", PLAYS, CAT)
def e16(spark, d):
    p = t.plays(spark, d).join(t.catalog(spark, d).select("item", "artist"), "item")
    return p.select("session", F.col("pos").cast("long").alias("pos"), F.coalesce(F.max((F.col("artist") == "Brand#1").cast("int")).over(history.before(3)), F.lit(0)).alias("seen"))


@query("e17_running_best", "SELECT item, max(popularity) OVER (PARTITION BY artist ORDER BY item ROWS UNBOUNDED PRECEDING) AS best FROM cat", CAT)
def e17(spark, d):
    return t.catalog(spark, d).select("item", F.max("popularity").over(Window.partitionBy("artist").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)).alias("best"))


@query("e18_delta_report", "SELECT query, CASE WHEN a > b THEN 'HELP' WHEN a < b THEN 'HURT' ELSE 'flat' END AS verdict FROM (SELECT query, max(CASE WHEN rank % 2 = 0 THEN popularity END) AS a, max(CASE WHEN rank % 2 = 1 THEN popularity END) AS b FROM lst GROUP BY 1)", PRED, CAT, LIST)
def e18(spark, d):
    two = lists(spark, d).groupBy("query").agg(F.max(F.when(F.col("rank") % 2 == 0, F.col("popularity"))).alias("a"), F.max(F.when(F.col("rank") % 2 == 1, F.col("popularity"))).alias("b"))
    return two.select("query", F.when(F.col("a") > F.col("b"), "HELP").when(F.col("a") < F.col("b"), "HURT").otherwise("flat").alias("verdict"))


@query("e19_bucket_exemplars", "SELECT artist, string_agg(name, '; ' ORDER BY item) AS names FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY item) AS n FROM cat) WHERE n <= 5 GROUP BY 1", CAT)
def e19(spark, d):
    c = t.catalog(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("artist").orderBy("item"))).where("n <= 5")
    return c.groupBy("artist").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "name"))), lambda x: x["name"]), "; ").alias("names"))


@query("f1_top_k", "SELECT item, popularity FROM cat ORDER BY popularity DESC, item LIMIT 50", CAT)
def f1(spark, d):
    return t.catalog(spark, d).select("item", "popularity").orderBy(F.desc("popularity"), "item").limit(50)


@query("f2_final_ranking", "SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY popularity DESC, item) AS rank FROM lst", PRED, CAT, LIST)
def f2(spark, d):
    return ranked(lists(spark, d).withColumn("new_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("popularity"), "item"))))


@query("f3_emit_limit", "SELECT query, item FROM lst WHERE rank <= 20", PRED, CAT, LIST)
def f3(spark, d):
    return lists(spark, d).where("rank <= 20").select("query", "item")


@query("f4_length_sort", "SELECT name, row_number() OVER (ORDER BY length(name) DESC, name) AS n FROM (SELECT DISTINCT artist AS name FROM cat)", CAT)
def f4(spark, d):
    names = t.catalog(spark, d).select(F.col("artist").alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(F.desc(F.length("name")), "name")).cast("long").alias("n"))


def _candidates(spark, d, k=20):
    v = t.vectors(spark, d)
    q = v.where("item % 20 = 0").select(F.col("item").alias("query"), F.col("v").alias("q"))
    return retrieval.dense(q, v, k).join(v.select("item", "v"), "item").select("query", "item", "score", "v")


#: the greedy picks, one for each query and step; ties go to the better score, then to the smaller item
_CAND = "RECURSIVE vecs AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), near AS (SELECT query, item, score FROM (SELECT q.item AS query, x.item, round(list_dot_product(q.v, x.v), 9) AS score FROM vecs q, vecs x WHERE q.item % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 20), cand AS (SELECT query, item, score, list_transform(v, lambda e: e / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS rel FROM near JOIN vecs USING (item) WINDOW w AS (PARTITION BY query))"
_PICK = """{name} AS (SELECT DISTINCT query, 0 AS n, []::BIGINT[] AS chosen FROM cand
  UNION ALL SELECT query, n + 1, list_append(any_value(chosen), arg_max(item, {{'g': round({lam} * rel - (1 - {lam}) * near, 9), 's': score, 'i': -item}})) FROM (
    SELECT p.query, p.n, any_value(p.chosen) AS chosen, c.item, any_value(c.rel) AS rel, any_value(c.score) AS score, coalesce(max(list_dot_product(c.u, x.u)), 0) AS near
    FROM {name} p JOIN cand c ON c.query = p.query AND NOT list_contains(p.chosen, c.item) LEFT JOIN cand x ON x.query = p.query AND list_contains(p.chosen, x.item) WHERE p.n < 10 GROUP BY p.query, p.n, c.item) GROUP BY query, n)"""


@query("f5_mmr", "SELECT query, unnest(chosen) AS item, generate_subscripts(chosen, 1) AS new_rank FROM p WHERE n = 10", _CAND, _PICK.format(name="p", lam=0.7))
def f5(spark, d):
    return pool.mmr(_candidates(spark, d), 0.7, 10)


LAMBDAS = (0.0, 0.25, 0.5, 0.75, 1.0)


@query("f6_mmr_sweep", " UNION ALL ".join(f"SELECT count(DISTINCT item) AS items, {lam} AS lam FROM (SELECT unnest(chosen) AS item FROM p{i} WHERE n = 10)" for i, lam in enumerate(LAMBDAS)), _CAND, *[_PICK.format(name=f"p{i}", lam=lam) for i, lam in enumerate(LAMBDAS)])
def f6(spark, d):
    rows = kept(_candidates(spark, d))
    out = None
    for lam in LAMBDAS:
        one = pool.mmr(rows, lam, 10).groupBy().agg(F.count_distinct("item").alias("items")).withColumn("lam", F.lit(lam))
        out = one if out is None else out.unionByName(one)
    return out


BLEND = "mixed AS (SELECT *, CASE WHEN rank <= 30 THEN round({a} * (n - rank + 1) / n + (1 - {a}) * CASE WHEN hi > lo THEN (popularity - lo) / (hi - lo) ELSE 1 END, 9) END AS blend FROM (SELECT *, count(*) OVER w AS n, min(popularity) OVER w AS lo, max(popularity) OVER w AS hi FROM lst WINDOW w AS (PARTITION BY query, rank <= 30)))"


@query("f9_rerank_blend", "SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY (rank > 30)::INT, blend DESC NULLS LAST, rank) AS rank FROM mixed", PRED, CAT, LIST, BLEND.format(a=0.6))
def f9(spark, d):
    return ranked(pool.blended(lists(spark, d), "popularity", 0.6, 30))


@query("f10_rank_discount_blend", "SELECT query, item, round(.5 / log2(rank + 1) + .5 * popularity / max(popularity) OVER (PARTITION BY query), 6) AS s FROM lst", PRED, CAT, LIST)
def f10(spark, d):
    return lists(spark, d).select("query", "item", F.round(0.5 * ranking.rank_signal(F.col("rank") - 1) + 0.5 * ranking.max_scaled(F.col("popularity"), Window.partitionBy("query")), 6).alias("s"))


def _sweep_sql():
    one = "SELECT {a} AS alpha, query, item, row_number() OVER (PARTITION BY query ORDER BY (rank > 30)::INT, CASE WHEN rank <= 30 THEN round({a} * (n - rank + 1) / n + (1 - {a}) * CASE WHEN hi > lo THEN (popularity - lo) / (hi - lo) ELSE 1 END, 9) END DESC NULLS LAST, rank) AS r FROM (SELECT *, count(*) OVER w AS n, min(popularity) OVER w AS lo, max(popularity) OVER w AS hi FROM lst WINDOW w AS (PARTITION BY query, rank <= 30))"
    return "SELECT alpha, round(sum(CASE WHEN item = gold AND r <= 20 THEN 1 / log2(r + 1) ELSE 0 END) / (SELECT count(*) FROM gold), 6) AS ndcg FROM (" + " UNION ALL ".join(one.format(a=a) for a in (0.0, 0.5, 1.0)) + ") JOIN gold USING (query) GROUP BY 1"


@query("f11_blend_sweep", _sweep_sql(), *ALL, CAT, LIST)
def f11(spark, d):
    out = None
    rows, g = lists(spark, d), gold(spark, d).select("query", "gold")
    for a in (0.0, 0.5, 1.0):
        got = metrics.gold_ranks(ranked(pool.blended(rows, "popularity", a, 30)), g)
        one = got.agg(F.round(F.avg(ranking.ndcg(F.col("rank"))), 6).alias("ndcg")).withColumn("alpha", F.lit(a))
        out = one if out is None else out.unionByName(one)
    return out


@query("f12_pad", "SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY (size > 10)::INT, rank, item) AS rank FROM lst QUALIFY row_number() OVER (PARTITION BY query ORDER BY (size > 10)::INT, rank, item) <= 20", PRED, CAT, LIST)
def f12(spark, d):
    rows = lists(spark, d)
    return ranked(pool.padded(rows.where("size <= 10").select("query", "item", "rank"), rows.select("query", "item", "rank"), 20))


@query("f13_most_common", "SELECT session, item FROM (SELECT session, item, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, min(pos)) AS n FROM plays GROUP BY 1, 2) WHERE n <= 3", PLAYS)
def f13(spark, d):
    n = t.plays(spark, d).groupBy("session", "item").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("first"))
    return n.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("c"), "first"))).where("n <= 3").select("session", "item")


@query("f14_permutation", "SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY (rank NOT IN (3, 1, 2))::INT, CASE rank WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE rank END) AS rank FROM pred WHERE rank <= 20", PRED)
def f14(spark, d):
    order = F.array_position(F.array(*map(F.lit, (3, 1, 2))), F.col("rank"))
    key = Window.partitionBy("query").orderBy((order == 0).cast("int"), F.when(order > 0, order).otherwise(F.col("rank")))
    return ranked(predictions(spark, d, 20).withColumn("new_rank", F.row_number().over(key)))


@query("f15_artist_catalog", "SELECT artist, item, row_number() OVER (PARTITION BY artist ORDER BY popularity DESC, item) AS rank FROM cat QUALIFY row_number() OVER (PARTITION BY artist ORDER BY popularity DESC, item) <= 50", CAT)
def f15(spark, d):
    return retrieval.top_k(t.catalog(spark, d), ["artist"], 50, "popularity").select("artist", "item", F.col("rank").cast("long").alias("rank"))


@query("f16_cascade", "SELECT query, item FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY size DESC, item) AS n3 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY popularity DESC, item) AS n2 FROM lst WHERE rank <= 40) WHERE n2 <= 20) WHERE n3 <= 10", PRED, CAT, LIST)
def f16(spark, d):
    first = lists(spark, d).where("rank <= 40").drop("rank")
    second = retrieval.top_k(first, ["query"], 20, "popularity").drop("rank")
    return retrieval.top_k(second, ["query"], 10, "size").select("query", "item")


@query("g1_union_provenance", "SELECT query, item, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, min(ord * 1000000 + rank) AS position FROM (SELECT query, item, rank, 'play' AS source, 0 AS ord FROM pred WHERE rank <= 10 UNION ALL SELECT query, item, rank, 'price', 1 FROM (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY popularity DESC, item) AS rank FROM lst) WHERE rank <= 10) GROUP BY 1, 2", PRED, CAT, LIST)
def g1(spark, d):
    price = retrieval.top_k(lists(spark, d).drop("rank"), ["query"], 10, "popularity")
    return pool.union_sources([("play", predictions(spark, d, 10)), ("price", price)]).select("query", "item", "sources", "n_sources", F.col("position").cast("long").alias("position"))


@query("g2_union_all", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def g2(spark, d):
    return t.table(spark, d, "customer").select(F.col("c_name").alias("name")).unionByName(t.table(spark, d, "supplier").select(F.col("s_name").alias("name")))


@query("g3_intersection", "SELECT a.item, len(list_intersect(a.tags, b.tags)) AS shared FROM cat a JOIN cat b ON b.item = a.item + 1", CAT)
def g3(spark, d):
    c = t.catalog(spark, d).select("item", "tags")
    return c.join(c.select((F.col("item") - 1).alias("item"), F.col("tags").alias("other")), "item").select("item", F.size(F.array_intersect("tags", "other")).cast("long").alias("shared"))


@query("g4_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def g4(spark, d):
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(t.table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query("g5_distinct_keep_first", "SELECT session, item, min(pos) AS pos FROM plays GROUP BY 1, 2", PLAYS)
def g5(spark, d):
    return t.plays(spark, d).groupBy("session", "item").agg(F.min("pos").cast("long").alias("pos"))


@query("g6_multi_query_union", "SELECT query, item FROM (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY min(src), min(rank), item) AS n FROM (SELECT query, item, rank, 0 AS src FROM lst WHERE rank <= 20 UNION ALL SELECT query, item, rank, 1 FROM lst WHERE size > 25 AND rank <= 40) GROUP BY 1, 2) WHERE n <= 25", PRED, CAT, LIST)
def g6(spark, d):
    rows = lists(spark, d)
    both = pool.union_sources([("long", rows.where("rank <= 20")), ("sharp", rows.where("size > 25 AND rank <= 40"))])
    return both.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("position", "item"))).where("n <= 25").select("query", "item")
