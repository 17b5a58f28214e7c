"""Joins and aggregations (C, D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text, vector
from tessera.operators import cooccur, history, metrics, retrieval
from tessera.plans.base import CAT, EPLAYS, PLAYS, PRED, TURNS, VECS, query
from tessera.sources import tables as t


def predictions(spark, d, k=None):
    """query, item, rank: a session's items by how often it played them."""
    n = t.plays(spark, d).groupBy(F.col("session").alias("query"), "item").agg(F.count(F.lit(1)).alias("n"))
    out = n.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "item"))).drop("n")
    return out.where(F.col("rank") <= k) if k else out


def gold(spark, d, only: str | None = None):
    """query, turn, gold: the last play of a session, with its month as turn; only: as in plays."""
    p = t.plays(spark, d, only)
    last = p.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pos")))).where("n = 1")
    return last.select(F.col("session").alias("query"), (F.col("session") % 7).alias("turn"), F.col("item").alias("gold"), "label", F.col("pos").cast("long").alias("n_plays"))


GOLD = "gold AS (SELECT session AS query, session % 7 AS turn, item AS gold, label, pos AS n_plays FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS n FROM plays) WHERE n = 1)"
RANKS = "ranks AS (SELECT g.*, p.rank FROM gold g LEFT JOIN pred p ON p.query = g.query AND p.item = g.gold)"
ALL = (PLAYS, PRED, GOLD, RANKS)


def ranks(spark, d):
    return metrics.gold_ranks(predictions(spark, d), gold(spark, d))


@query("c1_dimension_lookup", "SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(name, 'unknown') AS name FROM lineitem LEFT JOIN cat ON item = l_partkey AND popularity > 1000", CAT)
def c1(spark, d):
    c = t.catalog(spark, d).where("popularity > 1000").select("item", "name")
    return t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").join(c, F.col("l_partkey") == F.col("item"), "left").select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce("name", F.lit("unknown")).alias("name"))


@query("c2_vector_lookup", "SELECT doc_id, round(coalesce(list_dot_product(v, v), 0), 6) AS score FROM documents LEFT JOIN vecs ON item = doc_id", VECS)
def c2(spark, d):
    v = t.vectors(spark, d)
    return t.table(spark, d, "documents").select("doc_id").join(v, F.col("doc_id") == F.col("item"), "left").select("doc_id", F.round(F.coalesce(vector.dot(F.col("v"), F.col("v")), F.lit(0.0)), 6).alias("score"))


@query("c3_dense_scoring", "SELECT q.item AS query, count(*) AS n, round(sum(list_dot_product(q.v, x.v)), 4) AS total FROM vecs q, vecs x WHERE q.item % 20 = 0 GROUP BY 1", VECS)
def c3(spark, d):
    v = t.vectors(spark, d)
    s = retrieval.scores(v.where("item % 20 = 0").select(F.col("item").alias("query"), F.col("v").alias("q")), v)
    return s.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


BM25 = r"""
tok AS (SELECT doc_id AS item, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
tf AS (SELECT item, term, count(*) AS tf FROM (SELECT item, unnest(w) AS term FROM tok) GROUP BY 1, 2),
dl AS (SELECT item, len(w) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT query, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))) AS term FROM asked),
sc AS (SELECT query, tf.item, round(sum(ln(1 + (n - df + .5) / (df + .5)) * tf / (tf + 1.5 * (.25 + .75 * dl / avgdl))), 9) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.item = tf.item, st GROUP BY 1, 2)"""


@query("c4_inverted_index_join", "SELECT query, item, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 5", "asked AS (SELECT item_id AS query, text FROM benchmark)", BM25)
def c4(spark, d):
    q = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")
    return retrieval.bm25(q, docs, 5).select("query", "item", F.round("score", 6).alias("score"))


@query("c5_gold_join", "SELECT query, gold, rank FROM ranks WHERE rank IS NOT NULL", *ALL)
def c5(spark, d):
    return ranks(spark, d).where("rank IS NOT NULL").select("query", "gold", F.col("rank").cast("long").alias("rank"))


@query("c6_band_self_join", "SELECT a.item AS src, b.item AS dst, count(*) AS n FROM eplays a JOIN eplays b ON a.session = b.session AND b.pos - a.pos BETWEEN 1 AND 3 AND a.item <> b.item GROUP BY 1, 2", EPLAYS)
def c6(spark, d):
    order = Window.partitionBy("session").orderBy("pos")
    leads = t.event_plays(spark, d).select(F.col("item").alias("src"), F.array(*[F.lead("item", i).over(order) for i in (1, 2, 3)]).alias("ahead"))
    ahead = leads.select("src", F.explode("ahead").alias("dst"))
    return ahead.where("dst IS NOT NULL AND src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("c7_feedback_shift", "SELECT session, pos, lead(label) OVER (PARTITION BY session ORDER BY pos) AS judged FROM plays", PLAYS)
def c7(spark, d):
    return history.shifted_feedback(t.plays(spark, d)).select("session", F.col("pos").cast("long").alias("pos"), "judged")


@query("c8_feedback_inference", rf"""SELECT session, turn, CASE WHEN nxt IS NULL THEN '' WHEN regexp_matches(regexp_replace(nxt, '[^\x00-\x7F\P{{L}}]', 'q', 'g'), '{text.mention_pattern(text.POSITIVE).replace("'", "''")}') THEN 'MOVES_TOWARD_GOAL' WHEN regexp_matches(regexp_replace(nxt, '[^\x00-\x7F\P{{L}}]', 'q', 'g'), '{text.mention_pattern(text.NEGATIVE).replace("'", "''")}') THEN 'DOES_NOT_MOVE_TOWARD_GOAL' ELSE '' END AS label FROM (SELECT *, first_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM turns) WHERE role = 'assistant'""", TURNS)
def c8(spark, d):
    after = Window.partitionBy("session").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    rows = t.turns(spark, d).withColumn("nxt", F.first(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(after))
    return rows.where("role = 'assistant'").select("session", "turn", text.feedback(F.coalesce("nxt", F.lit(""))).alias("label"))


@query("c9_latest_positive", "SELECT session, pos, last_value(CASE WHEN label = 'MOVES' THEN item END IGNORE NULLS) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_liked FROM plays", PLAYS)
def c9(spark, d):
    return history.running_feedback(t.plays(spark, d)).select("session", F.col("pos").cast("long").alias("pos"), "last_liked")


@query("c11_artist_expansion", "SELECT session, x.item, min(n) AS rank FROM (SELECT DISTINCT session, artist FROM plays JOIN cat USING (item)) JOIN (SELECT item, artist, row_number() OVER (PARTITION BY artist ORDER BY popularity DESC, item) AS n FROM cat) x USING (artist) WHERE n <= 5 GROUP BY 1, 2", PLAYS, CAT)
def c11(spark, d):
    """The first items of every artist that a session has played, with their place in the artist's list."""
    c = t.catalog(spark, d)
    best = c.withColumn("n", F.row_number().over(Window.partitionBy("artist").orderBy(F.desc("popularity"), "item"))).where("n <= 5").select("artist", F.col("item").alias("cand"), "n")
    artists = t.plays(spark, d).select("session", "item").join(c.select("item", "artist"), "item").select("session", "artist").distinct()
    return artists.join(best, "artist").groupBy("session", F.col("cand").alias("item")).agg(F.min("n").cast("long").alias("rank"))


@query("c12_bucket_expansion", "SELECT query, item, rank FROM (SELECT q.item AS query, x.item, row_number() OVER (PARTITION BY q.item ORDER BY round(list_dot_product(q.v, x.v), 9) DESC, x.item) AS rank FROM vecs q JOIN vecs x ON q.l0 = x.l0 WHERE q.item % 20 = 0) WHERE rank <= 5", VECS)
def c12(spark, d):
    v = t.vectors(spark, d)
    q = v.where("item % 20 = 0").select(F.col("item").alias("query"), F.col("v").alias("q"), F.col("l0").alias("cell"))
    found = retrieval.dense(q, v.select("item", "v", F.col("l0").alias("cell")), 5, cells=True)
    return found.select("query", "item", F.col("rank").cast("long").alias("rank"))


CENT = "cent AS (SELECT l0, list(a ORDER BY i) AS c FROM (SELECT l0, i, avg(x) AS a FROM (SELECT l0, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs) GROUP BY 1, 2) GROUP BY 1)"


@query("c13_neighbour_codes", "SELECT l0, near FROM (SELECT a.l0, b.l0 AS near, row_number() OVER (PARTITION BY a.l0 ORDER BY round(list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c) * list_dot_product(b.c, b.c)), 9) DESC, b.l0) AS n FROM cent a JOIN cent b ON a.l0 <> b.l0) WHERE n <= 3", VECS, CENT)
def c13(spark, d):
    c = retrieval.mean_vectors(t.vectors(spark, d), ["l0"])
    near = retrieval.scores(c.select(F.col("l0").alias("query"), F.col("v").alias("q")), c.select(F.col("l0").alias("item"), "v")).where("query != item")
    return retrieval.top_k(near.withColumn("score", F.round("score", 9)), ["query"], 3).select(F.col("query").alias("l0"), F.col("item").alias("near"))


_NORMAL = "trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query("c14_name_match", f"SELECT item, found, n FROM (SELECT item, {_NORMAL.format(x='upper(name)')} AS k, {_NORMAL.format(x='artist')} AS a FROM cat) JOIN (SELECT {_NORMAL.format(x='name')} AS k, {_NORMAL.format(x='artist')} AS a, min(item) AS found, count(*) AS n FROM cat GROUP BY 1, 2) USING (k, a)", CAT)
def c14(spark, d):
    """The first item of equal normal title and artist, and how many there are."""
    c = t.catalog(spark, d)
    index = c.groupBy(text.normal(F.col("name")).alias("k"), text.normal(F.col("artist")).alias("a")).agg(F.min("item").alias("found"), F.count(F.lit(1)).alias("n"))
    asked = c.select("item", text.normal(F.upper("name")).alias("k"), text.normal(F.col("artist")).alias("a"))
    return asked.join(index, ["k", "a"]).select("item", "found", "n")


@query("c15_overlap_join", "SELECT count(*) AS both_n, round(100.0 * count(*) / (SELECT count(*) FROM vecs), 4) AS percent FROM vecs WHERE item IN (SELECT doc_id FROM documents)", VECS)
def c15(spark, d):
    v = t.vectors(spark, d).select("item")
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.lit(1).alias("hit"))
    return v.join(docs, "item", "left").agg(F.count("hit").alias("both_n"), F.round(100.0 * F.count("hit") / F.count(F.lit(1)), 4).alias("percent"))


@query("c16_score_log_join", "SELECT p.query, p.item, coalesce(c.popularity, CAST(-p.rank AS DOUBLE)) AS score FROM pred p LEFT JOIN cat c ON c.item = p.item AND c.size > 25 WHERE rank <= 20", PRED, CAT)
def c16(spark, d):
    log = t.catalog(spark, d).where("size > 25").select("item", "popularity")
    return predictions(spark, d, 20).join(log, "item", "left").select("query", "item", F.coalesce("popularity", -F.col("rank").cast("double")).alias("score"))


@query("c18_parallel_join", "SELECT session, pos, item, label FROM plays", PLAYS)
def c18(spark, d):
    a = t.plays(spark, d).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", "item", "label"))).alias("x"))
    z = a.select("session", F.explode(F.arrays_zip(F.col("x.pos").alias("pos"), F.col("x.item").alias("item"), F.col("x.label").alias("label"))).alias("z"))
    return z.select("session", F.col("z.pos").cast("long").alias("pos"), F.col("z.item").alias("item"), F.col("z.label").alias("label"))


@query("d1_cooccurrence", "SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM (SELECT src, dst, sum(w) AS w FROM (SELECT a.item AS src, b.item AS dst, CASE abs(b.pos - a.pos) WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN .5 ELSE .25 END AS w FROM plays a JOIN plays b ON a.session = b.session AND abs(b.pos - a.pos) BETWEEN 1 AND 3 AND a.item <> b.item) GROUP BY 1, 2 HAVING sum(w) >= 1) QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 300", PLAYS)
def d1(spark, d):
    return cooccur.neighbours(t.plays(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("d2_macro_metric", "SELECT round(avg(x), 6) AS macro_ndcg, count(*) AS turns FROM (SELECT turn, avg(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END) AS x FROM ranks GROUP BY 1)", *ALL)
def d2(spark, d):
    return metrics.macro(ranks(spark, d), "turn")


@query("d3_micro_metric", "SELECT round(avg(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg, count(*) AS n FROM ranks", *ALL)
def d3(spark, d):
    from tessera.functions import ranking

    return ranks(spark, d).agg(F.round(F.avg(ranking.ndcg(F.col("rank"))), 6).alias("ndcg"), F.count(F.lit(1)).alias("n"))


@query("d4_hits_by_turn", "SELECT turn, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg{k}, round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS hit{k}" for k in (1, 10, 20)) + " FROM ranks GROUP BY 1", *ALL)
def d4(spark, d):
    return metrics.by_turn(ranks(spark, d), "turn")


@query("d5_catalog_diversity", "SELECT count(DISTINCT item) AS items, round(count(DISTINCT item) / (SELECT count(*) FROM part), 6) AS diversity FROM pred WHERE rank <= 20", PRED)
def d5(spark, d):
    n = t.table(spark, d, "part").agg(F.count(F.lit(1)).alias("total"))
    return predictions(spark, d, 20).agg(F.count_distinct("item").alias("items")).crossJoin(n).select("items", F.round(F.col("items") / F.col("total"), 6).alias("diversity"))


@query("d6_distinct_2", r"SELECT count(DISTINCT b) AS different, count(*) AS n, round(count(DISTINCT b) / count(*), 6) AS distinct_2 FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM turns WHERE role = 'assistant'))", TURNS)
def d6(spark, d):
    return metrics.distinct_2(t.turns(spark, d).where("role = 'assistant'"))


@query("d7_pool_recall", "SELECT round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0 END), 6) AS recall, count(*) AS turns FROM ranks", *ALL)
def d7(spark, d):
    return ranks(spark, d).agg(F.round(F.avg(F.coalesce((F.col("rank") <= 50).cast("double"), F.lit(0.0))), 6).alias("recall"), F.count(F.lit(1)).alias("turns"))


@query("d8_popularity_counts", "SELECT item, count(*) AS plays, count(DISTINCT session) AS sessions FROM plays GROUP BY 1", PLAYS)
def d8(spark, d):
    return t.plays(spark, d).groupBy("item").agg(F.count(F.lit(1)).alias("plays"), F.count_distinct("session").alias("sessions"))


@query("d9_grouped_list", "SELECT artist, string_agg(item, ',' ORDER BY item) AS items FROM cat GROUP BY 1", CAT)
def d9(spark, d):
    return t.catalog(spark, d).groupBy("artist").agg(F.array_join(F.array_sort(F.collect_list("item")).cast("array<string>"), ",").alias("items"))


@query("d10_bucket_purity", "SELECT artist, round(max(n) / sum(n), 6) AS purity, CAST(sum(n) AS BIGINT) AS total FROM (SELECT artist, tags[len(tags)] AS tag, count(*) AS n FROM cat GROUP BY 1, 2) GROUP BY 1", CAT)
def d10(spark, d):
    n = t.catalog(spark, d).groupBy("artist", F.element_at("tags", -1).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("artist").agg(F.round(F.max("n") / F.sum("n"), 6).alias("purity"), F.sum("n").alias("total"))


@query("d11_entropy", "SELECT artist, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT artist, n / sum(n) OVER (PARTITION BY artist) AS p FROM (SELECT artist, size, count(*) AS n FROM cat GROUP BY 1, 2)) GROUP BY 1", CAT)
def d11(spark, d):
    n = t.catalog(spark, d).groupBy("artist", "size").agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("artist")))
    return p.groupBy("artist").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


@query("d12_leaf_statistics", "SELECT count(*) AS used, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, list_sort(list(n))[len(list(n)) // 4 + 1] AS q1, list_sort(list(n))[len(list(n)) * 3 // 4 + 1] AS q3, count(*) FILTER (WHERE n = 1) AS singles FROM (SELECT artist, size, count(*) AS n FROM cat GROUP BY 1, 2)", CAT)
def d12(spark, d):
    n = t.catalog(spark, d).groupBy("artist", "size").agg(F.count(F.lit(1)).alias("n"))
    # counts by value first: the leaves themselves never meet in one row
    by = n.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    run = by.withColumn("upto", F.sum("m").over(Window.orderBy("n")))
    total = by.agg(F.sum("m").alias("used"))
    at = lambda f: F.min(F.when(F.col("upto") > F.floor(F.col("used") * f), F.col("n")))
    return run.crossJoin(total).agg(F.max("used").alias("used"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.sum(F.col("n") * F.col("m")) / F.max("used"), 6).alias("mean"), at(0.25).alias("q1"), at(0.75).alias("q3"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("m"))), F.lit(0)).alias("singles"))


@query("d13_centroids", "SELECT l0, round(c[1] / sqrt(list_dot_product(c, c)), 6) AS first, round(c[64] / sqrt(list_dot_product(c, c)), 6) AS last FROM cent", VECS, CENT)
def d13(spark, d):
    return retrieval.mean_vectors(t.vectors(spark, d), ["l0"]).select("l0", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query("d15_quantiles", "SELECT role, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90 FROM (SELECT role, length(text) AS n FROM turns) GROUP BY 1", TURNS)
def d15(spark, d):
    n = t.turns(spark, d).select("role", F.length("text").alias("n"))
    return n.groupBy("role").agg(F.round(F.percentile("n", 0.5), 6).alias("p50"), F.round(F.percentile("n", 0.9), 6).alias("p90"))


@query("d16_share_ratio", "SELECT source, round((t / sum(t) OVER ()) / (n / sum(n) OVER ()), 6) AS ratio FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS t FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)")
def d16(spark, d):
    rows = t.table(spark, d, "documents").select("doc_id", "source").join(t.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    by = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("t"))
    total = by.agg(F.sum("n").alias("n_all"), F.sum("t").alias("t_all"))
    return by.crossJoin(F.broadcast(total)).select("source", F.round((F.col("t") / F.col("t_all")) / (F.col("n") / F.col("n_all")), 6).alias("ratio"))


@query("d17_majority_vote", "SELECT session, artist FROM (SELECT session, artist, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, min(pos)) AS n FROM plays JOIN cat USING (item) GROUP BY 1, 2) WHERE n = 1", PLAYS, CAT)
def d17(spark, d):
    n = t.plays(spark, d).join(t.catalog(spark, d).select("item", "artist"), "item").groupBy("session", "artist").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("first"))
    return n.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("c"), "first"))).where("n = 1").select("session", "artist")


@query("d18_source_count", "SELECT session, item, count(DISTINCT coalesce(label, 'none')) AS n_sources FROM plays GROUP BY 1, 2", PLAYS)
def d18(spark, d):
    return t.plays(spark, d).groupBy("session", "item").agg(F.count_distinct(F.coalesce("label", F.lit("none"))).alias("n_sources"))


@query("d19_rank_merge", "SELECT session, artist, min(pos) AS best, max(popularity) AS w, count(DISTINCT item) AS n_from FROM plays JOIN cat USING (item) GROUP BY 1, 2", PLAYS, CAT)
def d19(spark, d):
    p = t.plays(spark, d).join(t.catalog(spark, d).select("item", "artist", "popularity"), "item")
    return p.groupBy("session", "artist").agg(F.min("pos").cast("long").alias("best"), F.max("popularity").alias("w"), F.count_distinct("item").alias("n_from"))


@query("d20_segmented_recall", "SELECT turn, coalesce(label, CASE WHEN grouping(label) = 1 THEN '*' ELSE 'none' END) AS segment, count(*) AS n, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0 END), 6) AS recall FROM ranks GROUP BY GROUPING SETS ((turn), (turn, label), ())", *ALL)
def d20(spark, d):
    sets = ranks(spark, d).groupingSets([["turn"], ["turn", "label"], []], "turn", "label")
    hit = F.coalesce((F.col("rank") <= 20).cast("double"), F.lit(0.0))
    rows = sets.agg(F.grouping("label").alias("all_labels"), F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("recall"))
    return rows.select("turn", F.coalesce("label", F.when(F.col("all_labels") == 1, "*").otherwise("none")).alias("segment"), "n", "recall")


KS = (5, 10, 20, 50)


@query("d21_recall_grid", "SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS recall FROM ranks, (SELECT unnest([5, 10, 20, 50]) AS k) GROUP BY 1", *ALL)
def d21(spark, d):
    ks = spark.createDataFrame([(k,) for k in KS], "k int")
    return ranks(spark, d).crossJoin(F.broadcast(ks)).groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))), 6).alias("recall"))


@query("d22_weight_grid", "SELECT w, round(avg(CASE WHEN r <= 20 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS gain FROM (SELECT w, query, 1 + count(*) FILTER (WHERE s > gs) AS r FROM (SELECT p.query, w, round(w / p.rank + (1 - w) * c.popularity / 3000, 9) AS s, max(CASE WHEN p.item = g.gold THEN round(w / p.rank + (1 - w) * c.popularity / 3000, 9) END) OVER (PARTITION BY p.query, w) AS gs FROM pred p JOIN gold g ON g.query = p.query JOIN cat c ON c.item = p.item, (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS w)) GROUP BY 1, 2) GROUP BY 1", *ALL, CAT)
def d22(spark, d):
    w = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.5, 1.0)], "w double")
    p = predictions(spark, d).join(gold(spark, d).select("query", "gold"), "query").join(t.catalog(spark, d).select("item", "popularity"), "item").crossJoin(F.broadcast(w))
    s = p.withColumn("s", F.round(F.col("w") / F.col("rank") + (1 - F.col("w")) * F.col("popularity") / 3000, 9))
    s = s.withColumn("gs", F.max(F.when(F.col("item") == F.col("gold"), F.col("s"))).over(Window.partitionBy("query", "w")))
    r = s.groupBy("w", "query").agg((1 + F.count(F.when(F.col("s") > F.col("gs"), 1))).alias("r"))
    return r.groupBy("w").agg(F.round(F.avg(F.when(F.col("r") <= 20, 1 / F.log2(F.col("r") + 1)).otherwise(0.0)), 6).alias("gain"))


@query("d23_pareto", "SELECT size, price FROM (SELECT *, max(price) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT p_size AS size, max(p_retailprice) AS price FROM part GROUP BY 1)) WHERE best IS NULL OR price > best")
def d23(spark, d):
    rows = t.table(spark, d, "part").groupBy(F.col("p_size").alias("size")).agg(F.max("p_retailprice").alias("price"))
    return metrics.pareto(rows, "size", "price")


@query("d24_source_report", "SELECT CASE WHEN rank IS NULL THEN 'unreachable' WHEN rank <= 5 THEN 'top' ELSE 'deep' END AS bucket, count(*) AS n, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0 END), 6) AS top20, round(quantile_cont(rank, 0.5), 6) AS p50 FROM ranks GROUP BY 1", *ALL)
def d24(spark, d):
    bucket = F.when(F.col("rank").isNull(), "unreachable").when(F.col("rank") <= 5, "top").otherwise("deep")
    return ranks(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce((F.col("rank") <= 20).cast("double"), F.lit(0.0))), 6).alias("top20"), F.round(F.percentile("rank", 0.5), 6).alias("p50"))


@query("d25_worst_groups", "SELECT source, rate FROM (SELECT source, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1) ORDER BY rate, source LIMIT 5")
def d25(spark, d):
    rows = t.table(spark, d, "documents").select("doc_id", "source").join(t.table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("rate")).orderBy("rate", "source").limit(5)


@query("d26_standardisation", "SELECT item, round((popularity - avg(popularity) OVER ()) / (stddev_pop(popularity) OVER () + 1e-8), 5) AS z FROM cat", CAT)
def d26(spark, d):
    c = t.catalog(spark, d).select("item", "popularity")
    return c.crossJoin(F.broadcast(c.agg(F.avg("popularity").alias("m"), F.stddev_pop("popularity").alias("s")))).select("item", F.round((F.col("popularity") - F.col("m")) / (F.col("s") + 1e-8), 5).alias("z"))


@query("d27_cv_summary", "SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT query % 5 AS fold, avg(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END) AS x FROM ranks GROUP BY 1)", *ALL)
def d27(spark, d):
    from tessera.functions import ranking

    folds = ranks(spark, d).groupBy(F.col("query") % 5).agg(F.avg(ranking.ndcg(F.col("rank"))).alias("x"))
    return folds.agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


@query("d28_composite", r"SELECT round(.5 * ndcg + .1 * diversity + .1 * lexical + .3 * (judge - 1) / 4, 6) AS score FROM (SELECT avg(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END) AS ndcg FROM ranks), (SELECT count(DISTINCT item) / (SELECT count(*) FROM part) AS diversity FROM pred WHERE rank <= 20), (SELECT count(DISTINCT b) / count(*) AS lexical FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM turns WHERE role = 'assistant'))), (SELECT 1 + 4 * avg(quality) AS judge FROM labels)", *ALL, TURNS)
def d28(spark, d):
    """Gain, catalog diversity, lexical diversity and a judge's mark from 1 to 5 (here from the labels)."""
    from tessera.functions import ranking

    gain = ranks(spark, d).agg(F.avg(ranking.ndcg(F.col("rank"))).alias("ndcg"))
    items = t.table(spark, d, "part").agg(F.count(F.lit(1)).alias("total"))
    shown = predictions(spark, d, 20).agg(F.count_distinct("item").alias("items"))
    pairs = metrics.distinct_2(t.turns(spark, d).where("role = 'assistant'")).select((F.col("different") / F.col("n")).alias("lexical"))
    judge = t.table(spark, d, "labels").agg((1 + 4 * F.avg("quality")).alias("judge"))
    one = gain.crossJoin(items).crossJoin(shown).crossJoin(pairs).crossJoin(judge)  # one row each
    return one.select(F.round(0.5 * F.col("ndcg") + 0.1 * F.col("items") / F.col("total") + 0.1 * F.col("lexical") + 0.3 * (F.col("judge") - 1) / 4, 6).alias("score"))


@query("d29_distinct_exact", "SELECT count(DISTINCT item) AS items, count(DISTINCT session) AS sessions FROM plays", PLAYS)
def d29(spark, d):
    return t.plays(spark, d).agg(F.count_distinct("item").alias("items"), F.count_distinct("session").alias("sessions"))


@query("d29_distinct_approximate")
def d29a(spark, d):
    return t.plays(spark, d).agg(F.approx_count_distinct("item", 0.02).alias("items"))


@query("d30_rollup", "SELECT p_type, p_brand, count(*) AS n, grouping_id(p_type, p_brand) AS level FROM part GROUP BY ROLLUP (p_type, p_brand)")
def d30(spark, d):
    return t.table(spark, d, "part").rollup("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("d30_cube", "SELECT p_type, p_size, sum(p_retailprice) AS total FROM part GROUP BY CUBE (p_type, p_size)")
def d30c(spark, d):
    return t.table(spark, d, "part").cube("p_type", "p_size").agg(F.sum("p_retailprice").alias("total"))


@query("d31_code_hits", "SELECT turn, round(avg(exact), 6) AS exact, round(avg(coarse), 6) AS coarse FROM (SELECT g.query, g.turn, max(CAST(p.item = g.gold AS INT)) AS exact, max(CAST(c.artist = x.artist AS INT)) AS coarse FROM gold g JOIN pred p ON p.query = g.query AND p.rank <= 10 JOIN cat c ON c.item = p.item JOIN cat x ON x.item = g.gold GROUP BY 1, 2) GROUP BY 1", *ALL, CAT)
def d31(spark, d):
    c = t.catalog(spark, d).select("item", "artist")
    rows = gold(spark, d).join(predictions(spark, d, 10), "query").join(c, "item").join(c.select(F.col("item").alias("gold"), F.col("artist").alias("gold_artist")), "gold")
    hit = rows.groupBy("query", "turn").agg(F.max((F.col("item") == F.col("gold")).cast("int")).alias("exact"), F.max((F.col("artist") == F.col("gold_artist")).cast("int")).alias("coarse"))
    return hit.groupBy("turn").agg(F.round(F.avg("exact"), 6).alias("exact"), F.round(F.avg("coarse"), 6).alias("coarse"))


@query("d32_rescue_count", "SELECT count(*) FILTER (WHERE coalesce(rank > 5, true) AND rank <= 20) AS rescued, count(*) AS n FROM ranks", *ALL)
def d32(spark, d):
    return ranks(spark, d).agg(F.count(F.when(F.coalesce(F.col("rank") > 5, F.lit(True)) & (F.col("rank") <= 20), 1)).alias("rescued"), F.count(F.lit(1)).alias("n"))
