"""Names in texts and what follows from them: C10, I3, B19, H12; training sets from the pool: J9, J11, J14; C17."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import mentions as found
from tessera.operators import pool, retrieval
from tessera.plans.base import CAT, TURNS, query
from tessera.plans.features import _FACTS, FUSED, MESSAGES, _fused, facts, messages
from tessera.plans.joins import gold
from tessera.plans.pooling import AGAIN, ARTIST_CAP, MORE, POOL, SIGNALS, SOURCES, WORLD, World, _of, asked
from tessera.plans.scalars import QUOTED, sql_text
from tessera.sources import tables as t
from tessera.sources.staging import kept


def _tag_names(spark, d) -> DataFrame:
    return t.catalog(spark, d).select(F.explode("tags").alias("name")).distinct()


@query("c10_mention_join", "SELECT DISTINCT session, turn, w AS name FROM turns JOIN (SELECT DISTINCT unnest(tags) AS w FROM cat) ON contains(lower(text), w)", TURNS, CAT)
def c10(spark, d):
    return found.mentions(t.turns(spark, d).select("session", "turn", "text"), _tag_names(spark, d)).select("session", "turn", "name").distinct()


GREEDY = "list_reduce(list_prepend({'l': text, 'f': []::VARCHAR[], 'n': ''}, names), lambda a, x: CASE WHEN contains(a.l, x.n) THEN {'l': replace(a.l, x.n, ' '), 'f': list_append(a.f, x.n), 'n': ''} ELSE a END).f"


@query("c10_greedy_mentions", f"SELECT session, turn, unnest({GREEDY}) AS name FROM (SELECT session, turn, lower(text) AS text, list({{'l': '', 'f': []::VARCHAR[], 'n': w}} ORDER BY length(w) DESC, w) AS names FROM turns JOIN (SELECT DISTINCT unnest(tags) AS w FROM cat) ON contains(lower(text), w) GROUP BY 1, 2, 3)", TURNS, CAT)
def c10_greedy(spark, d):
    return found.greedy(t.turns(spark, d).select("session", "turn", "text"), _tag_names(spark, d), ["session", "turn"])


def _artists(items: DataFrame) -> DataFrame:
    return items.where(F.length("artist") >= 4).select(F.col("artist").alias("name")).distinct()


NAMED = "named AS (SELECT DISTINCT said.item AS query, lower(artist) AS name FROM said JOIN (SELECT DISTINCT p_brand AS artist FROM part WHERE length(p_brand) >= 4) ON contains(lower(text), lower(artist)))"


@query("i3_entity_bm25", "SELECT query, item, rank, round(score, 9) AS score FROM again", WORLD, MESSAGES, NAMED,
    f"asked2 AS (SELECT query, concat_ws(' ', n, p) AS text FROM (SELECT said.item AS query, (SELECT string_agg(name, ' ' ORDER BY name) FROM named WHERE named.query = said.item) AS n, array_to_string(regexp_extract_all(text, {sql_text(QUOTED)}, 1), ' ') AS p FROM said))",
    MORE, AGAIN.format(k=20))
def i3(spark, d):
    """The artists that the message names, and its quoted phrases, ask."""
    w, items = World(spark, d), facts(spark, d)
    said = messages(w.h, items)
    names = found.mentions(said.withColumnRenamed("said", "text"), _artists(items)).groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("names"))
    phrases = F.array_join(F.regexp_extract_all("said", F.lit(QUOTED), F.lit(1)), " ")
    q = said.join(names, "query", "left").select("query", F.concat_ws(" ", "names", phrases).alias("text"))
    return retrieval.bm25(q, w.docs, 20, exclude=w.seen, once=True).select("query", "item", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query("i8_artist_expansion", f"""SELECT query, item, min(n) AS rank, min(src) AS found_by FROM (
  SELECT query, p_brand, 'played_track_artist' AS src FROM hs JOIN part ON p_partkey = item UNION ALL SELECT query, p_brand, 'message' FROM named JOIN (SELECT DISTINCT p_brand FROM part) ON lower(p_brand) = name)
  JOIN alist USING (p_brand) ANTI JOIN seen USING (query, item) GROUP BY 1, 2""", WORLD, MESSAGES, NAMED, SOURCES["artist"][0])
def i8(spark, d):
    """Items of the artists that the message names or the history holds: the best place in an artist's list, seen items counted, and where the artist came from (the message first)."""
    w, items = World(spark, d), facts(spark, d)
    said = messages(w.h, items).withColumnRenamed("said", "text")
    artists = items.select("artist").distinct()
    named = found.mentions(said, _artists(items)).join(artists, F.lower("artist") == F.col("name")).select("query", "artist").distinct()
    all_ = w.artist(named)
    first = items.select("artist", "item", "popularity")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("artist").orderBy(F.desc("popularity"), "item"))).where(F.col("n") <= ARTIST_CAP)
    said_ = named.join(first, "artist").select("query", "item", F.lit("message").alias("found_by")).distinct()
    return all_.join(said_, ["query", "item"], "left").select("query", "item", F.col("rank").cast("long").alias("rank"), F.coalesce("found_by", F.lit("played_track_artist")).alias("found_by"))


#: sources that give way where the message names an artist
GATED = ["nn", "mean_nn", "collab"]


@query("b19_source_gate", f"SELECT query, item, source FROM members WHERE NOT (source IN ({', '.join(map(sql_text, GATED))}) AND query IN (SELECT query FROM named))", WORLD, POOL, MESSAGES, NAMED)
def b19(spark, d):
    """The pool's sources, without those that look at plays where the message names an artist."""
    w, items = World(spark, d), facts(spark, d)
    named = found.mentions(messages(w.h, items).withColumnRenamed("said", "text"), _artists(items)).select("query").distinct()
    rows = reduce(DataFrame.unionByName, [s.select("query", "item", F.lit(n).alias("source")) for n, s in w.sources()])
    gated = rows.where(F.col("source").isin(GATED)).join(named, "query", "left_anti")
    return rows.where(~F.col("source").isin(GATED)).unionByName(gated)


@query("c17_decision_join", "SELECT query, item, source, row_number() OVER (PARTITION BY query ORDER BY src, rank, item) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, item ORDER BY src) AS n FROM (SELECT query, item, rank, 0 AS src, 'kept' AS source FROM s_bm25 WHERE rank <= 8 UNION ALL SELECT query, item, rank, 1, 'added' FROM s_tt WHERE rank <= 8 UNION ALL SELECT query, item, rank, 2, 'pad' FROM s_artist)) WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY src, rank, item) <= 20", *_of("bm25", "tt", "artist"))
def c17(spark, d):
    """What was kept of a list, then what was added, then what fills it up; each item by its first decision."""
    w = World(spark, d)
    parts = [("kept", w.bm25().where("rank <= 8")), ("added", w.unseen(w.dense("tt")).where("rank <= 8")), ("pad", w.artist())]
    rows = reduce(DataFrame.unionByName, [s.select("query", "item", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("src"), F.lit(n).alias("source")) for i, (n, s) in enumerate(parts)])
    first = rows.groupBy("query", "item").agg(F.min(F.struct("src", "rank", "source")).alias("x")).select("query", "item", "x.*")
    out = first.withColumn("new", F.row_number().over(Window.partitionBy("query").orderBy("src", "rank", "item"))).where("new <= 20")
    return out.select("query", "item", "source", F.col("new").cast("long").alias("rank"))


@query("j9_contrastive_pairs", "SELECT query, positive, item AS negative, row_number() OVER (PARTITION BY query ORDER BY src, rank, item) AS n FROM (SELECT m.query, positive, item, src, rank FROM (SELECT query, item, min(src) AS src, min_by(rank, src * 1000000 + rank) AS rank FROM (SELECT query, item, min(back) AS rank, 0 AS src FROM hs WHERE label = 'DOES_NOT' AND NOT EXISTS (SELECT 1 FROM hs h WHERE h.query = hs.query AND h.item = hs.item AND h.label = 'MOVES') GROUP BY 1, 2 UNION ALL SELECT query, item, rank, 1 FROM s_bm25 UNION ALL SELECT query, item, rank, 2 FROM s_tt) GROUP BY 1, 2) m JOIN (SELECT query, arg_min(item, back) AS positive FROM hs WHERE label = 'MOVES' GROUP BY 1) p ON p.query = m.query WHERE item <> positive) QUALIFY row_number() OVER (PARTITION BY query ORDER BY src, rank, item) <= 6", *_of("bm25", "tt"))
def j9(spark, d):
    """The latest liked play against six negatives: rejected plays first, then what BM25, then what the vectors mine."""
    w = World(spark, d)
    liked = w.h.where("label = 'MOVES'")
    positive = liked.groupBy("query").agg(F.min_by("item", "back").alias("positive"))
    no = w.h.where("label = 'DOES_NOT'").join(liked.select("query", "item"), ["query", "item"], "left_anti").groupBy("query", "item").agg(F.min("back").alias("rank"))
    parts = [no, w.bm25(), w.unseen(w.dense("tt"))]
    rows = reduce(DataFrame.unionByName, [s.select("query", "item", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("src")) for i, s in enumerate(parts)])
    rows = rows.groupBy("query", "item").agg(F.min(F.struct("src", "rank")).alias("x")).join(positive, "query").where("item != positive").select("query", "positive", F.col("item").alias("negative"), "x.*")
    n = F.row_number().over(Window.partitionBy("query").orderBy("src", "rank", "negative"))
    return rows.withColumn("n", n).where("n <= 6").select("query", "positive", "negative", F.col("n").cast("long").alias("n"))


@query("j11_listwise_groups", "SELECT query, item, label FROM (SELECT query, item, (item = gold)::INT AS label, max((item = gold)::INT) OVER (PARTITION BY query) AS y FROM pool JOIN (SELECT session AS query, item AS gold FROM plays QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) = 1) USING (query)) WHERE y = 1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY label DESC, sha256(query || '/' || item), item) <= 8", WORLD, POOL)
def j11(spark, d):
    """Turns whose item is in the pool: that item and seven others of the pool, by hash."""
    rows = World(spark, d).pool().join(gold(spark, d).select("query", "gold"), "query").select("query", "item", (F.col("item") == F.col("gold")).cast("int").alias("label"))
    rows = rows.withColumn("y", F.max("label").over(Window.partitionBy("query"))).where("y = 1")
    key = F.sha2(F.concat_ws("/", F.col("query").cast("string"), F.col("item").cast("string")), 256)
    n = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("label"), key, "item"))
    return rows.withColumn("n", n).where("n <= 8").select("query", "item", "label")


_SAY = "'I recommend \"' || {n} || '\" by ' || {a} || '.'"


@query("j14_preference_pairs", f"SELECT a.query, a.item AS chosen, b.item AS rejected, {_SAY.format(n='a.name', a='a.artist')} AS chosen_response, {_SAY.format(n='b.name', a='b.artist')} AS rejected_response FROM fused a JOIN fused b ON a.query = b.query AND a.rank = 1 AND b.rank = 5", WORLD, POOL, SIGNALS, _FACTS, FUSED.replace("said.item = query", "said.item = sig.query"))
def j14(spark, d):
    """The fused list's first item against its fifth, and the responses that name them."""
    rows, _, _ = _fused(spark, d)
    rows = rows.where("rank IN (1, 5)").withColumn("response", F.format_string('I recommend "%s" by %s.', "name", "artist"))
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return rows.groupBy("query").agg(at(1, "item").alias("chosen"), at(5, "item").alias("rejected"), at(1, "response").alias("chosen_response"), at(5, "response").alias("rejected_response")).where("rejected IS NOT NULL")


#: why a turn's item is or isn't reached, by its places in the whole lists of two vector spaces (a, c) and of BM25 (b); the first that holds
REACH = [("history_len = 1", "cold_start"), ("named AND b IS NULL", "entity_link_gap"), ("a <= 0.06 * n", "mid_range_tt"), ("coalesce(b, n) < 0.02 * n AND a > 0.1 * n", "bm25_only"), ("a > 0.1 * n AND c > 0.1 * n", "truly_unreachable")]


def _place_sql(space: str) -> str:
    return f"SELECT g.query, 1 + count(*) FILTER (WHERE x.s > g.s OR (x.s = g.s AND x.item < g.item)) AS place FROM (SELECT query, item, round(list_dot_product(qv.{space}, sv.{space}), 9) AS s FROM qv, sv WHERE qv.{space} IS NOT NULL) x JOIN (SELECT gd.query, sv.item, round(list_dot_product(qv.{space}, sv.{space}), 9) AS s FROM gd JOIN qv USING (query) JOIN sv ON sv.item = gold WHERE qv.{space} IS NOT NULL) g ON g.query = x.query GROUP BY 1"


@query("h12_reach", "SELECT query, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in REACH) + " ELSE 'high_rank_tt' END AS bucket FROM (SELECT gd.query, len AS history_len, query IN (SELECT query FROM named) AS named, (SELECT count(*) FROM part) AS n, "
    f"(SELECT place FROM ({_place_sql('tt')}) p WHERE p.query = gd.query) AS a, (SELECT rank FROM ball WHERE ball.query = gd.query AND ball.item = gold) AS b, (SELECT place FROM ({_place_sql('cf')}) p WHERE p.query = gd.query) AS c FROM gd JOIN (SELECT query, count(*) AS len FROM hs GROUP BY 1) USING (query))",
    WORLD, MESSAGES, NAMED, "gd AS (SELECT session AS query, item AS gold FROM plays WHERE session % 20 = 0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) = 1)", "ball AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM sc)")
def h12(spark, d):
    w, items = World(spark, d), facts(spark, d)
    g = gold(spark, d).select("query", "gold").join(w.h.groupBy("query").agg(F.count(F.lit(1)).alias("history_len")), "query")

    g = kept(g)
    wanted = g.select("query", F.col("gold").alias("item"))

    def place(space: str, name: str) -> DataFrame:
        return retrieval.places(w.asking(space), w.spaced(space), wanted, members=w.holders).withColumnRenamed("place", name)

    ranked = retrieval.bm25_places(retrieval.bm25_asked(asked(w.h, spark, d)), w.docs, wanted, once=True).withColumnRenamed("place", "b")
    said = found.mentions(messages(w.h, items).withColumnRenamed("said", "text"), _artists(items)).select("query", F.lit(True).alias("named")).distinct()
    rows = g.join(place("tt", "a"), "query", "left").join(place("cf", "c"), "query", "left").join(ranked, "query", "left").join(said, "query", "left").withColumn("named", F.coalesce("named", F.lit(False)))
    rows = rows.withColumn("n", F.lit(t.table(spark, d, "part").count()))
    out = F.when(F.lit(False), "")
    for cond, name in REACH:
        out = out.when(F.expr(cond), name)
    return rows.select("query", out.otherwise("high_rank_tt").alias("bucket"))
