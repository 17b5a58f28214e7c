"""The 70-column feature matrix (K, I28), interaction columns (H28) and the checks of both (J20).

A row is a candidate of a turn's pool (see ``pooling``). A part's album is its brand and type, its
tags are the words of its name, its type and one genre word, its year 1970 plus its size; a leaf
code is its label and its number modulo 8. A turn's latest message is one of the hand-made texts
and names the last item, in a third of the turns its artist too. Columns keep the fixed order that trained models read by
position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ranking, text
from tessera.operators import pool
from tessera.plans.base import query
from tessera.plans.joins import gold
from tessera.plans.pooling import POOL, SENT, SIGNALS, WEIGHTS, WORLD, World
from tessera.plans.scalars import FIXTURES, _era_sql, _list, hit, sql_text
from tessera.sources import tables as t
from tessera.sources.staging import kept

#: fixed values: the columns in their order
COLUMNS = ["tt_cos", "qm_cos", "ql_cos", "clap_cos", "cf_cos", "bm25_signal", "tt_rank_sig", "artist_sig", "nn_sig", "bm25_origin", "artist_origin", "tt_origin", "pool_size", "qm_origin", "qm_rank_sig", "nn_source_count", "mean_nn_origin", "mean_nn_rank_sig", "dist_to_last", "dist_to_recent_mean", "collab_origin", "collab_rank_sig", "collab_score", "collab_source_count", "popularity", "track_year", "n_sources", "turn_number", "history_len", "popularity_pctile", "years_since_release", "tag_overlap_count", "query_len_tokens", "cf_dist_to_last", "cf_dist_to_recent_mean", "goal_category", "user_has_negation", "user_has_followup", "query_track_tag_sim", "n_sources_norm", "log1p_n_sources", "bm25_top1", "sim_to_pos_hist_mean", "sim_to_neg_hist_mean", "artist_in_rejected_set", "n_rejected_in_history", "within_artist_trans_rank", "within_artist_pop_rank", "turns_toward_goal", "consecutive_rejections_tail", "same_album_as_last_history", "n_same_album_in_history", "album_in_recent_window", "q_has_era", "q_era_year", "q_genre_count", "q_mood_count", "q_instrument_count", "cand_genre_match", "cand_era_match", "cand_sem_l0_match_last", "cand_sem_leaf_match_last", "cand_sem_l0_match_count", "cand_sem_l0_match_moves", "from_sem_bucket", "sem_bucket_l0_rank", "sem_bucket_l0_score", "from_sem_centroid", "sem_centroid_l0_rank", "sem_centroid_l0_score"]
#: fixed values: products of two columns, and their names
PRODUCTS = [("tt_cos", "bm25_signal", "tt_x_bm25"), ("tt_rank_sig", "bm25_origin", "ttrank_x_bm25orig"), ("tt_cos", "tt_rank_sig", "tt_x_ttrank"), ("qm_cos", "bm25_signal", "qm_x_bm25"), ("artist_sig", "artist_origin", "artist_x_orig"), ("nn_sig", "tt_cos", "nn_x_tt"), ("collab_rank_sig", "collab_score", "collab_rank_x_score"), ("popularity", "tt_cos", "pop_x_tt"), ("popularity", "bm25_signal", "pop_x_bm25"), ("tag_overlap_count", "bm25_signal", "tagoverlap_x_bm25"), ("tag_overlap_count", "tt_cos", "tagoverlap_x_tt"), ("cf_dist_to_last", "cf_cos", "cfdist_x_cfcos"), ("n_sources", "tt_cos", "nsrc_x_tt"), ("popularity_pctile", "tt_cos", "poppctile_x_tt")]


GENRE = [g for g in text.GENRES if g.isalpha()]


def album():
    return F.concat_ws("/", "artist", "kind")


def tags():
    genre = F.element_at(F.array(*map(F.lit, GENRE)), (F.col("item") % len(GENRE) + 1).cast("int"))
    return F.concat(F.split("name", " "), F.array(F.lower("kind"), genre))


def facts(spark, d) -> DataFrame:
    """item, name, artist, kind, album, tags, popularity, year, pctile of the parts."""
    p = t.table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.col("p_brand").alias("artist"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("popularity"), (F.col("p_size") + 1970).alias("year"))
    # the share of cheaper items: counts of prices, so that no task orders all items
    prices = c.groupBy("popularity").agg(F.count(F.lit(1)).alias("m"))
    ranged = prices.repartitionByRange("popularity").withColumn("part", F.spark_partition_id())
    ranged = kept(ranged)  # the ranges are drawn once
    before = ranged.groupBy("part").agg(F.sum("m").alias("n")).withColumn("ahead", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # a row for each range
    inside = F.sum("m").over(Window.partitionBy("part").orderBy("popularity")) - F.col("m")
    places = ranged.withColumn("inside", inside).join(F.broadcast(before), "part").select("popularity", (F.col("ahead") + F.col("inside")).alias("cheaper"))
    total = c.agg(F.count(F.lit(1)).alias("n_items"))
    c = c.withColumns({"album": album(), "tags": tags()}).join(places, "popularity").crossJoin(F.broadcast(total))
    place = F.col("cheaper") + F.row_number().over(Window.partitionBy("popularity").orderBy("item")) - 1
    return c.withColumn("pctile", place / F.greatest(F.col("n_items") - 1, F.lit(1))).drop("cheaper", "n_items")


def messages(h: DataFrame, items: DataFrame) -> DataFrame:
    """query, said: the turn's latest message."""
    choice = F.element_at(F.array(*map(F.lit, FIXTURES)), (F.floor(F.col("query") / 20) % len(FIXTURES) + 1).cast("int"))
    return h.where("back = 1").join(items.select("item", "name", "artist"), "item").select("query", F.concat(choice, F.lit(" "), "name", F.when(F.floor(F.col("query") / 20) % 3 == 0, F.concat(F.lit(" by "), "artist")).otherwise("")).alias("said"))


def found_words(column, words: list[str]):
    """The words of a list that occur in a text."""
    low = F.lower(column)
    return F.array_compact(F.array(*[F.when(low.contains(w) & low.rlike(text.keyword_pattern(w)), F.lit(w)) for w in words]))


def turns(w: World, items: DataFrame) -> DataFrame:
    """One row for each turn: counts of its history and what its texts hold."""
    h = w.h.join(items.select("item", "artist", "album"), "item").join(w.labels(), "item")
    moves, no = F.col("label") == "MOVES", F.coalesce(F.col("label") == "DOES_NOT", F.lit(False))
    last = lambda c: F.max(F.when(F.col("back") == 1, F.col(c))).alias(f"last_{c}")
    n = F.count(F.lit(1))
    out = h.groupBy("query").agg(n.alias("history_len"), F.count(F.when(moves, 1)).alias("n_moves"), F.count(F.when(no, 1)).alias("n_no"), (F.coalesce(F.min(F.when(~no, F.col("back"))), n + 1) - 1).alias("tail"), last("album"), last("l0"), last("item"))
    customers = t.table(w.spark, w.d, "customer").select(F.col("c_custkey").alias("query"), "c_mktsegment")
    segments = customers.select("c_mktsegment").distinct().withColumn("goal", F.row_number().over(Window.orderBy("c_mktsegment")) - 1)  # a few rows
    out = out.join(customers.join(F.broadcast(segments), "c_mktsegment").select("query", "goal"), "query")
    from tessera.plans.pooling import asked

    words = lambda c: F.array_distinct(text.ascii_words(F.col(c)))
    out = out.join(asked(w.h, w.spark, w.d).withColumnRenamed("text", "wanted"), "query").join(messages(w.h, items), "query")
    out = out.withColumns({"wanted_words": words("wanted"), "said_words": words("said"), "n_words": F.size(text.ascii_words(F.col("said"))), "era": text.era(F.col("said")), "genres": found_words(F.col("said"), text.GENRES)})
    return out.withColumns({"n_genres": F.size("genres"), "n_moods": text.keyword_count(F.col("said"), text.MOODS), "n_instruments": text.keyword_count(F.col("said"), text.INSTRUMENTS), "negation": text.mentions(F.col("said"), text.NEGATION), "followup": text.mentions(F.col("said"), text.FOLLOWUP)})


#: so many rows of the sources are dealt by item and back at a time
SLICE = 6_000_000
#: columns that are cosines, rounded to 9 digits
ANGLES = {"tt_cos": ("two", "tt"), "qm_cos": ("last", "qm"), "ql_cos": ("two", "ql"), "clap_cos": ("recent", "clap"), "cf_cos": ("liked", "cf"), "dist_to_last": ("last", "tt"), "dist_to_recent_mean": ("positive", "tt"), "cf_dist_to_last": ("last", "cf"), "cf_dist_to_recent_mean": ("recent", "cf"), "sim_to_pos_hist_mean": ("liked", "tt"), "sim_to_neg_hist_mean": ("no", "tt")}


def asking(w: World, items: DataFrame, spark, d) -> DataFrame:
    """One row for each turn, with all that its candidates are held against: albums (count and latest place), rejected artists and buckets (counts) of its history, and the item that was played."""
    h = w.h.join(items.select("item", "artist", "album"), "item").join(w.labels(), "item")
    albums = h.groupBy("query", "album").agg(F.count(F.lit(1)).alias("n_album"), F.min("back").alias("album_back")).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("album", F.struct("n_album", "album_back")))).alias("albums"))
    rejected = h.where("label = 'DOES_NOT'").groupBy("query").agg(F.collect_set("artist").alias("artists_no"))
    buckets = h.where("l0 IS NOT NULL").groupBy("query", "l0").agg(F.count(F.lit(1)).alias("n_l0"), F.count(F.when(F.col("label") == "MOVES", 1)).alias("n_l0_moves")).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("l0", F.struct("n_l0", "n_l0_moves")))).alias("buckets"))
    return turns(w, items).drop("wanted", "said").join(albums, "query", "left").join(rejected, "query", "left").join(buckets, "query", "left").join(gold(spark, d, "o_custkey % 20 = 0").select("query", "gold", "turn"), "query")


def packed(features: DataFrame) -> DataFrame:
    """features with cosines as whole billionths, which is what 9 digits are: half as long and as exact."""
    return features.withColumns({c: F.when(~F.isnan(c), F.round(F.col(c) * 1e9)).cast("int") for c in ANGLES})


def unpacked(features: DataFrame) -> DataFrame:
    return features.withColumns({c: F.coalesce(F.col(c) / F.lit(1e9), F.lit(float("nan"))) for c in ANGLES})


def matrix(spark, d, written: bool = False) -> DataFrame:
    """query, item, label and COLUMNS, all double.

    Candidates go to the catalog while they are narrow, and come back to their turns; a turn's own facts are one row, so
    that no wide row is shuffled. Large pools go there and back by slices of turns, each written before the next begins.
    written: small ones too, with columns rounded to 9 digits.
    """
    w = World(spark, d)
    items, n = kept(facts(spark, d)), -(-w.found().count() // SLICE)
    asked_ = kept(asking(w, items, spark, d), free=True)
    if n <= 1 and not written:
        return _columns(w, items, asked_, w.candidates())
    exact = (lambda x: x.select("query", "item", "label", *_rounded(COLUMNS))) if written else (lambda x: x)
    parts = [unpacked(kept(packed(exact(_columns(w, items, asked_, w.candidates(n, i)))), free=True)) for i in range(max(n, 1))]
    return reduce(DataFrame.unionByName, parts)


def _columns(w: World, items: DataFrame, asked_: DataFrame, candidates: DataFrame) -> DataFrame:
    # an album and the tags follow from name, artist and type; narrow rows meet the catalog and are dealt by turn again
    rows = candidates.hint("merge").join(items.select("item", "name", "artist", "kind", "popularity", "year", "pctile"), "item").repartition("query")
    rows = w.told(rows.join(F.broadcast(w.vectors.select("of", "l0")) if w.n_vectors <= SENT else w.vectors.select("of", "l0"), "of"))
    by_artist = Window.partitionBy("query", "artist")
    rows = rows.withColumns({"pool_size": F.count(F.lit(1)).over(Window.partitionBy("query")), "within_artist_trans_rank": F.percent_rank().over(by_artist.orderBy(F.coalesce("collab_w", F.lit(0)))), "within_artist_pop_rank": F.percent_rank().over(by_artist.orderBy("popularity"))})
    rows = rows.withColumns({"album": album(), "tags": tags()}).join(asked_.hint("merge"), "query")
    rows = rows.withColumns({"in_album": F.try_element_at("albums", F.col("album")), "in_bucket": F.try_element_at("buckets", F.col("l0"))})
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    has = lambda name: F.array_contains(F.split("sources", ","), name).cast("int")
    tags_in = lambda c: F.size(F.filter("tags", lambda x: F.array_contains(F.col(c), F.lower(x))))
    own = {
        "artist_origin": has("artist"),
        "tt_origin": has("tt"),
        "qm_origin": has("qm"),
        "nn_source_count": num("nn_from"),
        "mean_nn_origin": has("mean_nn"),
        "collab_origin": has("collab"),
        "collab_score": num("collab_w"),
        "collab_source_count": num("collab_from"),
        "track_year": F.col("year"),
        "turn_number": F.col("turn") + 1,
        "popularity_pctile": F.col("pctile"),
        "years_since_release": 2026 - F.col("year"),
        "tag_overlap_count": tags_in("wanted_words"),
        "query_len_tokens": F.col("n_words"),
        "goal_category": F.col("goal"),
        "user_has_negation": F.col("negation").cast("int"),
        "user_has_followup": F.col("followup").cast("int"),
        "query_track_tag_sim": tags_in("said_words") / F.size("tags"),
        "n_sources_norm": F.col("n_sources") / (F.col("turn") + 2),
        "log1p_n_sources": F.log1p("n_sources"),
        "bm25_top1": flag(F.col("bm25_rank") == 1),
        "artist_in_rejected_set": F.coalesce(F.array_contains("artists_no", F.col("artist")), F.lit(False)).cast("int"),
        "n_rejected_in_history": ranking.clipped(F.col("n_no")),
        "turns_toward_goal": F.col("n_moves"),
        "consecutive_rejections_tail": F.col("tail"),
        "same_album_as_last_history": flag(F.col("album") == F.col("last_album")),
        "n_same_album_in_history": ranking.clipped(num("in_album.n_album")),
        "album_in_recent_window": flag(F.col("in_album.album_back") <= 3),
        "q_has_era": F.col("era.found").cast("int"),
        "q_era_year": F.col("era.centre"),
        "q_genre_count": F.col("n_genres"),
        "q_mood_count": F.col("n_moods"),
        "q_instrument_count": F.col("n_instruments"),
        "cand_genre_match": F.size(F.array_intersect("genres", F.transform("tags", F.lower))),
        "cand_era_match": flag(F.col("year").between(F.col("era.lo"), F.col("era.hi"))),
        "cand_sem_l0_match_last": flag(F.col("l0") == F.col("last_l0")),
        "cand_sem_leaf_match_last": flag((F.col("l0") == F.col("last_l0")) & (F.col("item") % 8 == F.col("last_item") % 8)),
        "cand_sem_l0_match_count": ranking.clipped(num("in_bucket.n_l0")),
        "cand_sem_l0_match_moves": ranking.clipped(num("in_bucket.n_l0_moves")),
        "from_sem_bucket": has("bucket"),
        "sem_bucket_l0_rank": F.coalesce((F.col("bucket_l0_rank") - 1) / 3, F.lit(0.0)),
        "sem_bucket_l0_score": num("bucket_l0_score"),
        "from_sem_centroid": has("centroid"),
        "sem_centroid_l0_rank": F.coalesce((F.col("centroid_l0_rank") - 1) / 3, F.lit(0.0)),
        "sem_centroid_l0_score": num("centroid_l0_score"),
    }
    # cosines come last: only numbers go through them
    made = [own.get(c, F.col(c)).cast("double").alias(c) for c in COLUMNS if c not in ANGLES]
    out = w.compared(rows.select("query", "item", "of", flag(F.col("item") == F.col("gold")).alias("label"), *made))
    return out.select("query", "item", "label", *[w.cosine(*ANGLES[c]).alias(c) if c in ANGLES else c for c in COLUMNS])


def with_products(features: DataFrame) -> DataFrame:
    return features.select("*", *[(F.col(a) * F.col(b)).alias(n) for a, b, n in PRODUCTS])


# ---- the same in SQL

_SAID = "(SELECT [" + ", ".join(map(sql_text, FIXTURES)) + f"][CAST(floor(query / 20) AS BIGINT) % {len(FIXTURES)} + 1])"
MESSAGES = f"said AS (SELECT query AS item, {_SAID} || ' ' || p_name || CASE WHEN CAST(floor(query / 20) AS BIGINT) % 3 = 0 THEN ' by ' || p_brand ELSE '' END AS text FROM hs JOIN part ON p_partkey = item WHERE back = 1)"


def _count(words) -> str:
    return " + ".join(f"regexp_matches(lower(text), {sql_text(text.keyword_pattern(w))})::INT" for w in words)


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda e: e <> ''))"


FEATURES = f"""fct AS (SELECT p_partkey AS item, p_name AS name, p_brand AS artist, p_brand || '/' || p_type AS album, list_concat(string_split(p_name, ' '), [lower(p_type), {_list(GENRE)}[p_partkey % {len(GENRE)} + 1]]) AS tags, p_retailprice AS popularity, p_size + 1970 AS year,
    (row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) / greatest(count(*) OVER () - 1, 1) AS pctile FROM part),
{MESSAGES},
erax AS ({_era_sql()}),
hx AS (SELECT hs.*, artist, album, l0 FROM hs JOIN fct USING (item) JOIN iv USING (item)),
tn AS (SELECT query, count(*) AS history_len, count(*) FILTER (WHERE label = 'MOVES') AS n_moves, count(*) FILTER (WHERE label = 'DOES_NOT') AS n_no, coalesce(min(back) FILTER (WHERE coalesce(label, '') <> 'DOES_NOT'), count(*) + 1) - 1 AS tail,
    max(album) FILTER (WHERE back = 1) AS last_album, max(l0) FILTER (WHERE back = 1) AS last_l0, max(item) FILTER (WHERE back = 1) AS last_item FROM hx GROUP BY 1),
tx AS (SELECT tn.*, (SELECT count(DISTINCT x.c_mktsegment) FROM customer x WHERE x.c_mktsegment < c.c_mktsegment) AS goal, erax.found, erax.centre, erax.lo, erax.hi, {_words('asked.text')} AS wanted_words, {_words('said.text')} AS said_words,
    len(list_filter(string_split_regex(lower(said.text), '[^a-z0-9]+'), lambda e: e <> '')) AS n_words, g.*
    FROM tn JOIN customer c ON c_custkey = query JOIN asked USING (query) JOIN said ON said.item = query JOIN erax ON erax.item = query
    JOIN (SELECT item AS g_query, {_count(text.GENRES)} AS n_genres, {_count(text.MOODS)} AS n_moods, {_count(text.INSTRUMENTS)} AS n_instruments, {hit(text.NEGATION)}::INT AS negation, {hit(text.FOLLOWUP)}::INT AS followup,
      list_filter([{', '.join(f"CASE WHEN regexp_matches(lower(text), {sql_text(text.keyword_pattern(w))}) THEN {sql_text(w)} END" for w in text.GENRES)}], lambda e: e IS NOT NULL) AS genres FROM said) g ON g_query = query),
al AS (SELECT query, album, count(*) AS n_album, min(back) AS album_back FROM hx GROUP BY 1, 2),
rj AS (SELECT DISTINCT query, artist, 1 AS artist_no FROM hx WHERE label = 'DOES_NOT'),
bk AS (SELECT query, l0, count(*) AS n_l0, count(*) FILTER (WHERE label = 'MOVES') AS n_l0_moves FROM hx GROUP BY 1, 2),
gd AS (SELECT session AS query, session % 7 AS turn, item AS gold FROM plays QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) = 1),
rows AS (SELECT * FROM sig JOIN fct USING (item) JOIN tx USING (query) LEFT JOIN al USING (query, album) LEFT JOIN rj USING (query, artist) LEFT JOIN bk USING (query, l0) JOIN gd USING (query))"""


def _has(name: str) -> str:
    return f"list_contains(string_split(sources, ','), '{name}')::INT"


def _cos(x: str, mean: str) -> str:
    return f"round(coalesce(list_dot_product({x}, {mean}), 0), 9)"


def _tags(words: str) -> str:
    return f"len(list_filter(tags, lambda e: list_contains({words}, lower(e))))"


#: what a column is in SQL, where it isn't a signal's or the catalog's name
IN_SQL = {
    "artist_origin": _has("artist"), "tt_origin": _has("tt"), "pool_size": "count(*) OVER (PARTITION BY query)", "qm_origin": _has("qm"), "nn_source_count": "coalesce(nn_from, 0)", "mean_nn_origin": _has("mean_nn"),
    "dist_to_last": _cos("v_tt", "u_last"), "dist_to_recent_mean": _cos("v_tt", "u_positive"), "collab_origin": _has("collab"), "collab_score": "coalesce(collab_w, 0)", "collab_source_count": "coalesce(collab_from, 0)", "track_year": "year",
    "turn_number": "turn + 1", "popularity_pctile": "pctile", "years_since_release": "2026 - year", "tag_overlap_count": _tags("wanted_words"), "query_len_tokens": "n_words", "cf_dist_to_last": _cos("v_cf", "c_last"), "cf_dist_to_recent_mean": _cos("v_cf", "c_recent"),
    "goal_category": "goal", "user_has_negation": "negation", "user_has_followup": "followup", "query_track_tag_sim": f"{_tags('said_words')} / len(tags)", "n_sources_norm": "n_sources / (turn + 2)", "log1p_n_sources": "ln(1 + n_sources)", "bm25_top1": "coalesce((bm25_rank = 1)::INT, 0)",
    "sim_to_pos_hist_mean": _cos("v_tt", "u_liked"), "sim_to_neg_hist_mean": _cos("v_tt", "u_no"), "artist_in_rejected_set": "coalesce(artist_no, 0)", "n_rejected_in_history": "least(n_no, 10) / 10",
    "within_artist_trans_rank": "percent_rank() OVER (PARTITION BY query, artist ORDER BY coalesce(collab_w, 0))", "within_artist_pop_rank": "percent_rank() OVER (PARTITION BY query, artist ORDER BY popularity)", "turns_toward_goal": "n_moves", "consecutive_rejections_tail": "tail",
    "same_album_as_last_history": "(album = last_album)::INT", "n_same_album_in_history": "least(coalesce(n_album, 0), 10) / 10", "album_in_recent_window": "coalesce((album_back <= 3)::INT, 0)", "q_has_era": "found::INT", "q_era_year": "centre", "q_genre_count": "n_genres", "q_mood_count": "n_moods", "q_instrument_count": "n_instruments",
    "cand_genre_match": "len(list_distinct(list_intersect(genres, list_transform(tags, lambda e: lower(e)))))", "cand_era_match": "coalesce((year BETWEEN lo AND hi)::INT, 0)", "cand_sem_l0_match_last": "(l0 = last_l0)::INT", "cand_sem_leaf_match_last": "(l0 = last_l0 AND item % 8 = last_item % 8)::INT",
    "cand_sem_l0_match_count": "least(coalesce(n_l0, 0), 10) / 10", "cand_sem_l0_match_moves": "least(coalesce(n_l0_moves, 0), 10) / 10", "from_sem_bucket": _has("bucket"), "sem_bucket_l0_rank": "coalesce((bucket_l0_rank - 1) / 3, 0)", "sem_bucket_l0_score": "coalesce(bucket_l0_score, 0)",
    "from_sem_centroid": _has("centroid"), "sem_centroid_l0_rank": "coalesce((centroid_l0_rank - 1) / 3, 0)", "sem_centroid_l0_score": "coalesce(centroid_l0_score, 0)",
}
MATRIX = "mx AS (SELECT query, item, (item = gold)::INT AS label, " + ", ".join(f"CAST({IN_SQL.get(c, c)} AS DOUBLE) AS {c}" for c in COLUMNS) + " FROM rows)"
ALL = (WORLD, POOL, SIGNALS, FEATURES, MATRIX)


def _rounded(columns: list[str]) -> list:
    return [(F.round(c, 9) + 0.0).alias(c) for c in columns]  # no negative zeros


@query("i28_feature_matrix", "SELECT query, item, label, " + ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in COLUMNS) + " FROM mx", *ALL)
def i28(spark, d):
    return matrix(spark, d).select("query", "item", "label", *_rounded(COLUMNS))


@query("h28_interactions", "SELECT query, item, " + ", ".join(f"round({a} * {b}, 4) + 0.0 AS {n}" for a, b, n in PRODUCTS) + " FROM mx", *ALL)
def h28(spark, d):
    return with_products(matrix(spark, d)).select("query", "item", *[(F.round(n, 4) + 0.0).alias(n) for _, _, n in PRODUCTS])


def guarded(features: DataFrame, columns: list[str], least_rows: int, prefix: str = "sem_") -> DataFrame:
    """One row for each column: its place, nulls and NaN, infinities, share that is not 0, range, the checks of the
    whole table (row count, prefix columns free of gaps and not all 0) and a fingerprint of ids and codes that doesn't depend on the order of rows."""
    bad = lambda c: F.count(F.when(F.col(c).isNull() | F.isnan(c), 1))
    parts = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), bad(c).alias("missing"), F.count(F.when(F.abs(F.col(c)) == float("inf"), 1)).alias("infinite"), F.round(F.avg((F.coalesce(F.col(c), F.lit(0.0)) != 0).cast("double")), 6).alias("nonzero"), F.round(F.min(c), 9).alias("least"), F.round(F.max(c), 9).alias("most")) for i, c in enumerate(columns, 1)]
    mark = F.sum(F.conv(F.substring(F.sha2(F.concat_ws("/", F.col("query").cast("string"), F.col("item").cast("string")), 256), 1, 8), 16, 10).cast("long"))
    rows = features.agg(F.array(*parts).alias("x"), F.count(F.lit(1)).alias("n_rows"), mark.alias("fingerprint")).select(F.explode("x").alias("x"), "n_rows", "fingerprint").select("x.*", "n_rows", "fingerprint")
    fine = (F.col("missing") == 0) & (F.col("infinite") == 0) & ((F.col("nonzero") > 0) | ~F.col("name").contains(prefix))
    return rows.withColumn("passes", fine & (F.col("n_rows") >= least_rows))


_ONE = "SELECT {i} AS place, '{c}' AS name, count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS missing, count(*) FILTER (WHERE isinf({c})) AS infinite, round(avg((coalesce({c}, 0) <> 0)::INT), 6) AS nonzero, round(min({c}), 9) AS least, round(max({c}), 9) AS most FROM mx"


@query("j20_feature_guard", "SELECT x.*, n_rows, fingerprint, missing = 0 AND infinite = 0 AND (nonzero > 0 OR NOT contains(name, 'sem_')) AND n_rows >= 1000 AS passes FROM (" + " UNION ALL ".join(_ONE.format(i=i, c=c) for i, c in enumerate(COLUMNS, 1)) + ") x, (SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || sha256(query || '/' || item)[1:8] AS BIGINT)) AS BIGINT) AS fingerprint FROM mx)", WORLD, POOL, SIGNALS, FEATURES, MATRIX.replace("mx AS (", "mx AS MATERIALIZED ("))
def j20(spark, d):
    return guarded(matrix(spark, d), COLUMNS, 1000)


# ---- rewriting of the fused list by what the message says (F7, F8)


def _fused(spark, d):
    """(query, item, rank, name, artist, said), best fused score first; the world and the catalog."""
    w, items = World(spark, d), facts(spark, d)
    rows = pool.weighted(w.signals(), WEIGHTS).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    # written once: the files behind the signals go before the ranked list is dealt by item
    rows = kept(rows.select("query", "item", rank.alias("rank")), free=True)
    rows = rows.hint("merge").join(items.select("item", "name", "artist"), "item").repartition("query").join(messages(w.h, items), "query")
    return rows, w, items


FUSED = "fused AS (SELECT query, item, name, artist, text, row_number() OVER (PARTITION BY query ORDER BY round(" + " + ".join(f"{w} * {n}" for n, w in WEIGHTS.items()) + ", 6) DESC, item) AS rank FROM sig JOIN fct USING (item) JOIN said ON said.item = query)"
_FACTS = FEATURES[: FEATURES.index("erax AS")].rstrip().rstrip(",")


def _holds(message, name):
    return F.concat(F.lit(" "), text.normal(message), F.lit(" ")).contains(F.concat(F.lit(" "), text.normal(name), F.lit(" ")))


def _holds_sql(name: str) -> str:
    normal = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
    return f"contains(' ' || {normal('text')} || ' ', ' ' || {normal(name)} || ' ')"


@query("f7_named_boost", f"SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY (rank <= 400 AND length(name) >= 4 AND {_holds_sql('name')} AND {_holds_sql('artist')})::INT DESC, rank) AS rank FROM fused", WORLD, POOL, SIGNALS, _FACTS, FUSED.replace("said.item = query", "said.item = sig.query"))
def f7(spark, d):
    """Candidates whose name and artist the message holds as whole words come first."""
    rows, _, _ = _fused(spark, d)
    match = (F.length(text.normal(F.col("name"))) >= 4) & _holds(F.col("said"), F.col("name")) & _holds(F.col("said"), F.col("artist"))
    return pool.boosted(rows, match, 400).select("query", "item", F.col("new_rank").cast("long").alias("rank"))


@query("f8_pivot_suppress", f"SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY (hit AND others >= 20)::INT, rank) AS rank FROM (SELECT *, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY query) AS others FROM (SELECT f.query, f.item, f.rank, {hit(text.PIVOT, 'f.text')} AND a.artist IS NOT NULL AS hit FROM fused f LEFT JOIN (SELECT DISTINCT query, p_brand AS artist FROM hs JOIN part ON p_partkey = item) a ON a.query = f.query AND a.artist = f.artist))", WORLD, POOL, SIGNALS, _FACTS, FUSED.replace("said.item = query", "said.item = sig.query"))
def f8(spark, d):
    """Where the message wants something else, artists of the history go to the end, if enough others remain."""
    rows, w, items = _fused(spark, d)
    # a turn's own artists go to its message, in one row: candidates are dealt by turn only
    past = w.h.join(items.select("item", "artist"), "item").groupBy("query").agg(F.collect_set("artist").alias("past"))
    hit_ = text.mentions(F.col("said"), text.PIVOT) & F.coalesce(F.array_contains("past", F.col("artist")), F.lit(False))
    return pool.suppressed(rows.join(past, "query", "left"), hit_, 20).select("query", "item", F.col("new_rank").cast("long").alias("rank"))
