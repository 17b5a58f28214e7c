"""Model and dataset building (J), streaming analogues (L) and strategy lookup (M)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import codebook, cooccur, reduction, retrieval
from tessera.plans.base import CAT, EPLAYS, PLAYS, PRED, TURNS, VECS, query
from tessera.plans.joins import CENT
from tessera.plans.windows import LIST, lists
from tessera.sources import tables as t
from tessera.sources.staging import kept
from tessera.streaming import sessions


@query("j1_residual_codes")
def j1(spark, d):
    return codebook.two_level(t.vectors(spark, d), 8, 8)


@query("j2_projected_codes")
def j2(spark, d):
    """Two modalities, the vector's halves: each scaled by itself, then reduced and coded together."""
    return codebook.multimodal(t.vectors(spark, d), _halves(), 8, 8, 64, 16)


def _halves() -> list:
    return [F.slice("v", 1, 32), F.slice("v", 33, 32)]


_JOINT = """jn AS (SELECT item, list_concat(list_transform(a, lambda x: x / na), list_transform(b, lambda x: x / nb)) AS j FROM (
  SELECT item, v[1:32] AS a, v[33:64] AS b, greatest(sqrt(list_dot_product(v[1:32], v[1:32])), 1e-8) AS na, greatest(sqrt(list_dot_product(v[33:64], v[33:64])), 1e-8) AS nb FROM vecs)),
ju AS (SELECT item, list_transform(j, lambda x: x / greatest(sqrt(list_dot_product(j, j)), 1e-8)) AS j FROM jn),
gm AS (SELECT i, k, sum(j[i] * j[k]) AS g FROM ju, range(1, 65) a(i), range(1, 65) b(k) GROUP BY 1, 2)"""


@query("j2_explained_energy", "SELECT (SELECT count(*) FROM ju) AS items, round((SELECT sum(g) FROM gm WHERE i = k), 4) AS energy, round((SELECT sum(g * g) FROM gm), 3) AS squares, true AS left_out, true AS orthogonal", VECS, _JOINT)
def j2_energy(spark, d):
    """The energies' sum and sum of squares (trace and norm of the Gram matrix); that what 16 directions leave out of the rows is the rest of the energy, and that they are orthogonal."""
    rows = t.vectors(spark, d).select("item", vector.unit(F.concat(*[vector.unit(p) for p in _halves()])).alias("v"))
    energy, directions = reduction.leading(reduction.gram(rows, 64), 16)
    apart = abs(directions @ directions.T - np.eye(len(directions))).max()
    left = reduction.projected(rows, directions).agg(F.count(F.lit(1)).alias("items"), F.sum("left").alias("left"))
    fits = F.abs(F.col("left") - float(energy[16:].sum())) < 1e-6 * F.greatest(F.col("items"), F.lit(1))
    return left.select("items", F.lit(round(float(energy.sum()), 4)).alias("energy"), F.lit(round(float((energy**2).sum()), 3)).alias("squares"), fits.alias("left_out"), F.lit(bool(apart < 1e-9)).alias("orthogonal"))


@query("j3_flat_codes")
def j3(spark, d):
    return codebook.assign(t.vectors(spark, d).select("item", vector.unit(F.col("v")).alias("v")), 20, 42)[0].select("item", "code")


@query("j6_cooccurrence_events", "SELECT src, dst, w FROM (SELECT a.item AS src, b.item AS dst, sum(CASE abs(b.pos - a.pos) WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN .5 ELSE .25 END) AS w FROM eplays a JOIN eplays b ON a.session = b.session AND abs(b.pos - a.pos) BETWEEN 1 AND 3 AND a.item <> b.item GROUP BY 1, 2) WHERE w >= 1", EPLAYS)
def j6(spark, d):
    return cooccur.neighbours(t.event_plays(spark, d)).select("src", "dst", "w")


@query("j7_bm25_index", r"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT item, term, count(*) AS tf FROM (SELECT doc_id AS item, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def j7(spark, d):
    tf, _ = retrieval.index(t.table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text"))
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("j10_cold_pairs", "SELECT item, CASE WHEN item % 2 = 0 THEN name ELSE artist END AS a, CASE WHEN item % 2 = 0 THEN artist ELSE name END AS b FROM cat WHERE item NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 20)", CAT)
def j10(spark, d):
    cold = t.catalog(spark, d).join(t.table(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_partkey").alias("item")), "item", "left_anti")
    even = F.col("item") % 2 == 0
    return cold.select("item", F.when(even, F.col("name")).otherwise(F.col("artist")).alias("a"), F.when(even, F.col("artist")).otherwise(F.col("name")).alias("b"))


@query("l2_session_state", "SELECT session, count(*) AS plays, count(DISTINCT item) AS kinds FROM eplays GROUP BY 1", EPLAYS)
def l2(spark, d):
    return sessions.running_state(spark, d)


@query("l3_available_now", "SELECT user_id AS session, count(*) AS n FROM events GROUP BY 1")
def l3(spark, d):
    return sessions.appended(spark, d).groupBy(F.col("user_id").alias("session")).agg(F.count(F.lit(1)).alias("n"))


SCORES = {"plays": lambda: -F.col("rank"), "price": lambda: F.col("popularity"), "size": lambda: F.col("size")}


@query("m2_strategies", "SELECT query, strategy, item FROM (SELECT query, item, 'plays' AS strategy, row_number() OVER (PARTITION BY query ORDER BY -rank DESC, item) AS n FROM lst UNION ALL SELECT query, item, 'price', row_number() OVER (PARTITION BY query ORDER BY popularity DESC, item) FROM lst UNION ALL SELECT query, item, 'size', row_number() OVER (PARTITION BY query ORDER BY size DESC, item) FROM lst) WHERE n = 1", PRED, CAT, LIST)
def m2(spark, d):
    rows, out = lists(spark, d), None
    for name, score in SCORES.items():
        one = retrieval.top_k(rows.withColumn("score", score()).drop("rank"), ["query"], 1).select("query", F.lit(name).alias("strategy"), "item")
        out = one if out is None else out.unionByName(one)
    return out


@query("m6_generator_rows", "SELECT item, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS at FROM cat", CAT)
def m6(spark, d):
    return t.catalog(spark, d).select("item", F.posexplode("tags").alias("at", "tag")).select("item", "tag", F.col("at").cast("long").alias("at"))


@query("a7_codebook_tables", "SELECT item, vecs.l0, round(c[1], 6) AS first, round(c[64], 6) AS last FROM vecs JOIN cent USING (l0)", VECS, CENT)
def a7(spark, d):
    """A codebook is two tables, codes and centroids, written and read by name."""
    from tessera.plans.scans import _temp

    at, v = _temp(spark), t.vectors(spark, d)
    mean = F.array(*[F.avg(F.element_at("v", i + 1)) for i in range(64)])
    v.select("item", "l0").write.parquet(f"{at}/codes")
    v.groupBy("l0").agg(mean.alias("c")).write.parquet(f"{at}/centroids")
    codes, centres = spark.read.schema("item long, l0 int").parquet(f"{at}/codes"), spark.read.schema("l0 int, c array<double>").parquet(f"{at}/centroids")
    return codes.join(centres, "l0").select("item", "l0", F.round(F.element_at("c", 1), 6).alias("first"), F.round(F.element_at("c", 64), 6).alias("last"))


@query("l1_windowed_stream", "SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def l1(spark, d):
    """Event counts and sums by ten-minute window and type, from the stream alone."""
    rows = sessions.windowed(spark, d)
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_SPAN = "span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)"
_ARRIVED = "ev AS (SELECT events.*, epoch_us(ts) AS us, least(2, 3 * (epoch_us(ts) - lo) // (hi - lo + 1) + (event_id % 11 = 0)::INT) AS arrival FROM events, span)"
#: the watermark after each arrival, in whole milliseconds; none before the first
_MARKS = "wm AS (SELECT a.arrival, max(ev.us) // 1000 * 1000 - 3600000000 AS mark FROM (SELECT DISTINCT arrival FROM ev) a JOIN ev ON ev.arrival <= a.arrival GROUP BY 1 UNION ALL SELECT -1, -1)"


def _closed_sql(size: int, slide: int) -> str:
    """Windows of minutes that are closed at the end, of rows whose window was open when they came."""
    cells = f"SELECT (us // {slide * 60_000_000} - k) * {slide * 60_000_000} AS s, ev.event_type, value, arrival FROM ev, range({size // slide}) r(k)"
    end = f"s + {size * 60_000_000}"
    return f"SELECT strftime(make_timestamp(s), '%Y-%m-%d %H:%M') AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM ({cells}) JOIN wm ON wm.arrival = cells.arrival - 1 WHERE {end} > mark AND {end} <= (SELECT max(mark) FROM wm) GROUP BY 1, 2".replace(") JOIN wm", ") cells JOIN wm")


def _closed(spark, d, kind: str):
    rows = sessions.closed(spark, d, kind)
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "key", "n", F.round("total", 4).alias("total"))


@query("l1_closed_windows", _closed_sql(10, 10), _SPAN, _ARRIVED, _MARKS)
def l1_closed(spark, d):
    """Ten-minute windows that the watermark has passed, from arrivals with late rows."""
    return _closed(spark, d, "tumbling")


@query("l1_sliding_windows", _closed_sql(30, 10), _SPAN, _ARRIVED, _MARKS)
def l1_sliding(spark, d):
    """Half hours, a new one every ten minutes, that the watermark has passed."""
    return _closed(spark, d, "sliding")


_PAUSE = 6 * 3_600_000_000


def _sessions_sql(k: int) -> str:
    """Sessions after an arrival: those still open and the rows that aren't late, joined where they overlap; closed ones are known by their end."""
    rows = f"SELECT user_id, us AS s, us + {_PAUSE} AS e, 1 AS n, value AS total FROM ev WHERE arrival = {k} AND us + {_PAUSE} > (SELECT mark FROM wm WHERE arrival = {k - 1})"
    still = f" UNION ALL SELECT user_id, s, e, n, total FROM ses{k - 1} WHERE e > (SELECT mark FROM wm WHERE arrival = {k - 1})" if k else ""
    return f"""ses{k} AS (SELECT user_id, min(s) AS s, max(e) AS e, sum(n) AS n, sum(total) AS total FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM (
    SELECT *, (s > coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS fresh FROM ({rows}{still}))) GROUP BY user_id, island)"""


@query("l1_session_windows", "SELECT strftime(make_timestamp(s), '%Y-%m-%d %H:%M') AS start, CAST(user_id AS VARCHAR) AS key, CAST(n AS BIGINT) AS n, round(total, 4) AS total FROM (" + " UNION ALL ".join(f"SELECT ses{k}.* FROM ses{k}, wm WHERE arrival = {k} AND e <= mark" for k in range(3)) + ")", _SPAN, _ARRIVED, _MARKS, *[_sessions_sql(k) for k in range(3)])
def l1_sessions(spark, d):
    """Users' sessions, ended by a pause, that the watermark has passed."""
    return _closed(spark, d, "session")


@query("l2_turn_history", f"""SELECT user_id AS session, event_id, coalesce(array_to_string(list_reverse(list_slice(before, -{sessions.HISTORY}, -1)), ' '), '') AS history FROM (
  SELECT *, list(event_type) OVER (PARTITION BY user_id, island ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM (
      SELECT *, coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {sessions.IDLE_DAYS} * 86400000000)::INT, 1) AS fresh FROM (SELECT *, epoch_us(ts) AS us FROM events))))
  WHERE (us // 86400000000 + 1) * 86400000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events)""")
def l2_history(spark, d):
    """What a turn's history was, from state that lives through the arrivals."""
    return sessions.histories(spark, d)


_USED = r"list_reduce(list_prepend({'used': 0::BIGINT, 't': ''}, parts), lambda a, x: CASE WHEN a.used + len(string_split_regex(x.t, '\s+')) <= 60 THEN {'used': a.used + len(string_split_regex(x.t, '\s+')), 't': ''} ELSE a END).used"


@query("m5_list_folds", f"SELECT session, round(mean_chars, 6) AS mean_chars, {_USED} AS packed_words FROM (SELECT session, avg(length(text)) AS mean_chars, list({{'used': 0::BIGINT, 't': text}} ORDER BY turn DESC, text DESC) AS parts FROM turns GROUP BY 1)", TURNS)
def m5(spark, d):
    """Folds over a session's texts, the latest first: a mean with its own merge and finish, and a greedy packing."""
    texts = F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]))
    rows = t.turns(spark, d).groupBy("session").agg(texts.alias("parts"))
    mean = F.aggregate("parts", F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n")), lambda a, x: F.struct((a["total"] + F.length(x)).alias("total"), (a["n"] + 1).alias("n")), lambda a: a["total"] / a["n"])
    words = lambda x: F.size(F.split(x, r"\s+")).cast("long")
    packed = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: F.when(a + words(x) <= 60, a + words(x)).otherwise(a))
    return rows.select("session", F.round(mean, 6).alias("mean_chars"), packed.alias("packed_words"))
