"""Scans, sources, projections and filters (A, B)."""

from __future__ import annotations

import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import ranking, text, vector
from tessera.operators import history
from tessera.plans.base import CAT, PLAYS, TURNS, VECS, query
from tessera.operators.ordering import numbered
from tessera.sources import jsonarray
from tessera.sources import tables as t


def _temp(spark) -> str:
    """A folder for a round trip: in the shared folder where the session names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/tessera-trip-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessera-") + "/out"


@query("a1_catalog_scan", "SELECT c_custkey AS id, c_name || '/2' AS name FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, c_name || '/1' FROM customer WHERE c_acctbal <= 0")
def a1(spark, d):
    all_rows = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("/1")).alias("name"))
    later = t.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("/2")).alias("name"))
    return t.last_wins([all_rows, later], "id")


@query("a2_session_scan", "SELECT conv_id AS session, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1")
def a2(spark, d):
    nested = t.turns(spark, d).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("conversations"))
    return nested.select("session", F.size("conversations").cast("long").alias("turns"), F.col("conversations")[0]["turn"].alias("first_turn"), F.element_at("conversations", -1)["turn"].alias("last_turn"))


@query("a3_json_array_scan", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INT) AS turn_number, text AS predicted_response FROM conversations WHERE role = 'user'")
def a3(spark, d):
    rows = t.turns(spark, d).where("role = 'user'").select(F.col("session").cast("string").alias("session_id"), F.lit(None).cast("string").alias("user_id"), F.col("turn").cast("int").alias("turn_number"), F.array().cast("array<string>").alias("predicted_track_ids"), F.col("text").alias("predicted_response"))
    at = _temp(spark)
    one = rows.groupBy(F.col("turn_number").alias("file")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    one.repartition(8, "file").select("value").write.option("maxRecordsPerFile", 1).text(at)
    return t.json_array(spark, at, t.PREDICTIONS).select("session_id", "turn_number", "predicted_response")


@query("a3_json_array_ranges", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INT) AS turn_number, text AS predicted_response FROM conversations")
def a3_ranges(spark, d):
    """Arrays read in ranges of bytes, as files too long for a task are: a range holds several elements and cuts some."""
    rows = t.turns(spark, d).select(F.col("session").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_number"), F.col("text").alias("predicted_response"))
    at = _temp(spark)
    # a file for each turn number holds all sessions' turns of it, an element a line; the writer keeps an order that begins with its own column
    lines = rows.select(F.col("turn_number").alias("file"), F.to_json(F.struct(*rows.columns)).alias("value"))
    order = Window.partitionBy("file").orderBy(F.xxhash64("value"), "value")
    n, last = F.row_number().over(order), F.count(F.lit(1)).over(Window.partitionBy("file"))
    lines = lines.withColumn("n", n).withColumn("last", last)
    value = F.concat(F.when(F.col("n") == 1, "[").otherwise(","), "value", F.when(F.col("n") == F.col("last"), "]").otherwise(""))
    lines.select("file", "n", value.alias("value")).repartition("file").sortWithinPartitions("file", "n").drop("n").write.partitionBy("file").text(at)
    return jsonarray.rows(spark, at, t.PREDICTIONS, 1 << 18).select("session_id", "turn_number", "predicted_response")


@query("a4_json_lines_scan", "SELECT conv_id AS session, turn, role, text FROM conversations")
def a4(spark, d):
    rows, at = t.turns(spark, d), _temp(spark)
    t.write_json(rows, at)
    return t.json_lines(spark, at, rows.schema)


@query("a5_matrix_scan", "SELECT item, len(v) AS dims, round(v[1], 6) AS first FROM vecs", VECS)
def a5(spark, d):
    return t.vectors(spark, d).select("item", F.size("v").cast("long").alias("dims"), F.round(F.col("v")[0], 6).alias("first"))


@query("a6_parquet_trip", "SELECT vec_id, label FROM embeddings WHERE label >= 5")
def a6(spark, d):
    at = _temp(spark)
    t.table(spark, d, "embeddings").select("vec_id", "label").write.parquet(at)
    return spark.read.schema("vec_id long, label int").parquet(at).where("label >= 5")


@query("a9_vector_repair", "SELECT item, round(list_dot_product(u, u), 6) AS len2, round(u[1], 6) AS first FROM (SELECT item, list_transform(w, lambda x: x / greatest(sqrt(list_dot_product(w, w)), 1e-8)) AS u FROM (SELECT item, CASE WHEN item % 7 = 0 THEN list_transform(range(64), lambda x: 0.0::DOUBLE) ELSE v END AS w FROM vecs))", VECS)
def a9(spark, d):
    broken = t.vectors(spark, d).withColumn("v", F.when(F.col("item") % 7 == 0, F.slice("v", 1, 3)).otherwise(F.col("v")))
    u = broken.select("item", vector.repaired(F.col("v"), 64).alias("u"))
    return u.select("item", F.round(vector.dot(F.col("u"), F.col("u")), 6).alias("len2"), F.round(F.col("u")[0], 6).alias("first"))


@query("a10_user_vector_drop", "SELECT item FROM vecs WHERE item % 5 <> 0", VECS)
def a10(spark, d):
    v = F.when(F.col("item") % 5 == 0, F.array_repeat(F.lit(0.0), 64)).otherwise(F.col("v"))
    return t.vectors(spark, d).withColumn("v", v).where((F.size("v") == 64) & (vector.norm(F.col("v")) > 1e-8)).select("item")


@query("a11_prediction_sink", "SELECT session AS session_id, count(*) AS n FROM plays GROUP BY 1", PLAYS)
def a11(spark, d):
    lists = t.plays(spark, d).groupBy(F.col("session").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("predicted_track_ids"))
    at = _temp(spark)
    t.write_json(lists, at)
    return t.json_lines(spark, at, lists.schema).select("session_id", F.size("predicted_track_ids").cast("long").alias("n"))


@query("a12_feature_sink", "SELECT session % 5 AS fold, count(*) AS n FROM plays GROUP BY 1", PLAYS)
def a12(spark, d):
    at = _temp(spark)
    t.write_features(t.plays(spark, d).withColumn("fold", F.col("session") % 5), at, "fold")
    return spark.read.parquet(at).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("a13_provenance_sink", "SELECT session, max(pos) AS turns, count(*) FILTER (WHERE label = 'MOVES') AS gold FROM plays GROUP BY 1", PLAYS)
def a13(spark, d):
    rows, at = t.plays(spark, d), _temp(spark)
    t.write_json(rows, at)
    back = t.json_lines(spark, at, rows.schema)
    return back.groupBy("session").agg(F.max("pos").cast("long").alias("turns"), F.count(F.when(F.col("label") == "MOVES", 1)).alias("gold"))


@query("a14_shard_merge", "SELECT session, dense_rank() OVER (ORDER BY session) - 1 AS group_id, count(*) AS n FROM turns GROUP BY session", TURNS)
def a14(spark, d):
    rows = t.turns(spark, d)
    both = t.merged_shards([rows.where("session % 2 = 0"), rows.where("session % 2 = 1")], ["session"])
    return both.groupBy("session", "group_id").agg(F.count(F.lit(1)).alias("n"))


@query("a15_resumable_stage", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a15(spark, d):
    return t.append_missing(t.table(spark, d, "documents").select("doc_id"), t.table(spark, d, "labels"), ["doc_id"])


@query("a16_response_cache", "SELECT session, turn FROM turns t WHERE NOT EXISTS (SELECT 1 FROM turns c WHERE c.session = t.session AND c.turn = t.turn AND c.role = 'assistant')", TURNS)
def a16(spark, d):
    rows = t.turns(spark, d)
    return t.append_missing(rows.select("session", "turn"), rows.where("role = 'assistant'"), ["session", "turn"])


@query("a19_session_normaliser", "SELECT session, CASE WHEN role IN ('user', 'human') THEN 'user' ELSE 'system' END AS speaker, row_number() OVER (PARTITION BY session ORDER BY turn) AS n FROM turns", TURNS)
def a19(spark, d):
    who = F.when(F.col("role").isin("user", "human"), "user").otherwise("system")
    return t.turns(spark, d).select("session", who.alias("speaker"), F.row_number().over(Window.partitionBy("session").orderBy("turn")).cast("long").alias("n"))


@query("a20_markdown_report", "SELECT session, string_agg('| ' || turn || ' | ' || role || ' |', chr(10) ORDER BY turn) AS report FROM turns GROUP BY 1", TURNS)
def a20(spark, d):
    line = F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), F.col("role"), F.lit(" |"))
    return t.turns(spark, d).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda r: r["x"]), "\n").alias("report"))


@query("a21_rerank_export", "SELECT session, string_agg(item || ':' || name, ';' ORDER BY pos) AS docs FROM plays JOIN cat USING (item) GROUP BY 1", PLAYS, CAT)
def a21(spark, d):
    rows = t.plays(spark, d).join(t.catalog(spark, d).select("item", "name"), "item")
    one = F.concat(F.col("item").cast("string"), F.lit(":"), F.col("name"))
    return rows.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("x")))), lambda r: r["x"]), ";").alias("docs"))


@query("a22_schema_inspection", "SELECT column_name AS column_name FROM information_schema.columns WHERE table_name = 'documents'")
def a22(spark, d):
    return spark.createDataFrame([(c,) for c in t.table(spark, d, "documents").columns], "column_name string")


@query("a23_csv_trip", "SELECT p_partkey, p_brand, p_size FROM part")
def a23(spark, d):
    at = _temp(spark)
    t.table(spark, d, "part").select("p_partkey", "p_brand", "p_size").write.option("header", True).csv(at)
    return spark.read.schema("p_partkey long, p_brand string, p_size int").option("header", True).csv(at)


@query("b1_first_of_list", "SELECT item, coalesce(tags[1], '') AS first, '' AS none FROM cat", CAT)
def b1(spark, d):
    return t.catalog(spark, d).select("item", F.coalesce(F.get("tags", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get(F.array().cast("array<string>"), F.lit(0)), F.lit("")).alias("none"))


@query("b2_track_text", "SELECT item, name || ' ' || artist || ' ' || array_to_string(tags, ' ') AS text FROM cat", CAT)
def b2(spark, d):
    return t.catalog(spark, d).select("item", F.trim(F.concat_ws(" ", "name", "artist", F.array_join("tags", " "))).alias("text"))


@query("b3_index_text", "SELECT item, name || ' by ' || artist || ' | Tags: ' || array_to_string(tags[1:12], ', ') || CASE WHEN size > 25 THEN ' | ' || size ELSE '' END AS text FROM cat", CAT)
def b3(spark, d):
    year = F.when(F.col("size") > 25, F.col("size").cast("string"))
    return t.catalog(spark, d).select("item", F.concat_ws(" | ", F.concat("name", F.lit(" by "), "artist"), F.concat(F.lit("Tags: "), F.array_join(F.slice("tags", 1, 12), ", ")), year).alias("text"))


@query("b4_rerank_text", "SELECT item, name || ' by ' || artist || '; tags ' || array_to_string(tags[1:6], ', ') || '; ' || size AS text FROM cat", CAT)
def b4(spark, d):
    return t.catalog(spark, d).select("item", F.concat_ws("; ", F.concat("name", F.lit(" by "), "artist"), F.concat(F.lit("tags "), F.array_join(F.slice("tags", 1, 6), ", ")), F.col("size").cast("string")).alias("text"))


@query("b5_short_texts", "SELECT item, name || ' ' || artist AS plain, name || ' – ' || artist AS dash, name || ' by ' || artist AS by_form FROM cat", CAT)
def b5(spark, d):
    return t.catalog(spark, d).select("item", F.concat_ws(" ", "name", "artist").alias("plain"), F.concat_ws(" – ", "name", "artist").alias("dash"), F.concat_ws(" by ", "name", "artist").alias("by_form"))


@query("b6_bm25_document", "SELECT item, lower(name || ' ' || artist || ' ' || array_to_string(tags, ' ')) AS text FROM cat", CAT)
def b6(spark, d):
    return t.catalog(spark, d).select("item", F.lower(F.concat_ws(" ", "name", "artist", F.array_join("tags", " "))).alias("text"))


@query("b7_weighted_document", "SELECT item, lower(name || ' ' || name || ' ' || name || ' ' || artist || ' ' || artist || ' ' || array_to_string(tags[1:20], ' ')) AS text FROM cat", CAT)
def b7(spark, d):
    parts = F.flatten(F.array(F.array_repeat("name", 3), F.array_repeat("artist", 2), F.slice("tags", 1, 20)))
    return t.catalog(spark, d).select("item", F.lower(F.array_join(parts, " ")).alias("text"))


@query("b8_turn_flatten", "SELECT session, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS at, role, text FROM turns", TURNS)
def b8(spark, d):
    nested = t.turns(spark, d).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("c"))
    return nested.select("session", F.posexplode("c").alias("at", "x")).select("session", F.col("at").cast("long").alias("at"), "x.role", "x.text")


@query("b9_turn_pivot", "SELECT session, turn // 2 AS pair, max(text) FILTER (WHERE role = 'user') AS user_text, max(text) FILTER (WHERE role = 'assistant') AS assistant_text FROM turns GROUP BY 1, 2", TURNS)
def b9(spark, d):
    side = lambda r: F.max_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn")))
    return t.turns(spark, d).groupBy("session", F.floor(F.col("turn") / 2).alias("pair")).agg(side("user").alias("user_text"), side("assistant").alias("assistant_text"))


@query("b10_seen_exclusion", "SELECT session, item FROM (SELECT session, item, pos, max(pos) OVER (PARTITION BY session) AS last FROM plays) GROUP BY 1, 2 HAVING min(pos) = min(last)", PLAYS)
def b10(spark, d):
    """Last plays of sessions whose item the session hasn't seen before."""
    p = t.plays(spark, d).withColumn("last", F.max("pos").over(Window.partitionBy("session")))
    return p.where("pos = last").select("session", "item").join(p.where("pos < last").select("session", "item"), ["session", "item"], "left_anti")


@query("b11_session_filter", "SELECT session, turn FROM turns WHERE session IN (SELECT doc_id FROM labels)", TURNS)
def b11(spark, d):
    return t.turns(spark, d).join(t.table(spark, d, "labels").select(F.col("doc_id").alias("session")), "session", "left_semi").select("session", "turn")


@query("b12_session_slice", "SELECT session FROM (SELECT session, row_number() OVER (ORDER BY session) AS n FROM (SELECT DISTINCT session FROM turns)) WHERE n BETWEEN 11 AND 30", TURNS)
def b12(spark, d):
    return t.turns(spark, d).select("session").distinct().orderBy("session").offset(10).limit(20)


@query("b13_seeded_shuffle", "SELECT session, row_number() OVER (ORDER BY sha256('42/' || session), session) AS n FROM (SELECT DISTINCT session FROM turns)", TURNS)
def b13(spark, d):
    """The order is that of a hash with the seed, equal on every run."""
    ids = t.turns(spark, d).select("session").distinct().withColumn("h", F.sha2(F.concat(F.lit("42/"), F.col("session").cast("string")), 256))
    return numbered(ids, "h", "session").select("session", "n")


@query("b14_hash_sample", "SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295 < 0.25")
def b14(spark, d):
    return t.table(spark, d, "documents").where(ranking.hash_unit(F.col("doc_id")) < 0.25).select("doc_id")


@query("b15_blind_simulation", "SELECT session, turn, CASE WHEN role = 'system' THEN '' ELSE text END AS text, CAST(NULL AS VARCHAR) AS goal FROM turns", TURNS)
def b15(spark, d):
    nested = t.turns(spark, d).withColumn("goal", F.lit("g")).groupBy("session", "goal").agg(F.collect_list(F.struct("turn", "role", "text")).alias("c"))
    blind = nested.withColumn("goal", F.lit(None).cast("string")).withColumn("c", F.transform("c", lambda x: F.when(x["role"] == "system", x.withField("text", F.lit(""))).otherwise(x)))
    return blind.select("session", F.explode("c").alias("x"), "goal").select("session", "x.turn", "x.text", "goal")


@query("b16_turn_coercion", "SELECT session, turn, TRY_CAST(CASE WHEN turn % 3 = 0 THEN 'x' || turn ELSE CAST(turn AS VARCHAR) END AS INT) AS n FROM turns", TURNS)
def b16(spark, d):
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("x"), F.col("turn").cast("string"))).otherwise(F.col("turn").cast("string"))
    return t.turns(spark, d).withColumn("raw", raw).selectExpr("session", "turn", "try_cast(raw AS int) AS n")


@query("b17_blind_rewrite", "SELECT session, kind, row_number() OVER (PARTITION BY session ORDER BY kind, turn) AS at FROM (SELECT session, turn, CASE WHEN role = 'assistant' THEN 0 ELSE 1 END AS kind FROM turns UNION ALL SELECT session, max(turn), 2 FROM turns GROUP BY 1)", TURNS)
def b17(spark, d):
    rows = t.turns(spark, d).select("session", "turn", F.when(F.col("role") == "assistant", 0).otherwise(1).alias("kind"))
    rows = rows.unionByName(rows.groupBy("session").agg(F.max("turn").alias("turn")).withColumn("kind", F.lit(2)))
    return rows.select("session", "kind", F.row_number().over(Window.partitionBy("session").orderBy("kind", "turn")).cast("long").alias("at"))


@query("b18_causality", "SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE coalesce(l_shipdate <= o_orderdate, true)")
def b18(spark, d):
    o = t.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    rows = t.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.where(F.coalesce(F.col("l_shipdate") <= F.col("o_orderdate"), F.lit(True))).select("l_orderkey", "l_partkey", "l_shipdate")


@query("b20_progress_only", "SELECT session, max(pos) AS last_liked FROM plays WHERE label = 'MOVES' GROUP BY 1", PLAYS)
def b20(spark, d):
    order = Window.partitionBy("session").orderBy(F.desc("pos"))
    return t.plays(spark, d).where("label = 'MOVES'").withColumn("n", F.row_number().over(order)).where("n = 1").select("session", F.col("pos").cast("long").alias("last_liked"))


@query("b21_drop_rejected", "SELECT session, pos FROM plays WHERE coalesce(label, '') <> 'DOES_NOT'", PLAYS)
def b21(spark, d):
    return t.plays(spark, d).where("coalesce(label, '') != 'DOES_NOT'").select("session", F.col("pos").cast("long").alias("pos"))


@query("b22_drop_zero_groups", "SELECT session, pos FROM (SELECT session, pos, max((coalesce(label, '') = 'MOVES' AND item < 500)::INT) OVER (PARTITION BY session) AS y FROM plays) WHERE y > 0", PLAYS)
def b22(spark, d):
    good = ((F.col("label") == "MOVES") & (F.col("item") < 500)).cast("int")
    return t.plays(spark, d).withColumn("y", F.max(good).over(Window.partitionBy("session"))).where("y > 0").select("session", F.col("pos").cast("long").alias("pos"))


@query("b23_group_subsample", "SELECT session FROM (SELECT DISTINCT session FROM plays) ORDER BY sha256(CAST(session AS VARCHAR)), session LIMIT 100", PLAYS)
def b23(spark, d):
    return t.plays(spark, d).select("session").distinct().orderBy(F.sha2(F.col("session").cast("string"), 256), "session").limit(100)


@query("b24_min_length", "SELECT session, count(*) AS n FROM plays GROUP BY 1 HAVING count(*) >= 40", PLAYS)
def b24(spark, d):
    return t.plays(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("n")).where("n >= 40")


@query("b25_group_cap", "SELECT item, artist FROM (SELECT item, artist, row_number() OVER (PARTITION BY artist ORDER BY item) AS n FROM cat) WHERE n <= 8", CAT)
def b25(spark, d):
    return t.catalog(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("artist").orderBy("item"))).where("n <= 8").select("item", "artist")


@query("b26_weighted_drop", "SELECT session, pos FROM (SELECT *, CASE label WHEN 'MOVES' THEN 1.0 WHEN 'DOES_NOT' THEN 0.2 ELSE 0.5 END AS w, CAST('0x' || substr(sha256(session || '/' || pos), 1, 8) AS BIGINT) / 4294967295 AS u FROM plays) WHERE w >= 1 OR u < w", PLAYS)
def b26(spark, d):
    w = F.when(F.col("label") == "MOVES", 1.0).when(F.col("label") == "DOES_NOT", 0.2).otherwise(0.5)
    u = ranking.hash_unit(F.concat_ws("/", F.col("session").cast("string"), F.col("pos").cast("string")))
    return t.plays(spark, d).where((w >= 1) | (u < w)).select("session", F.col("pos").cast("long").alias("pos"))


@query("b27_protected_negatives", "SELECT DISTINCT session, item FROM plays p WHERE label = 'DOES_NOT' AND NOT EXISTS (SELECT 1 FROM plays m WHERE m.session = p.session AND m.item = p.item AND m.label = 'MOVES')", PLAYS)
def b27(spark, d):
    p = t.plays(spark, d)
    return p.where("label = 'DOES_NOT'").select("session", "item").distinct().join(p.where("label = 'MOVES'").select("session", "item"), ["session", "item"], "left_anti")


@query("b28_session_split", "SELECT session, n * 20 <= total AS valid FROM (SELECT session, row_number() OVER (ORDER BY sha256(CAST(session AS VARCHAR)), session) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT session FROM turns))", TURNS)
def b28(spark, d):
    ids = t.turns(spark, d).select("session").distinct()
    ids = numbered(ids.withColumn("h", F.sha2(F.col("session").cast("string"), 256)), "h", "session")
    return ids.crossJoin(F.broadcast(ids.agg(F.count(F.lit(1)).alias("total")))).select("session", (F.col("n") * 20 <= F.col("total")).alias("valid"))


@query("b29_held_out", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def b29(spark, d):
    return t.table(spark, d, "documents").select("doc_id").join(t.table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_anti")


@query("b30_duplicate_predictions", "SELECT session, count(*) - count(DISTINCT item) AS repeated FROM plays GROUP BY 1 HAVING count(*) <> count(DISTINCT item)", PLAYS)
def b30(spark, d):
    lists = t.plays(spark, d).groupBy("session").agg(F.collect_list("item").alias("ids"))
    return lists.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("session", (F.size("ids") - F.size(F.array_distinct("ids"))).cast("long").alias("repeated"))


@query("b31_eligible_turns", "SELECT session, pos, item FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY sha256(session || '/' || pos), pos) AS n FROM plays WHERE label = 'MOVES') WHERE n = 1", PLAYS)
def b31(spark, d):
    key = F.sha2(F.concat_ws("/", F.col("session").cast("string"), F.col("pos").cast("string")), 256)
    rows = t.plays(spark, d).where(F.col("label") == history.MOVES)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(key, "pos"))).where("n = 1").select("session", F.col("pos").cast("long").alias("pos"), "item")
