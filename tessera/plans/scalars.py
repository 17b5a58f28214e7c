"""Scalar functions (H)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import ranking, text, vector
from tessera.plans.base import CAT, PLAYS, TURNS, VECS, query
from tessera.sources import tables as t

#: hand-made texts beside the tables' own, which hold few of the phrases; item ids are negative
FIXTURES = ["", "something from the 1990s please", "1990", "90s hip-hop", "the nineties", "1985-1995 rock", "in 1987 jazz", "20s", "can you recommend something", "k-pop and r&b with guitar", "rocker", "I love it, perfect", "not really, too slow", "try something else instead", "more like this", "lyrics about rain", "play songs by Anna", 'that "Blue Moon" one', "sad and calm", "“Quiet Night” again", "tired of this, move on", "Don't want more"]


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SAID = "said AS (SELECT doc_id AS item, text FROM documents UNION ALL VALUES " + ", ".join(f"({-i - 1}, {sql_text(x)})" for i, x in enumerate(FIXTURES)) + ")"


def said(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")
    return docs.unionByName(spark.createDataFrame([(-i - 1, x) for i, x in enumerate(FIXTURES)], "item long, text string"))


def hit(phrases: str, column: str = "text") -> str:
    """A word's edge is where ASCII letters end there; other letters become one of them first."""
    return rf"regexp_matches(regexp_replace({column}, '[^\x00-\x7F\P{{L}}]', 'q', 'g'), {sql_text(text.mention_pattern(phrases))})"


@query("h1_normal_text", r"SELECT item, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS x FROM said", SAID)
def h1(spark, d):
    return said(spark, d).select("item", text.normal(F.col("text")).alias("x"))


@query("h2_unicode_fold", r"SELECT item, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '\bfeat\.?\s.*$', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS x FROM said", SAID)
def h2(spark, d):
    """Marks off, brackets and "feat." out; decomposition has no built-in form, so it runs on Arrow batches."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    x = F.regexp_replace(F.regexp_replace(F.lower(fold(F.col("text"))), r"\([^)]*\)|\[[^\]]*\]", " "), r"\bfeat\.?\s.*$", " ")
    return said(spark, d).select("item", F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9 ]", " "), " +", " ")).alias("x"))


@query("h3_filler_removal", rf"SELECT item, coalesce(nullif(trim(regexp_replace(regexp_replace(text, {sql_text(text.mention_pattern(text.FILLER))}, ' ', 'g'), '\s+', ' ', 'g')), ''), text) AS x FROM said", SAID)
def h3(spark, d):
    return said(spark, d).select("item", text.without_filler(F.col("text")).alias("x"))


@query("h4_feedback", f"SELECT item, CASE WHEN {hit(text.POSITIVE)} THEN '{text.MOVES}' WHEN {hit(text.NEGATIVE)} THEN '{text.DOES_NOT}' ELSE '' END AS label FROM said", SAID)
def h4(spark, d):
    return said(spark, d).select("item", text.feedback(F.col("text")).alias("label"))


@query("h5_intent_flags", f"SELECT item, {hit(text.NEGATION)} AS negation, {hit(text.FOLLOWUP)} AS followup FROM said", SAID)
def h5(spark, d):
    return said(spark, d).select("item", text.mentions(F.col("text"), text.NEGATION).alias("negation"), text.mentions(F.col("text"), text.FOLLOWUP).alias("followup"))


@query("h6_pivot", f"SELECT item, {hit(text.PIVOT)} AS pivot FROM said", SAID)
def h6(spark, d):
    return said(spark, d).select("item", text.mentions(F.col("text"), text.PIVOT).alias("pivot"))


def _era_sql() -> str:
    pick = lambda p, g: f"TRY_CAST(nullif(regexp_extract(low, {sql_text(p)}, {g}), '') AS INT)"
    named = "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN {y}" for w, y in text.DECADES.items()) + " END"
    return f"""SELECT item, lo IS NOT NULL AS found, coalesce((lo + hi) / 2, 0) AS centre, lo, hi FROM (
      SELECT item, coalesce(least(a, b), ten, yr) AS lo, coalesce(CASE WHEN a IS NOT NULL THEN greatest(a, b) END, ten + 9, yr) AS hi FROM (
        SELECT item, {pick(text.RANGE, 1)} AS a, {pick(text.RANGE, 2)} AS b, coalesce({named}, {pick(text.TENS, 1)}, 1900 + {pick(text.SHORT, 1)}) AS ten, {pick(text.YEAR, 1)} AS yr
        FROM (SELECT item, lower(text) AS low FROM said)))"""


@query("h7_era", _era_sql(), SAID)
def h7(spark, d):
    return said(spark, d).select("item", text.era(F.col("text")).alias("e")).select("item", "e.found", "e.centre", "e.lo", "e.hi")


def _keys_sql(words) -> str:
    return " + ".join(f"regexp_matches(lower(text), {sql_text(text.keyword_pattern(w))})::INT" for w in words)


@query("h8_keyword_counts", f"SELECT item, {_keys_sql(text.GENRES)} AS genres, {_keys_sql(text.MOODS)} AS moods, {_keys_sql(text.INSTRUMENTS)} AS instruments FROM said", SAID)
def h8(spark, d):
    c = lambda ws: text.keyword_count(F.col("text"), ws)
    return said(spark, d).select("item", c(text.GENRES).alias("genres"), c(text.MOODS).alias("moods"), c(text.INSTRUMENTS).alias("instruments"))


QUOTED = "[\"“]([^\"“”]{3,60})[\"”]"


@query("h9_quoted_phrases", f"SELECT item, array_to_string(regexp_extract_all(text, {sql_text(QUOTED)}, 1), '|') AS phrases FROM said WHERE regexp_matches(text, {sql_text(QUOTED)})", SAID)
def h9(spark, d):
    rows = said(spark, d).where(F.col("text").rlike(QUOTED))
    return rows.select("item", F.array_join(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1)), "|").alias("phrases"))


def _in(words, column="low"):
    return "(" + " OR ".join(f"contains({column}, {sql_text(w)})" for w in words) + ")"


def _list(words):
    return "[" + ", ".join(map(sql_text, words)) + "]"


@query("h10_audit_bucket", rf"""SELECT item, CASE WHEN {_in(text.SIMILAR)} THEN 'more_like_this' WHEN list_has_any(string_split_regex(low, '\s+'), {_list(text.LYRICS)}) THEN 'lyrics'
  WHEN regexp_matches(text, '(?i)"[^"]+"|' || {sql_text(text.EDGE_L)} || 'by\s+[\p{{L}}\p{{N}}_]+') THEN 'specific' WHEN list_has_any(string_split_regex(low, '[^\p{{L}}\p{{N}}_]+'), {_list(text.MOOD_WORDS)}) THEN 'mood'
  WHEN item % 4 >= 2 THEN 'history_driven' ELSE 'generic' END AS bucket FROM (SELECT *, lower(text) AS low FROM said)""", SAID)
def h10(spark, d):
    return said(spark, d).select("item", text.audit_bucket(F.col("text"), F.col("item") % 4).alias("bucket"))


@query("h11_pool_bucket", "SELECT item, CASE " + " ".join(f"WHEN {_in(ws)} THEN '{n}'" for n, ws in text.POOL_WORDS.items()) + " WHEN item % 2 = 0 THEN 'history_driven' ELSE 'generic' END AS bucket FROM (SELECT *, lower(text) AS low FROM said)", SAID)
def h11(spark, d):
    return said(spark, d).select("item", text.pool_bucket(F.col("text"), F.col("item") % 2 == 0).alias("bucket"))


@query("h13_first_sentence", "SELECT item, CASE WHEN instr(text, '. ') > 0 AND instr(text, '. ') < 200 THEN substr(text, 1, instr(text, '. ')) ELSE substr(text, 1, 200) END AS x FROM said", SAID)
def h13(spark, d):
    return said(spark, d).select("item", text.first_sentence(F.col("text")).alias("x"))


@query("h14_year_decade_age", "SELECT o_orderkey, y AS year, y // 10 * 10 AS decade, 2026 - y AS age FROM (SELECT o_orderkey, TRY_CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INT) AS y FROM orders)")
def h14(spark, d):
    y = t.table(spark, d, "orders").selectExpr("o_orderkey", "try_cast(substr(cast(o_orderdate AS string), 1, 4) AS int) AS year")
    return y.select("o_orderkey", "year", (F.floor(F.col("year") / 10) * 10).cast("int").alias("decade"), (2026 - F.col("year")).alias("age"))


@query("h15_token_codec", "SELECT item, '<' || l0 || '> <' || (item % 64 + 256) || '>' AS code, l0 AS back FROM vecs", VECS)
def h15(spark, d):
    c = t.vectors(spark, d).select("item", F.format_string("<%d> <%d>", F.col("l0").cast("int"), (F.col("item") % 64 + 256).cast("int")).alias("code"))
    return c.select("item", "code", F.regexp_extract("code", "<([0-9]+)>", 1).cast("int").alias("back"))


@query("h16_output_parser", "SELECT item, 0 AS at, CAST(l0 AS INT) AS c, CAST(item % 64 AS INT) AS f FROM vecs UNION ALL SELECT item, 1, 7, 9 FROM vecs", VECS)
def h16(spark, d):
    raw = F.concat(F.col("l0").cast("string"), F.lit(" "), (F.col("item") % 64).cast("string"), F.lit("\n7 9\n[RESPONSE]\n1 2"))
    lines = t.vectors(spark, d).select("item", F.posexplode(F.split(F.substring_index(raw, "[RESPONSE]", 1), "\n")).alias("at", "line"))
    pick = lambda g: F.regexp_extract("line", r"^\s*(\d+) (\d+)\s*$", g).cast("int")
    return lines.where(F.col("line").rlike(r"^\s*\d+ \d+\s*$")).select("item", "at", pick(1).alias("c"), pick(2).alias("f"))


@query("h17_dialogue_format", "SELECT session, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS x FROM turns GROUP BY 1", TURNS)
def h17(spark, d):
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    return t.turns(spark, d).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda r: r["x"]), "\n").alias("x"))


HIST = "hist AS (SELECT session, pos, concat_ws(' ', lag(name, 2) OVER w, lag(name, 1) OVER w) AS two, name FROM plays JOIN cat USING (item) WINDOW w AS (PARTITION BY session ORDER BY pos))"


def _hist(spark, d):
    p = t.plays(spark, d).join(t.catalog(spark, d).select("item", "name"), "item")
    w = Window.partitionBy("session").orderBy("pos")
    return p.select("session", F.col("pos").cast("long").alias("pos"), "name", "label", F.concat_ws(" ", F.lag("name", 2).over(w), F.lag("name", 1).over(w)).alias("two"))


@query("h18_query_builders", "SELECT session, pos, concat_ws(' ', name, 'goal', nullif(two, '')) AS tt, concat_ws(' ', 'goal', nullif(two, ''), name) AS bm25 FROM hist", PLAYS, CAT, HIST)
def h18(spark, d):
    two = F.nullif("two", F.lit(""))
    return _hist(spark, d).select("session", "pos", F.concat_ws(" ", "name", F.lit("goal"), two).alias("tt"), F.concat_ws(" ", F.lit("goal"), two, "name").alias("bm25"))


@query("h19_rerank_query", "SELECT session, pos, 'Request: ' || name || CASE WHEN two <> '' THEN ' | Recently played: ' || two ELSE '' END AS x FROM hist", PLAYS, CAT, HIST)
def h19(spark, d):
    recent = F.when(F.col("two") != "", F.concat(F.lit("Recently played: "), F.col("two")))
    return _hist(spark, d).select("session", "pos", F.concat_ws(" | ", F.concat(F.lit("Request: "), "name"), recent).alias("x"))


@query("h20_multi_turn_query", "SELECT session, turn, '[TURN-3] ' || coalesce(lag(text, 2) OVER w, '') || ' [TURN-2] ' || coalesce(lag(text, 1) OVER w, '') || ' [TURN-1] ' || text AS x FROM turns WHERE role = 'user' WINDOW w AS (PARTITION BY session ORDER BY turn)", TURNS)
def h20(spark, d):
    w = Window.partitionBy("session").orderBy("turn")
    past = lambda n: F.coalesce(F.lag("text", n).over(w), F.lit(""))
    return t.turns(spark, d).where("role = 'user'").select("session", "turn", F.concat(F.lit("[TURN-3] "), past(2), F.lit(" [TURN-2] "), past(1), F.lit(" [TURN-1] "), F.col("text")).alias("x"))


#: fixed values: names of the query strategies; g goal, c culture, q query
STRATEGIES = {"query_only": ["q"], "query_x3": ["q", "q", "q"], "goal_query": ["g", "q"], "goal_culture_query": ["g", "c", "q"], "goal_culture_query_x2": ["g", "c", "q", "q"], "no_hist_goal_culture": ["g", "c", "q"]}


@query("h21_strategies", " UNION ALL ".join(f"SELECT item, '{n}' AS strategy, concat_ws(' ', {', '.join(p)}) AS x FROM (SELECT item, 'goal' AS g, artist AS c, name AS q FROM cat)" for n, p in STRATEGIES.items()), CAT)
def h21(spark, d):
    parts = {"g": F.lit("goal"), "c": F.col("artist"), "q": F.col("name")}
    every = F.array(*[F.struct(F.lit(n).alias("strategy"), F.concat_ws(" ", *[parts[x] for x in p]).alias("x")) for n, p in STRATEGIES.items()])
    return t.catalog(spark, d).select("item", F.explode(every).alias("s")).select("item", "s.strategy", "s.x")


@query("h22_token_budget", r"SELECT session, array_to_string(list_reduce(list_prepend({'used': 0::BIGINT, 'kept': []::VARCHAR[], 't': ''}, parts), lambda a, x: CASE WHEN a.used + len(string_split_regex(x.t, '\s+')) <= 60 THEN {'used': a.used + len(string_split_regex(x.t, '\s+')), 'kept': list_append(a.kept, x.t), 't': ''} ELSE a END).kept, ' ') AS x FROM (SELECT session, list({'used': 0::BIGINT, 'kept': []::VARCHAR[], 't': text} ORDER BY turn DESC, text DESC) AS parts FROM turns GROUP BY 1)", TURNS)
def h22(spark, d):
    """Turns newest first while their words fit 60; one that doesn't fit gives way to the next."""
    parts = F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]))
    return t.turns(spark, d).groupBy("session").agg(parts.alias("parts")).select("session", text.budgeted(F.col("parts"), 60, lambda p: F.size(F.split(p, r"\s+"))).alias("x"))


@query("h23_char_budget", "SELECT session, CASE WHEN length(b) <= 400 THEN b ELSE '' END AS x FROM (SELECT session, max_by(text, turn) AS b FROM turns GROUP BY 1)", TURNS)
def h23(spark, d):
    last = F.slice(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])), 1, 1)
    return t.turns(spark, d).groupBy("session").agg(last.alias("parts")).select("session", text.budgeted(F.col("parts"), 400, lambda p: F.length(p), "\n").alias("x"))


@query("h24_vector_math", "SELECT a.item, round(list_dot_product(a.v, b.v), 6) AS dot, round(sqrt(list_dot_product(a.v, a.v)), 6) AS norm, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS cosine FROM vecs a JOIN vecs b ON b.item = a.item + 1", VECS)
def h24(spark, d):
    v = t.vectors(spark, d).select("item", "v")
    both = v.join(v.select((F.col("item") - 1).alias("item"), F.col("v").alias("w")), "item")
    return both.select("item", F.round(vector.dot(F.col("v"), F.col("w")), 6).alias("dot"), F.round(vector.norm(F.col("v")), 6).alias("norm"), F.round(vector.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("h25_residual", "SELECT a.item, round(a.v[1] - b.v[1], 6) AS first, round(a.v[64] - b.v[64], 6) AS last FROM vecs a JOIN vecs b ON b.item = a.item + 1", VECS)
def h25(spark, d):
    v = t.vectors(spark, d).select("item", "v")
    r = v.join(v.select((F.col("item") - 1).alias("item"), F.col("v").alias("w")), "item").select("item", vector.residual(F.col("v"), F.col("w")).alias("r"))
    return r.select("item", F.round(F.col("r")[0], 6).alias("first"), F.round(F.col("r")[63], 6).alias("last"))


@query("h26_discounts", "SELECT item, round(1 / log2(size + 2), 6) AS signal, round(ln(1 + size), 6) AS log1p, round(least(size, 10) / 10, 6) AS clipped, round(exp(size / 10.0) / sum(exp(size / 10.0)) OVER (PARTITION BY artist), 6) AS softmax FROM cat", CAT)
def h26(spark, d):
    e = F.exp(F.col("size") / 10.0)
    return t.catalog(spark, d).select("item", F.round(ranking.rank_signal(F.col("size")), 6).alias("signal"), F.round(F.log1p("size"), 6).alias("log1p"), F.round(ranking.clipped(F.col("size")), 6).alias("clipped"), F.round(e / F.sum(e).over(Window.partitionBy("artist")), 6).alias("softmax"))


@query("h27_reciprocal_ranks", "SELECT session, pos, round(1 / pos, 6) AS rr, round(1 / (pos + 60), 6) AS rrf, round((n - pos + 1) / n, 6) AS linear FROM (SELECT session, pos, count(*) OVER (PARTITION BY session) AS n FROM plays)", PLAYS)
def h27(spark, d):
    at, n = F.col("pos") - 1, F.count(F.lit(1)).over(Window.partitionBy("session"))
    return t.plays(spark, d).select("session", F.col("pos").cast("long").alias("pos"), F.round(ranking.reciprocal(at), 6).alias("rr"), F.round(ranking.reciprocal(F.col("pos"), 60), 6).alias("rrf"), F.round(ranking.linear(at, n), 6).alias("linear"))


@query("h29_tag_overlap", "SELECT session, turn, item, len(list_filter(tags, lambda x: list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), lower(x)))) AS n FROM turns JOIN cat ON item = session + 1", TURNS, CAT)
def h29(spark, d):
    rows = t.turns(spark, d).join(t.catalog(spark, d).select("item", "tags"), F.col("item") == F.col("session") + 1)
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    return rows.withColumn("w", words).select("session", "turn", "item", F.size(F.filter("tags", lambda x: F.array_contains("w", F.lower(x)))).cast("long").alias("n"))


@query("h30_hash_bucket", "SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 16 AS bucket FROM documents")
def h30(spark, d):
    return t.table(spark, d, "documents").select("doc_id", ranking.hash_bucket(F.col("doc_id"), 16).alias("bucket"))


@query("h31_list_parse", "SELECT item, len(tags) AS n, tags[1] AS first FROM cat", CAT)
def h31(spark, d):
    raw = F.concat(F.lit("['"), F.array_join("tags", "', '"), F.lit("']"))
    back = F.coalesce(F.from_json(F.replace(raw, F.lit("'"), F.lit('"')), "array<string>"), F.array().cast("array<string>"))
    return t.catalog(spark, d).select("item", F.size(back).cast("long").alias("n"), F.get(back, F.lit(0)).alias("first"))


@query("h32_tokenisers", r"SELECT item, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS plain, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS spaced FROM said", SAID)
def h32(spark, d):
    return said(spark, d).select("item", F.size(text.ascii_words(F.col("text"))).cast("long").alias("plain"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("spaced"))


@query("h33_left_pad", "SELECT session, string_agg(coalesce(code, 0), ',' ORDER BY slot) AS codes FROM (SELECT s.session, slot, item % 64 + 1 AS code FROM (SELECT session, max(pos) AS n, unnest(range(1, 51)) AS slot FROM plays GROUP BY 1) s LEFT JOIN plays p ON p.session = s.session AND p.pos = n - 50 + slot) GROUP BY 1", PLAYS)
def h33(spark, d):
    codes = F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("item") % 64 + 1).alias("c")))), lambda x: x["c"])
    c = t.plays(spark, d).groupBy("session").agg(codes.alias("c")).withColumn("c", F.slice("c", F.greatest(F.size("c") - 49, F.lit(1)), 50))
    return c.select("session", F.array_join(F.concat(F.array_repeat(F.lit(0).cast("long"), 50 - F.size("c")), F.col("c")).cast("array<string>"), ",").alias("codes"))


@query("h34_missing_policy", "SELECT item, CASE WHEN size > 5 THEN popularity END AS popularity, coalesce(CASE WHEN size > 5 THEN popularity END, 0) AS filled FROM cat", CAT)
def h34(spark, d):
    p = F.when(F.col("size") > 5, F.col("popularity"))
    return t.catalog(spark, d).select("item", p.alias("popularity"), F.coalesce(p, F.lit(0.0)).alias("filled"))


@query("h35_markdown_strip", r"SELECT item, regexp_replace(regexp_replace(text, '[*_`#]+', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS x FROM said", SAID)
def h35(spark, d):
    return said(spark, d).select("item", F.regexp_replace(F.regexp_replace("text", "[*_`#]+", ""), "\n{3,}", "\n\n").alias("x"))


@query("h36_ordinal_encoding", "SELECT item, code FROM cat JOIN (SELECT artist, row_number() OVER (ORDER BY artist) AS code FROM (SELECT DISTINCT artist FROM cat)) USING (artist)", CAT)
def h36(spark, d):
    c = t.catalog(spark, d)
    codes = c.select("artist").distinct().withColumn("code", F.row_number().over(Window.orderBy("artist")).cast("long"))
    return c.join(codes, "artist").select("item", "code")


@query("h37_map_lookup", "SELECT item, CASE l0 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END AS name FROM vecs", VECS)
def h37(spark, d):
    m = F.create_map(F.lit(0), F.lit("zero"), F.lit(1), F.lit("one"))
    return t.vectors(spark, d).select("item", F.coalesce(F.try_element_at(m, F.col("l0").cast("int")), F.lit("more")).alias("name"))


@query("h38_binning", "SELECT item, CASE WHEN popularity / 2000 >= .7 THEN 'High' WHEN popularity / 2000 >= .3 THEN 'Medium' WHEN popularity > 0 THEN 'Low' ELSE '' END AS bin FROM cat", CAT)
def h38(spark, d):
    x = F.col("popularity") / 2000
    return t.catalog(spark, d).select("item", F.when(x >= 0.7, "High").when(x >= 0.3, "Medium").when(x > 0, "Low").otherwise("").alias("bin"))


@query("h39_json_reply", "SELECT session, 3 AS n, session % 3 = 0 AS complete FROM turns GROUP BY 1, 3", TURNS)
def h39(spark, d):
    raw = F.concat(F.lit('Sure: {"order": [2, 0, 1'), F.when(F.col("session") % 3 != 0, F.lit(", 2, 9")).otherwise(F.lit("")), F.lit("]} done"))
    r = t.turns(spark, d).select("session").distinct().withColumn("o", F.from_json(F.regexp_extract(raw, r"(\{.*\})", 1), "order array<int>")["order"])
    good = F.array_distinct(F.filter("o", lambda x: (x >= 0) & (x < 3)))
    return r.select("session", F.size(good).alias("n"), (F.size("o") == 3).alias("complete"))


@query("h40_labelled_lines", "SELECT item, name, 'made by ' || artist || chr(10) || 'second' AS description FROM cat", CAT)
def h40(spark, d):
    raw = F.concat(F.lit("NAME: "), "name", F.lit("\nDESCRIPTION: made by "), "artist", F.lit("\nsecond"))
    pick = lambda p: F.regexp_extract(raw, p, 1)
    return t.catalog(spark, d).select("item", pick(r"(?m)^NAME: (.*)$").alias("name"), pick(r"(?s)DESCRIPTION: (.*)$").alias("description"))
