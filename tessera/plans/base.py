"""The register of queries, and the views in SQL that the oracles share."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PLAYS = """plays AS (SELECT o_custkey AS session, l_partkey AS item,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag) AS pos,
  CASE l_returnflag WHEN 'A' THEN 'MOVES' WHEN 'R' THEN 'DOES_NOT' END AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EPLAYS = "eplays AS (SELECT user_id AS session, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"
CAT = "cat AS (SELECT p_partkey AS item, p_name AS name, p_brand AS artist, list_append(string_split(p_name, ' '), lower(p_type)) AS tags, p_retailprice AS popularity, p_size AS size FROM part)"
TURNS = "turns AS (SELECT conv_id AS session, turn, role, text FROM conversations)"
VECS = "vecs AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v, label AS l0 FROM embeddings)"
PRED = """pred AS (SELECT o_custkey AS query, l_partkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, l_partkey) AS rank
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def query(name: str, sql: str | None = None, *views: str):
    """Registers a function of (spark, sf_dir); views are put before the SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(views)} " if views else "") + sql
        return f

    return add
