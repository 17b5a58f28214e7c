"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree over the groups.

Levels are windows. Nodes of one level are partitioned by group and parent index; the full-frame
``collect_list`` in index order is a parent's run. Its digests in a row are what the parent's
digest is taken of, and what a child sees beside itself are its siblings. One row of each parent
goes on to the next level, with the paths of all leaves below it. ``levels`` levels share one
exchange, as rows are dealt by the block of leaves that they lie in, so a group of any size is
spread over its blocks; then blocks are the leaves of the levels above.

A leaf is the SHA-256 of a row's columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and
the value. Leaves of a group ascend by key (null first), rows that share a key by their digest;
rows that are equal in all columns are told apart by their place only, so their answers may be
exchanged. A null group is one of its own, before all others. Extra columns aren't read, and may
have any names. A group of one row has its leaf as root; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import util

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, p: digest(p["before"], acc, p["after"]))


def siblings(path: Column) -> Column:
    """All siblings' digests, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, str]:
    """rows (with a group g) with their place idx in the group's order and the group's size m.

    Ranges of (g, order) are sorted each by itself and written; a place is the group's rows in the
    ranges before, and those before it in its own.
    """
    by = ["g", *order]
    ranged = rows.repartitionByRange(util.parts(rows), *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ranged, path = util.staged(ranged.withColumn("range", F.shiftright("at", 33)), name)
    sizes = ranged.groupBy("g", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    group = Window.partitionBy("g")  # a row for each range that the group lies in
    ahead = F.sum("n").over(group.orderBy("range")) - F.col("n") - F.col("low")
    sizes = sizes.select(F.col("g").alias("of"), F.col("range").alias("piece"), ahead.alias("shift"), F.sum("n").over(group).alias("m"))
    return ranged.join(sizes, (F.col("g") == F.col("of")) & (F.col("range") == F.col("piece"))).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "range", "of", "piece", "shift"), path


def _level(nodes: DataFrame, fan: int) -> DataFrame:
    """Parents of nodes (g, block, idx, m, node, members): one row each."""
    run = Window.partitionBy("g", "block", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nodes = nodes.withColumn("parent", F.expr(f"idx div {fan}"))
    nodes = nodes.withColumn("run", F.collect_list(F.struct("node", "members")).over(run)).where(F.col("idx") % fan == 0)
    digests = F.col("run.node")

    def seen(child, i):
        side = F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("before"), F.array_join(F.slice(digests, i + 2, F.lit(fan)), "").alias("after"))
        # a one-element array names the child's siblings, so that they are put together once for all its leaves
        return F.flatten(F.transform(F.array(side), lambda s: F.transform(child["members"], lambda x: F.struct(x["who"].alias("who"), F.array_append(x["path"], s).alias("path")))))

    many = F.col("m") > 1
    up = F.when(many, F.sha2(F.array_join(digests, "").cast("binary"), 256)).otherwise(F.col("node"))
    members = F.when(many, F.flatten(F.transform("run", seen))).otherwise(F.col("members"))
    return nodes.select("g", "block", F.col("parent").alias("idx"), F.expr(f"(m + {fan - 1}) div {fan}").alias("m"), up.alias("node"), members.alias("members"))


def climbed(nodes: DataFrame, most: int, *, fan: int, levels: int, parts: int) -> tuple[DataFrame, list[str]]:
    """(g, who, path, top) of nodes (g, idx, m, node, who), of which a group has ``most`` at most."""
    width = fan**levels
    own = nodes.select("g", F.expr(f"idx div {width}").alias("block"), "idx", "m", "node", F.array(F.struct("who", F.expr(f"CAST(array() AS {_PATH})").alias("path"))).alias("members"))
    own = own.repartition(parts, "g", "block")
    for _ in range(levels):
        own = _level(own, fan)
    low, path = util.staged(own, "blocks")
    if most <= width:
        return low.select("g", F.col("node").alias("top"), F.explode("members").alias("x")).select("g", "x.who", "x.path", "top"), [path]
    above, paths = climbed(low.select("g", "idx", "m", "node", F.struct(F.col("idx").alias("place")).alias("who")), -(-most // width), fan=fan, levels=levels, parts=parts)
    above = above.select(F.col("g").alias("of"), F.col("who.place").alias("place"), F.col("path").alias("rest"), "top")
    both = low.join(above, (F.col("g") == F.col("of")) & (F.col("block") == F.col("place")))
    both = both.select("g", "top", "rest", F.explode("members").alias("x"))
    return both.select("g", "x.who", F.concat("x.path", "rest").alias("path"), "top"), [path, *paths]


def manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "lang", columns=COLUMNS, forged: Column | None = None, fan: int = 2, levels: int = 7) -> tuple[DataFrame, list[str]]:
    """(key, forged, leaf, subroot, root, path) of every row of docs; the staged tables behind it.

    path: what stands before and after a node among the children of its parent, from the leaf's
    own level to the root. forged: a column that is passed through (such as an altered leaf).
    """
    if fan < 2 or levels < 1:
        raise ValueError("a run has two nodes or more, and a block one level or more")
    spark = docs.sparkSession
    parts = util.parts(docs)
    g = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaf = digest(*[encoded(F.col(c)) for c in columns])
    rows = docs.select(g.alias("g"), F.col(key).alias("key"), leaf.alias("leaf"), (F.lit(None).cast("string") if forged is None else forged).alias("forged"), F.monotonically_increasing_id().alias("u"))
    rows, leaf_path = util.staged(rows, "leaves")
    rows, range_path = numbered(rows, ["key", "leaf", "u"], "ranged")
    nodes = rows.select("g", "idx", "m", F.col("leaf").alias("node"), F.struct("key", "leaf", "forged").alias("who"))
    most = spark.read.parquet(range_path).groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    low, paths = climbed(nodes, most, fan=fan, levels=levels, parts=parts)
    low, low_path = util.staged(low, "paths")
    util.drop(spark, leaf_path, range_path, *paths)

    # the groups' roots are leaves of a tree of their own
    tops = low.groupBy("g").agg(F.first("top").alias("node"))
    tops, top_path = util.staged(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), "subroots")
    tops, place_path = numbered(tops, ["name"], "places")
    n = spark.read.parquet(top_path).count()
    high, paths = climbed(tops.select("g", "idx", "m", "node", F.struct("name").alias("who")), n, fan=fan, levels=levels, parts=parts)
    high, high_path = util.staged(high.select(F.col("who.name").alias("name"), F.col("path").alias("rest"), F.col("top").alias("root")), "roots")
    util.drop(spark, top_path, place_path, *paths)
    out = low.join(high, F.col("g") == F.col("name"))
    out = out.select(F.col("who.key").alias(key), F.col("who.forged").alias("forged"), F.col("who.leaf").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "rest").alias("path"))
    return out, [low_path, high_path]


def op11(spark, sf_dir: str) -> DataFrame:
    """Leaves, roots, the digest of each proof, and what a proof says of rows whose n_chars is one too large."""
    docs = util.documents(spark, sf_dir).select(*COLUMNS)
    other = F.when(F.col("n_chars").isNotNull(), F.col("n_chars").cast("decimal(20,0)") + 1)
    altered = digest(*[encoded(other if c == "n_chars" else F.col(c)) for c in COLUMNS])
    out, paths = manifest(docs, forged=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, altered))
    root = folded(F.coalesce("forged", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return util.result(out.withColumn("verified", F.col("folded_root") == F.col("root")), *paths)


_ENCODED = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = " || ".join(_ENCODED.format(c) for c in COLUMNS)
_OTHER = _LEAF.replace("n_chars", "(n_chars + 1)")

#: DuckDB has no crc32: eight shifts for each byte of the decimal doc_id
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT coalesce('=' || lang, '') AS g, doc_id, sha256({_LEAF}) AS leaf, sha256({_OTHER}) AS other,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: CAST(unicode(b) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 7 = 0 AS altered
  FROM documents),
leaves AS (SELECT g, doc_id, leaf, CASE WHEN altered THEN other ELSE leaf END AS shown, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d),
t AS (SELECT g, 0 AS lvl, i, m, leaf AS h FROM leaves
  UNION ALL
  SELECT g, lvl + 1, i // 2, (m + 1) // 2, sha256(h || coalesce(n, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY i) AS n FROM t WHERE m > 1) WHERE i % 2 = 0),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS m FROM t WHERE m = 1),
u AS (SELECT 0 AS lvl, i, m, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, (m + 1) // 2, sha256(h || coalesce(n, '')) FROM (SELECT *, lead(h) OVER (ORDER BY i) AS n FROM u WHERE m > 1) WHERE i % 2 = 0),
p AS (SELECT g, i AS leaf_i, 0 AS lvl, i, m, '' AS proof, shown AS fold FROM leaves
  UNION ALL
  SELECT p.g, leaf_i, p.lvl + 1, p.i // 2, (p.m + 1) // 2, proof || coalesce(s.h, ''),
    sha256(CASE WHEN p.i % 2 = 1 THEN s.h || fold ELSE fold || coalesce(s.h, '') END)
  FROM p LEFT JOIN t s ON s.g = p.g AND s.lvl = p.lvl AND s.i = xor(p.i, CAST(1 AS BIGINT)) WHERE p.m > 1),
q AS (SELECT p.g, leaf_i, 0 AS lvl, subroots.i, subroots.m, proof, fold, subroot FROM p JOIN subroots USING (g) WHERE p.m = 1
  UNION ALL
  SELECT q.g, leaf_i, q.lvl + 1, q.i // 2, (q.m + 1) // 2, proof || coalesce(s.h, ''),
    sha256(CASE WHEN q.i % 2 = 1 THEN s.h || fold ELSE fold || coalesce(s.h, '') END), subroot
  FROM q LEFT JOIN u s ON s.lvl = q.lvl AND s.i = xor(q.i, CAST(1 AS BIGINT)) WHERE q.m > 1),
r AS (SELECT h AS root FROM u WHERE m = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM q JOIN leaves ON leaves.g = q.g AND leaves.i = leaf_i CROSS JOIN r WHERE q.m = 1
"""
