"""Collocations by level-wise passes: phrases of k words are counted where both of their (k-1)-word parts are frequent.

Texts (A-Z in lower case; null: empty) are cut into pieces at ``.,;:!?`` and line ends, pieces
into words at spaces and tabs. Counts are kept for each group (lang; null: ``und``).

1. A pass over the texts counts single words, all of them. Phrases with ``least`` occurrences or
   more make the level's table, which is written.
2. The pass for k words reads the frequent (k-1)-word phrases from a broadcast and emits a phrase
   only where both of the overlapping parts are frequent, summed up for a block of text. The
   broadcast holds the phrases' 64-bit hashes if there are at most ``exact`` of them, else a
   bitmap of ``bits`` bits with two for each hash: its size is bounded at any scale. A phrase that
   passes by accident is counted like the others, by its own words, and has too few occurrences.
3. A candidate's cuts are looked up in the level tables, as all parts of a frequent phrase are
   frequent. Longer candidates send their count to the phrases inside them. A group's best come
   from the best of shares of it.

Counts are 64-bit integers, their products decimals of 38 digits. An empty table, and one
without a frequent phrase, give no rows. Rows are read by text and group only, so ids may be
null or repeated; every row counts. Extra columns aren't read, and may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import util
from tessera.llm.minhash import mix

#: the end of a piece stands between words as one that no text holds
STOP = b"."
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", STOP * 10)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: bytes of text that are counted at once
BLOCK = 6 << 20


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words of some texts of one group, with STOP between pieces."""
    return STOP.join(texts).lower().translate(_ENDS).replace(STOP, b" . ").split()


def hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Of phrases whose words have the given hashes, position by position."""
    out = parts[0]
    for x in parts[1:]:
        out = mix(out * _FACTOR + x)
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return mix(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))


class Frequent:
    """Hashes of frequent phrases, sorted, or as a bitmap: every one of them is found."""

    def __init__(self, raw: bytes, bits: int = 0):
        self.bits, self.held = bits, np.frombuffer(raw, np.uint8 if bits else np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.bits:
            return np.logical_and.reduce([self.held[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1 == 1 for p in _places(h, self.bits)])
        if not len(self.held):
            return np.zeros(len(h), bool)
        return self.held[np.minimum(np.searchsorted(self.held, h), len(self.held) - 1)] == h


def _places(h: np.ndarray, bits: int):
    return h % np.uint64(bits), mix(h ^ _FACTOR) % np.uint64(bits)


def phrases(texts: list[bytes], k: int, frequent: Frequent | None):
    """(phrases of k words, counts) of some texts of one group; for k > 1 only those whose parts are both frequent."""
    words = words_of(texts)
    index = dict.fromkeys(words)
    index.pop(STOP, None)
    vocabulary = list(index)
    if k == 1:
        from collections import Counter

        counts = Counter(words)
        return vocabulary, [counts[w] for w in vocabulary]
    for i, w in enumerate(vocabulary):
        index[w] = i
    index[STOP] = -1
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    of_word = np.append(word_hashes(vocabulary), np.uint64(0))
    # places where a phrase of k - 1 words begins that is frequent
    if k == 2:
        ok = np.append(frequent.has(of_word[:-1]), False)[ids]
    else:
        n = max(0, len(ids) - k + 2)
        parts = [ids[j : j + n] for j in range(k - 1)]
        ok = np.logical_and.reduce([p >= 0 for p in parts])
        at = np.flatnonzero(ok)
        ok[at] = frequent.has(hashes([of_word[p[at]] for p in parts]))
    at = np.flatnonzero(ok[:-1] & ok[1:])
    if not len(at):
        return [], []
    # phrases of the block as numbers: equal pairs of what came before and the next word
    key = ids[at]
    for j in range(1, k):
        pair = key * (len(vocabulary) + 1) + ids[at + j]
        _, first, key, counts = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
    first = at[first]
    return [b" ".join(words[a : a + k]) for a in first.tolist()], counts.tolist()


def _counted(docs: DataFrame, k: int, frequent: list | None, bits: int) -> DataFrame:
    import pyarrow as pa

    sent = None if frequent is None else docs.sparkSession.sparkContext.broadcast(frequent)

    def counted(batches):
        util.lean()
        known: dict = {} if sent is None else {g: Frequent(raw, bits) for g, raw in sent.value}
        held: dict = {}
        size = 0

        def out():
            for group, texts in held.items():
                if k > 1 and None not in known and group not in known:
                    continue
                found, counts = phrases(texts, k, known.get(None) or known.get(group))
                for a in range(0, len(found), 1 << 16):
                    part = found[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([group] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(counts[a : a + (1 << 16)], pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(group, []).append(text)
                size += len(text) + 1
                if size >= BLOCK:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    rows = docs.mapInArrow(counted, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _frequent(level: DataFrame, exact: int, bits: int) -> tuple[list, int]:
    """What a pass broadcasts of a level: hashes mixed with their group's, or a bitmap of them."""
    import pyarrow as pa

    def hashed(batches):
        util.lean()
        for batch in batches:
            lists = [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            h = hashes([word_hashes(list(x)) for x in zip(*lists)]) if lists else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64))], names=["lang", "h"])

    rows = level.select("lang", "phrase").mapInArrow(hashed, "lang string, h long")
    n = level.count()
    if n <= exact:
        got = rows.toArrow()
        by: dict = {}
        for g, h in zip(got.column("lang").to_pylist(), got.column("h").to_pylist()):
            by.setdefault(g, []).append(h)
        return [(g, np.sort(np.array(h, np.int64).view(np.uint64)).tobytes()) for g, h in by.items()], 0
    # a phrase that is frequent in one group lets it pass in all: only more is counted
    step = 1 << 18  # bits of one row

    def places(batches):
        util.lean()
        for batch in batches:
            h = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            p = np.unique(np.concatenate(_places(h, bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p // step), pa.array(p % step)], names=["row", "bit"])

    def pages(batches):
        util.lean()
        held: dict = {}
        for batch in batches:
            row, bit = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for r in np.unique(row).tolist():
                np.bitwise_or.at(held.setdefault(r, np.zeros(step // 8, np.uint8)), bit[row == r] >> 3, np.uint8(1) << (bit[row == r] & 7).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["row", "page"])

    spread = max(int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bits // step) // 16)
    marks = rows.mapInArrow(places, "row long, bit long").repartition(spread, "row").mapInArrow(pages, "row long, page binary")
    whole = bytearray(-(-bits // step) * step // 8)
    for row, page in marks.collect():  # as many bytes as the bitmap has, at most
        whole[row * step // 8 : row * step // 8 + len(page)] = page
    return [(None, bytes(whole))], bits


def levels(docs: DataFrame, *, text: str = "text", group: str = "lang", words: int = 4, least: int = 30, exact: int = 2_000_000, bits: int = 1 << 28) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """Tables (lang, phrase, f) of frequent phrases of 1, 2 ... words, (lang, n) of all words, and the staged tables behind them."""
    spark = util.settle(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")).where(F.octet_length("text") > 0)
    tables, paths, frequent, kind = [], [], None, 0
    for k in range(1, words + 1):
        found = _counted(rows, k, frequent, kind)
        if k == 1:
            # what is counted of all words is needed only for its sum
            found, all_path = util.staged(found, "counted")
            total, total_path = util.staged(found.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
            paths.append(total_path)
        table, path = util.staged(found.where(F.col("f") >= least), f"level-{k}")
        tables.append(table)
        paths.append(path)
        if k == 1:
            util.drop(spark, all_path)
        if k < words:
            frequent, kind = _frequent(table, exact, bits)
    return tables, total, paths


def _parts(phrase, k: int, a: int, n: int):
    """Words a + 1 .. a + n of a phrase of k words."""
    return phrase if n == k else F.array_join(F.slice(F.split(phrase, " "), a + 1, n), " ")


def scored(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of candidates, by their lowest-scoring cut, without those that a longer one stands for."""
    every, cuts, inside = None, None, None
    for k, table in enumerate(tables, 1):
        some = table.select("lang", "phrase", "f")
        every = some if every is None else every.unionByName(some)
        for j in range(1, k):
            cut = table.select("lang", "phrase", F.col("f").alias("a"), F.lit(j).alias("k"), _parts(F.col("phrase"), k, 0, j).alias("left"), _parts(F.col("phrase"), k, j, k - j).alias("right"))
            cuts = cut if cuts is None else cuts.unionByName(cut)
        for n in range(2, k):
            for j in range(k - n + 1):
                part = table.select("lang", _parts(F.col("phrase"), k, j, n).alias("phrase"), F.col("f").alias("longer"))
                inside = part if inside is None else inside.unionByName(part)
    for side, name in (("left", "l"), ("right", "r")):
        of = every.select(F.col("lang").alias("_g"), F.col("phrase").alias("_p"), F.col("f").alias(name))
        cuts = cuts.join(of, (F.col("lang") == F.col("_g")) & (F.col(side) == F.col("_p"))).drop("_g", "_p", side)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("score", F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    if inside is None:
        return best
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")).select(F.col("lang").alias("_g"), F.col("phrase").alias("_p"), "longer")
    best = best.join(inside, (F.col("lang") == F.col("_g")) & (F.col("phrase") == F.col("_p")), "left")
    stands = F.coalesce(big("longer") * 100 >= big("a") * 80, F.lit(False))
    return best.where(~stands).select("lang", "phrase", "a", "l", "r", "score")


def best(rows: DataFrame, order: list, k: int, name: str, share: int = 1 << 16) -> DataFrame:
    """The first k rows of each group by order, with their rank: from shares of the groups, in rounds."""
    share = max(share, 4 * k)
    groups = rows.count() // share + 1
    while groups > 1:
        own = Window.partitionBy("lang", "_share").orderBy(*order)
        rows = rows.withColumn("_share", F.pmod(F.xxhash64("lang", "phrase", F.lit(groups)), F.lit(groups)))
        rows = rows.withColumn(name, F.row_number().over(own)).where(F.col(name) <= k).drop("_share", name)
        groups = 1 if groups <= max(2, share // k) else -(-groups * k // share)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col(name) <= k)


def collocations(docs: DataFrame, *, top: int = 2000, **more) -> tuple[DataFrame, list[str]]:
    """(lang, rank, phrase, a, l, r, n, score) of each group's first ``top`` phrases; the staged tables behind it."""
    tables, total, paths = levels(docs, **more)
    rows, path = util.staged(scored(tables), "scored")
    ranked = best(rows, [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    of = total.select(F.col("lang").alias("_g"), "n")
    out = ranked.join(of, F.col("lang") == F.col("_g"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), [*paths, path]


def op12(spark, sf_dir: str) -> DataFrame:
    out, paths = collocations(util.documents(spark, sf_dir))
    return util.result(out, *paths)


_PART = "array_to_string(list_slice(string_split(phrase, ' '), {0}, {1}), ' ')"

#: all phrases are counted here, and frequent ones picked afterwards
ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, k, phrase, a, c, {_PART.format(1, "c")} AS lp, {_PART.format("c + 1", "k")} AS rp FROM f, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k),
scores AS (SELECT cuts.*, x.a AS l, y.a AS r, (CAST(2000000 AS HUGEINT) * cuts.a) // (x.a + y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, {_PART.format("i", "i + m - 1")} AS phrase, max(a) AS longer
  FROM f, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
