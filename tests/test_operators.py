"""Hand-computed cases of the operators and functions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import ranking, text, vector
from tessera.operators import cooccur, history, metrics, pool, retrieval
from tessera.sources import tables


def column(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("said, found, centre, lo, hi", [("from the 1990s", True, 1994.5, 1990, 1999), ("1990", True, 1994.5, 1990, 1999), ("90s", True, 1994.5, 1990, 1999), ("nineties", True, 1994.5, 1990, 1999), ("1985-1995", True, 1990.0, 1985, 1995), ("20s", True, 1924.5, 1920, 1929), ("in 1987", True, 1987.0, 1987, 1987), ("none", False, 0.0, None, None), ("", False, 0.0, None, None), (None, False, 0.0, None, None)])
def test_era(spark, said, found, centre, lo, hi):
    e = column(spark, said, text.era)
    assert (e["found"], e["centre"], e["lo"], e["hi"]) == (found, centre, lo, hi)


@pytest.mark.parametrize("said, n", [("hip hop", 1), ("hip-hop", 1), ("k-pop", 2), ("rocker", 0), ("r&b", 1), ("Rock and POP", 2), (None, 0)])
def test_keywords(spark, said, n):
    assert column(spark, said, lambda c: text.keyword_count(c, text.GENRES)) == n


def test_feedback_and_filler(spark):
    assert column(spark, "Yes, love it", text.feedback) == text.MOVES
    assert column(spark, "too slow", text.feedback) == text.DOES_NOT
    assert column(spark, "hm", text.feedback) == ""
    assert column(spark, "please", text.without_filler) == "please"
    assert column(spark, "please jazz", text.without_filler) == "jazz"


def test_budget(spark):
    kept = column(spark, ["a b", "c d e", "f"], lambda c: text.budgeted(c, 3, lambda p: F.size(F.split(p, " "))), "array<string>")
    assert kept == "a b f"


def test_vectors(spark):
    assert column(spark, [3.0, 4.0], vector.norm, "array<double>") == 5.0
    assert column(spark, [1.0], lambda c: vector.repaired(c, 2), "array<double>") == [0.0, 0.0]
    assert column(spark, None, lambda c: vector.repaired(c, 2), "array<double>") == [0.0, 0.0]


PLAYS = [(1, 1, 10, None), (1, 2, 20, "MOVES"), (1, 3, 20, "DOES_NOT"), (1, 4, 30, "DOES_NOT"), (2, 1, 10, "DOES_NOT")]


def plays(spark):
    return spark.createDataFrame(PLAYS, "session long, pos int, item long, label string")


def test_history(spark):
    got = {(r.session, r.pos): r.history for r in history.last_n(plays(spark), 2).collect()}
    assert got[1, 1] == [] and got[1, 2] == [10] and got[1, 4] == [20, 20] and got[2, 1] == []


def test_feedback_runs(spark):
    got = {(r.session, r.pos): r for r in history.running_feedback(plays(spark)).collect()}
    assert got[1, 4].moves == 1 and got[1, 4].rejected == 1 and got[1, 4].tail == 1 and got[1, 4].last_liked == 20
    assert got[1, 1].moves == 0 and got[1, 1].tail == 0 and got[1, 1].last_liked is None


def test_positive_history(spark):
    kind = "array<struct<item:long,label:string>>"
    assert column(spark, [(1, "MOVES"), (2, "DOES_NOT"), (3, None)], history.positive_history, kind) == [1, 3]
    assert column(spark, [(1, "DOES_NOT")], history.positive_history, kind) == [1]


def test_cooccurrence(spark):
    got = {(r.src, r.dst): r.w for r in cooccur.pairs(plays(spark)).groupBy("src", "dst").agg(F.sum("w").alias("w")).collect()}
    assert got[10, 20] == 1.5 and got[20, 30] == 1.5 and got[10, 30] == 0.25 and (20, 20) not in got
    assert all(r.w >= 1.0 for r in cooccur.neighbours(plays(spark)).collect())


def ranked(spark):
    return spark.createDataFrame([(1, 100 + i, i, "a" if i < 4 else "b", float(i)) for i in range(1, 7)], "query long, item long, rank int, artist string, s double")


def test_cap_and_blend(spark):
    got = [r.item for r in pool.capped(ranked(spark), "artist", 1, 4).orderBy("new_rank").collect()]
    assert got == [101, 104, 102, 103]
    got = [r.item for r in pool.blended(ranked(spark), "s", 0.0, 3).orderBy("new_rank").collect()]
    assert got == [103, 102, 101, 104, 105, 106]


def test_suppress_only_if_enough_remain(spark):
    hit = F.col("artist") == "a"
    assert [r.item for r in pool.suppressed(ranked(spark), hit, 3).orderBy("new_rank").collect()][0] == 104
    assert [r.item for r in pool.suppressed(ranked(spark), hit, 4).orderBy("new_rank").collect()][0] == 101


def test_mmr(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.9, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0])], "query long, item long, score double, v array<double>")
    assert [r.item for r in pool.mmr(rows, 0.5, 3).orderBy("new_rank").collect()] == [1, 3, 2]


def test_ndcg(spark):
    r = spark.createDataFrame([(1,), (20,), (21,), (None,)], "r int").select(ranking.ndcg(F.col("r")).alias("x")).collect()
    assert r[0].x == 1.0 and round(r[1].x, 6) == round(1 / 4.392317422778761, 6) and r[2].x == 0.0 and r[3].x == 0.0


def test_bm25_empty(spark):
    q = spark.createDataFrame([(1, "x y"), (2, "")], "query long, text string")
    d = spark.createDataFrame([(1, ""), (2, None), (3, "x z")], "item long, text string")
    assert [(r.query, r.item) for r in retrieval.bm25(q, d, 5).collect()] == [(1, 3)]


def test_union_keeps_first_place(spark):
    a = spark.createDataFrame([(1, 7, 3)], "query long, item long, rank int")
    b = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query long, item long, rank int")
    got = {r.item: r for r in pool.union_sources([("a", a), ("b", b)]).collect()}
    assert got[7].sources == "a,b" and got[7].position == 3 and got[7].best_rank == 1 and got[8].position == 1_000_002


def test_last_wins_and_missing(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id long, v string")
    b = spark.createDataFrame([(2, "b")], "id long, v string")
    assert {r.id: r.v for r in tables.last_wins([a, b], "id").collect()} == {1: "a", 2: "b"}
    assert [r.id for r in tables.append_missing(a, b, ["id"]).collect()] == [1]


def test_pareto(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 0.3)], "n int, g double")
    assert [r.n for r in metrics.pareto(rows, "n", "g").orderBy("n").collect()] == [1, 3]


def test_fillers_that_follow_one_another_all_go(spark):
    texts = ["please play me jazz", "can you please recommend something calm", "playful pleasers", "please", "I'd like something that's soft"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = [r.x for r in df.select("i", text.without_filler(F.col("text")).alias("x")).orderBy("i").collect()]
    assert got == ["jazz", "calm", "playful pleasers", "please", "soft"]


def test_pivot_phrases(spark):
    yes = ["this isn't working", "that's not it", "it isn't what i meant", "I don't want any more of it", "don't want another one", "move on", "hoping for something new", "a new indie rock band"]
    no = ["more of this", "newer bands", "the instead-ofs", ""]
    df = spark.createDataFrame([(x,) for x in yes + no], "text string")
    got = {r.text: r.p for r in df.select("text", text.mentions(F.col("text"), text.PIVOT).alias("p")).collect()}
    assert [x for x in yes if not got[x]] == [] and not any(got[x] for x in no)


def test_keyword_counts_by_pattern(spark):
    import random
    import re

    random.seed(1)
    words = ["hip hop", "hip-hop", "k-pop", "r&b", "rock", "rocker", "drum and bass", "pop", "jazz", "JAZZ", "x", "é"]
    texts = ["".join(random.choice(words) + random.choice([" ", ",", "-", "", "&", "é"]) for _ in range(random.randint(0, 8))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = {r.i: r.n for r in df.select("i", text.keyword_count(F.col("text"), text.GENRES).alias("n")).collect()}
    for i, x in enumerate(texts):
        low = (x or "").lower()
        assert got[i] == sum(bool(re.search(r"(?<![a-z0-9])" + re.escape(k) + r"(?![a-z0-9])", low)) for k in text.GENRES), x


def test_mentions_and_greedy(spark):
    from tessera.operators import mentions

    texts = [(1, "We like The Red Stone and stone"), (2, "abc"), (3, None), (4, ""), (5, "redstone red")]
    names = spark.createDataFrame([("red stone",), ("stone",), ("red",), ("ab",), ("zzzz",), ("",), (None,)], "name string")
    df = spark.createDataFrame(texts, "i int, text string")
    got = {(r.i, r["name"]) for r in mentions.mentions(df, names).collect()}
    assert got == {(1, "red stone"), (1, "stone"), (1, "red"), (2, "ab"), (5, "red"), (5, "stone")}
    got = sorted((r.i, r["name"]) for r in mentions.greedy(df, names, ["i"]).collect())
    assert got == [(1, "red stone"), (1, "stone"), (2, "ab"), (5, "red"), (5, "stone")]


def test_places_in_order(spark):
    from tessera.operators.ordering import numbered

    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "a long, b long"), "a").collect()
    assert all(r.n == r.a + 1 for r in got) and len(got) == 1000
    assert numbered(spark.createDataFrame([], "a long"), "a").count() == 0


def test_dense_blocks_by_brute_force(spark):
    import numpy as np

    from tessera.operators import retrieval

    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((90, 6)), 1)  # ties too
    items = spark.createDataFrame([(i, [float(x) for x in r], int(i % 3)) for i, r in enumerate(v)], "item long, v array<double>, cell int")
    queries = items.where("item % 9 = 0").selectExpr("item AS query", "v AS q", "cell")
    gone = spark.createDataFrame([(q, i) for q in range(0, 90, 9) for i in range(q, q + 5)], "query long, item long")
    for size in (4, 1000):
        for cells in (False, True):
            got = {}
            for r in retrieval.dense(queries, items, 7, itself=False, exclude=gone, cells=cells, size=size).orderBy("query", "rank").collect():
                got.setdefault(r.query, []).append((r.item, r.score))
            for q in range(0, 90, 9):
                own = [(-round(float(v[q] @ v[i]), 9), i) for i in range(90) if i != q and not q <= i < q + 5 and (not cells or i % 3 == q % 3)]
                assert [i for i, _ in got[q]] == [i for _, i in sorted(own)[:7]]
    assert retrieval.scores(queries, items, size=8).count() == 10 * 90
    assert retrieval.dense(queries.limit(0), items, 3).count() == 0


def test_places_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = np.round(rng.standard_normal((70, 4)), 1)
    v[60:] = v[:10]  # ties
    items = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item long, v array<double>")
    queries = items.where("item % 5 = 0").selectExpr("item AS query", "v AS q")
    wanted = spark.createDataFrame([(q, (q * 7 + 3) % 75) for q in range(0, 70, 5)], "query long, item long")
    for size in (3, 1000):
        got = {r.query: r.place for r in retrieval.places(queries, items, wanted, size=size).collect()}
        want = {}
        for q in range(0, 70, 5):
            own = sorted((-round(float(v[q] @ v[i]), 9), i) for i in range(70))
            if (q * 7 + 3) % 75 < 70:
                want[q] = [i for _, i in own].index((q * 7 + 3) % 75) + 1
        assert got == want
    assert retrieval.places(queries, items, wanted.limit(0)).count() == 0


def test_mentions_of_equal_empty_and_missing_texts(spark):
    from tessera.operators import mentions

    rows = [(1, "The Cure and the CURE"), (1, "The Cure and the CURE"), (2, ""), (3, None), (4, "ab the cur"), (5, "x" * 20_000 + "abba")]
    names = spark.createDataFrame([("the cure",), ("Cure",), ("abba",), ("ab",), ("",), (None,)], "name string")
    texts = spark.createDataFrame(rows, "i int, text string")
    got = sorted((r.i, r["name"]) for r in mentions.mentions(texts, names).collect())
    want = sorted((i, n) for i, s in rows if s for n in ("the cure", "cure", "abba", "ab") if n in s.lower())
    assert got == want
    assert mentions.mentions(texts, names.limit(0)).count() == 0 == mentions.mentions(texts.limit(0), names).count()


def test_windows_that_the_watermark_has_passed(spark, sf):
    from tessera.streaming import sessions

    key = lambda df: {(r.start, r.event_type): (r.n, round(r.total, 4)) for r in df.collect()}
    whole, closed = key(sessions.windowed(spark, sf)), key(sessions.windowed(spark, sf, "append"))
    assert closed.items() <= whole.items()
    last = max(k[0] for k in whole)
    assert all((last - k[0]).total_seconds() < 7200 for k in whole.keys() - closed.keys())


def test_equal_vectors_are_multiplied_once(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    v = np.round(rng.standard_normal((9, 4)), 1)
    v[8] = v[2]  # equal vectors under two numbers too
    vectors = spark.createDataFrame([(i, [float(x) for x in r], int(i % 2)) for i, r in enumerate(v)], "item long, v array<double>, cell int")
    of = {i: (i * 5 + i // 7) % 9 for i in range(100, 180)}
    members = spark.createDataFrame([(o, i) for i, o in of.items()], "of long, item long")
    queries = vectors.selectExpr("item AS query", "v AS q", "cell")
    gone = {(q, i) for q in range(9) for i in of if (i + q) % 4 == 0}
    exclude = spark.createDataFrame(sorted(gone), "query long, item long")
    wanted = spark.createDataFrame([(q, 100 + q * 8) for q in range(9)], "query long, item long")
    for size in (2, 1000):
        for cells in (False, True):
            got = {}
            for r in retrieval.dense(queries, vectors, 12, exclude=exclude, cells=cells, members=members, size=size).orderBy("query", "rank").collect():
                got.setdefault(r.query, []).append(r.item)
            for q in range(9):
                own = sorted((-round(float(v[q] @ v[of[i]]), 9), i) for i in of if (q, i) not in gone and (not cells or of[i] % 2 == q % 2))
                assert got[q] == [i for _, i in own[:12]]
        places = {r.query: r.place for r in retrieval.places(queries, vectors, wanted, members=members, size=size).collect()}
        for q in range(9):
            own = sorted((-round(float(v[q] @ v[of[i]]), 9), i) for i in of)
            assert places[q] == 1 + [i for _, i in own].index(100 + q * 8)


def test_bm25_blocks_by_brute_force(spark):
    import math
    import random

    draw = random.Random(4)
    texts = [" ".join(draw.choices("abcdefgh", k=draw.randint(0, 5))) for _ in range(25)]
    docs = {i: draw.choice(texts) for i in range(120)}
    asks = {q: " ".join(draw.choices("abcdefghxyz", k=draw.randint(1, 5))) for q in range(12)}
    gone = {(q, i) for q in asks for i in docs if (i * 3 + q) % 5 == 0}
    n, mean = len(docs), sum(len(x.split()) for x in docs.values()) / len(docs)
    df = {t: sum(t in x.split() for x in docs.values()) for t in "abcdefgh"}

    def score(q, i, repeats):
        said, x, total = asks[q].split(), docs[i].split(), 0.0
        for t in said if repeats else set(said):
            if t in x:
                total += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / mean))
        return round(total, 9)

    queries = spark.createDataFrame(list(asks.items()), "query long, text string")
    items = spark.createDataFrame(list(docs.items()), "item long, text string")
    exclude = spark.createDataFrame(sorted(gone), "query long, item long")
    wanted = spark.createDataFrame([(q, q * 9) for q in asks], "query long, item long")
    asked = retrieval.bm25_asked(queries)
    for once in (False, True):
        for repeats, size in ((False, 3), (True, 1000)):
            got = {}
            for r in retrieval.bm25(queries, items, 9, repeats=repeats, exclude=exclude, once=once, size=size).orderBy("query", "rank").collect():
                got.setdefault(r.query, []).append(r.item)
            for q in asks:
                own = sorted((-score(q, i, repeats), i) for i in docs if (q, i) not in gone and score(q, i, repeats) > 0)
                assert got.get(q, []) == [i for _, i in own[:9]]
        places = {r.query: r.place for r in retrieval.bm25_places(asked, items, wanted, once=once, size=4).collect()}
        own = {q: sorted((-score(q, i, False), i) for i in docs if score(q, i, False) > 0) for q in asks}
        assert places == {q: 1 + [i for _, i in own[q]].index(q * 9) for q in asks if score(q, q * 9, False) > 0}


def test_neighbours_of_some_items(spark):
    whole = {tuple(r) for r in cooccur.neighbours(plays(spark)).collect()}
    some = spark.createDataFrame([(next(iter(whole))[0],)], "item long")
    src = some.first().item
    assert {tuple(r) for r in cooccur.neighbours(plays(spark), of=some).collect()} == {r for r in whole if r[0] == src}


def test_sketch_of_fewer_items_than_there_are(spark, sf, monkeypatch):
    from tessera.plans import sketches

    monkeypatch.setattr(sketches, "ITEMS", 32)  # no count is above the sketch's error
    rows = sketches.d8_sketch(spark, sf).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 21)) and all(r.within for r in rows)
