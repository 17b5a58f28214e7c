"""What is shuffled does not grow with the pairs that are only looked at."""

import __spark_entry__
from tessera.operators import cooccur


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_members_of_clusters_are_not_shuffled(spark, sf):
    df = __spark_entry__.queries()["i22_cluster_recall"](spark, sf)
    # a turn's clusters are dealt by turn; no exchange is keyed by the members
    assert not [x for x in plan(df).splitlines() if "Exchange hashpartitioning(query" in x and "item" in x]
    assert df.count() == df.select("query", "item").distinct().count()


def test_expansion_shuffles_what_is_taken_only(spark):
    history = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 11)], "turn long, back int, item long")
    table = spark.createDataFrame([(10, 11, 9.0, 1), (10, 20, 5.0, 2), (10, 21, 4.0, 3), (10, 22, 3.0, 4), (11, 12, 7.0, 1), (11, 20, 6.0, 2)], "src long, dst long, w double, rank int")
    df = cooccur.expanded(history, table, [2, 1])
    assert sorted(map(tuple, df.collect())) == [(1, 20, 1, 6.0, 2), (1, 21, 2, 4.0, 1), (2, 12, 0, 7.0, 1), (2, 20, 1, 6.0, 1)]
    assert "LeftAnti" not in plan(df) and "Window" not in plan(df)


def test_one_timer_for_each_user_and_batch(spark, sf):
    from pyspark.sql.streaming import StreamingQueryListener

    timers, rows = [], []

    class Seen(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            timers.extend(x.customMetrics.get("numRegisteredTimers", 0) for x in event.progress.stateOperators)
            rows.append(event.progress.numInputRows)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener = Seen()
    spark.streams.addListener(listener)
    try:
        __spark_entry__.queries()["l2_turn_history"](spark, sf).count()
        import time

        until = time.time() + 20
        while sum(rows) < 1000 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    # three arrivals: a timer when rows come, and one for what is left
    assert sum(rows) == 1000 and 0 < sum(timers) <= 6 * users


def test_unlabelled_plays_leave_out_the_columns_that_order_labels(spark, sf):
    from tessera.sources import tables

    bare = tables.plays(spark, sf, labels=False)
    assert not [c for c in ("l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag") if c in plan(bare)]
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, tables.plays(spark, sf).select("session", "pos", "item").collect()))


def test_a_row_holds_banned_items_of_its_own_cell_only(spark):
    from tessera.operators import retrieval

    q = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [1.0])], "query long, cell int, q array<double>")
    gone = spark.createDataFrame([(1, 0, 7), (1, 0, 8), (1, 1, 9)], "query long, cell int, item long")
    got, most = retrieval._banned(q, True, gone)
    assert most == 2 and {r.cell: sorted(r.banned) for r in got.collect()} == {0: [7, 8], 1: [9]}
    x = spark.createDataFrame([(7, 0, [3.0]), (5, 0, [2.0]), (9, 1, [3.0]), (6, 1, [1.0])], "item long, cell int, v array<double>")
    assert sorted((r.cell, r.item) for r in retrieval.dense(q, x, 2, cells=True, exclude=gone).collect()) == [(0, 5), (1, 6)]


def test_signals_are_dealt_by_turn_and_products_give_the_same(spark, sf):
    from tessera.plans import pooling

    w = pooling.World(spark, sf)
    by_product = w.signals()
    shown = plan(by_product)
    assert "MapInArrow" in shown and "hashpartitioning(query" in shown and "hashpartitioning(item" not in shown and "hashpartitioning(of" not in shown
    w.n_vectors = pooling.SENT + 1  # too many to be sent
    assert w.table() is None
    by_expression = {(r.query, r.item): r.asDict() for r in w.signals().collect()}
    got = {(r.query, r.item): r.asDict() for r in by_product.collect()}
    assert got.keys() == by_expression.keys() and len(got) > 1000
    for key, row in got.items():
        assert all(row[c] == y or abs(row[c] - y) <= 2e-9 for c, y in by_expression[key].items()), key


def test_plays_meet_labels_by_merging(spark, sf, monkeypatch):
    from tessera.plans import pooling

    seen = []
    monkeypatch.setattr(pooling, "kept", lambda df, free=False: (seen.append(plan(df)), df)[1])
    pooling.World(spark, sf).predicted()
    steps = seen[-1]
    assert "SortMergeJoin [item" in steps


def test_only_the_means_asked_for_are_made_and_parts_are_merged(spark, sf, monkeypatch):
    from tessera.plans import pooling

    full = pooling.World(spark, sf)
    all_means = {tuple(r) for r in full.means.selectExpr("query", "role", "cast(v as string) v").collect()}
    seen = []
    monkeypatch.setattr(pooling, "kept", lambda df, free=False: (seen.append(plan(df)), df)[1])
    w = pooling.World(spark, sf, ["positive"])
    got = {tuple(r) for r in w.means.selectExpr("query", "role", "cast(v as string) v").collect()}
    assert got and {r[:2] for r in got} == {r[:2] for r in all_means if r[1] == "positive"}
    assert "SortMergeJoin [item" in seen[-1]
    row = lambda r: (r.query, r.item, r["rank"], round(r.score, 9))
    assert sorted(map(row, w.near_mean().collect())) == sorted(map(row, full.near_mean().collect()))


def test_pairs_of_blocks_go_to_python_in_small_batches(spark):
    from tessera.operators import retrieval

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    q = spark.createDataFrame([(1, [1.0])], "query long, q array<double>")
    x = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "item long, v array<double>")
    assert [r.item for r in retrieval.dense(q, x, 2).orderBy("rank").collect()] == [4, 3]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
