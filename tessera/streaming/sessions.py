"""Structured Streaming forms: windows under a watermark, keyed state and resumed appends.

The events table is read as a stream of files. Each query runs over what is there and stops; its
checkpoint is in the cluster's shared folder where the session names one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/tessera-stream-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tessera-stream-")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").format("parquet").load(f"{sf_dir}/events*")


def _done(stream: DataFrame, mode: str, at: str) -> None:
    (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()).awaitTermination()


def windowed(spark: SparkSession, sf_dir: str, mode: str = "complete") -> DataFrame:
    """start, event_type, n, total by ten-minute windows under a watermark of an hour.

    complete: all windows, as the last micro-batch has them. append: those that the watermark has
    passed, each once, when it can't change any more; rows later than that are dropped.
    """
    at = _folder(spark)
    stream = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    stream = stream.select(F.col("window.start").alias("start"), "event_type", "n", "total")
    schema = "start timestamp, event_type string, n long, total double"
    if mode == "append":
        _done(stream, "append", at)
        return spark.read.schema(schema).parquet(f"{at}/out")

    def replace(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


#: arrivals of the events, event time that late rows are waited for, and the pause that ends a user's session
ARRIVALS, DELAY, PAUSE = 3, "1 hour", "6 hours"


def arrivals(spark: SparkSession, sf_dir: str, at: str, late: bool):
    """Writes the events in parts of the time that they span, one after another, and gives the stream of them each time.

    late: every eleventh event comes with the part after its own.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    ends = rows.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))  # one row
    rows = rows.crossJoin(F.broadcast(ends))
    part = F.expr(f"({ARRIVALS} * (unix_micros(ts) - lo)) div (hi - lo + 1)")
    if late:
        part = F.least(F.lit(ARRIVALS - 1), part + (F.col("event_id") % 11 == 0).cast("int"))
    rows = rows.withColumn("arrival", part).drop("lo", "hi")
    for k in range(ARRIVALS):
        rows.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{at}/in")
        yield spark.readStream.schema(rows.drop("arrival").schema).parquet(f"{at}/in").withWatermark("ts", DELAY)


def closed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """start, key, n, total of the windows that the watermark has passed, each once, when it can't change any more.

    kind: tumbling (ten minutes, by type), sliding (half an hour, every ten minutes, by type) or
    session (a user's events until a pause). Every arrival resumes the stream from its checkpoint;
    rows of windows that are closed by then are dropped.
    """
    window, key = {"tumbling": (F.window("ts", "10 minutes"), F.col("event_type")), "sliding": (F.window("ts", "30 minutes", "10 minutes"), F.col("event_type")), "session": (F.session_window("ts", PAUSE), F.col("user_id").cast("string"))}[kind]
    at = _folder(spark)
    for stream in arrivals(spark, sf_dir, at, late=True):
        counts = stream.groupBy(window.alias("w"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        _done(counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n", "total"), "append", at)
    return spark.read.schema("start timestamp, end timestamp, key string, n long, total double").parquet(f"{at}/out")


#: plays that a turn's history holds, days without a play after which it is forgotten
HISTORY, IDLE_DAYS = 5, 2


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, event_id, history (the last plays before this one, the latest first) of each play whose day is over.

    Plays wait in a user's list state until the watermark passes the end of their day, which a
    timer tells; then they are taken in event time, whatever order they came in, and the list of
    the last plays goes with the user from arrival to arrival. After a long pause it is empty.
    A user's timer is for the earliest day that waits; all days that are over by then are taken at once.
    """
    from pyspark.sql.streaming import StatefulProcessor

    day, idle = 86_400_000_000, IDLE_DAYS * 86_400_000_000

    def over(play) -> int:
        return (play[0] // day + 1) * day // 1000

    class Plays(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "us long, event_id long, item string")
            self.history = handle.getListState("history", "us long, item string")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            first = []
            for frame in rows:
                plays = [(int(u), int(e), None if pd.isna(i) else str(i)) for u, e, i in zip(frame["us"], frame["event_id"], frame["event_type"])]
                self.waiting.appendList(plays)
                first.append(min(map(over, plays)))
            self.handle.registerTimer(min(first))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            mark = timerValues.getCurrentWatermarkInMs()
            plays, left = [], []
            for x in self.waiting.get():
                (plays if over(x) <= mark else left).append(tuple(x))
            if not plays:
                return
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(min(map(over, left)))
            else:
                self.waiting.clear()
            held, out = [tuple(x) for x in self.history.get()], []
            for us, event_id, item in sorted(plays, key=lambda x: x[:2]):
                held = held if held and us - held[0][0] <= idle else []
                out.append((key[0], event_id, " ".join(x[1] or "" for x in held)))
                held = [(us, item), *held][:HISTORY]
            self.history.put(held)
            yield pd.DataFrame(out, columns=["session", "event_id", "history"])

        def close(self) -> None:
            pass

    at, conf = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for stream in arrivals(spark, sf_dir, at, late=False):
            rows = stream.select("ts", "user_id", "event_id", "event_type", F.unix_micros("ts").alias("us")).groupBy("user_id")
            _done(rows.transformWithStateInPandas(Plays(), "session long, event_id long, history string", "Append", "EventTime"), "append", at)
    finally:
        spark.conf.set(conf, before) if before else spark.conf.unset(conf)
    return spark.read.schema("session long, event_id long, history string").parquet(f"{at}/out")


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows by an available-now file stream: a second run with the same checkpoint would add new files only."""
    at = _folder(spark)
    stream = events(spark, sf_dir)
    _done(stream, "append", at)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, plays, kinds: a state for each session, kept by the stream from one micro-batch to the next.

    The state is a count and the kinds of item met so far (a few). Every batch writes the
    sessions that it changed; counts only grow, so a session's largest row is its latest.
    """
    at = _folder(spark)

    def update(key, frames, state):
        import pandas as pd

        plays, kinds = state.get if state.exists else (0, [])
        kinds = set(kinds)
        for f in frames:
            plays += len(f)
            kinds.update(f.event_type.dropna())
        state.update((plays, sorted(kinds)))
        yield pd.DataFrame({"session": [key[0]], "plays": [plays], "kinds": [len(kinds)]})

    def add(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    rows = events(spark, sf_dir).select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(update, "session long, plays long, kinds long", "plays long, kinds array<string>", "update", "NoTimeout")
    rows.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("session long, plays long, kinds long, batch int").parquet(f"{at}/out")
    return out.groupBy("session").agg(F.max("plays").alias("plays"), F.max("kinds").alias("kinds"))
