"""Readers and writers, and the views of the star schema that stand for sessions and a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTIONS = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("turn_number", T.IntegerType()), T.StructField("predicted_track_ids", T.ArrayType(T.StringType())), T.StructField("predicted_response", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_array(spark: SparkSession, path: str, schema: T.StructType, whole: int = 128 << 20) -> DataFrame:
    """One JSON array of rows in a file; the schema is stated, so files are read once.

    Spark's own reader takes a file in one task. Where a file is longer than ``whole`` bytes, all are read in byte ranges.
    """
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    if longest > whole:
        from tessera.sources import jsonarray

        return jsonarray.rows(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_features(df: DataFrame, path: str, fold: str) -> None:
    """Feature rows, one folder for each fold: training on some folds reads those only."""
    df.write.mode("overwrite").partitionBy(fold).parquet(path)


def append_missing(new: DataFrame, sink: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the sink lacks: what a resumed stage or a response cache still has to do."""
    return new.join(sink.select(*keys).distinct(), keys, "left_anti")


def merged_shards(shards: list[DataFrame], group: list[str]) -> DataFrame:
    """Union of shards with equal columns, with a contiguous group id from 0."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    from tessera.operators.ordering import numbered

    ids = numbered(out.select(*group).distinct(), *group, name="group_id")
    return out.join(ids.withColumn("group_id", F.col("group_id") - 1), group)


def last_wins(splits: list[DataFrame], key: str) -> DataFrame:
    """Splits one after the other; of rows with one key the last split's stays."""
    out = splits[0].withColumn("_split", F.lit(0))
    for i, s in enumerate(splits[1:], 1):
        out = out.unionByName(s.withColumn("_split", F.lit(i)))
    order = Window.partitionBy(key).orderBy(F.desc("_split"))
    return out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_split")


def plays(spark: SparkSession, sf_dir: str, only: str | None = None, labels: bool = True) -> DataFrame:
    """session, pos (from 1), item, label: order lines as plays, the return flag as feedback. only: a condition on o_custkey; orders that it leaves go to the lines, up to a million of them.

    Without labels, plays of one item with one line number are all alike: the columns that only tell them apart are not read.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if only is not None:
        o = o.where(only)
        o = F.broadcast(o) if o.count() <= 1_000_000 else o
    ties = ["l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag"] if labels else []
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *ties).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", *ties)
    found = [F.col("o_custkey").alias("session"), F.row_number().over(order).alias("pos"), F.col("l_partkey").alias("item")]
    if not labels:
        return rows.select(*found)
    label = F.when(F.col("l_returnflag") == "A", "MOVES").when(F.col("l_returnflag") == "R", "DOES_NOT")
    return rows.select(*found, label.alias("label"))


def event_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, pos, item: events in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.row_number().over(order).alias("pos"), F.col("event_type").alias("item"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, name, artist, tags, popularity, size of the parts."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.col("p_brand").alias("artist"), F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("tags"), F.col("p_retailprice").alias("popularity"), F.col("p_size").alias("size"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("l0"))
