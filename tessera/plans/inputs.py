"""The engine's inputs drawn from the star-schema tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text
from ..operators.recommend import flat, ranges
from ..sources.files import parquet

MEASURES = ("l_quantity", "l_price", "l_discount", "l_tax")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines_of(parquet(spark, sf_dir, "documents"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rate suppliers 1 to 5, by the quantities they order."""
    orders = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    rating = (F.pmod(F.floor("l_quantity"), F.lit(5)) + 1).cast("double")
    rated = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rated.groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_suppkey").cast("int").alias("item")).agg(F.max(rating).alias("rating"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as baskets of brands."""
    items = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = parquet(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("basket_id")).agg(F.collect_set("p_brand").alias("items"))


#: Friends that a task lists, about, before equal ones fall together.
MOST_FRIENDS = 20_000_000


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are friends who purchase in the same ten minutes; all users are listed, each once.

    Users are dealt over blocks, and the buyers of ten minutes go once to each block that holds one of
    them; a pair of friends is never a row.
    """
    events = parquet(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase' and user_id is not null and ts is not null").select("user_id", F.window("ts", "10 minutes").alias("w"))
    together = bought.groupBy("w").agg(F.sort_array(F.collect_set("user_id")).alias("users"))
    pairs = together.agg(F.sum(F.pow(F.size("users"), F.lit(2.0))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(pairs) // MOST_FRIENDS), min(spark.sparkContext.defaultParallelism, int(pairs) // 100_000))
    of = lambda u: F.pmod(F.xxhash64(u), F.lit(blocks))
    rows = together.select("users", F.explode(F.array_distinct(F.transform("users", of))).alias("block"))
    rows = rows.select("block", "users", F.filter("users", lambda u: of(u) == F.col("block")).alias("own")).repartition(blocks, "block")

    def friends(table: pa.Table) -> pa.Table:
        users, offsets = flat(table["users"])
        own, own_offsets = flat(table["own"])
        row = np.repeat(np.arange(len(table)), np.diff(own_offsets))[order := np.argsort(own, kind="stable")]
        ids, first = np.unique(own[order], return_index=True)
        lists = []
        for user, held in zip(ids, np.split(row, first[1:]), strict=True):
            met = np.unique(users[ranges(offsets[held], offsets[held + 1] - offsets[held])])
            lists.append(met[met != user])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.table({"user": ids, "friends": pa.ListArray.from_arrays(ends, np.concatenate(lists))})

    lists = rows.groupBy("block").applyInArrow(friends, "user long, friends array<bigint>")
    every = events.select(F.col("user_id").alias("user")).distinct()
    others = every.join(bought.select(F.col("user_id").alias("user")).distinct(), "user", "left_anti")
    return lists.unionByName(others.select("user", F.array().cast("array<bigint>").alias("friends")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each user to the user of the next event."""
    from pyspark.sql import Window

    # events by day, so that the order needs no single task: a day's first event follows the last of the day before
    events = parquet(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("src"), F.to_date("ts").alias("day"))
    inside = Window.partitionBy("day").orderBy("ts", "event_id")
    within = events.withColumn("dst", F.lead("src").over(inside)).select("day", "src", "dst")
    ends = events.groupBy("day").agg(F.min(F.struct("ts", "event_id", "src")).alias("first"), F.max(F.struct("ts", "event_id", "src")).alias("last"))
    across = ends.select(F.col("last.src").alias("src"), F.lead("first.src").over(Window.orderBy("day")).alias("dst"))
    return within.select("src", "dst").unionByName(across).where("src is not null and dst is not null").distinct()


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("l_price"), "l_discount", "l_tax")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stored stream of words."""
    return parquet(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("word"))


def word_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.words import file_words

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    # the table is a file or a folder of files
    raw = file_words(spark, sf_dir, schema, "events.parquet") if not _is_folder(spark, f"{sf_dir}/events.parquet") else file_words(spark, f"{sf_dir}/events.parquet", schema)
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("word"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
