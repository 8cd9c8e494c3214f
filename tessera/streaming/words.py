"""Top words over streams. Streams have ``ts`` (timestamp) and ``word``; batches may too."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..persist import shared_dir


def socket_words(spark: SparkSession, host: str = "localhost", port: int = 9999) -> DataFrame:
    """One word a line from a TCP server, with its arrival time."""
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load().select(F.col("timestamp").alias("ts"), F.col("value").alias("word"))


def file_words(spark: SparkSession, folder: str, schema: str, glob: str = "*", files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(folder)


def late_until(words: DataFrame, delay: str | None) -> DataFrame:
    """With a delay, words that come later than it are left out and closed windows are forgotten."""
    return words.withWatermark("ts", delay) if delay else words


def tumbling_counts(words: DataFrame, every: str = "10 seconds", delay: str | None = None) -> DataFrame:
    """window_start, word and count of each window; ``delay`` is the watermark's."""
    got = late_until(words, delay).groupBy(F.window("ts", every).alias("w"), "word").agg(F.count("*").alias("count"))
    return got.select(F.col("w.start").alias("window_start"), "word", "count")


def sliding_counts(words: DataFrame, length: str = "60 seconds", slide: str = "10 seconds", delay: str | None = None) -> DataFrame:
    got = late_until(words, delay).groupBy(F.window("ts", length, slide).alias("w"), "word").agg(F.count("*").alias("count"))
    return got.select(F.col("w.start").alias("window_start"), "word", "count")


def top_of_windows(counts: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent words of each window; ties by word."""
    order = Window.partitionBy("window_start").orderBy(F.desc("count"), F.asc("word"))
    return counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def decayed(state: float, silent: int, count: int, c: float, least: float) -> float:
    """A state after ``silent`` empty batches and one with ``count``; below ``least`` it is dropped (0)."""
    for _ in range(silent):
        state *= 1 - c
        if state < least:
            state = 0.0
            break
    state = count + (1 - c) * state
    return state if state >= least else 0.0


def decaying_state(counts: DataFrame, c: float = 0.1, least: float = 1.0) -> DataFrame:
    """word, batch and value: an exponentially decaying window, from a stream of (word, batch, n).

    ``batch`` numbers the batches from 0. Spark calls only for words that occur, so the batches in
    which a word was silent are made up for at its next occurrence, which gives the same values.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (0.0, -1)
        rows = pd.concat(list(frames)).groupby("batch", as_index=False)["n"].sum().sort_values("batch")
        out = []
        for batch, n in zip(rows["batch"], rows["n"], strict=True):
            silent = int(batch) - last - 1 if last >= 0 else 0
            value = decayed(value, silent, int(n), c, least)
            last = int(batch)
            out.append((key[0], last, value))
        state.update((value, last))
        yield pd.DataFrame(out, columns=["word", "batch", "value"])

    return counts.groupBy("word").applyInPandasWithState(update, "word string, batch long, value double", "value double, batch long", "update", GroupStateTimeout.NoTimeout)


def decayed_totals(counts: DataFrame, last: int, c: float = 0.1, least: float = 1.0) -> DataFrame:
    """The same for stored batches (word, batch, n): each word's value after batch ``last``.

    Words that were dropped have no row. A word's batches are folded in order in one expression;
    its rows are one a batch, summed before the shuffle.
    """
    per_batch = counts.groupBy("word", "batch").agg(F.sum("n").alias("n"))
    seen = per_batch.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("batch", "n"))).alias("b"))
    start = F.struct(F.lit(0.0).alias("v"), F.lit(-1).cast("long").alias("at"))

    def faded(v, gap):
        # dropped on the way once it falls below the least value
        now = v * F.pow(F.lit(1 - c), gap.cast("double"))
        return F.when((gap > 0) & (now < least), 0.0).otherwise(now)

    def fold(s, x):
        old = faded(s["v"], F.greatest(x["batch"] - s["at"] - 1, F.lit(0)))
        new = x["n"] + (1 - c) * old
        return F.struct(F.when(new >= least, new).otherwise(0.0).alias("v"), x["batch"].alias("at"))

    done = seen.select("word", F.aggregate("b", start, fold).alias("s"))
    return done.select("word", faded(F.col("s.v"), F.lit(last) - F.col("s.at")).alias("value")).where(F.col("value") > 0)


def run_to_end(stream: DataFrame, name: str, keys: Sequence[str], checkpoint: str | None = None, mode: str = "update") -> DataFrame:
    """Run a stream over all that is there, and return each key's last row.

    Each batch's changes are written to a folder of its own, named by the batch, so a batch that is
    repeated after a failure replaces itself; nothing is gathered on the driver. Results and the
    query's checkpoint stand in ``checkpoint``, else in a new folder that the executors share.
    """
    spark = stream.sparkSession
    folder = checkpoint or f"{shared_dir(spark)}/stream-{name}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/b{number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/out/none")  # there may be no batch
    rows = spark.read.schema(schema).parquet(f"{folder}/out/*")
    rows = rows.select(*schema.names, F.regexp_extract(F.input_file_name(), "/b([0-9]+)/[^/]*$", 1).cast("long").alias("batch_"))
    if mode == "append":
        return rows.drop("batch_")
    rest = [c for c in schema.names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_").alias("r"))
    return last.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*schema.names)


def print_top(stream: DataFrame, n: int = 10, checkpoint: str | None = None):
    """Start a query that prints the most frequent words after each batch; stop it with ``.stop()``."""

    def show(batch: DataFrame, number: int) -> None:
        batch.orderBy(F.desc("count"), F.asc("word")).show(n, truncate=False)

    writer = stream.writeStream.outputMode("update").foreachBatch(show)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
