"""Text-format sources and sinks. Each parser takes a DataFrame of lines, ``value``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbers(text: DataFrame, separator: str) -> DataFrame:
    return text.select(F.transform(F.split("value", separator), lambda x: x.cast("double")).alias("features"))


def space_vectors(text: DataFrame, as_vector: bool = False) -> DataFrame:
    """features: doubles that single spaces part."""
    out = _numbers(text, " ")
    return out.select(array_to_vector("features").alias("features")) if as_vector else out


def csv_vectors(text: DataFrame, as_vector: bool = False) -> DataFrame:
    """features: doubles that commas part, no header."""
    out = _numbers(text, ",")
    return out.select(array_to_vector("features").alias("features")) if as_vector else out


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV without header under an explicit schema."""
    return spark.read.csv(path, schema=schema, sep=sep)


def ratings(text: DataFrame) -> DataFrame:
    """user, item and rating from the first three fields; white space parts them."""
    f = F.split("value", r"\s+")
    return text.select(f[0].cast("int").alias("user"), f[1].cast("int").alias("item"), f[2].cast("double").alias("rating"))


def zero_based(rated: DataFrame) -> DataFrame:
    """Ids counted from 0 instead of 1."""
    return rated.withColumn("user", F.col("user") - 1).withColumn("item", F.col("item") - 1)


def baskets(text: DataFrame) -> DataFrame:
    """basket_id and its distinct items. Blank lines are baskets too and have one empty item."""
    return text.select(F.monotonically_increasing_id().alias("basket_id"), F.array_distinct(F.split(F.regexp_replace("value", r"\s+\z", ""), r"\s+")).alias("items"))


def quoted_texts(text: DataFrame) -> DataFrame:
    """doc_id and text from lines ``"id","text"``."""
    return text.select(
        F.expr("cast(substring(value, 2, instr(value, '\",\"') - 2) as int)").alias("doc_id"),
        F.expr("substring(value, instr(value, '\",\"') + 3, length(value) - instr(value, '\",\"') - 3)").alias("text"),
    )


def adjacency(text: DataFrame) -> DataFrame:
    """user and its distinct friends from lines ``user TAB f1,f2,...``; friends may be absent."""
    f = F.split("value", "\t")
    listed = F.when((F.size(f) > 1) & (F.get(f, F.lit(1)) != ""), F.transform(F.split(F.get(f, F.lit(1)), ","), lambda x: x.cast("int")))
    return text.select(f[0].cast("int").alias("user"), F.array_distinct(F.coalesce(listed, F.array().cast("array<int>"))).alias("friends"))


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src and dst from lines ``from TAB to``, duplicates collapsed."""
    return spark.read.csv(path, schema="src long, dst long", sep="\t").distinct()


def local_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A collection of the driver as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def write_pairs(df: DataFrame, path: str) -> None:
    """A text directory of ``(a,b)`` lines; fails if it is there."""
    df.select(F.concat(F.lit("("), F.concat_ws(",", *(F.col(f"`{c}`").cast("string") for c in df.columns)), F.lit(")"))).write.text(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A one-column text directory; fails if it is there."""
    df.write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of ``x y`` lines in one file: reports have a row for each parameter tried."""
    df.coalesce(1).write.csv(path, sep=" ")
