"""Counts over lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_lines, tokens


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``value``: the lines of each text."""
    return docs.select(F.explode(text_lines(F.col(text))).alias("value"))


def line_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("n_lines"))


def word_count(lines: DataFrame) -> DataFrame:
    """word and count; words keep their case, and lines that begin with a separator have an empty one."""
    return lines.select(F.explode(tokens(F.col("value"))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def letter_count(lines: DataFrame) -> DataFrame:
    """letter and count of words by upper-case first letter; other words are left out."""
    words = lines.select(F.explode(tokens(F.col("value"))).alias("word")).where(F.col("word").rlike("^[A-Za-z]"))
    return words.groupBy(F.upper(F.substring("word", 1, 1)).alias("letter")).agg(F.count("*").alias("count"))
