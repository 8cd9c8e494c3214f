"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """A line's words, parted by runs of anything but ASCII letters, digits and underscores.

    A leading separator and an empty line give an empty word, trailing ones don't, and a line of
    separators only has no words.
    """
    cut = F.regexp_replace(line, r"[^\w]+\z", "")
    return F.when((line == "") | (cut != ""), F.split(cut, r"[^\w]+")).otherwise(F.array().cast("array<string>"))


def text_lines(text: Column) -> Column:
    """The lines of a text, as a line-by-line reader gives them: a final line end opens no line."""
    return F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")


def shingles(text: Column, k: int) -> Column:
    """Distinct substrings of length k at every place; the last ones are shorter, down to 1."""
    # characters zipped with those after them: substring() would read the text from its start each time
    chars = F.split(text, "")
    each = chars
    for j in range(1, k):
        each = F.zip_with(each, F.slice(chars, F.lit(j + 1), F.greatest(F.length(text), F.lit(1))), lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    return F.when(F.length(text) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))
