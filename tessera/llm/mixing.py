"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash of their id and text. Each gets a virtual finish time: the words
of its source up to and including it, over its source's target. All entries of all sources are then
sorted by virtual finish time over ranges of that time, and the mix is cut where a running sum over
the whole order spends the total budget. The document that its source serves at virtual time 1 is
two entries, cut there, so sources meet their targets to the word. A source whose target exceeds
its size goes round again: each document has an entry for each round.

Running sums use two levels: sums of ranges, then rows inside one range. Inside sources ranges go
by hash, and over all sources by virtual time, in which every source advances evenly; so neither
a source that holds most rows nor any stretch of the mix is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows that one range holds, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 512, 65_536


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _source(docs: DataFrame):
    return F.col("source") if "source" in docs.columns else F.lit(None).cast("string")


def targets(sources: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size and target, from source and source_size.

    Sources get ``weights`` in turn by code point, null last. The budget is ``share`` times all
    sizes. A target stops at ``most`` times its source's size; the excess goes to the others by
    weight until none is above: all uncapped sources stand at one level of words a weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    # capped are the sources with the least size a weight, as many as keep the level above them
    ratio = F.col("source_size") * F.lit(1.0) / F.col("weight")
    order = Window.orderBy(ratio, "weight", F.col("source").isNull(), F.encode("source", "UTF-8"))
    upto, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    placed = (
        weighted.withColumn("total", F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * most)
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("level", (F.lit(share) * F.col("total") - F.col("capped")) / F.col("rest"))
    )
    # the level rises while sources are capped; the first that isn't sets it for the rest
    free = placed.withColumn("first", F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct((-F.col("rest")).alias("at"), "level")))
    free = free.withColumn("set", F.min("first").over(every)["level"])
    own = F.coalesce(F.col("set") * F.col("weight"), most * F.col("source_size") * F.lit(1.0))
    return free.select("source", "source_size", F.least(own, most * F.col("source_size") * F.lit(1.0)).alias("target"))


def _shuffled(seed: str):
    """The hash by which documents are shuffled; rows of one doc_id are spread by their texts."""
    own = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))]
    return F.md5(F.concat(*own).cast("binary"))


def _ranges(n: int) -> int:
    return max(1, min(MOST_RANGES, n // RANGE_ROWS))


def _upto(sums: DataFrame, by: list[str], at: str) -> DataFrame:
    """For each range ``at`` (within ``by``), the words of the ranges before it."""
    order = Window.partitionBy(*by).orderBy(at)
    return sums.withColumn("before", F.sum("words").over(order) - F.col("words")).drop("words")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, virtual_finish and copies of each row of ``docs``.

    ``taken`` counts the words that the mix takes, repeats included; ``virtual_finish`` is that of
    the document's last words in the mix, null where none are; ``copies`` has (copy, words,
    virtual_finish) of each time that it is taken. With ``key``, a column that numbers the rows of
    ``docs``, that column comes along. Null and empty texts have size 0 and are never taken. Repeated
    rows, and rows that share a doc_id or have none, are queued each. Ties of the shuffle go by
    doc_id and size. An empty table gives no rows; further columns are ignored.
    """
    row = F.col(key) if key else F.monotonically_increasing_id()
    sized = write_table(docs.select(row.alias("row"), "doc_id", _source(docs).alias("source"), _size().alias("size"), _shuffled(seed).alias("h")), "sizes")
    ranges = _ranges(sized.count())
    shuffled = sized.withColumn("range", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("int"))
    sums = write_table(shuffled.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    goal = write_table(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    small = _upto(sums, ["source"], "range").select(F.col("source").alias("s"), F.col("range").alias("r"), "before")
    small = small.join(goal, small["s"].eqNullSafe(goal["source"])).drop("source")
    inside = Window.partitionBy("source", "range").orderBy("h", F.col("doc_id").isNull(), "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = shuffled.withColumn("within", F.sum("size").over(inside))
    queued = queued.join(small, queued["source"].eqNullSafe(small["s"]) & (queued["range"] == small["r"]))
    begin = F.col("before") + F.col("within") - F.col("size")
    queued = write_table(queued.select("row", "doc_id", "source", "size", "source_size", "target", begin.alias("begin")), "queues")

    # entries: the part of each copy up to virtual time 1, and what is beyond
    cut = F.floor("target")
    entries = queued.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    entries = entries.withColumn("begin", F.col("begin") + F.col("copy") * F.col("source_size"))
    first = F.greatest(F.lit(0), F.least(F.col("size"), cut - F.col("begin")))
    time = lambda words: F.coalesce(F.try_divide(words.cast("double"), F.col("target")), F.lit(float("inf")))
    parts = F.array(
        F.struct(F.lit(0).alias("beyond"), first.alias("words"), F.least(F.lit(1.0), time(F.col("begin") + first)).alias("finish")),
        F.struct(F.lit(1).alias("beyond"), (F.col("size") - first).alias("words"), F.greatest(F.lit(1.0), time(F.col("begin") + F.col("size"))).alias("finish")),
    )
    entries = entries.select("row", "copy", "source", F.explode(parts).alias("p")).select("row", "copy", "source", "p.*").where("words > 0")
    spans = F.lit(_ranges(2 * most * queued.count()))
    at = F.when(F.col("finish") <= 1, F.col("finish")).otherwise(2 - 1 / F.col("finish"))  # ranges of virtual time, 0 to 2
    entries = entries.withColumn("span", F.floor(at * spans).cast("long"))
    upto = _upto(entries.groupBy("span").agg(F.sum("words").alias("words")), [], "span").withColumnRenamed("span", "t")
    order = Window.partitionBy("span").orderBy("finish", "beyond", F.col("source").isNull(), "source", "row", "copy").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = entries.withColumn("within", F.coalesce(F.sum("words").over(order), F.lit(0))).join(upto, F.col("span") == F.col("t"))
    budget = goal.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0)).alias("budget"))
    sorted_ = sorted_.crossJoin(F.broadcast(budget))
    sorted_ = sorted_.withColumn("words", F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("before") - F.col("within")))).where("words > 0")
    # a copy that is cut at virtual time 1 and goes on beyond it is one copy again
    copies = sorted_.groupBy("row", "copy").agg(F.sum("words").cast("long").alias("words"), F.max("finish").alias("virtual_finish"))
    copies = copies.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("copy", "words", "virtual_finish"))).alias("copies"))
    copies = copies.withColumnRenamed("row", "r")
    out = queued.join(copies, queued["row"] == copies["r"], "left")
    none = F.array().cast("array<struct<copy: int, words: long, virtual_finish: double>>")
    out = out.withColumn("copies", F.coalesce("copies", none))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return out.select(
        *([F.col("row").alias(key)] if key else []),
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        F.array_max(F.transform("copies", lambda c: c["virtual_finish"])).alias("virtual_finish"),
        "copies",
    )


#: Columns that ``mixed_texts`` adds.
ADDED = ("copy", "size", "source_size", "target", "taken", "virtual_finish")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in order of virtual finish time: a row for each copy of a document that it takes.

    Rows have the columns of ``docs`` and ``ADDED``; a copy of which the mix takes only the first
    words has its text cut after them (``n_chars``, where there is one, follows), and ``taken``
    counts the words of the copy. Columns of ``docs`` that have these names are kept under the
    name with ``_doc`` behind it. Rows meet their verdict by a number of their own, so null and
    repeated doc_ids and repeated rows are taken each. Null and empty texts are never taken; an
    empty table gives no rows; long texts are taken whole.
    """
    names = {c: c for c in docs.columns}
    for c in [c for c in docs.columns if c.lower() in ADDED]:
        while names[c].lower() in {*ADDED, *(n.lower() for o, n in names.items() if o != c)}:
            names[c] += "_doc"
    key = "row"
    while key in {n.lower() for n in names.values()}:
        key += "_"
    rows = write_table(docs.withColumnsRenamed(names).withColumn(key, F.monotonically_increasing_id()), "rows")
    mixed = mix(rows, key=key, **how).where("taken > 0").select(F.col(key).alias("row_of"), "size", "source_size", "target", F.explode("copies").alias("c"))
    out = rows.join(mixed, rows[key] == mixed["row_of"]).drop(key, "row_of")
    out = out.withColumns({"copy": F.col("c.copy"), "taken": F.col("c.words"), "virtual_finish": F.col("c.virtual_finish")}).drop("c")
    # words, each with the white space before it
    pieces = F.split("text", "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    cut = F.col("taken") < F.col("size")
    out = out.withColumn("text", F.when(cut, F.array_join(F.slice(pieces, F.lit(1), F.col("taken").cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names.values(), *ADDED).orderBy("virtual_finish", "doc_id", "copy")


SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS h
  FROM documents
), w AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, CAST(encode(source) AS BLOB)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM s GROUP BY source
), p AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         coalesce(sum(source_size) OVER before, 0) * 2 AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest
  FROM w WINDOW before AS (ORDER BY source_size * 1.0::DOUBLE / weight, weight, source IS NULL, CAST(encode(source) AS BLOB) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (1.5::DOUBLE * total - CAST(capped AS DOUBLE)) / CAST(rest AS DOUBLE) AS level FROM p
), t AS (
  SELECT source, source_size, weight,
         (SELECT arg_min(level, -rest) FROM l WHERE level * weight <= 2 * source_size) AS level FROM l
), g AS (
  SELECT source, source_size, least(coalesce(level * weight, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM t
), q AS (
  SELECT s.*, g.source_size, g.target,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - start))
          + greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - start)) AS BIGINT) AS taken
FROM q
"""
