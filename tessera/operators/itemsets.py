"""Frequent itemsets and association rules.

Baskets are (basket_id, items array). Itemsets are sorted arrays. Supports are counted by joins of
baskets that hold frequent items only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..persist import checkpointed


def frequent_items(baskets: DataFrame, support: float, n: int | None = None) -> DataFrame:
    """items (one) and n of the items in at least ``support`` of all baskets."""
    n = baskets.count() if n is None else n
    seen = baskets.select("basket_id", F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return seen.where(F.col("n") / max(n, 1) >= support).select(F.array("item").alias("items"), "n")


def candidate_pairs(single: DataFrame) -> DataFrame:
    """Unordered pairs of frequent items."""
    a, b = single.select(F.col("items")[0].alias("a")), single.select(F.col("items")[0].alias("b"))
    return a.join(b, F.col("a") < F.col("b")).select(F.array("a", "b").alias("items"))


def candidate_triples(pairs: DataFrame) -> DataFrame:
    """Unions of two frequent pairs that share an item, distinct and not pruned further."""
    each = pairs.select("items", F.explode("items").alias("shared"))
    other = each.select(F.col("items").alias("other"), F.col("shared").alias("with"))
    both = each.join(other, (F.col("shared") == F.col("with")) & (F.col("items") < F.col("other")))
    return both.select(F.array_sort(F.array_distinct(F.concat("items", "other"))).alias("items")).where(F.size("items") == 3).distinct()


def _kept(baskets: DataFrame, single: DataFrame) -> DataFrame:
    one = single.select(F.col("items")[0].alias("item"))
    return baskets.select("basket_id", F.explode(F.array_distinct("items")).alias("item")).join(one, "item", "left_semi")


def _support(kept: DataFrame, size: int) -> DataFrame:
    """items and n of all sets of ``size`` items that occur in a basket."""
    sides = [kept.select(F.col("basket_id").alias(f"b{i}"), F.col("item").alias(f"i{i}")) for i in range(size)]
    joined = sides[0]
    for i in range(1, size):
        joined = joined.join(sides[i], (F.col("b0") == F.col(f"b{i}")) & (F.col(f"i{i - 1}") < F.col(f"i{i}")))
    return joined.groupBy(F.array(*(F.col(f"i{i}") for i in range(size))).alias("items")).agg(F.count("*").alias("n"))


def apriori(baskets: DataFrame, support: float = 0.01) -> dict[str, DataFrame]:
    """C1, L1, C2, L2, C3 and L3; the L have items, n and support. Sets stop at three items."""
    baskets = checkpointed(baskets.select("basket_id", "items"))
    n = max(1, baskets.count())
    l1 = checkpointed(frequent_items(baskets, support, n))
    kept = checkpointed(_kept(baskets, l1))
    c2 = candidate_pairs(l1)
    l2 = checkpointed(_support(kept, 2).where(F.col("n") / n >= support))
    c3 = candidate_triples(l2)
    l3 = _support(kept, 3).join(c3, "items", "left_semi").where(F.col("n") / n >= support)
    relative = lambda df: df.select("items", "n", (F.col("n") / n).alias("support"))
    c1 = baskets.select(F.explode(F.array_distinct("items")).alias("item")).distinct().select(F.array("item").alias("items"))
    return {"C1": c1, "L1": relative(l1), "C2": c2, "L2": relative(l2), "C3": c3, "L3": relative(l3)}


def set_counts(found: dict[str, DataFrame]) -> DataFrame:
    """name and size of each collection of sets."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("size")) for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


def rules(found: dict[str, DataFrame], confidence: float = 0.8) -> DataFrame:
    """body, head and confidence of the rules with one head from pairs and triples.

    Confidence is the quotient of the two relative supports, as doubles.
    """
    whole = found["L2"].unionByName(found["L3"]).select("items", F.col("support").alias("both"), F.explode("items").alias("head"))
    whole = whole.withColumn("body", F.array_except("items", F.array("head")))
    parts = found["L1"].unionByName(found["L2"]).select(F.col("items").alias("body"), F.col("support").alias("alone"))
    out = whole.join(parts, "body").withColumn("confidence", F.col("both") / F.col("alone"))
    return out.where(F.col("confidence") >= confidence).select("body", "head", "confidence")


def ranked(found: DataFrame) -> DataFrame:
    """Rules by falling confidence, then body and head."""
    return found.orderBy(F.desc("confidence"), "body", "head")


def rule_text(found: DataFrame) -> DataFrame:
    """``[a, b] -> [c] (Confidence: x)``."""
    body = F.concat(F.lit("["), F.array_join("body", ", "), F.lit("]"))
    return found.select(F.concat(body, F.lit(" -> ["), F.col("head"), F.lit("] (Confidence: "), F.col("confidence").cast("string"), F.lit(")")).alias("rule"))


def fp_growth(baskets: DataFrame, support: float = 0.01, confidence: float = 0.8, partitions: int = 10):
    """A fitted model: ``freqItemsets`` of any size, ``associationRules`` with one head.

    The model mines again for each use of its sets, so baskets are kept; ``fp_rules`` mines once.
    """
    kept = checkpointed(baskets.select(F.array_distinct("items").alias("items")))
    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=partitions).fit(kept)


def fp_rules(model, confidence: float) -> DataFrame:
    """body (sorted), head and confidence of the rules with one head, from frequent sets mined once."""
    sets = checkpointed(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    whole = sets.where(F.size("items") > 1).select("items", F.col("freq").alias("both"), F.explode("items").alias("head"))
    whole = whole.withColumn("body", F.array_except("items", F.array("head")))
    alone = sets.select(F.col("items").alias("body"), F.col("freq").alias("alone"))
    out = whole.join(alone, "body").withColumn("confidence", F.col("both").cast("double") / F.col("alone").cast("double"))
    return out.where(F.col("confidence") >= confidence).select("body", "head", "confidence")


def fp_itemsets(model, least: int = 2) -> DataFrame:
    """items (sorted) and freq of the sets of at least ``least`` items."""
    return model.freqItemsets.where(F.size("items") >= least).select(F.array_sort("items").alias("items"), "freq")
