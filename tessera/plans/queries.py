"""The catalogue: a name for each query over the star-schema tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, graph, itemsets, linalg, recommend, similarity, social, text
from ..sources import files
from ..sources.files import parquet
from ..streaming import words as streams
from . import inputs

QUERIES: dict = {}
SUPPORT, CONFIDENCE, ROUNDS, HASHES = 0.002, 0.15, 5, 300


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def line_count(spark: SparkSession, sf: str) -> DataFrame:
    return text.line_count(inputs.lines(spark, sf))


@query
def word_count(spark, sf):
    return text.word_count(inputs.lines(spark, sf))


@query
def letter_count(spark, sf):
    return text.letter_count(inputs.lines(spark, sf))


@query
def value_subtract(spark, sf):
    """Rows by value that a part of the table doesn't have; duplicates stay."""
    items = parquet(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    few = parquet(spark, sf, "lineitem").where("l_quantity > 49").select("l_suppkey", "l_linenumber", "l_returnflag")
    return recommend.subtract(items, few)


@query
def bag_union_distinct(spark, sf):
    customers = parquet(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    suppliers = parquet(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return customers.unionByName(suppliers).agg(F.count("*").alias("n_rows"), F.count_distinct("nation").alias("n_nations"))


@query
def join_aggregate(spark, sf):
    """Order values by nation: equi-joins, a pre-aggregated sum and a sort."""
    orders = parquet(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    customers = parquet(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = parquet(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("total"), 2).alias("total")).orderBy("n_name")


@query
def top_orders(spark, sf):
    orders = parquet(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(10)


@query
def anti_and_semi(spark, sf):
    """Customers with and without orders."""
    customers, orders = parquet(spark, sf, "customer").select("c_custkey"), parquet(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    have = customers.join(orders, "c_custkey", "left_semi").agg(F.count("*").alias("n")).withColumn("kind", F.lit("with"))
    lack = customers.join(orders, "c_custkey", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit("without"))
    return have.unionByName(lack)


@query
def bernoulli_split(spark, sf):
    train, test = recommend.sample_split(inputs.ratings(spark, sf))
    return train.agg(F.count("*").alias("n")).withColumn("part", F.lit("train")).unionByName(test.agg(F.count("*").alias("n")).withColumn("part", F.lit("test")))


@query
def ratings_split_train(spark, sf):
    return recommend.hash_split(inputs.ratings(spark, sf))[0]


@query
def ratings_split_test(spark, sf):
    return recommend.hash_split(inputs.ratings(spark, sf))[1]


@query
def cf_similarity(spark, sf):
    train, _ = recommend.hash_split(inputs.ratings(spark, sf))
    return recommend.item_similarity(train).select("i", "j", F.round("cosine", 6).alias("cosine"))


@query
def cf_predict(spark, sf):
    train, test = recommend.hash_split(inputs.ratings(spark, sf))
    near = recommend.predictions(train, test.withColumnRenamed("rating", "truth"), (10,))
    return near.where("w10 <> 0").select("user", "item", F.round(F.col("s10") / F.col("w10"), 5).alias("prediction"))


@query
def cf_rmse_sweep(spark, sf):
    train, test = recommend.hash_split(inputs.ratings(spark, sf))
    return recommend.cf_sweep(train, test).select("k", F.round("rmse", 5).alias("rmse"))


@query
def als_rmse(spark, sf):
    train, test = recommend.hash_split(inputs.ratings(spark, sf))
    return recommend.rmse(recommend.als(train, 5, 5, 0.1).transform(test))


@query
def als_rmse_sweep(spark, sf):
    """All 54 fits of the operator's defaults."""
    train, test = recommend.hash_split(inputs.ratings(spark, sf))
    return recommend.als_sweep(train, test)


def _sets(spark, sf):
    return itemsets.apriori(inputs.baskets(spark, sf), SUPPORT)


@query
def apriori_counts(spark, sf):
    return itemsets.set_counts(_sets(spark, sf))


@query
def frequent_pairs(spark, sf):
    return _sets(spark, sf)["L2"].select(F.array_join("items", ",").alias("items"), "n")


@query
def frequent_triples(spark, sf):
    return _sets(spark, sf)["L3"].select(F.array_join("items", ",").alias("items"), "n")


@query
def assoc_rules(spark, sf):
    found = itemsets.ranked(itemsets.rules(_sets(spark, sf), CONFIDENCE))
    return found.select(F.array_join("body", ",").alias("body"), "head", F.round("confidence", 6).alias("confidence"))


@query
def assoc_rule_lines(spark, sf):
    return itemsets.rule_text(itemsets.ranked(itemsets.rules(_sets(spark, sf), CONFIDENCE)))


@query
def fpgrowth_itemsets(spark, sf):
    model = itemsets.fp_growth(inputs.baskets(spark, sf), SUPPORT, CONFIDENCE)
    return itemsets.fp_itemsets(model).select(F.array_join("items", ",").alias("items"), "freq")


@query
def fp_rules(spark, sf):
    model = itemsets.fp_growth(inputs.baskets(spark, sf), SUPPORT, CONFIDENCE)
    return itemsets.fp_rules(model, CONFIDENCE).select(F.array_join("body", ",").alias("body"), "head", F.round("confidence", 6).alias("confidence"))


def _docs(spark, sf):
    return parquet(spark, sf, "documents").select("doc_id", "text")


@query
def minhash_signatures(spark, sf):
    """Each document's minimum under each of 300 hash functions."""
    return similarity.signed_sets(_docs(spark, sf), hashes=HASHES).select("doc_id", F.posexplode("signature").alias("i", "low")).withColumn("low", F.col("low").cast("long"))


@query
def bounded_input(spark, sf):
    """The first thousand documents."""
    return similarity.first_documents(_docs(spark, sf), 1000).select("doc_id", F.length("text").alias("n"))


@query
def lsh_recall(spark, sf):
    """The share of the truly similar pairs that 20 bands find."""
    return similarity.recalls(similarity.signed_sets(_docs(spark, sf), hashes=HASHES), [20]).select(F.round("recall", 6).alias("recall"))


@query
def band_sweep(spark, sf):
    """Recall at 20 to 50 bands."""
    found = similarity.recalls(similarity.signed_sets(_docs(spark, sf), hashes=HASHES), range(20, 51, 5))
    return found.select("bands", F.round(F.coalesce("recall", F.lit(0.0)), 6).alias("recall"))


@query
def lsh_pairs(spark, sf):
    return similarity.similar_pairs(_docs(spark, sf)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query
def minhash_error(spark, sf):
    """How far MinHash estimates are from exact similarities, over the candidate pairs."""
    return similarity.candidate_error(similarity.signed_sets(_docs(spark, sf), hashes=HASHES), 30).select(F.round("rmse", 6).alias("rmse"))


@query
def friend_recs(spark, sf):
    got = social.recommendations(inputs.adjacency(spark, sf))
    return got.select("user", F.array_join(F.col("recommended").cast("array<string>"), ",").alias("recommended"))


@query
def friend_lines(spark, sf):
    return social.as_lines(social.recommendations(inputs.adjacency(spark, sf)))


def _ranks(spark, sf, **how):
    edges = inputs.edges(spark, sf)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graph.pagerank(edges, nodes, **how)


@query
def pagerank_ranks(spark, sf):
    return _ranks(spark, sf, rounds=ROUNDS).select("node", F.round("rank", 6).alias("rank"))


@query
def pagerank_top10(spark, sf):
    """Until the total change is below 0.01."""
    return graph.top_ranked(_ranks(spark, sf, epsilon=0.01)).select("node", F.round("rank", 2).alias("rank"))


def _streamed(stream: DataFrame, *keys: str) -> DataFrame:
    return streams.run_to_end(stream, uuid.uuid4().hex, keys)


@query
def stream_tumbling(spark, sf):
    return _streamed(streams.tumbling_counts(inputs.word_stream(spark, sf), "10 minutes"), "window_start", "word").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "word", "count")


@query
def stream_sliding(spark, sf):
    return _streamed(streams.sliding_counts(inputs.word_stream(spark, sf), "60 minutes", "10 minutes"), "window_start", "word").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "word", "count")


@query
def stream_top_words(spark, sf):
    counts = _streamed(streams.tumbling_counts(inputs.word_stream(spark, sf), "6 hours"), "window_start", "word")
    return streams.top_of_windows(counts, 2).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "word", "count", "rn")


def _hours(df: DataFrame, first: DataFrame | None = None) -> DataFrame:
    return df.select("word", (F.floor(F.unix_timestamp("ts") / 3600)).alias("hour"))


@query
def stream_edw(spark, sf):
    """Each word's decaying count after the last hour, kept as state of a stream."""
    hours = inputs.words(spark, sf).agg(F.min(F.floor(F.unix_timestamp("ts") / 3600)).alias("a"), F.max(F.floor(F.unix_timestamp("ts") / 3600)).alias("b")).first()
    counted = inputs.word_stream(spark, sf).select("word", (F.floor(F.unix_timestamp("ts") / 3600) - F.lit(hours["a"])).cast("long").alias("batch"), F.lit(1).alias("n"))
    states = _streamed(streams.decaying_state(counted), "word", "batch")
    last = states.groupBy("word").agg(F.max(F.struct("batch", "value")).alias("s"))
    gap = F.lit(hours["b"] - hours["a"]) - F.col("s.batch")
    value = F.col("s.value") * F.pow(F.lit(0.9), gap.cast("double"))
    return last.select("word", F.round(value, 6).alias("value")).where(F.col("value") >= 1)


@query
def edw_replay(spark, sf):
    hourly = inputs.words(spark, sf).groupBy("word", F.floor(F.unix_timestamp("ts") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    ends = hourly.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).first()
    batches = hourly.select("word", (F.col("hour") - F.lit(ends["a"])).cast("long").alias("batch"), "n")
    return streams.decayed_totals(batches, int(ends["b"] - ends["a"])).select("word", F.round("value", 6).alias("value"))


@query
def zscore(spark, sf):
    got = linalg.zscore(inputs.measures(spark, sf), inputs.MEASURES, ("l_orderkey", "l_linenumber"))
    return got.select("l_orderkey", "l_linenumber", *(F.round(c, 5).alias(c) for c in inputs.MEASURES))


@query
def gram_matrix(spark, sf):
    """Sums of decimals, so that no order of adding them shows in the rounded result."""
    exact = inputs.measures(spark, sf).select(*(F.col(c).cast("decimal(18,5)").alias(c) for c in inputs.MEASURES))
    return linalg.gram_matrix(exact, inputs.MEASURES).select("i", "j", F.round(F.col("value").cast("decimal(38,10)"), 3).cast("double").alias("value"))


@query
def covariance(spark, sf):
    return linalg.covariance(inputs.measures(spark, sf), inputs.MEASURES).select("i", "j", F.round("value", 6).alias("value"))


@query
def svd_v(spark, sf):
    got = linalg.svd_v(linalg.zscore(inputs.measures(spark, sf), inputs.MEASURES), inputs.MEASURES)
    return got.select("component", "column", F.round("value", 5).alias("value"), F.round("singular", 4).alias("singular"))


@query
def pca_pc(spark, sf):
    got = linalg.principal_components(linalg.zscore(inputs.measures(spark, sf), inputs.MEASURES), inputs.MEASURES)
    return got.select("component", "column", F.round("value", 5).alias("value"))


@query
def standardized_vectors(spark, sf):
    """The library's scaler on embeddings, a row for each entry."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = parquet(spark, sf, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return linalg.standardize(rows).select("vec_id", F.posexplode(vector_to_array("scaled")).alias("d", "x")).select("vec_id", "d", F.round("x", 5).alias("scaled"))


@query
def kmeans_cost_sweep(spark, sf):
    """Sizes 2 to 20 and both ways to begin."""
    return cluster.cost_sweep(cluster.as_vectors(parquet(spark, sf, "embeddings"), "embedding"))


@query
def cost_given_centroids(spark, sf):
    """The cost of the means of each label."""
    points = parquet(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    each = points.select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    means = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("v"))
    return cluster.cost(points, means).select(F.round("cost", 5).alias("cost"))


def _text_lines(table: DataFrame, *columns, sep: str = " ") -> DataFrame:
    """A table's rows as the lines of a text file."""
    return table.select(F.concat_ws(sep, *columns).alias("value"))


@query
def parsed_ratings(spark, sf):
    """Ratings by way of their lines, with ids counted from 0."""
    text_rows = _text_lines(inputs.ratings(spark, sf), "user", "item", "rating", sep="\t ")
    return files.zero_based(files.ratings(text_rows))


@query
def parsed_vectors(spark, sf):
    """Measures by way of lines with spaces and with commas, summed up by column."""
    orders = parquet(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    spaced = files.space_vectors(_text_lines(orders, *orders.columns)).select(F.lit("space").alias("kind"), F.posexplode("features").alias("d", "x"))
    commas = files.csv_vectors(_text_lines(orders, *orders.columns, sep=",")).select(F.lit("comma").alias("kind"), F.posexplode("features").alias("d", "x"))
    exact = F.sum(F.col("x").cast("decimal(18,5)")).cast("double")
    return spaced.unionByName(commas).groupBy("kind", "d").agg(F.count("*").alias("n"), exact.alias("total"))


@query
def parsed_baskets(spark, sf):
    """Orders' brands by way of lines of words: how many baskets have how many distinct words."""
    lines = _text_lines(inputs.baskets(spark, sf), F.array_join("items", "  "))
    return files.baskets(lines).groupBy(F.size("items").alias("words")).agg(F.count("*").alias("n"))


@query
def parsed_adjacency(spark, sf):
    """Friends by way of their lines."""
    rows = inputs.adjacency(spark, sf).select("user", F.array_join(F.array_sort(F.col("friends")).cast("array<string>"), ",").alias("friends"))
    got = files.adjacency(_text_lines(rows, "user", "friends", sep="\t"))
    return got.select("user", F.size("friends").alias("n"), F.array_join(F.array_sort("friends").cast("array<string>"), ",").alias("friends"))


@query
def parsed_texts(spark, sf):
    """One-line texts by way of quoted lines."""
    rows = parquet(spark, sf, "nation").select(F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('","'), F.col("n_name"), F.lit('"')).alias("value"))
    return files.quoted_texts(rows)
