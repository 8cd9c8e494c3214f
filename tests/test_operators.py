"""Hand-sized cases with known results."""

import datetime
import math
import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, graph, itemsets, linalg, recommend, similarity, social, text
from tessera import persist
from tessera.sources import files, plot
from tessera.streaming import simulator
from tessera.streaming import words as streams


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_tokens_and_letters(spark):
    df = lines(spark, "", "---", " foo bar ", "foo--bar", "Étion x")
    got = {r["word"]: r["count"] for r in text.word_count(df).collect()}
    assert got == {"": 3, "foo": 2, "bar": 2, "tion": 1, "x": 1}
    assert {r["letter"]: r["count"] for r in text.letter_count(df).collect()} == {"F": 2, "B": 2, "T": 1, "X": 1}
    assert text.line_count(df).first()[0] == 5


def test_lines_of_texts(spark):
    df = spark.createDataFrame([("a\nb\r\nc\n",), ("",), (None,)], "text string")
    assert [r[0] for r in text.lines_of(df).collect()] == ["a", "b", "c", ""]


def test_parsers(spark):
    assert files.space_vectors(lines(spark, "1 2.5")).first()[0] == [1.0, 2.5]
    assert files.csv_vectors(lines(spark, "1,2.5"), True).first()[0].toArray().tolist() == [1.0, 2.5]
    assert tuple(files.ratings(lines(spark, "1\t2  3 99")).first()) == (1, 2, 3.0)
    assert tuple(files.zero_based(files.ratings(lines(spark, "1 2 3"))).first()) == (0, 1, 3.0)
    assert files.baskets(lines(spark, "a b a ")).first()["items"] == ["a", "b"]
    assert tuple(files.quoted_texts(lines(spark, '"7","ab, cd"')).first()) == (7, "ab, cd")
    got = {r["user"]: r["friends"] for r in files.adjacency(lines(spark, "1\t2,3,2", "4", "5\t")).collect()}
    assert got == {1: [2, 3], 4: [], 5: []}


def test_sinks(spark, tmp_path):
    files.write_pairs(spark.createDataFrame([("a", 1)], "w string, n int"), str(tmp_path / "p"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "p")).collect()] == ["(a,1)"]
    with pytest.raises(Exception):
        files.write_pairs(spark.createDataFrame([("a", 1)], "w string, n int"), str(tmp_path / "p"))
    files.write_report(spark.createDataFrame([(2, 1.5)], "k int, c double"), str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["2 1.5"]
    (tmp_path / "e").write_text("1\t2\n1\t2\n2\t3\n")
    assert files.edge_list(spark, str(tmp_path / "e")).count() == 2


def test_subtract_by_value(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (2,), (None,)], "x int")
    right = spark.createDataFrame([(2,), (None,)], "x int")
    assert [r[0] for r in recommend.subtract(left, right).collect()] == [1, 1]
    train, test = recommend.sample_split(spark.range(1000).toDF("x"))
    assert train.count() + test.count() == 1000 and 700 < train.count() < 900


def test_shingles(spark):
    df = spark.createDataFrame([(7, "abcd"), (8, "abcab"), (9, ""), (10, None)], "doc_id int, text string")
    got = {}
    for r in similarity.document_shingles(df).collect():
        got.setdefault(r[0], set()).add(r[1])
    assert got == {7: {"abc", "bcd", "cd", "d"}, 8: {"abc", "bca", "cab", "ab", "b"}}


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef ") for _ in range(120)) for _ in range(5)]
    docs = [(i, base[i % 5][: 120 - i // 5] + "xyz"[: i // 5 % 3]) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    sh = {i: {t[j : j + 3] for j in range(len(t))} for i, t in docs}
    often = {s for v in sh.values() for s in v if sum(s in w for w in sh.values()) > 1}
    want = {(a, b) for a in sh for b in sh if a < b and len(sh[a] & sh[b] & often) / len((sh[a] | sh[b]) & often) >= 0.8}
    assert {(r[0], r[1]) for r in similarity.similar_pairs(df).collect()} == want


APRIORI = [(0, list("abc")), (1, list("abc")), (2, list("ab")), (3, list("ad")), (4, list("bc"))]


def test_apriori_and_rules(spark):
    found = itemsets.apriori(spark.createDataFrame(APRIORI, "basket_id int, items array<string>"), 0.4)
    assert {r[0]: r[1] for r in itemsets.set_counts(found).collect()} == {"C1": 4, "L1": 3, "C2": 3, "L2": 3, "C3": 1, "L3": 1}
    assert {tuple(r["items"]): r["support"] for r in found["L2"].collect()} == {("a", "b"): 0.6, ("a", "c"): 0.4, ("b", "c"): 0.6}
    rules = itemsets.ranked(itemsets.rules(found, 0.8))
    assert [(r["body"], r["head"], r["confidence"]) for r in rules.collect()] == [(["a", "c"], "b", 1.0), (["c"], "b", 1.0)]
    assert [r[0] for r in itemsets.rule_text(rules).collect()] == ["[a, c] -> [b] (Confidence: 1.0)", "[c] -> [b] (Confidence: 1.0)"]


def test_apriori_within_fp_growth(spark):
    baskets = spark.createDataFrame(APRIORI, "basket_id int, items array<string>")
    fp = {tuple(r["items"]) for r in itemsets.fp_itemsets(itemsets.fp_growth(baskets, 0.4, 0.8)).collect()}
    own = itemsets.apriori(baskets, 0.4)
    assert {tuple(r["items"]) for k in ("L2", "L3") for r in own[k].collect()} == fp


def test_friends(spark):
    rows = lines(spark, "0\t1,2", "1\t0,2,3", "2\t0,1", "3\t1,4", "4\t3", "5", "6\t7", "7\t6")
    adjacency = files.adjacency(rows)
    got = [r[0] for r in social.as_lines(social.recommendations(adjacency)).collect()]
    assert got == ["0\t3", "1\t4", "2\t3", "3\t0,2", "4\t1", "5\t"]
    assert {r[0] for r in social.recommendations(adjacency, include_all=True).collect()} == set(range(8))


@pytest.mark.parametrize("eps,want", [(1.0, [1.0, 0.68, 1.32, 1.0]), (0.01, [0.935734, 0.760486, 1.368046, 0.935734])])
def test_pagerank_with_sink(spark, eps, want):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (1, 2)], "src long, dst long")
    ranks = {r[0]: r[1] for r in graph.pagerank(edges, graph.node_range(spark, 4), epsilon=eps).collect()}
    assert [ranks[i] for i in range(1, 5)] == pytest.approx(want, abs=1e-6)
    assert sum(ranks.values()) == pytest.approx(4)


CF = [(0, 0, 5.0), (0, 1, 3.0), (1, 0, 4.0), (1, 1, 2.0), (1, 2, 1.0), (2, 1, 4.0), (2, 2, 5.0)]


def test_collaborative_filtering(spark):
    train = spark.createDataFrame(CF, "user int, item int, rating double")
    sim = recommend.item_similarity(train)
    assert {(r[0], r[1]): round(r[2], 6) for r in sim.collect()} == {(0, 1): 0.667017, (0, 2): 0.122513, (1, 2): 0.801193}
    every = spark.createDataFrame([(u, i) for u in range(3) for i in range(3)], "user int, item int")
    near = recommend.neighbours(train, sim, every, 2)
    for k, want in ((1, [3, 5, 3, 2, 1, 2, 4, 5, 4]), (2, [3, 5, 3.265264, 1.844828, 2.362919, 2.265264, 4.155172, 5, 4])):
        got = {(r[0], r[1]): r[2] for r in recommend.predict(near, k).collect()}
        assert [got[u, i] for u in range(3) for i in range(3)] == pytest.approx(want, abs=1e-6)


def test_als_and_rmse(spark):
    train = spark.createDataFrame(CF, "user int, item int, rating double")
    got = recommend.als_sweep(train, train, (2,), (0.1,), (5,)).first()
    assert got["rmse"] < 1.0
    p = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "rating double, prediction double")
    assert recommend.rmse(p).first()[0] == pytest.approx(math.sqrt(0.5))


COUNTS = [3, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 2]
VALUES = [3, 2.7, 2.43, 3.187, 2.8683, 2.58147, 2.323323, 2.090991, 1.881892, 1.693702, 1.524332, 3.371899]


def test_decaying_window(spark):
    batches = spark.createDataFrame([("w", i, n) for i, n in enumerate(COUNTS) if n] + [("x", 0, 1)], "word string, batch long, n long")
    for last in (0, 3, 10, 11):
        upto = batches.where(F.col("batch") <= last)
        got = {r[0]: r[1] for r in streams.decayed_totals(upto, last).collect()}
        assert got["w"] == pytest.approx(VALUES[last], abs=1e-6)
        assert ("x" in got) == (last == 0)


def test_stream_equals_replay(spark, tmp_path):
    rows = spark.createDataFrame([("w", i, n) for i, n in enumerate(COUNTS) if n], "word string, batch long, n long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))  # batches come in order
    stream = streams.file_words(spark, str(tmp_path / "in"), "word string, batch long, n long")
    got = streams.run_to_end(streams.decaying_state(stream), "edw_test", ["word", "batch"], str(tmp_path / "cp")).where("batch = 11").first()
    assert got["value"] == pytest.approx(VALUES[-1], abs=1e-6)


def minutes(*words):
    return [(datetime.datetime(2024, 1, 1, 10, m), w) for m, w in words]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "ts timestamp, word string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    counts = lambda: {(r["window_start"].minute, r["word"]): r["count"] for r in streams.run_to_end(streams.tumbling_counts(streams.file_words(spark, folder, schema), "10 minutes"), "x", ["window_start", "word"], str(tmp_path / "cp")).collect()}
    write(minutes((1, "a"), (2, "a"), (11, "b")))
    assert counts() == {(0, "a"): 2, (10, "b"): 1}
    write(minutes((3, "a"), (12, "c")))
    assert counts() == {(0, "a"): 3, (10, "b"): 1, (10, "c"): 1}


def test_watermark_leaves_out_late_words(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "ts timestamp, word string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    for delay, want in (("5 minutes", 1), (None, 2)):
        stream = lambda: streams.sliding_counts(streams.file_words(spark, f"{folder}", schema), "10 minutes", "10 minutes", delay)  # noqa: E731, B023
        run = lambda: streams.run_to_end(stream(), "x", ["window_start", "word"], str(tmp_path / f"cp{delay}"))  # noqa: E731, B023
        if delay:
            write(minutes((1, "a"), (50, "b")))
        run()
        if delay:
            write(minutes((2, "a")))
        got = {(r["window_start"].minute, r["word"]): r["count"] for r in run().collect()}
        assert got == {(0, "a"): want, (50, "b"): 1}


def test_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = streams.tumbling_counts(streams.file_words(spark, str(tmp_path / "in"), "ts timestamp, word string"), "10 minutes")
    assert streams.run_to_end(stream, "x", ["window_start", "word"], str(tmp_path / "cp")).count() == 0


def test_socket_words_from_the_simulator(spark, tmp_path):
    (tmp_path / "words").write_text("a\nb\na\n")
    with socket.create_server(("localhost", 0)) as s:
        port = s.getsockname()[1]
    server = threading.Thread(target=simulator.serve, args=(str(tmp_path / "words"), port, 0.0), daemon=True)
    server.start()
    time.sleep(0.5)
    stream = streams.socket_words(spark, port=port)
    rows: list = []
    query = stream.writeStream.foreachBatch(lambda batch, _: rows.extend(r["word"] for r in batch.collect())).start()
    until = time.time() + 60
    while len(rows) < 3 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    server.join(10)
    assert rows == ["a", "b", "a"]


def test_each_batch_is_printed(spark, tmp_path, capfd):
    spark.createDataFrame(minutes((1, "much"), (2, "much"), (3, "little")), "ts timestamp, word string").write.parquet(str(tmp_path / "in"))
    counts = streams.file_words(spark, str(tmp_path / "in"), "ts timestamp, word string", files=100).groupBy("word").agg(F.count("*").alias("count"))
    query = streams.print_top(counts, 1, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    out = capfd.readouterr().out
    assert "much" in out and "little" not in out


def test_plots(tmp_path):
    assert plot.als_label("5_0.1.txt") == "lambda = 0.1" and plot.als_label("5_0.1") == "lambda = 0.1"
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            plot.plot_reports({"a": [(1, 2)]}, str(tmp_path / "p.png"), "x", "y")
    else:
        plot.plot_reports({"a": [(1, 2)]}, str(tmp_path / "p.png"), "x", "y")
        assert (tmp_path / "p.png").stat().st_size


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError):
        persist.shared_dir(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://x"}
    assert persist.shared_dir(Session) == "hdfs://x"


def test_svd_and_pca_agree(spark):
    rng = random.Random(1)
    rows = [(a, a * 0.5 + rng.random(), rng.random()) for a in (rng.random() for _ in range(60))]
    df = linalg.zscore(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    v = {(r[0], r[1]): r[2] for r in linalg.svd_v(df, ["a", "b", "c"]).collect()}
    pc = {(r[0], r[1]): r[2] for r in linalg.principal_components(df, ["a", "b", "c"]).collect()}
    assert v == pytest.approx(pc, abs=1e-6)
    u, s, _ = linalg.svd(df, ["a", "b", "c"])
    assert u.agg(F.sum(F.col("u0") * F.col("u0"))).first()[0] == pytest.approx(1)
    assert s[0] >= s[1]


def test_kmeans_cost(spark):
    points = spark.createDataFrame([(0, [0.0]), (1, [2.0]), (2, [10.0]), (3, [14.0])], "id int, v array<double>")
    model = cluster.kmeans(cluster.as_vectors(points, "v"), 2)
    assert model.summary.trainingCost == pytest.approx(10.0)
    centroids = spark.createDataFrame([([1.0],), ([12.0],)], "v array<double>")
    assert cluster.cost(points, centroids).first()[0] == pytest.approx(10.0)


def test_kmeans_sweep(spark):
    points = spark.createDataFrame([(float(i % 4 * 10 + i % 3),) for i in range(60)], "x double")
    got = {(r["init"], r["k"]): r["cost"] for r in cluster.cost_sweep(cluster.as_vectors(points.select(F.array("x").alias("v")), "v"), (2, 4)).collect()}
    assert set(got) == {(i, k) for i in ("k-means||", "random") for k in (2, 4)}
    assert got["k-means||", 4] == pytest.approx(40.0)  # four groups of 0, 1, 2, five times each
    assert all(got[i, 4] <= got[i, 2] for i in ("k-means||", "random"))


def test_cost_counts_points_that_share_an_id(spark):
    points = spark.createDataFrame([(1, [0.0]), (1, [4.0]), (None, [4.0])], "id long, v array<double>")
    centroids = spark.createDataFrame([([1.0],), (None,)], "v array<double>")
    assert cluster.cost(points, centroids).first()["cost"] == pytest.approx(19.0)


def test_exact_pairs_and_recall(spark):
    rng = random.Random(5)
    sets = {i: {rng.randrange(12) for _ in range(rng.randint(1, 9))} for i in range(60)}
    rows = spark.createDataFrame([(i, f"s{x}") for i, v in sets.items() for x in v], "doc_id long, shingle string")
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    truth = similarity.exact_pairs(rows)
    assert {tuple(r) for r in truth.collect()} == want
    some = truth.where("a % 2 = 0")
    assert similarity.recall(some, truth).first()[0] == pytest.approx(sum(a % 2 == 0 for a, _ in want) / len(want))
    signatures = similarity.minhash(similarity.numbered(rows), 100)
    swept = [r["recall"] for r in similarity.band_sweep(signatures, truth, (5, 20, 50)).collect()]
    assert swept == sorted(swept) and swept[-1] > 0.9
    assert similarity.first_documents(spark.range(9).toDF("doc_id"), 3).count() == 3


def test_cost_takes_all_centroids(spark):
    points = spark.createDataFrame([(1, [10_500.0]), (2, [3.0])], "id long, v array<double>")
    centroids = spark.range(10_501).select(F.array(F.col("id").cast("double")).alias("v"))
    assert cluster.cost(points, centroids).first()["cost"] == 0


def test_sweeps_are_registered_whole(monkeypatch):
    from tessera.plans import queries

    calls = []
    monkeypatch.setattr(queries.recommend, "als_sweep", lambda *a, **k: calls.append((len(a), k)))
    monkeypatch.setattr(queries.recommend, "hash_split", lambda *a: (None, None))
    monkeypatch.setattr(queries.cluster, "cost_sweep", lambda *a, **k: calls.append((len(a), k)))
    monkeypatch.setattr(queries.cluster, "as_vectors", lambda *a: None)
    monkeypatch.setattr(queries.inputs, "ratings", lambda *a: None)
    monkeypatch.setattr(queries, "parquet", lambda *a: None)
    queries.als_rmse_sweep(None, None)
    queries.kmeans_cost_sweep(None, None)
    assert calls == [(2, {}), (1, {})]


def test_predictions_by_blocks(spark, monkeypatch):
    """Blocks give what joins of neighbours give, and no step makes a row of each pair of ratings."""
    rng = random.Random(8)
    rows = [(u, i * 1_000_003 % 2**31, float(rng.randint(1, 5))) for u in range(40) for i in range(30) if rng.random() < 0.4]
    train, test = recommend.hash_split(spark.createDataFrame(rows + [(99, 7, 2.0), (98, 5, 3.0)], "user int, item int, rating double"))
    for most in (100, 16_000_000):
        monkeypatch.setattr(recommend, "MOST_IN_BLOCK", most)
        monkeypatch.setattr(recommend, "MOST_PRODUCTS", most)
        near = recommend.neighbours(train, recommend.item_similarity(train), test, 7)
        for k in (3, 7):
            want = {(r[0], r[1]): r[2] for r in recommend.predict(near, k).collect()}
            got = {(r["user"], r["item"]): r["s"] / r["w"] for r in recommend.predictions(train, test.withColumnRenamed("rating", "truth"), (3, 7)).select("user", "item", F.col(f"s{k}").alias("s"), F.col(f"w{k}").alias("w")).collect()}
            assert got == pytest.approx(want) and len(want) > 50
    plan = recommend.item_similarity(train)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "FlatMapGroupsInArrow" in plan
    empty = train.where("user < 0")
    assert recommend.item_similarity(empty).count() == 0 and recommend.predictions(empty, test.withColumnRenamed("rating", "truth"), (3,)).count() == 0


def test_kmeans_fits_run_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)
    fit = cluster.kmeans
    monkeypatch.setattr(cluster, "kmeans", lambda *a, **k: (both.wait(), fit(*a, **k))[1])
    points = cluster.as_vectors(spark.createDataFrame([([float(i % 7)],) for i in range(50)], "v array<double>"), "v")
    rows = cluster.cost_sweep(points, (2, 3)).collect()
    assert [(r["init"], r["k"]) for r in rows] == [("k-means||", 2), ("k-means||", 3), ("random", 2), ("random", 3)]
    assert all(r["cost"] == pytest.approx(fit(points, r["k"], init=r["init"]).summary.trainingCost) for r in rows)


def test_signed_sets_and_their_blocks(spark, monkeypatch):
    """Signatures, recall and error against brute force, in one block and in many; shingles are rows of no join."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abc é\U0001f600") for _ in range(60)) for _ in range(4)]
    docs = [(i, base[i % 4][: 60 - i // 8] + rng.choice(["", "xy", "z"]) + "abcd"[i % 4]) for i in range(40)] + [(3, "qrs"), (90, ""), (91, None), (92, "#")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    own: dict = {}
    for i, t in docs:
        own.setdefault(i, set()).update((t or "")[j : j + 3] for j in range(len(t or "")))
    sets = {i: {x for x in v if sum(x in w for w in own.values()) > 1} for i, v in own.items()}
    sets = {i: v for i, v in sets.items() if v}
    rows = spark.createDataFrame([(i, x) for i, v in sets.items() for x in v], "doc_id long, shingle string")
    signatures = {r[0]: r[1] for r in similarity.minhash(similarity.numbered(rows), 60).collect()}
    signed = similarity.signed_sets(df, 3, 60)
    assert "shingle" not in signed._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["signature"] for r in signed.collect()} == signatures
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    truth = [p for p, x in alike.items() if x >= 0.8]
    banded = lambda n: {(a, b) for a, b in alike if any(signatures[a][i * (60 // n) : (i + 1) * (60 // n)] == signatures[b][i * (60 // n) : (i + 1) * (60 // n)] for i in range(n))}
    met = banded(12)
    off = [alike[a, b] - sum(x == y for x, y in zip(signatures[a], signatures[b], strict=True)) / 60 for a, b in met]
    for most in (16_000_000, 400):
        monkeypatch.setattr(similarity, "MOST_IN_BLOCK", most)
        got = {r["bands"]: r["recall"] for r in similarity.recalls(signed, [6, 12]).collect()}
        assert got == pytest.approx({n: sum(p in banded(n) for p in truth) / len(truth) for n in (6, 12)})
        assert similarity.candidate_error(signed, 12).first()["rmse"] == pytest.approx((sum(x * x for x in off) / len(off)) ** 0.5)
        assert {(r["a"], r["b"]): r["jaccard"] for r in similarity.similar_pairs(df, 3, 60, 60).collect()} == pytest.approx({p: alike[p] for p in truth if p in banded(60)})
    long = {r["doc_id"]: len(r["set"]) for r in similarity.signed_sets(spark.createDataFrame([(1, "abcdef"), (2, "abcdeg")], "doc_id long, text string"), 5, 20).collect()}
    assert long == {1: 1, 2: 1}


def test_recommendations_against_brute_force(spark, monkeypatch):
    """One-sided lists, users without lists and users alike, in one block and in many."""
    rng = random.Random(4)
    lists = {u: {v for v in range(24) if v != u and rng.random() < 0.15} for u in range(20)}
    for u in (40, 41, 42):  # alike: on the same lists, and friends
        lists[u] = {40, 41, 42, 3, 5} - {u}
        for v in (3, 5):
            lists[v].add(u)
    lists[50] = set()
    rows = lines(spark, *(f"{u}\t{','.join(map(str, v))}" for u, v in lists.items()))
    n: dict = {}
    for v in lists.values():
        for a in v:
            for b in v:
                if a != b and b not in lists.get(a, ()) and a not in lists.get(b, ()):
                    n.setdefault(a, {}).setdefault(b, 0)
                    n[a][b] += 1
    want = {a: [b for b, _ in sorted(x.items(), key=lambda e: (-e[1], e[0]))][:4] for a, x in n.items()} | {u: [] for u, v in lists.items() if not v}
    for most in (16_000_000, 20):
        monkeypatch.setattr(social, "MOST_IN_BLOCK", most)
        got = social.recommendations(files.adjacency(rows), 4)
        assert {r[0]: r[1] for r in got.collect()} == want
    same = social._alike(files.adjacency(rows))[0].where("user >= 40 and user < 50").collect()
    assert {r["c"] for r in same} == {40}


def test_friends_are_no_rows(spark):
    from tessera.plans import inputs

    plan = inputs.adjacency(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "FlatMapGroupsInArrow" in plan


def test_fp_rules_mine_once(spark):
    """The model's own rules, from kept sets and kept baskets: no use of them mines or joins again."""
    rng = random.Random(2)
    rows = [(i, [x for x in "abcdef" if rng.random() < 0.6]) for i in range(80)]
    calls = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (calls.add(1), x)[1], "array<string>").asNondeterministic()
    baskets = spark.createDataFrame(rows, "basket_id int, items array<string>").withColumn("items", seen("items"))
    model = itemsets.fp_growth(baskets, 0.1, 0.5)
    want = {(tuple(sorted(r["antecedent"])), r["consequent"][0]): r["confidence"] for r in model.associationRules.collect()}
    found = itemsets.fp_rules(model, 0.5)
    assert {(tuple(r["body"]), r["head"]): r["confidence"] for r in found.collect()} == pytest.approx(want) and len(want) > 50
    assert calls.value == 80


def test_als_fits_run_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)
    fit = recommend.als
    train = spark.createDataFrame(CF, "user int, item int, rating double")
    want = [recommend.rmse(fit(train, 2, n, 0.1, 7).transform(train)).first()["rmse"] for n in (1, 4)]
    monkeypatch.setattr(recommend, "als", lambda *a, **k: (both.wait(), fit(*a, **k))[1])
    got = recommend.als_sweep(train, train, (2,), (0.1,), (1, 4)).collect()
    assert [r["iterations"] for r in got] == [1, 4] and [r["rmse"] for r in got] == pytest.approx(want)
