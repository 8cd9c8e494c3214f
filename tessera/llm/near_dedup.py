"""Near-duplicate detection with SetSketch registers.

Each document's set of word shingles is summed up in registers that hold exponentially spaced,
truncated minima: register i is ``floor(1 - log_b(h_i))``, clamped to 0..q+1, of the least value
h_i that an exponentially distributed hash takes over the set. Sketches of a union are the
register-wise maxima, and equal registers mark similar sets, so runs of registers serve as bands.

Documents with equal sets are one class from the start. Classes that share a band are candidates:

1. Each band bucket picks its least document as hub. All members are held against it on full
   shingle sets, which gives links and each member's exact similarity to the hub.
2. Where a bucket still holds several components, all pairs of members of different components
   are tried that can be similar: by size, and as Jaccard distance is a
   metric, by how far their distances to the hub differ. A pair is tried in the
   first band that it shares. Large buckets verify inside the join, which then yields links only.

In small buckets a pair's similarity is first estimated from both sketches by maximum
likelihood, and only pairs well below the threshold are left out. Links always rest on full
sets. Buckets have no cap; groups of thousands of copies cost rows about in their number.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, map_texts, write_table

#: Registers of a sketch, in bands of so many; base and truncation of the register values.
BANDS, ROWS = 24, 5
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: Larger buckets are compared block against block, in blocks of about so many; the rest list their pairs.
LARGE, BLOCK = 128, 512
#: Pairs of one hub that share a copy of its set, about.
HUB = 256
#: An estimate so far below the threshold leaves a pair out: over four standard deviations.
MARGIN = 0.15

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20250101)
_A = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str, k: int, words: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``k``-word shingles; fewer words count as one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII white space and case only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def registers(items: np.ndarray) -> np.ndarray:
    """The SetSketch of a non-empty set of 64-bit hashes."""
    low = np.full(len(_A), np.iinfo(np.uint32).max, np.uint32)
    x = (items >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * _A
        part += _B
        np.minimum(low, part.min(axis=0), out=low)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def joint_similarity(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarities of pairs of sets of known sizes, from both sketches.

    With ``d`` registers below, equal and above, the likelihood is the trinomial one in which a
    register of one set exceeds the other's with probability p_b(u - v J); it is maximised over
    a grid and then refined.
    """
    below, above = (first < second).sum(1)[:, None], (first > second).sum(1)[:, None]
    equal = first.shape[1] - below - above
    u = (n_first / (n_first + n_second))[:, None]
    v = 1 - u

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(3):
        grid = lo + (hi - lo) * np.linspace(0, 1, 41)
        up, down = p(np.maximum(u - v * grid, 0)), p(np.maximum(v - u * grid, 0))
        like = above * np.log(np.maximum(up, 1e-12)) + below * np.log(np.maximum(down, 1e-12)) + equal * np.log(np.maximum(1 - up - down, 1e-12))
        at, every = like.argmax(1), np.arange(len(grid))
        lo, hi = grid[every, np.maximum(at - 1, 0)][:, None], grid[every, np.minimum(at + 1, 40)][:, None]
    return ((lo + hi) / 2)[:, 0]


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, the registers and the band keys."""

    def make():
        words = _Words()

        def fn(texts: list[str]) -> dict:
            n, h1, h2, regs, keys = [], [], [], [], []
            for text in texts:
                s = shingle_set(text, k, words)
                n.append(len(s))
                if not len(s):
                    h1.append(None), h2.append(None), regs.append(None), keys.append(None)
                    continue
                raw = s.tobytes()
                h1.append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64)))
                h2.append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(raw, seed=7)).astype(np.int64)))
                r = registers(s).reshape(BANDS, ROWS)
                regs.append(r.tobytes())
                keys.append([np.uint64(xxhash.xxh3_64_intdigest(row.tobytes(), seed=b)).astype(np.int64) for b, row in enumerate(r)])
            return {"n_shingles": n, "h1": h1, "h2": h2, "registers": regs, "bands": keys}

        return fn

    return map_texts(docs, "doc_id long, n_shingles long, h1 long, h2 long, registers binary, bands array<long>", make)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and its sorted shingle hashes."""

    def make():
        words = _Words()
        return lambda texts: {"shingles": [shingle_set(t, k, words).astype(np.int64) for t in texts]}

    return map_texts(docs, "doc_id long, shingles array<long>", make)


def components(edges: DataFrame) -> DataFrame:
    """node and its component (the least node reachable), for the nodes that edges (a, b) touch.

    Large-star and small-star steps alternate; each keeps the edges about as many as they were,
    and each node's neighbours are reduced by minima that combine before the shuffle. Rounds go on
    until every edge ends at its component's least node, which comes after about log n of them.
    """
    now = write_table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node keeps its smaller neighbours; they and it are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = write_table(small.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
        # done when every edge is a star: one edge up from each node, and none through it
        ends = new.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(new.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
        drop_tables(now)
        now = new
        if not ends.where("up > 1 or up = 1 and low = 1").limit(1).count():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule a link out."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(np.int32) for c in ("registers", "registers_b"))
                j = joint_similarity(x, y, batch.column("n").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float))
                yield batch.select(["a", "b"]).filter(pa.array(j >= percent / 100 - MARGIN))

    both = pairs.join(sketches.withColumnRenamed("doc", "a"), "a").join(sketches.select(F.col("doc").alias("b"), F.col("registers").alias("registers_b"), F.col("n").alias("n_b")), "b")
    return both.select("a", "b", "registers", "registers_b", "n", "n_b").mapInArrow(run, "a long, b long")


def _block_links(percent: int):
    """The links between members of two blocks of a bucket, tried as in the join of small buckets."""

    def run(key, t):
        band, x, y = key[0].as_py(), key[2].as_py(), key[3].as_py()
        doc, comp, n, block = (t.column(c).to_numpy() for c in ("doc", "comp", "n", "block"))
        j = t.column("j").to_numpy(zero_copy_only=False).astype(float) if t.num_rows else np.empty(0)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(t.num_rows, -1).astype(np.int32)
        shingles = t.column("shingles").combine_chunks()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        out_a, out_b = [], []
        for i in range(0, len(left), 64):
            part = left[i : i + 64]
            ok = comp[part][:, None] != comp[right]
            ok &= 100 * np.minimum(n[part][:, None], n[right]) >= percent * np.maximum(n[part][:, None], n[right])
            ok &= ~(np.abs(j[part][:, None] - j[right]) > 1 - percent / 100 + 1e-9)
            ok &= doc[part][:, None] > doc[right] if x == y else doc[part][:, None] != doc[right]
            for b in range(band):
                ok &= bands[part, b][:, None] != bands[right, b]
            p, q = np.nonzero(ok)
            p, q = part[p], right[q]
            for s in range(0, len(p), 4096):
                u, v = p[s : s + 4096], q[s : s + 4096]
                like = joint_similarity(regs[u], regs[v], n[u].astype(float), n[v].astype(float)) >= percent / 100 - MARGIN
                for a, b in zip(u[like].tolist(), v[like].tolist(), strict=True):
                    both = len(np.intersect1d(shingles[a].values.to_numpy(), shingles[b].values.to_numpy(), assume_unique=True))
                    if 100 * both >= percent * (n[a] + n[b] - both):
                        out_a.append(max(doc[a], doc[b])), out_b.append(min(doc[a], doc[b]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _held(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs with their intersection ``both`` and the sizes ``n`` and ``n_b`` of the full sets.

    A document in many pairs is ``b`` (a hub); its set goes out in a copy for each HUB pairs or so,
    over which they are dealt, so no task has all members of a large group.
    """
    many = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / HUB).cast("int").alias("copies"))
    dealt = pairs.join(many, pairs["b"] == many["hub"]).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).select("a", "b", "salt")
    hubs = many.join(full, many["hub"] == full["doc"]).select("hub", F.col("shingles").alias("shingles_b"), F.col("n").alias("n_b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    side = dealt.join(full.withColumnRenamed("doc", "a"), "a")
    side = side.join(hubs, (side["b"] == hubs["hub"]) & (side["salt"] == hubs["copy"]))
    return side.select("a", "b", "n", "n_b", F.size(F.array_intersect("shingles", "shingles_b")).cast("long").alias("both"))


def _labelled(members: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return members.withColumn("comp", F.col("doc"))
    joined = members.join(found, members["doc"] == found["node"], "left").withColumn("comp", F.coalesce("component", "doc"))
    return write_table(joined.drop("node", "component"), "labels")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of
    distinct ``k``-word shingles. Null, empty and blank texts have an empty set and no links;
    the component of a document is the smallest doc_id reachable. Rows with the same doc_id are
    one document that has each row's links; rows without doc_id stay single and are kept. Ties don't
    arise: of documents alike the least doc_id stands for all. Long texts are read whole; an empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    linked = 100 * F.col("both") >= percent * (F.col("n") + F.col("n_b") - F.col("both"))
    sketched = write_table(sketch_documents(docs, k), "sketches")
    sets = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = write_table(sets.groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min(F.struct("doc_id", "registers", "bands")).alias("x")).select("h1", "h2", "n", F.col("x.doc_id").alias("doc"), "x.registers", "x.bands"), "classes")
    rows = classes.select("doc", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    members = write_table(rows.join(shared, ["band", "key"]), "members")
    texts = docs.select("doc_id", "text").join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    full = write_table(shingle_sets(texts, k).select(F.col("doc_id").alias("doc"), "shingles", F.size("shingles").cast("long").alias("n")).where("n > 0"), "sets")
    sketches = classes.select("doc", "registers", "n")

    hubs = members.groupBy("band", "key").agg(F.min("doc").alias("hub"))
    first = members.join(hubs, ["band", "key"]).where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    first = write_table(_held(first, full), "held")
    found = components(first.where(linked).select("a", "b"))
    tried = first.select("a", "b")
    now = _labelled(members, found)
    mixed = now.groupBy("band", "key").agg(F.min("doc").alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "key", "hub", "size")
    to_hub = first.select(F.col("a").alias("doc"), F.col("b").alias("hub"), (F.col("both") / (F.col("n") + F.col("n_b") - F.col("both"))).alias("j")).groupBy("doc", "hub").agg(F.max("j").alias("j"), F.count("*").alias("texts"))
    side = now.join(mixed, ["band", "key"]).join(to_hub, ["doc", "hub"], "left").join(classes.select("doc", "n", "bands"), "doc")
    side = side.withColumn("j", F.when(F.col("doc") == F.col("hub"), 1.0).when(F.col("texts") == 1, F.col("j"))).drop("hub", "texts")
    side = write_table(side, "left")

    small = side.where(F.col("size") <= LARGE)
    other = small.select(*(F.col(c).alias(f"{c}_b") for c in small.columns))
    near = (
        (F.col("band") == F.col("band_b"))
        & (F.col("key") == F.col("key_b"))
        & (F.col("doc") > F.col("doc_b"))
        & (F.col("comp") != F.col("comp_b"))
        & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
        & F.coalesce(F.abs(F.col("j") - F.col("j_b")) <= 1 - percent / 100 + 1e-9, F.lit(True))
        & (F.array_position(F.zip_with("bands", "bands_b", lambda x, y: x == y), True) == F.col("band") + 1)
    )
    pairs = small.join(other, near).select(F.col("doc").alias("a"), F.col("doc_b").alias("b")).join(tried, ["a", "b"], "left_anti")
    links = _held(_likely(write_table(pairs, "pairs"), sketches, percent), full).where(linked).select("a", "b")

    large = side.where(F.col("size") > LARGE).join(full.select("doc", "shingles"), "doc").join(sketches.select("doc", "registers"), "doc")
    large = large.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.withColumn("x", F.least("block", "with")).withColumn("y", F.greatest("block", "with"))
    sure = large.groupBy("band", "key", "x", "y").applyInArrow(_block_links(percent), "a long, b long")
    links = write_table(links.unionByName(sure), "links")

    # rows with equal sets and rows of one doc_id belong together
    equal = sets.join(classes.select("h1", "h2", F.col("n").alias("n_shingles"), "doc"), ["h1", "h2", "n_shingles"]).where("doc <> doc_id").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links).unionByName(equal))
    out = sketched.select("doc_id", "n_shingles").join(found, sketched["doc_id"] == found["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
