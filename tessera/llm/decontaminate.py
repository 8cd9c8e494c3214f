"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into word n-grams. Seeds are the rare ones: those that at most one document in a
thousand holds, and in any case the rarer half of each item, so that neither common words nor many
copies of an item leave it without. All documents are counted.

Seeds join training passages to items: a scan keeps the documents that hold an n-gram which passes
a Bloom filter of the items' n-grams, with its places; these are counted, and a join by seed gives the
pairs of a text and an item that share one. Verdicts depend on the text alone, so equal texts are
aligned once. A text and an item are aligned word by word, locally, around the places of the shared
seeds; the score is the share of the item that the best alignment covers, so exact, edited and
shortened copies are found.

The corpus is read once, whatever the size of the benchmark. The Bloom filter has a fixed size and is
all that is sent to every task; beyond its reach it lets more through, and results stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, map_texts, write_table

#: Words of a seed; the least score; a seed is rare if no more than one document in so many has it.
SEED, LEAST, RARE = 3, 0.5, 1000
#: Scores of a match, a mismatch and a gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items with fewer words than this are only matched whole.
SHORT = 8
#: Bits of a Bloom filter (as a power of 2), two of which each entry sets; cells aligned at once.
BLOOM, CELLS = 25, 1 << 20

_STRIP = bytes(32 if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_STRIP).split()


class _Ids(dict):
    """64-bit hashes of words."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = self[w] = xxhash.xxh3_64_intdigest(w)
        return found


def hashes(text: str, cache: dict) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
        out ^= out >> np.uint64(31)
    return out


def align(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Best local alignment scores of pairs of padded rows (0: no word), word by word."""
    n, width = texts.shape
    row = np.zeros((n, width + 1), np.int32)
    best = np.zeros(n, np.int32)
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    for i in range(items.shape[1]):
        w = items[:, i : i + 1]
        hit = np.where((texts == w) & (w != 0), MATCH, MISMATCH)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + hit, row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        # gaps along the text: the best start to the left, less its distance
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        row = np.where(w != 0, new, row)
        np.maximum(best, row.max(1), out=best)
    return best


def windows(offsets: Iterable[int], size: int, length: int) -> list[tuple[int, int]]:
    """Stretches of a text to align with an item of ``size`` words that may begin at ``offsets``."""
    out: list[tuple[int, int]] = []
    for off in sorted(offsets):
        begin, end = max(0, off - size // 2), min(length, off + size + size // 2)
        if out and begin <= out[-1][0] + size // 4:  # places of one copy share a window
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((begin, end))
    return out


def scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The share of the item that each (item, stretch of text) aligns, 0 to 1; about CELLS at once."""
    out = np.zeros(len(pairs))
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    at = 0
    while at < len(order):
        end, wide = at, 0
        while end < len(order) and (end == at or max(wide, len(pairs[order[end]][1])) * (end - at + 1) <= CELLS):
            wide = max(wide, len(pairs[order[end]][1]))
            end += 1
        part = order[at:end]
        a = np.zeros((len(part), max(len(pairs[t][0]) for t in part)), np.uint64)
        b = np.zeros((len(part), max(1, wide)), np.uint64)
        for r, t in enumerate(part):
            a[r, : len(pairs[t][0])], b[r, : len(pairs[t][1])] = pairs[t]
        out[part] = align(a, b) / np.array([MATCH * len(pairs[t][0]) for t in part])
        at = end
    return out


def _slots(values: np.ndarray) -> list[np.ndarray]:
    mixed = values.astype(np.uint64) * _MIX
    return [(mixed >> np.uint64(64 - BLOOM)).astype(np.int64), ((mixed ^ (mixed >> np.uint64(32))) & np.uint64((1 << BLOOM) - 1)).astype(np.int64)]


def bloom(df: DataFrame):
    """A broadcast Bloom filter of a column of longs, of a fixed size whatever their number."""

    def run(batches):
        bits = np.zeros(1 << BLOOM, bool)
        for b in batches:
            for at in _slots(b.column(0).to_numpy().view(np.uint64)):
                bits[at] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        for s in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[s : s + 50_000]), pa.array(words[at[s : s + 50_000]])], names=["at", "bits"])

    # the tasks' filters become one; at most 2^(BLOOM - 6) numbers reach the driver
    got = df.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (BLOOM - 6), np.int64)
    words[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return df.sparkSession.sparkContext.broadcast(words)


class Filter:
    def __init__(self, words: np.ndarray):
        self.bits = np.unpackbits(words.view(np.uint8)).view(bool)

    def passes(self, values: np.ndarray) -> np.ndarray:
        first, second = _slots(values)
        at = np.flatnonzero(self.bits[first])
        return at[self.bits[second[at]]]


def _item_table(benchmark: DataFrame) -> DataFrame:
    """item (a number of its own), item_id, words (hashes) and grams, in order."""

    def make():
        cache = _Ids()

        def fn(texts: list[str]) -> dict:
            words_ = [hashes(t, cache) for t in texts]
            return {"words": [h.view(np.int64) for h in words_], "grams": [ngrams(h, SEED).view(np.int64) for h in words_]}

        return fn

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return write_table(map_texts(rows, "item_id long, words array<long>, grams array<long>", make, keep=("item_id",)).withColumn("item", F.monotonically_increasing_id()), "items")


def _seed_table(items: DataFrame, found: DataFrame, n_docs: int) -> DataFrame:
    """item, gram and place of the seeds of all items."""
    counts = found.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    each = items.select("item", F.posexplode("grams").alias("place", "gram")).join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    half = each.groupBy("item").agg(F.percentile("n", F.lit(0.5)).alias("half"))
    rare = (F.col("n") * RARE <= n_docs) | (F.col("n") <= F.col("half"))
    return write_table(each.join(half, "item").where(rare).select("item", "gram", "place"), "seeds")


def _candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, md5 of the text, text, and the n-grams that items may have with their places."""
    shared = bloom(items.select(F.explode("grams").alias("gram")).distinct())

    def run(batches):
        own, cache = Filter(shared.value), _Ids()
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                g = ngrams(hashes(text or "", cache), SEED)
                at = own.passes(g)
                if len(at):
                    key = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1), pa.array([key]), pa.array([text]), pa.array([g[at].view(np.int64)], pa.list_(pa.int64())), pa.array([at], pa.list_(pa.int64()))],
                        names=["doc_id", "md5", "text", "grams", "places"],
                    )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return write_table(rows.mapInArrow(run, "doc_id long, md5 string, text string, grams array<long>, places array<long>"), "candidates")


def _passing(texts: DataFrame, shared) -> DataFrame:
    """The rows of (md5, text) whose md5 passes a Bloom filter."""

    def run(batches):
        own = Filter(shared.value)
        for b in batches:
            yield b.take(pa.array(own.passes(b.column(2).to_numpy().view(np.uint64)))).select(["md5", "text"])

    return texts.select("md5", "text", F.xxhash64("md5").alias("h")).mapInArrow(run, "md5 string, text string")


def _aligned(pairs: DataFrame, least: float) -> DataFrame:
    """md5, item_id and score of the pairs of a text and an item that align well enough."""

    def run(batches):
        cache = _Ids()
        last, h = None, np.empty(0, np.uint64)
        for b in batches:
            todo, owner, items = [], [], []
            for i, (key, text, offsets) in enumerate(zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True)):
                if key != last:
                    last, h = key, hashes(text.as_py(), cache)
                item = b.column(4)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                items.append(item)
                for begin, end in windows(offsets, len(item), len(h)):
                    todo.append((item, h[begin:end]))
                    owner.append(i)
            best = np.zeros(b.num_rows)
            np.maximum.at(best, np.array(owner, np.int64), scores(todo))
            good = best >= np.array([least if len(w) >= SHORT else 1.0 for w in items])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(3).filter(pa.array(good)), pa.array(best[good])], names=["md5", "item_id", "score"])

    return pairs.select("md5", "text", "offsets", "item_id", "words").mapInArrow(run, "md5 string, item_id long, score double")


def _hits(docs: DataFrame, benchmark: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The candidates, and md5, item_id and score of the texts that hold an item."""
    items = _item_table(benchmark)
    found = _candidates(docs, items)
    seeds = _seed_table(items, found, docs.count())
    each = found.groupBy("md5").agg(F.first("grams").alias("grams"), F.first("places").alias("places"))
    held = each.select("md5", F.explode(F.arrays_zip("grams", "places")).alias("s")).select("md5", F.col("s.grams").alias("gram"), F.col("s.places").alias("at"))
    pairs = held.join(seeds, "gram").groupBy("md5", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("offsets"))
    pairs = write_table(pairs, "pairs")
    wanted = pairs.select("md5").distinct()
    texts = _passing(found.select("md5", "text"), bloom(wanted.select(F.xxhash64("md5").alias("h"))))
    # by shuffle at every size: few texts pass that aren't wanted
    texts = texts.join(wanted.hint("merge"), "md5", "left_semi").groupBy("md5").agg(F.first("text").alias("text"))
    both = pairs.join(items.select("item", "item_id", "words"), "item").join(texts, "md5")
    hits = write_table(_aligned(both, least).groupBy("md5", "item_id").agg(F.max("score").alias("score")), "hits")
    drop_tables(items, seeds, pairs)
    return found, hits


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id and score: a row for each test item that a row of ``docs`` holds.

    A document holds an item when one aligned stretch covers at least ``least`` of it; items of
    fewer than 8 words must be there whole, and those of fewer than 3 match nothing. Null and empty
    texts and items match nothing, items without an id are left out; of items with the same id the
    best score counts. Each of repeated rows, and each row without a doc_id, has its own result
    rows; long texts are searched whole; an empty table on either side gives no rows. Further
    columns are ignored, whatever their names.
    """
    found, hits = _hits(docs, benchmark, least)
    return found.select("doc_id", "md5").join(hits, "md5").select("doc_id", "item_id", "score")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns as they are.

    Null and empty texts stay, rows that are repeated or have no doc_id stay or go each by its text,
    and columns may have any names; the rest is as in ``contaminated``.
    """
    found, hits = _hits(docs, benchmark, least)
    drop_tables(found)
    gone = hits.select("md5").distinct()
    # the only shuffle of texts is avoided where the hits are few: AQE sends them to all tasks
    return docs.join(gone, F.md5(docs["text"].cast("binary")) == gone["md5"], "left_anti")
