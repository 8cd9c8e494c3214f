"""A quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model.

The model runs over characters, order 5. A character is the last 12 bits of its code point, so all
scripts below U+1000 are told apart, and an n-gram is a number of up to 60 bits. All n-grams of
trusted text are counted in tables that grow with the text and stay spread over the cluster; joins
by context and by suffix give continuation counts, discounts and interpolation weights. With
v(g) = log p(g) - log(weight of g's context) - log p(g's suffix) for a counted n-gram, a text's
log-probability is the sum, over its n-grams of all orders, of v where they are counted and of the
log of their weight as contexts.

Texts are packed once, compressed, into blocks of bounded size, in a table bucketed by block, so
that text is never shuffled. Each block asks for its distinct n-grams, dealt into shards by key;
a shard of questions meets the same shard of the counts' values, and the answers of all shards meet
the block, which then scores its documents. So the joins carry distinct n-grams of blocks, not
positions of documents, and no table passes through the driver.

A trusted document is scored as if it weren't counted: n-grams that it alone holds are unseen.

Thresholds are quantiles of the perplexities of trusted documents of the same language, with a
margin: above the upper one a text is unlike trusted text, below the lower one it repeats itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, write_bucketed, write_table

ORDER, BITS = 5, 12
CLASSES = 1 << BITS
#: Bytes of text that a block holds, about; characters that are worked on at once.
BLOCK, SLICE = 16_000_000, 1_000_000
#: Quantiles of trusted perplexities, and how much further out, in log-perplexity, a text may be.
UPPER, LOWER, MARGIN = 0.98, 0.01, 0.12
#: A text's mean is drawn to its language's as if it had so many more characters.
PRIOR = 40


def _low(order: int) -> int:
    return (1 << (BITS * order)) - 1


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, all texts in a row, and the lengths of the texts.

    Before a text stands character 0.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code &= CLASSES - 1
    out = code.copy()
    for k in range(1, ORDER):
        out[k:] |= code[:-k] << (BITS * k)
    starts = np.cumsum(lengths) - lengths
    for k in range(1, ORDER):  # the k-th character of a text sees no more than k
        at = starts[lengths >= k] + k - 1
        out[at] &= _low(k)
    return out, lengths


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; sorting is faster here than hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with their counts."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(at, append=len(x))


def keys_of(top: np.ndarray) -> np.ndarray:
    """Sorted keys of all n-grams and contexts that distinct n-grams of the highest order hold.

    A key has its order above its 60 bits.
    """
    out = [np.arange(1, ORDER) << 60]  # the contexts at the start of a text
    for k in range(ORDER, 0, -1):
        top = distinct(top & _low(k))
        out.append(top | (k << 60))
    return distinct(np.concatenate(out))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed; equal bytes of all numbers stand together."""
    return zstandard.compress(b"".join(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays)), 1)


def _unpack(packed: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


def packed_texts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, its doc_ids, and its rows (doc_id, lang, text) as a compressed Arrow stream."""

    def run(batches):
        from pyspark import TaskContext

        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        at, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row():
            rows = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_table(rows)
            ids = pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([at]), ids, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "ids", "rows"])

        for b in batches:
            for i in range(0, b.num_rows, 256):
                held.append(b.slice(i, 256))
                size += held[-1].nbytes
                if size >= block:
                    yield row()
                    at, held, size = at + 1, [], 0
        if held:
            yield row()

    return docs.mapInArrow(run, "block long, ids array<long>, rows binary")


def _texts(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def _slices(texts: list[str | None]):
    """Runs of texts of about SLICE characters: first index and the texts, null as empty."""
    start, held, size = 0, [], 0
    for t in texts:
        if held and size + len(t or "") > SLICE:
            yield start, held
            start, held, size = start + len(held), [], 0
        held.append(t or "")
        size += len(t or "")
    if held:
        yield start, held


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and the sums of their counts."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([p[1] for p in parts]), len(gram)).astype(np.int64)


def _ask(shards: int, ask: bool = True, count: bool = True):
    """A block's distinct keys in each shard, and its trusted rows' counts (shard -1); either may be left out."""

    def run(key, block: pa.Table, trusted: pa.Table) -> pa.Table:
        parts, counts = [], []
        for packed in block.column("rows").to_pylist() if ask or trusted.num_rows else ():
            texts = _texts(packed).column("text").to_pylist()
            own = np.zeros(len(texts), bool)
            for at in trusted.column("at").to_pylist():
                own[at] = True
            for first, held in _slices(texts):
                good = own[first : first + len(held)]
                counts.append(counted(grams([t for t, ok in zip(held, good, strict=True) if ok])[0]))
                if ask:
                    parts += [counts[-1][0], distinct(grams([t for t, ok in zip(held, good, strict=True) if not ok])[0])]
                if len(counts) >= 16:
                    parts, counts = [distinct(np.concatenate(parts))] if ask else [], [_merged(counts)] if count else []
        shard, packed = [], []
        if ask:
            keys = keys_of(distinct(np.concatenate([np.empty(0, np.int64), *parts])))
            of = keys % shards
            order = np.argsort(of, kind="stable")
            found, starts = np.unique(of[order], return_index=True)
            shard += found.tolist()
            packed += [_pack(np.diff(k, prepend=0)) for k in np.split(keys[order], starts[1:])]
        if count:
            shard.append(-1)
            packed.append(_pack(*_merged(counts)))
        return pa.table({"block": pa.array([key[0].as_py()] * len(shard), pa.int64()), "shard": pa.array(shard, pa.int64()), "keys": pa.array(packed, pa.binary())})

    return run


def unpacked_counts(asked: DataFrame) -> DataFrame:
    """gram and n, its count over all trusted text."""

    def run(batches):
        for b in batches:
            for packed in b.column(0).to_pylist():
                gram, n = _unpack(packed, np.int64, np.int64)
                for s in range(0, len(gram), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(gram[s : s + 100_000]), pa.array(n[s : s + 100_000])], names=["gram", "n"])

    return asked.where("shard = -1").select("keys").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discount(counts: DataFrame):
    """The modified Kneser-Ney discount of ``n``, from counts of counts."""
    of = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
    d = [0.5, 0.75, 0.9]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
        d = [min(max(v, 0.05), i + 0.95) for i, v in enumerate(d)]
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def model_values(counts: DataFrame) -> tuple[DataFrame, float, list[DataFrame]]:
    """What a text's n-grams add to its log-probability, and the weight of the uniform base.

    key, value and raw (occurrences) as an n-gram, weight (its log) and raw_c as a context. The
    third result are tables to drop when the first is no longer read.
    """
    tables, made = [], []
    counts = write_table(counts.withColumn("raw", F.col("n")), "counts")
    for k in range(ORDER, 0, -1):
        tables.append(counts)
        if k > 1:  # below the highest order, an n-gram counts the distinct characters before it
            lower = F.col("gram").bitwiseAND(F.lit(_low(k - 1))).alias("gram")
            counts = write_table(counts.groupBy(lower).agg(F.count("*").alias("n"), F.sum("raw").alias("raw")), "counts")
    base, lower, out = 1.0, None, []
    for k, counts in enumerate(tables[::-1], 1):
        counts = counts.withColumn("cut", F.least(_discount(counts), F.col("n").cast("double")))
        sums = [F.sum("n").alias("total"), F.sum("cut").alias("cuts"), F.sum("raw").alias("raw_c")]
        if k == 1:
            every = counts.agg(*sums).first()
            base = every["cuts"] / every["total"] if every["total"] else 1.0
            p = (F.col("n") - F.col("cut")) / F.lit(float(every["total"] or 1)) + F.lit(base / CLASSES)
            value, found = F.log("p") - F.lit(float(np.log(base / CLASSES))), counts.withColumn("p", p)
        else:
            at = F.shiftright("gram", BITS).alias("context")
            contexts = write_table(counts.groupBy(at).agg(*sums).withColumn("gamma", F.col("cuts") / F.col("total")), "contexts")
            found = counts.withColumn("context", F.shiftright("gram", BITS)).join(contexts, "context")
            found = found.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_low(k - 1)))).join(lower, "suffix")
            found = found.withColumn("p", (F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("q"))
            value = F.log("p") - F.log("gamma") - F.log("q")
            made.append(contexts)
            out.append(contexts.select(F.col("context").bitwiseOR(F.lit((k - 1) << 60)).alias("key"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("raw"), F.log("gamma").alias("weight"), "raw_c"))
        found = write_table(found.select("gram", value.alias("value"), "raw", "p"), "values")
        made.append(found)
        out.append(found.select(F.col("gram").bitwiseOR(F.lit(k << 60)).alias("key"), "value", "raw", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("raw_c")))
        lower = found.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
    drop_tables(*tables)
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("value", "raw", "weight", "raw_c"))), float(base), made


_ANSWER = (np.int64, np.float32, np.float32, np.int32, np.int32)


def _answer(key, asked: pa.Table, values: pa.Table) -> pa.Table:
    """One shard: for each block that asks, the keys that are counted, with their values."""
    order = np.argsort(values.column("key").to_numpy(), kind="stable")
    held = [values.column(c).to_numpy()[order] for c in ("key", "value", "weight", "raw", "raw_c")]
    most = np.iinfo(np.int32).max
    held = [held[0], *(v.astype(np.float32) for v in held[1:3]), *(np.minimum(v, most).astype(np.int32) for v in held[3:])]
    out = []
    for packed in asked.column("keys").to_pylist():
        keys = np.cumsum(_unpack(packed, np.int64)[0])
        at = np.searchsorted(held[0], keys)
        at[at == len(held[0])] = 0
        hit = at[held[0][at] == keys] if len(held[0]) else at[:0]
        out.append(_pack(np.diff(held[0][hit], prepend=0), *(v[hit] for v in held[1:])))
    return pa.table({"block": asked.column("block"), "answers": pa.array(out, pa.binary())})


class Scorer:
    """The answers to a block, ready to score its documents."""

    def __init__(self, answers: list[bytes], top: np.ndarray):
        got = [_unpack(a, *_ANSWER) for a in answers]
        key = np.concatenate([np.empty(0, np.int64), *(np.cumsum(g[0]) for g in got)])
        order = np.argsort(key, kind="stable")
        # a last row stands for keys that are not counted
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        columns = [np.append(np.concatenate([np.empty(0, k), *(g[i] for g in got)])[order], 0) for i, k in enumerate(_ANSWER[1:], 1)]
        self.value, self.weight, self.raw, self.raw_c = columns
        self.top = top
        #: For each n-gram of the highest order: rows of its suffixes, and of their contexts.
        self.suffix = [self._find((top & _low(k)) | (k << 60)) for k in range(1, ORDER + 1)]
        self.context = [self._find(((top & _low(k)) >> BITS) | ((k - 1) << 60)) for k in range(2, ORDER + 1)]
        self.total = sum(self.value[s].astype(np.float64) for s in self.suffix) + sum(self.weight[c].astype(np.float64) for c in self.context)
        # a table of places makes look-ups cheap; what it doesn't hold is searched
        self.shift = np.uint64(64 - max(10, int(len(top)).bit_length() + 3))
        self.place = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.place[self._slot(top)] = np.arange(len(top))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, keys)
        return np.where(self.key[at] == keys, at, len(self.key) - 1)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def rows(self, gram: np.ndarray) -> np.ndarray:
        at = self.place[self._slot(gram)].astype(np.int64)
        other = np.flatnonzero(self.top[at] != gram)
        at[other] = np.searchsorted(self.top, gram[other])
        return at

    def own(self, rows: np.ndarray, lengths: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        """What n-grams add to each trusted text whose occurrences are all in it."""
        out = np.zeros(len(lengths))
        if not trusted.any():
            return out
        text = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(trusted[text])
        text, rows = text[at], rows[at]
        here = np.bincount(rows, minlength=len(self.top))
        for tables, raw, value in ((self.suffix, self.raw, self.value), (self.context, self.raw_c, self.weight)):
            for table in tables:
                # first those whose occurrences are all among these texts
                few = (raw > 0) & (raw <= np.bincount(table, here, len(raw)))
                at = np.flatnonzero(few[table][rows])
                pairs, n = counted(text[at] * len(raw) + table[rows[at]])
                owner, key = np.divmod(pairs, len(raw))
                alone = raw[key] <= n
                out += np.bincount(owner[alone], value[key[alone]] * n[alone].astype(np.float64), len(out))
        return out


def _score(base: float):
    def run(key, block: pa.Table, answers: pa.Table, trusted: pa.Table) -> pa.Table:
        ids, langs, sizes, losses, own_ = [], [], [], [], []
        got = answers.column("answers").to_pylist()
        for packed in block.column("rows").to_pylist():
            rows = _texts(packed)
            texts = rows.column("text").to_pylist()
            own = np.zeros(len(texts), bool)
            for at in trusted.column("at").to_pylist():
                own[at] = True
            parts = []
            for _, held in _slices(texts):
                parts.append(distinct(grams(held)[0]))
                if len(parts) >= 16:
                    parts = [distinct(np.concatenate(parts))]
            scorer = Scorer(got, distinct(np.concatenate([np.empty(0, np.int64), *parts])))
            for first, held in _slices(texts):
                g, lengths = grams(held)
                at = scorer.rows(g) if len(g) else g
                total = np.concatenate([[0.0], np.cumsum(scorer.total[at])])
                ends = np.cumsum(lengths)
                log_p = total[ends] - total[ends - lengths] + lengths * base
                losses.append(scorer.own(at, lengths, own[first : first + len(held)]) - log_p)
                sizes.append(lengths)
            ids.append(rows.column("doc_id").combine_chunks())
            langs.append(rows.column("lang").combine_chunks())
            own_.append(own)
        cat = lambda x, kind: np.concatenate([np.empty(0, kind), *x])
        return pa.table(
            {
                "doc_id": pa.chunked_array(ids, pa.int64()),
                "lang": pa.chunked_array(langs, pa.string()),
                "n_chars": cat(sizes, np.int64),
                "trusted": cat(own_, bool),
                "loss": cat(losses, np.float64),
            }
        )

    return run


def _prime(least: int) -> int:
    n = max(2, least)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def losses(docs: DataFrame, good: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, lang, n_chars, trusted and ``loss`` (the sum of -log p) for each row of ``docs``.

    ``good`` has the doc_ids of trusted documents, on which the model is counted.
    """
    spark = docs.sparkSession
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = write_bucketed(packed_texts(rows, block), "blocks", "block", buckets)
    places = packed.select("block", F.posexplode("ids").alias("at", "doc_id"))
    trusted = places.join(good.hint("merge"), "doc_id", "left_semi").groupBy("block").agg(F.collect_list("at").alias("at"))
    trusted = write_table(trusted, "trusted")
    blocks = packed.select("block", "rows")
    shards = _prime(max(16, packed.count() // 2))
    both = blocks.groupBy("block").cogroup(trusted.select("block", "at").groupBy("block"))
    asking = "block long, shard long, keys binary"
    own = write_table(both.applyInArrow(_ask(shards, ask=False), asking), "asked")
    values, base, made = model_values(unpacked_counts(own))
    drop_tables(own)
    # the questions go straight to their shards: written out as well, they would take their disk twice
    asked = both.applyInArrow(_ask(shards, count=False), asking)
    values = values.withColumn("shard", F.pmod("key", F.lit(shards)))
    answers = asked.groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(_answer, "block long, answers binary")
    # the places of trusted rows go along as another row of answers
    sent = answers.select("block", "answers", F.lit(None).cast("array<int>").alias("at"))
    sent = sent.unionByName(trusted.select("block", F.lit(None).cast("binary").alias("answers"), "at"))
    score = _score(float(np.log(base / CLASSES)))

    def run(key, block: pa.Table, got: pa.Table) -> pa.Table:
        answers = got.filter(pa.compute.is_valid(got.column("answers")))
        return score(key, block, answers, got.filter(pa.compute.is_valid(got.column("at"))))

    both = blocks.groupBy("block").cogroup(sent.groupBy("block"))
    out = write_table(both.applyInArrow(run, "doc_id long, lang string, n_chars long, trusted boolean, loss double"), "losses")
    drop_tables(packed, trusted, *made)
    return out


def quality(docs: DataFrame, labels: DataFrame, upper: float = UPPER, lower: float = LOWER, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, low, high and kept for each row of ``docs``.

    All documents that ``labels.quality`` marks 1 are trusted and counted. A document is kept when
    its perplexity (a character, drawn towards its language's mean where the text is short) lies
    between its language's thresholds, which languages with under 20 trusted documents (and rows
    without one) take from all. Null and empty texts are rejected. Long texts are scored whole.
    Rows that share a doc_id are scored each and trusted alike; a null doc_id is never trusted.
    Labels that contradict each other for one doc_id count as their smaller value, null ones not
    at all. Without trusted text, all texts that aren't empty are kept. An empty table gives no
    rows; further columns are ignored, whatever their names.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    scored = losses(docs, good)
    trusted = scored.where("trusted and n_chars > 0")
    stats = [(F.sum("loss") / F.sum("n_chars")).alias("mean"), F.count("*").alias("docs")]
    mean_all = trusted.agg(*stats).withColumnRenamed("mean", "mean_all").drop("docs")
    means = write_table(trusted.groupBy(F.col("lang").alias("l")).agg(*stats).where("docs >= 20").drop("docs"), "means")

    def drawn(df: DataFrame) -> DataFrame:
        # one row for each language: AQE broadcasts what is small
        df = df.join(means, F.col("lang") == F.col("l"), "left").drop("l").crossJoin(F.broadcast(mean_all))
        mean = F.coalesce("mean", "mean_all")
        return df.withColumn("x", F.coalesce((F.col("loss") + PRIOR * mean) / (F.col("n_chars") + PRIOR), F.lit(0.0))).drop("mean", "mean_all")

    at = lambda q: F.percentile_approx("x", q, 10_000)
    ends = [(at(lower) - margin).alias("low"), (at(upper) + margin).alias("high")]
    own = drawn(trusted)
    every = own.agg(*ends).select(F.col("low").alias("low_all"), F.col("high").alias("high_all"))
    each = write_table(own.groupBy(F.col("lang").alias("l")).agg(*ends, F.count("*").alias("docs")).where("docs >= 20").drop("docs"), "ends")
    out = drawn(scored).join(each, F.col("lang") == F.col("l"), "left").drop("l").crossJoin(F.broadcast(every))
    low, high = F.coalesce("low", "low_all"), F.coalesce("high", "high_all")
    inside = F.coalesce(F.col("x").between(low, high), F.lit(True)) & (F.col("n_chars") > 0)
    return out.select("doc_id", "lang", "n_chars", F.exp("x").alias("perplexity"), F.exp(low).alias("low"), F.exp(high).alias("high"), inside.alias("kept"))
