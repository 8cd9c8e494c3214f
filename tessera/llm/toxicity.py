"""A convolutional text classifier for toxicity.

Words are hashed to 32 bits; the hashes that occur in enough training documents have embeddings.
Other words take that of their longest beginning that does, so new compounds are known by their
stems; what is left shares one. Filters of widths 1, 2 and 3 run over the word embeddings, each filter's
largest response over the whole text is kept, and a logistic layer makes the score. Training is
plain numpy on a bounded sample of labelled rows (``most_rows``, by a hash of the id). Scores are
calibrated on a part that the filters have not seen, so that 0.5 is the best cut overall, and a
threshold is chosen for each language.

To score a text, each filter's product with each embedding is tabulated once, so a position costs
a few look-ups and additions, whatever the length of the text.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_texts

DIM, FILTERS, WIDTHS = 12, 4, (1, 2, 3)
#: Labelled rows that are fitted at most, and the documents a hash must be in for an embedding.
MOST_ROWS, MIN_DOCS = 5000, 6
#: Bytes of a word's beginnings that are hashed too.
STEMS = (8, 6, 5, 4)
EPOCHS, RATE = 10, 0.06

_SPACE = bytes(32 if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else c for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case runs of letters and digits; letters beyond ASCII count as such."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()


def hashes(word: bytes) -> list[int]:
    """Of the word, then of its beginnings, longest first."""
    return [zlib.crc32(word), *(zlib.crc32(b"_" + word[:n]) for n in STEMS if len(word) > n)]


class _Rows(dict):
    """Embedding row of a word; 0 for the rest."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.known = {int(h): i + 1 for i, h in enumerate(hashes)}

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = self[word] = next((self.known[h] for h in hashes(word) if h in self.known), 0)
        return found


class TextCNN:
    def __init__(self, hashes: np.ndarray, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.hashes = hashes
        self.emb = rng.normal(0, 0.1, (len(hashes) + 1, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, 0, 0] = 1.0
        self.bias = [np.full(FILTERS, -0.1, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out0 = np.float32(0)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str | None, float] = {}
        self._tables = None

    def rows(self, texts: list[str], cache: dict) -> list[np.ndarray]:
        out = []
        for t in texts:
            w = words(t)
            out.append(np.fromiter(map(cache.__getitem__, w), np.int32, len(w)))
        return out

    def tables(self) -> list[np.ndarray]:
        """For each width, each filter's product with each embedding: (place, filter, row)."""
        return [np.ascontiguousarray(np.einsum("wdf,rd->wfr", f, self.emb)) for f in self.filters]

    def pooled(self, docs: list[np.ndarray], tables: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
        """Largest response of each filter in each document and where it is; padding has row 0."""
        pad = np.zeros(max(WIDTHS) - 1, np.int32)
        lengths = np.fromiter((len(d) + len(pad) for d in docs), np.int64, len(docs))
        flat = np.concatenate([x for d in docs for x in (d, pad)])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        shifted = [flat]  # the word so many places on; beyond a text's end stands padding
        for k in range(1, max(WIDTHS)):
            on = np.zeros_like(flat)
            on[:-k] = flat[k:]
            for j in range(1, k + 1):
                on[ends - j] = 0
            shifted.append(on)
        best, responses = [], []
        for table in tables:
            for c in range(FILTERS):
                resp = table[0, c][flat]
                for k in range(1, len(table)):
                    resp += table[k, c][shifted[k]]
                best.append(np.maximum.reduceat(resp, starts))
                responses.append(resp)
        return np.stack(best, 1), (flat, starts, lengths, responses)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        act = np.maximum(pooled + np.concatenate(self.bias), 0)
        return act @ self.out + self.out0

    def fit(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """AdaGrad on the logistic loss, classes weighted alike; gradients flow through the maxima."""
        n = len(docs)
        has = np.zeros((len(self.emb), 2))
        for d, t in zip(docs, y, strict=True):
            has[np.unique(d), int(t)] += 1
        pos, neg = max(1, y.sum()), max(1, (1 - y).sum())
        # the first dimension starts as each word's smoothed log-odds
        self.emb[:, 0] = np.log((has[:, 1] + 0.5) / (pos + 1)) - np.log((has[:, 0] + 0.5) / (neg + 1))
        self.emb[:, 0] *= np.minimum(1, has.sum(1) / 8)
        self.emb[0] = 0
        weight = np.where(y == 1, n / (2 * pos), n / (2 * neg))
        rng = np.random.default_rng(5)
        params = [self.emb, *self.filters, *self.bias, self.out]
        seen = [np.full(p.shape, 1e-6, np.float32) for p in params]
        seen0 = 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for s in range(0, n, 64):
                part = order[s : s + 64]
                batch = [docs[i] for i in part]
                used, local = np.unique(np.concatenate([*batch, [0]]), return_inverse=True)
                cuts = np.cumsum([len(d) for d in batch])[:-1]
                emb = self.emb[used]
                tables = [np.einsum("wdf,rd->wfr", f, emb) for f in self.filters]
                pooled, (flat, starts, lengths, responses) = self.pooled(np.split(local[:-1].astype(np.int32), cuts), tables)
                pre = pooled + np.concatenate(self.bias)
                act = np.maximum(pre, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.out0, -30, 30)))
                err = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)
                grads = [np.zeros_like(emb), *(np.zeros_like(q) for q in params[1:])]
                grads[-1] = act.T @ err + 1e-4 * self.out
                back = np.outer(err, self.out) * (pre > 0)
                for i, f in enumerate(self.filters):
                    grads[1 + len(WIDTHS) + i] = back[:, i * FILTERS : (i + 1) * FILTERS].sum(0)
                    for c in range(FILTERS):
                        g, resp = back[:, i * FILTERS + c], responses[i * FILTERS + c]
                        for b in np.flatnonzero(g):
                            at = starts[b] + int(resp[starts[b] : starts[b] + lengths[b]].argmax())
                            for k, r in enumerate(flat[at : min(at + len(f), starts[b] + lengths[b])]):
                                grads[1 + i][k, :, c] += g[b] * emb[r]
                                if r:
                                    grads[0][r] += g[b] * f[k, :, c]
                for q, g, h in zip(params[1:], grads[1:], seen[1:], strict=True):
                    h += g * g
                    q -= RATE * g / np.sqrt(h)
                seen[0][used] += grads[0] ** 2
                self.emb[used] -= RATE * grads[0] / np.sqrt(seen[0][used])
                g0 = float(err.sum())
                seen0 += g0 * g0
                self.out0 -= np.float32(RATE * g0 / np.sqrt(seen0))

    def calibrate(self, logits: np.ndarray, y: np.ndarray, langs: list) -> None:
        """The shift that makes 0.5 the cut with the fewest errors, and a threshold for each language."""

        def cut(x, t):
            order = np.argsort(x)
            x, t = x[order], t[order]
            error = np.concatenate([[0], np.cumsum(t)]) + (1 - t).sum() - np.concatenate([[0], np.cumsum(1 - t)])
            i = np.flatnonzero(error == error.min())
            i = int(i[len(i) // 2])
            return float((x[max(0, i - 1)] + x[min(len(x) - 1, i)]) / 2)

        if 0 < y.sum() < len(y):
            self.shift = cut(logits, y)
        for lang in {*langs}:
            own = np.array([v == lang for v in langs])
            if 5 <= y[own].sum() < own.sum():
                self.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(cut(logits[own], y[own]) - self.shift, -30, 30))))

    def scores(self, texts: list[str], cache: dict) -> np.ndarray:
        if self._tables is None:
            self._tables = self.tables()
        pooled, _ = self.pooled(self.rows(texts, cache), self._tables)
        return 1 / (1 + np.exp(-np.clip(self.logit(pooled) - self.shift, -30, 30)))


def train(rows: list, seed: int = 17) -> TextCNN:
    """Fit on rows (text, toxic, lang, part); rows of part 0 calibrate."""
    import collections

    df = collections.Counter()
    for r in rows:
        df.update({h for w in {*words(r["text"] or "")} for h in hashes(w)})
    model = TextCNN(np.array(sorted(h for h, n in df.items() if n >= MIN_DOCS), np.uint32), seed)
    cache = _Rows(model.hashes)
    docs = model.rows([r["text"] or "" for r in rows], cache)
    y = np.array([float(r["toxic"]) for r in rows])
    fit = np.array([r["part"] != 0 for r in rows], bool)
    if fit.any() and 0 < y[fit].sum() < fit.sum():
        model.fit([d for d, f in zip(docs, fit, strict=True) if f], y[fit])
        own = np.flatnonzero(~fit) if 0 < y[~fit].sum() < (~fit).sum() else np.flatnonzero(fit)
        pooled, _ = model.pooled([docs[i] for i in own], model.tables())
        model.calibrate(model.logit(pooled), y[own], [rows[i]["lang"] for i in own])
    else:  # one class or no rows: the share of label 1
        model.out[:] = 0
        model.out0 = np.float32(2.0 if len(y) and y.mean() >= 0.5 else -2.0)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and flagged for each row of ``docs``.

    Labels are learnt only from rows whose crc32(doc_id) mod ``folds`` isn't 0, from at most
    ``most_rows`` of them, the first by a hash of the id. A score depends on the text alone;
    ``threshold`` is the one of the row's language (0.5 where too few labels calibrate it; null is a
    language of its own) and ``flagged`` applies it. Null and empty texts get the score of no words;
    long texts are scored whole. Each of repeated rows is scored; of rows that share a labelled
    doc_id the least text is learnt, so ties don't matter. A null doc_id is never learnt and not held
    out. Labels that are null don't count, those that contradict each other for one doc_id count
    once as their larger value; without any labels all scores are below 0.5. An empty table gives no
    rows; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(crc_bucket("doc_id", folds) != 0)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    # at most most_rows ids are sent to all tasks
    first = known.join(text.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).toPandas()
    bounded = spark.createDataFrame([(int(i), int(t)) for i, t in zip(first["doc_id"], first["toxic"], strict=True)], "doc_id long, toxic int")
    each = text.join(F.broadcast(bounded), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x"))
    rows = each.select("doc_id", "toxic", "x.text", "x.lang", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)).alias("part")).collect()
    model = train(sorted(rows, key=lambda r: r["doc_id"]))
    shared = spark.sparkContext.broadcast(model)

    def make():
        cache = _Rows(shared.value.hashes)
        return lambda texts: {"score": shared.value.scores(texts, cache)}

    has_lang = "lang" in docs.columns
    keep = ("doc_id", "lang") if has_lang else ("doc_id",)
    out = map_texts(docs, "doc_id long, lang string, score double" if has_lang else "doc_id long, score double", make, keep=keep)
    threshold = F.lit(0.5)
    for lang, value in (model.thresholds.items() if has_lang else ()):
        threshold = F.when(F.col("lang").eqNullSafe(F.lit(lang)), value).otherwise(threshold)
    return out.select(
        "doc_id",
        (crc_bucket("doc_id", folds) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("flagged"),
    )
