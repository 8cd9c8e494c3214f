"""Language identification with string kernels.

The kernel of two texts is the cosine of their sets of character n-grams, n from 1 to 3 blended
(a presence kernel). It is approximated after Nystroem by a few landmark texts: with C the kernel
between texts and landmarks and W that among landmarks, features are C W^(-1/2). One-versus-rest
kernel ridge regression on them gives a weight for each landmark and language. N-grams are hashed
to a fixed number of places, so a batch of texts is a 0/1 matrix, and its scores are two matrix
products: with the landmarks' matrix, then with the weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, map_texts

#: Places for hashed n-grams, landmarks, ridge, and labelled rows fitted at most for a language.
PLACES, LANDMARKS, RIDGE, MOST_ROWS = 2**14, 96, 1e-2, 150
ORDERS = (1, 2, 3)


def presence(texts: list[str], places: int = PLACES) -> np.ndarray:
    """0/1 rows of the n-grams that each text has, of lower-case letters with one gap for the rest."""
    out = np.zeros((len(texts), places), np.float32)
    low = [t.lower() for t in texts]
    code = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 1 for t in low])
    letter = ((code >= 97) & (code <= 122)) | (code >= 0xAA)
    code = np.where(letter, code, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after each run of letters
    code, row = code[keep], row[keep]
    if not len(code):
        return out
    h = np.zeros(len(code), np.uint32)
    flat = out.reshape(-1)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(code) - n + 1]
        if not len(h):
            break
        h = (h + code[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        own = row[: len(h)] == row[n - 1 :]
        flat[(row[: len(h)] * places + (h + np.uint32(n * 7919)) % np.uint32(places))[own]] = 1
    return out


def _unit(b: np.ndarray) -> np.ndarray:
    n = np.sqrt(b.sum(1, keepdims=True))
    return b / np.maximum(n, 1)


class KernelLanguages:
    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(v) for v in langs], int)
        b = _unit(presence(texts)) if texts else np.zeros((0, PLACES), np.float32)
        # landmarks in turn from the languages, so that rare ones have some
        rank = np.empty(len(y), int)
        for c in range(len(self.langs)):
            own = np.flatnonzero(y == c)
            rank[own] = np.arange(len(own))
        at = np.argsort(rank, kind="stable")[:landmarks]
        self.marks = np.ascontiguousarray(b[at].T)
        if not len(at):
            self.weights = np.zeros((0, 0), np.float32)
            return
        w, v = np.linalg.eigh((b[at] @ self.marks).astype(float))
        root = v[:, w > 1e-6] / np.sqrt(w[w > 1e-6])
        z = (b @ self.marks).astype(float) @ root
        counts = np.bincount(y, minlength=len(self.langs))
        balance = (len(y) / (len(self.langs) * np.maximum(counts, 1)))[y][:, None]
        goal = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        beta = np.linalg.solve(z.T @ (z * balance) + ridge * len(y) * np.eye(z.shape[1]), z.T @ (goal * balance))
        self.weights = (root @ beta).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score; ``und`` and 0 for texts without letters."""
        score, best = np.zeros(len(texts)), ["und"] * len(texts)
        if not self.langs:
            return best, score
        step = 128
        for s in range(0, len(texts), step):
            part = texts[s : s + step]
            raw = presence(part)
            values = (raw @ self.marks) @ self.weights / np.maximum(np.sqrt(raw.sum(1, keepdims=True)), 1)
            e = np.exp(4 * (values - values.max(1, keepdims=True)))
            top = values.argmax(1)
            share = e[np.arange(len(part)), top] / e.sum(1)
            for i, t in enumerate(part):
                if raw[i].any() and any(map(str.isalpha, t)):
                    best[s + i], score[s + i] = self.langs[top[i]], share[i]
                elif any(map(str.isalpha, t)):
                    best[s + i], score[s + i] = self.langs[top[i]], 1 / len(self.langs)
        return best, score


def identify_languages(docs: DataFrame, folds: int = 4, held: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs``.

    The text alone decides. Languages are learnt from rows with a language and a text whose
    crc32(doc_id) mod ``folds`` isn't ``held``: at most ``most_rows`` of each language, the first by a
    hash of id and text, so ties and the order of rows don't matter. Null texts and texts without
    letters are ``und`` with score 0; without any learnt language so are all. Long texts are read
    whole; each of repeated rows has a row; rows without a doc_id are predicted, not learnt and not
    held out. An empty table gives no rows; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    learn = docs.where("doc_id is not null and lang is not null and text is not null").where(crc_bucket("doc_id", folds) != held)
    # ids first: a window over texts would carry all of them
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    keyed = learn.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("doc_id", "text").alias("h"))
    least = keyed.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most_rows).select("doc_id", "lang", "h").collect()
    bounded = spark.createDataFrame([tuple(r) for r in least], "i long, l string, k long").distinct()
    same = (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l")) & (F.xxhash64("doc_id", "text") == F.col("k"))
    rows = learn.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(F.broadcast(bounded), same, "left_semi").distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["lang"]))
    shared = spark.sparkContext.broadcast(KernelLanguages([r["text"] for r in rows], [r["lang"] for r in rows]))

    def make():
        def fn(texts: list[str]) -> dict:
            best, score = shared.value.predict(texts)
            return {"lang_pred": best, "score": score}

        return fn

    out = map_texts(docs, "doc_id long, lang_pred string, score double", make)
    return out.select("doc_id", (crc_bucket("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
