"""Operators against plain versions of what they compute, and odd tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from tessera.llm import decontaminate, language_id, mixing, near_dedup, pii, secrets, token_count, toxicity
from tessera.llm.registry import tokenizer_path

#: Names that operators use for columns of their own or of their results.
CLASHING = "score kept size taken spans component_id _hits key node base more row block md5 h copies n_tokens held_out grams places strings found r s".split()


def test_convolution_by_loops():
    """Every filter at every place of a text, padding included; then the largest, then the logistic layer."""
    rng = random.Random(31)
    vocab = "you are a fine person and a stupidity stupidly moron friend of mine".split()
    rows = [{"doc_id": i, "text": " ".join(rng.choice(vocab) for _ in range(20)) + (" Stupid moron!" if i % 3 == 0 else ""), "toxic": int(i % 3 == 0), "lang": "en", "part": i % 4} for i in range(120)]
    model = toxicity.train(rows)
    known = {int(h): i + 1 for i, h in enumerate(model.hashes)}
    texts = [r["text"] for r in rows[:20]] + ["", "unheard of", "stupidest"]
    got = model.scores(texts, toxicity._Rows(model.hashes))
    pad = max(toxicity.WIDTHS) - 1
    for text, score in zip(texts, got, strict=True):
        ids = [next((known[h] for h in toxicity.hashes(w) if h in known), 0) for w in toxicity.words(text)]
        ids = ids + [0] * pad
        pooled = []
        for f in model.filters:
            for c in range(toxicity.FILTERS):
                places = [sum(float(model.emb[ids[i + k]] @ f[k, :, c]) for k in range(len(f)) if i + k < len(ids)) for i in range(len(ids))]
                pooled.append(max(places))
        act = [max(0.0, p + float(b)) for p, b in zip(pooled, np.concatenate(model.bias), strict=True)]
        logit = sum(a * float(o) for a, o in zip(act, model.out, strict=True)) + float(model.out0) - model.shift
        assert score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)


def test_kernel_by_sets():
    """Exact n-gram sets, without hashed places."""

    def grams(text):
        s = re.sub(r"[^a-zà-ɏ]+", " ", text.lower())
        return {(n, s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    texts = ["the cat sat on the mat", "der hund lief schnell", "le chat était là", "the dog ran", "straße und haus"]
    b = language_id._unit(language_id.presence([t + " " for t in texts]))
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            p, q = grams(x + " "), grams(y + " ")
            assert float(b[i] @ b[j]) == pytest.approx(len(p & q) / math.sqrt(len(p) * len(q)), abs=0.05)


def test_ridge_regression_in_the_kernel():
    """With every text a landmark, features span the kernel; the solution is that of plain ridge regression on it."""
    rng = random.Random(32)
    words = {"en": "the cat sat on mat and went home".split(), "de": "der hund lief über die straße nach haus".split()}
    langs = [rng.choice(["en", "de"]) for _ in range(30)]
    texts = [" ".join(rng.choice(words[v]) for _ in range(8)) for v in langs]
    model = language_id.KernelLanguages(texts, langs, landmarks=30)
    b = language_id._unit(language_id.presence(texts)).astype(float)
    k = b @ b.T
    y = np.array([["de", "en"].index(v) for v in langs])
    weight = (len(y) / (2 * np.bincount(y)))[y]
    goal = np.where(y[:, None] == np.arange(2), 1.0, -1.0)
    alpha = np.linalg.solve(np.diag(weight) @ k + language_id.RIDGE * len(y) * np.eye(len(y)), weight[:, None] * goal)
    new = ["the cat went", "der hund nach haus", "cat und hund"]
    raw = language_id._unit(language_id.presence(new))
    assert np.allclose((raw @ model.marks) @ model.weights, (raw.astype(float) @ b.T) @ alpha, atol=2e-2)


def plain_spans(pattern, text, ok):
    return [m.span() for m in re.finditer(pattern, text) if ok(m)]


def test_secret_patterns_equal_plain_regexes():
    rng = random.Random(33)
    parts = ["password", "Secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "x", "/+", "deadbeef", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        got = secrets.base_spans(text)
        assign = r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
        assert [s[1:] for s in got if s[0] == "assign"] == plain_spans(assign, text, lambda m: len(m[1]) >= 8)
        assert [s[1:] for s in got if s[0] == "access"] == plain_spans("AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 16)
        assert [s[1:] for s in got if s[0] == "hex"] == plain_spans("[0-9a-f]+", text, lambda m: len(m[0]) >= 32)


def test_planted_random_strings():
    """Recall over planted strings of several kinds, and no find in plain words."""
    rng = random.Random(34)
    tokens = secrets.vocabulary(tokenizer_path("byte_bpe_50k.tiktoken"))
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    planted = found = 0
    for _ in range(400):
        s = "".join(rng.choice(signs) for _ in range(rng.randint(16, 48)))
        text = "the connection uses " + rng.choice(["%s now", "key:%s;", "id.%s.end", "https://a.example.com/?k=%s", "(%s)"]) % s
        planted += 1
        at = text.index(s)
        found += any(a <= at and at + len(s) <= b for _, a, b in secrets.random_spans(text, tokens))
    assert found >= 0.97 * planted
    assert not secrets.random_spans("internationalization misunderstandings of telecommunication responsibilities " * 3, tokens)


def test_card_and_phone_patterns_equal_plain_regexes():
    rng = random.Random(35)
    for _ in range(6000):
        text = "".join(rng.choice("+0123456789012345678901234567890 -().x") for _ in range(rng.randint(0, 40)))
        got = pii.base_spans(text)
        digits = lambda m: re.sub("[^0-9]", "", m[0])

        def luhn(d):
            return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0

        assert [s[1:] for s in got if s[0] == "card"] == plain_spans(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)))
        assert [s[1:] for s in got if s[0] == "phone"] == plain_spans(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 8 <= len(digits(m)) <= 15)


def test_graph_scores_by_loops(spark):
    rng = random.Random(36)
    rows = []
    for v in range(60):
        kind = "phone" if v < 25 else ""
        rows.append((kind, f"v{v}", [f"1 p{rng.randrange(3)} x" if v < 40 else f"1 q{rng.randrange(3)} x", f"2 r{rng.randrange(4)} y"]))
    got = {(r["pattern"], r["kind"]): r["confidence"] for r in pii.bootstrap(spark.createDataFrame(rows, "kind string, value string, patterns array<string>"), 0.5, 3, 3).collect()}
    edges = {(k, v, p) for k, v, ps in rows for p in ps}
    of = defaultdict(set)
    for _, v, p in edges:
        of[p].add(v)
    seeds = {(v, k): 1.0 for k, v, _ in edges if k}
    known = dict(seeds)
    for _ in range(3):
        hits = Counter()
        for p, values in of.items():
            for (v, k), score in known.items():
                if v in values:
                    hits[p, k] += score
        trusted = {(p, k): n / (len(of[p]) + 1) for (p, k), n in hits.items() if n / (len(of[p]) + 1) >= 0.5 and n >= 3}
        miss = defaultdict(lambda: 1.0)
        for e_kind, v, p in edges:
            for (q, k), c in trusted.items():
                if q == p and not e_kind:
                    miss[v, k] *= 1 - min(c, 0.999)
        seeded = {v for v, _ in seeds}
        known = seeds | {key: 1 - m for key, m in miss.items() if 1 - m >= 0.5 and key[0] not in seeded}
    assert got.keys() == trusted.keys() and all(got[k] == pytest.approx(v) for k, v in trusted.items())


def test_contamination_by_all_pairs(spark):
    """Whole texts aligned with all items, without seeds or windows."""
    rng = random.Random(37)
    vocab = [f"w{i}" for i in range(150)]
    items = [[rng.choice(vocab) for _ in range(rng.choice([2, 5, 9, 20, 30]))] for _ in range(12)]
    texts = []
    for _ in range(50):
        w = list(rng.choice(items)) if rng.random() < 0.6 else []
        for _ in range(rng.choice([0, 1, 3]) if w else 0):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if len(w) > 12 and rng.random() < 0.3:
            del w[3:5]
        texts.append([f"z{rng.randrange(500)}" for _ in range(rng.randint(0, 25))] + w + [f"z{rng.randrange(500)}" for _ in range(rng.randint(0, 25))])

    def score(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            row = new
            best = max(best, *row)
        return best / (2 * len(a))

    def shared(a, b):
        return {tuple(a[i : i + 3]) for i in range(len(a) - 2)} & {tuple(b[i : i + 3]) for i in range(len(b) - 2)}

    want = {(d, i): score(a, b) for d, b in enumerate(texts) for i, a in enumerate(items) if len(a) >= 3 and score(a, b) >= (0.5 if len(a) >= 8 else 1.0)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) <= set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    # what is missed shares no three words in a row with its item
    assert all(not shared(items[i], texts[d]) for d, i in set(want) - set(got))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en", "a", 9) for i, t in [(0, "one two three four"), (0, "one two three four"), (None, None), (2, ""), (3, "mail a@b.cd now")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("own") for c in CLASHING})


def operators(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    ranks, pieces = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model")
    return {
        "toxicity": (lambda d: toxicity.toxicity(d, labels), 5),
        "secrets": (lambda d: secrets.secret_digest(d, ranks), 5),
        "redact": (lambda d: secrets.redact(d, ranks), 5),
        "mixing": (mixing.mix, 5),
        "languages": (language_id.identify_languages, 5),
        "near": (near_dedup.near_duplicates, 5),
        "tokens": (lambda d: token_count.token_counts(d, pieces), 5),
        "pii": (pii.pii_digest, 5),
        "contaminated": (lambda d: decontaminate.contaminated(d, bench), 2),
        "decontaminate": (lambda d: decontaminate.decontaminate(d, bench), 3),
    }


@pytest.mark.parametrize("name", ["toxicity", "secrets", "redact", "mixing", "languages", "near", "tokens", "pii", "contaminated", "decontaminate"])
def test_clashing_columns_and_empty_tables(spark, clashing, name):
    run, rows = operators(spark)[name]
    got = run(clashing)
    assert got.count() == rows and len({*got.columns}) == len(got.columns)
    if name in ("redact", "decontaminate"):
        assert got.columns == clashing.columns and {r["score"] for r in got.collect()} == {"own"}
    assert run(clashing.limit(0)).count() == 0
