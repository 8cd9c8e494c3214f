"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Whatever the fixed patterns find (e-mail, IP, card and phone numbers) are seed entities. The words
around an entity make lexical patterns; patterns and the values they surround form a graph.
Spark scores it in rounds: a pattern's confidence in a kind is the share of its distinct values
that are known to be of the kind, a value's score follows from the confidences of its patterns,
and well-scored values count as known in the next round. Patterns of high confidence then mark
identifiers that no fixed pattern covers. Strings with four or more digits enter the graph first; for the
patterns that then have enough known values, whatever stands at their place, digits or not, is a value
too and counts for or against them. Each round reads the texts again (by a Bloom filter of fixed size,
then exactly) for those patterns that it would trust by the values in hand. A pattern with more values
than its known ones bear cannot be trusted, so a task that meets so many tells this alone: common
words around a few identifiers cost no more rows than that. A round that trusts nothing is the last.

A context is made of whole words, parted by white space: what stands in the same word before or
after the value counts as a word of its own. Words that aren't addresses and have over 200
characters are cut into pieces at the signs of addresses, and each piece may be a value.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Covered, drop_tables, map_texts, runs, write_table
from .decontaminate import Filter, bloom

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # starts inside a run match only if its first does
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A value: words around [at] and [dot], a run of words with digits, or one string.
_PART = r"[^\s\"'<>|,;]+"
_AT = re.compile(_PART + r"(?:\x20?[\[(](?:at|dot)[\])]\x20?" + _PART + ")+")
_NUMBER = re.compile(r"[A-Za-z0-9().+/-]*[0-9][A-Za-z0-9().+/-]*")
_TOKEN = re.compile(_PART)
#: Longer strings are cut at the signs of addresses, and what is still longer into windows.
LONGEST = 200
_PIECE = re.compile(r"[^=&/?:()\[\]{}#]{1,200}")
#: Values that may have several words.
_SEVERAL = re.compile(r"[\[(](?:at|dot)[\])]|[0-9][A-Za-z().+/-]* [A-Za-z().+/-]*[0-9]")
#: Copies of a text's spans that the rows with this text are dealt over.
SALTS = 16
#: Slots (as a power of 2) of the table of how many values patterns may have; patterns that share one have its largest number.
LIMITS = 18
#: Confidence that a pattern needs, the known values it must surround, and the rounds.
CONFIDENCE, SUPPORT, ROUNDS = 0.8, 8, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Each match holds one @, so the signs are tried in turn; long runs of letters cost no more."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start."""
    out = _emails(text)
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _text_key(text: str) -> str:
    return str(xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass")))


#: Signs that a context's words lose at their ends.
_ENDS = ".,;:!?()[]{}\"'*#$%&|"
#: Signs after which a value may start inside a word.
_SIGNS = "\"'<>|,;:=([{/?&#"


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def _word(text: str, a: int = 0, b: int | None = None) -> str:
    """The word at a..b as contexts have it; of over 64 characters the ends count."""
    b = len(text) if b is None else b
    w = text[a:b] if b - a <= 64 else text[a : a + 32] + text[b - 32 : b]
    return _DIGIT.sub("0", "".join(map(_lower, w)).strip(_ENDS))


def _tables() -> dict[str, np.ndarray]:
    """What characters are, by code point up to 0xFFFF; those above are letters."""
    n = 0x10000
    norm = np.arange(n, dtype=np.uint64)
    for c in range(n):
        if not 0xD800 <= c < 0xE000:
            norm[c] = ord(_lower(chr(c)))
    norm[48:58] = 48
    flags = {k: np.zeros(n, bool) for k in ("space", "ends", "digit", "sign")}
    flags["space"][[c for c in range(0x3001) if chr(c).isspace()]] = True
    flags["ends"][[ord(c) for c in _ENDS]] = True
    flags["sign"][[ord(c) for c in _SIGNS]] = True
    flags["digit"][48:58] = True
    return flags | {"norm": norm}


_BASE = 0x9E3779B97F4A7C15 | 1
_ANGLES = [ord("<"), ord(">")]


class Table:
    """The words of several texts: where they stand, hashes of them as contexts have them, and their digits.

    ``starts`` and ``ends`` are places in their own text; ``text`` is its number.
    """

    chars: dict[str, np.ndarray] = {}

    def __init__(self, texts: list[str]):
        if not self.chars:
            self.chars.update(_tables())
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.cumsum(lengths) - lengths
        raw = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(raw, 0xFFFF)
        space = self.chars["space"][code]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        self.text = np.searchsorted(first, begin, "right") - 1
        self.starts, self.ends = begin - first[self.text], end - first[self.text]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self._parts = texts, raw, code, space, begin, end
        digits = np.concatenate([[0], np.cumsum(self.chars["digit"][code])])
        self.digits = digits[end] - digits[begin]
        # signs inside a word, and words too long to be one value
        sign = self.chars["sign"][code]
        inner = np.zeros(len(code) + 1, np.int64)
        inner[2:-1] = np.cumsum(sign[1:-1] & ~space[:-2] & ~space[2:]) if len(code) > 2 else 0
        inner[-1] = inner[-2] if len(code) > 1 else 0
        self.inside = (inner[end] - inner[begin] > 0) | (end - begin > LONGEST)
        # < and > part values from their word, but stay in contexts
        self.edged = np.isin(code[begin], _ANGLES) | np.isin(code[end - 1], _ANGLES)

    def hashes(self) -> np.ndarray:
        """A word's hash: of its characters without the signs at its ends."""
        texts, raw, code, space, begin, end = self._parts
        kept = np.flatnonzero(~(self.chars["ends"][code] | space))
        if not len(kept):
            return np.zeros(len(begin), np.uint64)
        low, high = np.searchsorted(kept, begin), np.searchsorted(kept, end)
        some = high > low
        a = np.where(some, kept[np.minimum(low, len(kept) - 1)], 0)
        b = np.where(some, kept[np.maximum(high - 1, 0)] + 1, 0)
        norm = self.chars["norm"][code]
        far = np.flatnonzero(raw >= 0x10000)
        norm[far] = [ord(_lower(chr(c))) for c in raw[far].tolist()]
        out = _hashed(norm, a, b)
        for i in np.flatnonzero(end - begin > 64).tolist():  # of long words the ends count
            out[i] = word_hash(_word(texts[self.text[i]], int(self.starts[i]), int(self.ends[i])))
        return out


def _hashed(norm: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the stretches a..b."""
    out = np.zeros(len(a), np.uint64)
    longest = int((b - a).max(initial=0))
    order = np.argsort(a - b, kind="stable")
    alive = np.searchsorted((a - b)[order], -np.arange(1, min(longest, 64) + 1), "right")
    for k, n in enumerate(alive.tolist()):
        at = order[:n]
        out[at] = out[at] * np.uint64(_BASE) + norm[a[at] + k] + np.uint64(1)
    return out


def word_hash(word: str) -> int:
    """The same hash of a word as contexts have it."""
    out = 0
    for c in word[:64]:
        out = (out * _BASE + ord(c) + 1) % 2**64
    return out


class Words:
    """The words of a text, parted by white space."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts.tolist(), ends.tolist()

    def word(self, i: int) -> str | None:
        return _word(self.text, self.starts[i], self.ends[i]) if 0 <= i < len(self.starts) else None

    def contexts(self, start: int, end: int) -> list[str]:
        """The patterns around a span: the two words before it, and the words on both sides."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        before = [w for w in (self.word(i - 2), self.word(i - 1)) if w is not None]
        if prefix := _word(self.text, self.starts[i], start):
            before.append(prefix)
        after = _word(self.text, end, self.ends[j]) or self.word(j + 1)
        out = []
        if len(before) >= 2:
            out.append(f"1 {before[-2]} {before[-1]}")
        if before and after is not None:
            out.append(f"2 {before[-1]} {after}")
        return out


def _values(text: str, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """The places of all strings that may be identifiers, in order, in linear time."""
    end = len(text) if end is None else end
    found = [m.span() for m in _TOKEN.finditer(text, begin, end)]
    joined = [m.span() for m in _AT.finditer(text, begin, end)] if ("[" in text or "(" in text) and "at" in text else []
    out, last, j = [], False, 0
    for a, b in found:
        while j < len(joined) and joined[j][1] <= a:
            j += 1
        if j < len(joined) and joined[j][0] <= a:
            if not out or out[-1] != joined[j]:
                out.append(joined[j])
            last = False
        elif b - a > LONGEST:
            out += [m.span() for m in _PIECE.finditer(text, a, b)]
            last = False
        else:
            number = bool(_NUMBER.fullmatch(text, a, b))
            if number and last and a == out[-1][1] + 1 and text[a - 1] == " " and b - out[-1][0] <= LONGEST:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            last = number
    return [(a, a + len(text[a:b].rstrip(".:!?)*#$%&"))) for a, b in out]


def _many_digits(s: str) -> bool:
    return len(_DIGIT.findall(s)) >= 4


def _scan(texts: list[str]) -> list[tuple[list, list]]:
    """For each text the base spans, and strings with four or more digits, with their contexts."""
    spans = [base_spans(t) for t in texts]
    asked = [i for i, t in enumerate(texts) if spans[i] or _DIGIT.search(t)]
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    table = Table([texts[i] for i in asked])
    for i, at in enumerate(asked):
        text, base, seen = texts[at], spans[at], []
        own = slice(table.first[i], table.first[i + 1])
        numbers = np.flatnonzero(table.digits[own])
        if len(numbers):
            words, taken = Words(text, table.starts[own], table.ends[own]), Covered(base)
            seen = [{"kind": k, "start": a, "end": b, "value": text[a:b], "patterns": words.contexts(a, b)} for k, a, b in base]
            if _SEVERAL.search(text):
                places = _values(text)
            else:
                places = [v for j in numbers.tolist() for v in _values(text, words.starts[j], words.ends[j])]
            for a, b in places:
                if b > a and _many_digits(text[a:b]) and not taken.meets(a, b):
                    seen.append({"kind": "", "start": a, "end": b, "value": text[a:b], "patterns": words.contexts(a, b)})
        elif base:
            words = Words(text, table.starts[own], table.ends[own])
            seen = [{"kind": k, "start": a, "end": b, "value": text[a:b], "patterns": words.contexts(a, b)} for k, a, b in base]
        out[at] = [{"kind": k, "start": a, "end": b} for k, a, b in base], seen
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _key(kind: int | np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of patterns, from their words' hashes."""
    return ((first * _ODD) ^ second ^ np.asarray(kind, np.uint64)) * _ODD


def _pattern_keys(patterns: list[str]) -> np.ndarray:
    parts = [p.split(" ") for p in patterns]
    first, second = (np.array([word_hash(p[i]) for p in parts], np.uint64) for i in (1, 2))
    return _key(np.array([int(p[0]) for p in parts], np.uint64), first, second)


def _value_keys(values: list[str]) -> np.ndarray:
    """Numbers of strings themselves."""
    return _key(4, np.array([xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass")) for v in values], np.uint64), np.uint64(0))


def _surrounded(texts: list[str], own: Filter, without: np.ndarray | None = None, known: Filter | None = None) -> list[list]:
    """For each text, strings with fewer digits that a pattern of the filter surrounds, with these patterns.

    Patterns whose numbers are in ``without`` are left out; with ``known``, so are strings that don't pass it.
    """
    table, out = Table(texts), [[] for _ in texts]
    without = np.empty(0, np.uint64) if without is None else without
    h, of = table.hashes(), table.text
    begins = table.inside | table.edged

    def passes(keys: np.ndarray) -> np.ndarray:
        at = own.passes(keys)
        return at[~np.isin(keys[at], without)]

    if known:
        begins |= table.ends - table.starts > 64
        begins[known.passes(_key(3, h, np.uint64(0)))] = True
    elif len(h) > 2:
        same = of[:-2] == of[2:]
        first = 2 + passes(_key(1, h[:-2], h[1:-1]))
        begins[first[same[first - 2]]] = True
        middle = 1 + passes(_key(2, h[:-2], h[2:]))
        begins[middle[same[middle - 1]]] = True
    for i, text in enumerate(texts):
        part = slice(table.first[i], table.first[i + 1])
        # a value of several words has its next word further on
        whole = bool(("[" in text or "(" in text or table.digits[part].any()) and _SEVERAL.search(text))
        at = np.flatnonzero(begins[part])
        if not whole and not len(at):
            continue
        words, base = Words(text, table.starts[part], table.ends[part]), Covered(base_spans(text))
        if whole:
            begun = {k for j in at.tolist() for k in range(words.starts[j], words.ends[j])}
            every = [(a, b) for a, b in _values(text) if a in begun or " " in text[a:b]]
        else:
            every = [v for j in at.tolist() for v in _values(text, words.starts[j], words.ends[j])]
        if known:
            passed = known.passes(_value_keys([text[a:b] for a, b in every]))
            every = [every[k] for k in passed.tolist()]
        every = [(a, b) for a, b in every if b > a and not _many_digits(text[a:b]) and not base.meets(a, b)]
        around = [words.contexts(a, b) for a, b in every]
        flat = [p for one in around for p in one]
        good = np.zeros(len(flat), bool)
        good[passes(_pattern_keys(flat))] = True
        k = 0
        for (a, b), patterns in zip(every, around, strict=True):
            kept = [p for p, ok in zip(patterns, good[k : k + len(patterns)], strict=True) if ok]
            k += len(patterns)
            if kept:
                out[i].append({"kind": "", "start": a, "end": b, "value": text[a:b], "patterns": kept})
    return out


def _edges(strings: DataFrame) -> DataFrame:
    return write_table(strings.select("kind", "value", F.explode("patterns").alias("pattern")).distinct(), "edges")


def _seeds(edges: DataFrame) -> DataFrame:
    return edges.where("kind <> ''").select("value", "kind").distinct().withColumn("score", F.lit(1.0))


def _hits(edges: DataFrame, known: DataFrame) -> DataFrame:
    return edges.select("value", "pattern").distinct().join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("hits"))


def _trusted(hits: DataFrame, values: DataFrame, confidence: float, support: int) -> DataFrame:
    # one value in hand for each pattern, so that few hits don't make a sure pattern
    trusted = hits.join(values, "pattern").withColumn("confidence", F.col("hits") / (F.col("values") + 1)).where((F.col("confidence") >= confidence) & (F.col("hits") >= support))
    return write_table(trusted.select("pattern", "kind", "confidence"), "patterns")


def _known(edges: DataFrame, trusted: DataFrame, seeds: DataFrame, confidence: float) -> DataFrame:
    found = edges.where("kind = ''").join(trusted.withColumnRenamed("kind", "as"), "pattern").groupBy("value", F.col("as").alias("kind"))
    found = found.agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score")).where(F.col("score") >= confidence)
    return seeds.unionByName(found.join(seeds.select("value").distinct(), "value", "left_anti"))


def bootstrap(strings: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind and confidence of the patterns that rounds of scoring leave trusted.

    ``strings`` has kind ('' where unknown), value and patterns.
    """
    edges = _edges(strings)
    values = edges.groupBy("pattern").agg(F.count_distinct("value").alias("values"))
    seeds = known = _seeds(edges)
    trusted = None
    for _ in range(rounds):
        trusted = _trusted(_hits(edges, known), values, confidence, support)
        known = _known(edges, trusted, seeds, confidence)
    return trusted


def _pattern_bloom(patterns: DataFrame):
    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_pattern_keys(b.column(0).to_pylist()).view(np.int64))], names=["key"])

    return bloom(patterns.select("pattern").mapInArrow(keys, "key long"))


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - LIMITS)).astype(np.int64)


def _batches(batches):
    """Texts of about a million characters at a time, null as empty."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(0)), 0).to_pylist()
        for i, j in runs(sizes, 1_000_000):
            yield [t or "" for t in b.column(0).slice(i, j - i).to_pylist()]


def _strings_at(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """pattern and value of all strings with few digits at the places of ``asked`` patterns.

    These have ``most``, the number of values beyond which they cannot be trusted. Where a task
    meets more, it gives one row for the pattern, with no value and this many in ``least``.
    """

    def slots(batches):
        for b in batches:
            at = _slot(_pattern_keys(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], names=["slot", "most"])

    shared = _pattern_bloom(asked)
    # a table of fixed size: at most 2^LIMITS numbers reach the driver
    got = asked.select("pattern", "most").mapInArrow(slots, "slot long, most long").groupBy("slot").agg(F.max("most").alias("most")).toArrow()
    limits = np.zeros(1 << LIMITS, np.int64)
    limits[got.column("slot").to_numpy()] = got.column("most").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(limits)

    def run(batches):
        own, limits, without = Filter(shared.value), sent.value, np.empty(0, np.uint64)
        held: dict[str, tuple[set[str] | None, int]] = {}
        for texts in _batches(batches):
            over = []
            for found in _surrounded(texts, own, without):
                for s in found:
                    for p in s["patterns"]:
                        if p not in held:
                            held[p] = set(), int(limits[_slot(_pattern_keys([p]))[0]])
                        values, most = held[p]
                        if values is None:
                            continue
                        values.add(s["value"])
                        if len(values) > most:
                            held[p] = None, most
                            over.append(p)
            if over:
                without = np.sort(np.concatenate([without, _pattern_keys(over)]))
        rows = ((p, v, 0) if v is not None else (p, None, most + 1) for p, (values, most) in held.items() for v in ([None] if values is None else values))
        yield from _rows(rows)

    kinds = "pattern string, value string, least long"
    return docs.select("text").mapInArrow(run, kinds).join(asked.select("pattern"), "pattern", "left_semi")


def _rows(rows):
    """Batches of rows (pattern, value, least)."""
    while part := list(islice(rows, 50_000)):
        p, v, n = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(v, pa.string()), pa.array(n, pa.int64())], names=["pattern", "value", "least"])


def _places_of(docs: DataFrame, values: DataFrame, able: DataFrame) -> DataFrame:
    """pattern and value of all places of ``values`` that ``able`` patterns surround."""

    def keys(batches):
        for b in batches:
            held = b.column(0).to_pylist()
            of_words = np.array([word_hash(_word(v)) for v in held], np.uint64)
            both = np.concatenate([_key(3, of_words, np.uint64(0)), _value_keys(held)])
            yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64))], names=["key"])

    shared, strings = _pattern_bloom(able), bloom(values.select("value").mapInArrow(keys, "key long"))

    def run(batches):
        own, known = Filter(shared.value), Filter(strings.value)
        for texts in _batches(batches):
            yield from _rows(iter({(p, s["value"], 0) for found in _surrounded(texts, own, known=known) for s in found for p in s["patterns"]}))

    found = docs.select("text").mapInArrow(run, "pattern string, value string, least long").select("pattern", "value").distinct()
    return found.join(able, "pattern", "left_semi").join(values, "value", "left_semi")


def confirmed(docs: DataFrame, seen: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """What ``bootstrap`` gives over ``seen`` and all strings with few digits at its able patterns.

    Able are those with enough known values, and those that ``bootstrap`` trusts by ``seen`` alone. The
    graph is not written out: a round needs the places of known values, and all values of the
    patterns that it would otherwise trust.
    """
    edges = _edges(seen)
    # only patterns with enough known values can be trusted: those of seeds, and of what these lead to
    seeded = edges.where("kind <> ''").select("value", "pattern").distinct().groupBy("pattern").count().where(F.col("count") >= support)
    able = write_table(seeded.select("pattern").union(bootstrap(seen, confidence, support, rounds).select("pattern")).distinct(), "able")
    seeds = known = _seeds(edges)
    many = F.length(F.regexp_replace("value", "[^0-9]", "")) >= 4
    gathered = seeds.select("value").distinct()
    least = trusted = None
    for k in range(rounds):
        if k:
            # what the last round found, wherever else it stands
            new = write_table(known.select("value").distinct().where(~many).join(gathered, "value", "left_anti"), "new")
            gathered = gathered.union(new)
            if not new.isEmpty():
                more = _places_of(docs, new, able).select(F.lit("").alias("kind"), "value", "pattern")
                edges = write_table(edges.unionByName(more).distinct(), "edges")
        hits = write_table(_hits(edges, known), "hits")
        best = hits.groupBy("pattern").agg(F.max("hits").alias("hits")).where(F.col("hits") >= support).join(able, "pattern", "left_semi")
        ask = best.join(_counted(edges, least), "pattern").where(F.col("hits") / (F.col("values") + 1) >= confidence)
        if least is not None:  # not those whose values are all in hand
            ask = ask.join(least.where("least = 0"), "pattern", "left_anti")
        ask = write_table(ask.select("pattern", F.floor(F.col("hits") / confidence - 1 + 1e-6).alias("most")), "ask")
        if not ask.isEmpty():
            got = write_table(_strings_at(docs, ask), "strings")
            marks = ask.select("pattern").join(got.groupBy("pattern").agg(F.max("least").alias("least")), "pattern", "left").na.fill(0)
            old = marks if least is None else least.join(ask, "pattern", "left_anti").unionByName(marks)
            least = write_table(old, "least")
            whole = got.join(least.where("least = 0"), "pattern", "left_semi").select(F.lit("").alias("kind"), "value", "pattern")
            edges = write_table(edges.unionByName(whole).distinct(), "edges")
            drop_tables(got)
        trusted = _trusted(hits, _counted(edges, least), confidence, support)
        if trusted.isEmpty():
            break
        known = _known(edges, trusted, seeds, confidence)
    return trusted


def _counted(edges: DataFrame, least: DataFrame | None) -> DataFrame:
    """pattern and the number of its values, or what is known to be fewer."""
    values = edges.groupBy("pattern").agg(F.count_distinct("value").alias("values"))
    if least is None:
        return values
    return values.join(least, "pattern", "left").select("pattern", F.greatest("values", F.coalesce("least", F.lit(0))).alias("values"))


def find_pii(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, ``base`` (kind, start, end) and ``more`` (the same, kinds ``like_<kind>``) for each row.

    Places are code points, end exclusive. Null and empty texts have no spans; long texts are read
    whole. Repeated rows and rows without a doc_id have their own result each; rows with the same
    text have the same spans and count once in the graph. Of patterns that surround one string the
    one of most confidence names its kind, ties going to the later name. An empty table gives no
    rows; further columns are ignored, whatever their names.
    """

    def first():
        def fn(texts: list[str]) -> dict:
            got = _scan(texts)
            return {"key": [_text_key(t) for t in texts], "base": [g[0] for g in got], "strings": [g[1] for g in got]}

        return fn

    def second():
        own = Filter(shared.value)

        def fn(texts: list[str]) -> dict:
            return {"key": [_text_key(t) for t in texts], "strings": _surrounded(texts, own)}

        return fn

    span = "struct<kind: string, start: long, end: long>"
    string = "struct<kind: string, start: long, end: long, value: string, patterns: array<string>>"
    scanned = write_table(map_texts(docs, f"doc_id long, key string, base array<{span}>, strings array<{string}>", first), "scan")
    each = lambda df: df.where(F.size("strings") > 0).select("key", F.explode("strings").alias("s")).select("key", "s.*").distinct()
    seen = write_table(each(scanned), "strings")
    trusted = confirmed(docs, seen, confidence, support, rounds)
    fresh = seen.where("kind = ''").select("key", "start", "end", "patterns")
    if not trusted.isEmpty():
        shared = _pattern_bloom(trusted)
        others = map_texts(docs, f"doc_id long, key string, strings array<{string}>", second)
        fresh = fresh.unionByName(others.select("key", F.explode("strings").alias("s")).select("key", "s.start", "s.end", "s.patterns"))
    # what passed the filter, less what isn't one of the patterns
    fresh = fresh.select("key", "start", "end", F.explode("patterns").alias("pattern")).join(trusted.withColumnRenamed("kind", "as"), "pattern")
    best = fresh.groupBy("key", "start", "end").agg(F.max(F.struct("confidence", "as")).alias("b"))
    more = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.concat(F.lit("like_"), "b.as").alias("kind")))).alias("more"))
    more = more.select("key", F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("more"))
    more = write_table(more, "more")
    drop_tables(seen)
    none = F.array().cast(f"array<{span}>")
    # many rows may share a text: they are dealt over copies of its spans
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    left = scanned.select("doc_id", "key", "base", salt.alias("salt"))
    right = more.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["key", "salt"], "left").select("doc_id", "base", F.coalesce("more", none).alias("more"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a hash of the base spans, all spans as text, and their number.

    Null and empty texts have counts of 0 and the hash of nothing; the rest is as in ``find_pii``.
    """
    got = find_pii(docs)
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform("base", line), ",")
    every = F.array_join(F.transform(F.concat("base", "more"), line), ",")
    return got.select("doc_id", *(count(k) for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"))
