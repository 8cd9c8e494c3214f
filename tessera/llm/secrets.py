"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary spends few tokens on words and many on random characters. Strings of
letters, digits and the signs of base-64 that have few characters a token are taken for secrets
of kind ``random``, after known digests (hexadecimal of digest lengths) and identifiers (UUIDs,
dates, numbers, addresses of mail and web) are set aside. Only a whole address around a string sets it
aside: of a web address that is host and path, not a password before the host nor the query.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Covered, map_texts
from .pii import _emails

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more: the longest match from its start
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_STRING = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PATH = r"(?:/[^\s?#\"'<>]*)?"
_URL = re.compile(r"://([^\s/?#\"'<>@]*@)?([A-Za-z0-9.-]+(?::[0-9]+)?" + _PATH + ")")
_HOST = re.compile(r"(?<![A-Za-z0-9_.-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,15}(?![A-Za-z0-9_+=-]|\.[A-Za-z0-9])" + _PATH)
#: Fewer characters a token than this are a random string.
RATIO = 2.1
#: Lengths of the usual digests in hexadecimal: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if _HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _known(s: str) -> bool:
    """Digests and identifiers."""
    if re.fullmatch(r"[0-9a-fA-F]+", s) and len(s) in DIGESTS:
        return True
    if _UUID.fullmatch(s) or re.fullmatch(r"[0-9_=/+-]+", s):
        return True
    return len({*s}) < 8  # rules and repeated signs


def addresses(text: str) -> Covered:
    """Mail addresses, hosts, and web addresses up to the query."""
    urls = [*_URL.finditer(text)]
    logins = Covered([("login", *m.span(1)) for m in urls if m[1]])  # no mail address, though it looks like one
    out = [e for e in _emails(text) if not logins.meets(e[1], e[2])]
    out += [("url", m.start(2) if m[1] else m.start(), m.end()) for m in urls]
    out += [("host", m.start(), m.end()) for m in _HOST.finditer(text)]
    return Covered(out)


def random_spans(text: str, tokens: Callable[[str], int], ratio: float = RATIO) -> list[tuple[str, int, int]]:
    out = []
    for m in _STRING.finditer(text):
        s = m[0]
        if not _known(s.strip("=-_/+")) and len(s) / tokens(s) < ratio:
            out.append(("random", m.start(), m.end()))
    if out:
        known = addresses(text)
        out = [r for r in out if not known.holds(r[1], r[2])]
    return out


def vocabulary(path: str) -> Callable[[str], int]:
    """Counts tokens under a file of byte-pair ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(coder.encode_ordinary(s))


def scan(text: str, tokens: Callable[[str], int]) -> list[tuple[str, int, int]]:
    """All spans by start, then kind; random strings that a base span covers are not repeated."""
    base = base_spans(text)
    covered = Covered(base)
    more = [r for r in random_spans(text, tokens) if not covered.holds(r[1], r[2])]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


_coders: dict[str, Callable[[str], int]] = {}


def _coder(path: str) -> Callable[[str], int]:
    if path not in _coders:
        _coders[path] = vocabulary(path)
    return _coders[path]


def find_secrets(docs: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: its ``keep`` columns and ``spans``, an array of (kind, start, end, text).

    Places are code points, end exclusive. Null and empty texts have no spans; long texts are read
    whole. Repeated rows and rows without a doc_id have their own spans each, equal texts equal ones;
    overlapping spans of different kinds all stand, in order of start, then kind. An empty table gives
    no rows; further columns are ignored, whatever their names.
    """

    def make():
        tokens = _coder(ranks_path)
        return lambda texts: {"found": [[{"kind": k, "start": a, "end": b, "text": t[a:b]} for k, a, b in scan(t, tokens)] for t in texts]}

    types = dict(docs.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return map_texts(docs, f"{head}, found array<struct<kind: string, start: long, end: long, text: string>>", make, keep=keep).withColumnRenamed("found", "spans")


def secret_digest(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, counts of the kinds, a hash of the base spans, and all spans as text.

    Null and empty texts have counts of 0 and the hash of nothing; the rest is as in ``find_secrets``.
    """
    got = find_secrets(docs, ranks_path)
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "random"), line), ",")
    return got.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


def redact(docs: DataFrame, ranks_path: str, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced; overlapping spans become one mark.

    Texts without secrets, null and empty texts stay as they are; ``n_chars`` follows the text. All
    rows (repeated ones and those without a doc_id too) and columns stay, whatever their names;
    long texts are cleaned whole; an empty table stays empty.
    """
    import pyarrow as pa

    schema = docs.schema
    at = docs.columns.index("text")

    def clean(text: str | None, tokens) -> str | None:
        if not text:
            return text
        out, done, to = [], 0, 0
        for _, a, b in scan(text, tokens):
            if a >= to:
                out += [text[done:a] if a > done else "", mark]
            to = max(to, b)
            done = to
        return "".join(out) + text[done:] if out else text

    def run(batches):
        tokens = _coder(ranks_path)
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([clean(t, tokens) for t in b.column(at).to_pylist()], pa.string())
            if "n_chars" in b.schema.names:
                n = b.schema.names.index("n_chars")
                old, was = b.column(n).to_pylist(), b.column(at).to_pylist()
                cols[n] = pa.array([o if w == t.as_py() else len(t.as_py()) for o, w, t in zip(old, was, cols[at], strict=True)], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, schema)
