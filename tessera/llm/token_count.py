"""Token counts by a finite-state tokenizer.

A byte-pair vocabulary is compiled, transition by transition as texts need them, into a
deterministic transducer over characters. It rests on a property of such vocabularies: the
encoding of a text's prefix ends in a token that is found from the tokens in which earlier
prefixes end. A token ``t`` ends prefix ``i`` when the prefix before ``t`` ends in a token ``u``
and the merges leave the pair ``u t`` apart; exactly one ``t`` does so.

A state therefore holds the tokens that may still be under way: for each, what has been read of
it, the token before it, and the number of tokens up to there relative to now; beginnings that no
token of the vocabulary can complete beside the token before are left out, which keeps the states
few. A transition is annotated with the change of the token count, so a text's count is the sum
over its path.

Texts are cut into chunks of equal length that run side by side. A chunk's map takes a start
state to its end state and count. Maps are evaluated at all start states that can occur: at the
state that a few characters of run-up suggest, and at every end state of the maps before, until
nothing new comes up; equal chunks share one map. The maps are then composed by a parallel prefix
scan (doubling), which gives every text's count and end state.

Transitions on the first classes of characters are a dense table, the others a hash table; both,
and the states, are bounded. A text of any length goes through in segments that hand on their end
state, so that the tables can be dropped in between.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SPACE = "▁"
#: Characters a chunk, and of its run-up; characters of a segment, and of one that is not cut further.
CHUNK, RUN_UP, SEGMENT, LEAST_SEGMENT = 512, 24, 2_000_000, 65_536
#: States and hashed transitions that are kept before the tables are built anew; classes with a dense column.
MOST_STATES, MOST_HASHED, DENSE = 1 << 17, 500_000, 128
#: Classes of characters outside the vocabulary, by their number of UTF-8 bytes.
_BYTES = 4


class Vocabulary:
    """Pieces with scores, as a byte-pair model of sentencepiece has them."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool = True, dummy_prefix: bool = False):
        self.scores = scores
        self.byte_fallback, self.dummy_prefix = byte_fallback, dummy_prefix
        self._grown: dict[str, list[str]] = {}
        for p in scores:
            for n in range(1, len(p)):
                self._grown.setdefault(p[:n], []).append(p)
        #: The highest score of the pieces that are longer than a beginning.
        self._top = {p: max(scores[t] for t in longer) for p, longer in self._grown.items()}
        self._parts: dict[str, tuple[str, str] | None] = {}
        self._edges: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.forget()

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only byte-pair models that leave the text as it is are compiled")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not compiled")
        return cls({p.piece: p.score for p in model.pieces if p.type == 1}, spec.byte_fallback, norm.add_dummy_prefix)

    def merge(self, text: str, parts: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The merges, highest score first and leftmost among equals; ``parts`` gets them."""
        sym: list[str | None] = list(text)
        left, right = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(sym) and (both := sym[i] + sym[j]) in self.scores:
                heapq.heappush(heap, (-self.scores[both], i, both))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i] if sym[i] is not None else len(sym)
            if j >= len(sym) or sym[i] + sym[j] != both:
                continue
            if parts is not None:
                parts[both] = (sym[i], sym[j])
            sym[i], sym[j] = both, None
            right[i] = right[j]
            if right[i] < len(sym):
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [x for x in sym if x is not None]

    def parts(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that merge last into this one; None for characters and unreachable pieces."""
        if piece not in self._parts:
            seen: dict[str, tuple[str, str]] = {}
            self._parts[piece] = seen.get(piece) if self.merge(piece, seen) == [piece] else None
        return self._parts[piece]

    def whole(self, piece: str) -> bool:
        return len(piece) == 1 or self.parts(piece) is not None

    def edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The pieces that stand at one edge (0 left, 1 right) while this one is merged, each with
        the score of the merge that ends it."""
        key = (piece, side)
        if key not in self._edges:
            out, now, ends = [], piece, -float("inf")
            while True:
                out.append((now, ends))
                if len(now) == 1:
                    break
                ends, now = self.scores[now], self.parts(now)[side]
            self._edges[key] = out
        return self._edges[key]

    def border(self, token: str) -> int:
        """What the right edge of a token can still do to the token after it.

        Kept, as a numbered tuple, are the pieces of the right edge with the scores of the merges
        that end them; tokens with the same border are followed alike.
        """
        if token[-1] == SPACE:  # runs of spaces share one score; there the order is replayed
            return self._number(((token, None),))
        return self.narrow(self._number(tuple(self.edge(token, 1))), "")

    def _number(self, border: tuple) -> int:
        found = self._numbers.get(border)
        if found is None:
            found = self._numbers[border] = len(self.borders)
            self.borders.append(border)
        return found

    def narrow(self, border: int, read: str) -> int:
        """The border without the pieces that can't merge across it once ``read`` follows."""
        key = (border, read)
        found = self._narrow.get(key)
        if found is None:
            kept = self.borders[border]
            if kept and kept[0][1] is not None:
                low, score, top = -float("inf"), self.scores, self._top
                kept = tuple((x, ends) for x, ends in kept if top.get(x + read, low) > ends or any(score.get(x + read[:k], low) > ends for k in range(1, len(read) + 1)))
            found = self._narrow[key] = self._number(kept)
        return found

    def apart(self, border: int, token: str) -> bool:
        """Whether the merges leave ``token`` beside a token with this border.

        They don't where two pieces at the border form a piece whose merge is due before either
        is merged into its own token; among equal scores the leftmost is due first.
        """
        pieces = self.borders[border]
        if not pieces:
            return True
        if pieces[0][1] is None:
            return self.merge(pieces[0][0] + token) == [pieces[0][0], token]
        for x, x_ends in pieces:
            for y, y_ends in self.edge(token, 0):
                score = self.scores.get(x + y)
                if score is not None and score > x_ends and score >= y_ends:
                    return False
        return True

    def open(self, border: int, begun: str) -> bool:
        """Whether some longer token that begins so can stand beside this border."""
        longer = self._grown.get(begun)
        if not longer or not self.borders[border]:
            return bool(longer)
        key = (border, begun)
        found = self._open.get(key)
        if found is None:
            found = self._open[key] = any(self.whole(t) and self.apart(border, t) for t in longer)
        return found

    def forget(self) -> None:
        """Drop what is kept about borders; it comes again as texts need it."""
        self.borders: list[tuple] = [()]
        self._numbers: dict[tuple, int] = {(): 0}
        self._narrow: dict[tuple[int, str], int] = {}
        self._open: dict[tuple[int, str], bool] = {}


class _Full(Exception):
    """The tables have reached their bound."""


class Transducer:
    """The transducer of a vocabulary; states and transitions appear as texts need them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.bounded = True
        self.classes = np.full(0x110000, -1, np.int16)
        self.numbers: dict[str, int] = {}
        self.chars: list[str] = []
        self.reset()

    def reset(self) -> None:
        self.v.forget()
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next = np.full((1024, DENSE), -1, np.int32)
        self.emit = np.zeros((1024, DENSE), np.int16)
        self.hashed = 0
        self._empty_hash(1 << 12)
        self.start = self._state((("", 0, 0),))

    def _empty_hash(self, size: int) -> None:
        self.h_key, self.h_next, self.h_emit = np.full(size, -1, np.int64), np.full(size, -1, np.int32), np.zeros(size, np.int16)

    def _state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            if self.bounded and len(self.states) >= MOST_STATES:
                raise _Full
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            if found >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return found

    def whole_state(self, state: int) -> tuple:
        """A state in words, so that it outlives the tables."""
        return tuple((read, self.v.borders[border], n) for read, border, n in self.states[state])

    def numbered(self, whole: tuple) -> int:
        return self._state(tuple((read, self.v._number(border), n) for read, border, n in whole))

    def encode(self, text: str) -> np.ndarray:
        """The class of each character."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        got = self.classes[code]
        if (got < 0).any():
            for c in np.unique(code[got < 0]):
                ch = SPACE if c == 0x20 else chr(c)
                if ch in self.v.scores:
                    if ch not in self.numbers:
                        self.numbers[ch] = len(self.chars)
                        self.chars.append(ch)
                    self.classes[c] = _BYTES + self.numbers[ch]
                else:
                    self.classes[c] = len(ch.encode("utf-8", "surrogatepass")) - 1 if self.v.byte_fallback else 0
            got = self.classes[code]
        return got

    def _compile(self, state: int, cls: int) -> None:
        """Add the transition of one state on one class.

        A state has (read, border, count) for each token that may be under way: what has been
        read of it, the border of the token before it and the count there relative to now.
        """
        if cls < _BYTES:
            self.next[state, cls], self.emit[state, cls] = self.start, cls + 1 if self.v.byte_fallback else 1
            return
        ch, v = self.chars[cls - _BYTES], self.v
        grown = [(read + ch, border, n) for read, border, n in self.states[state]]
        token, change = next((t, n + 1) for t, border, n in grown if t in v.scores and v.whole(t) and v.apart(border, t))
        key = tuple((read, v.narrow(border, read), n - change) for read, border, n in grown if v.open(border, read))
        to = self._state((*key, ("", v.border(token), 0)))
        if cls < DENSE:
            self.next[state, cls], self.emit[state, cls] = to, change
        else:
            self._keep(state, cls, to, change)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.h_key).bit_length())).astype(np.int64)

    def _keep(self, state: int, cls: int, to: int, change: int) -> None:
        if self.bounded and self.hashed >= MOST_HASHED:
            raise _Full
        if 4 * self.hashed >= len(self.h_key):
            old = self.h_key, self.h_next, self.h_emit
            self._empty_hash(4 * len(self.h_key))
            at = np.flatnonzero(old[0] >= 0)
            for slot, i in zip(self._slots(old[0][at]).tolist(), at.tolist(), strict=True):
                self._put(slot, *(o[i] for o in old))
        key = state << 16 | cls
        self._put(int(self._slots(np.array([key]))[0]), key, to, change)
        self.hashed += 1

    def _put(self, slot: int, key: int, to: int, change: int) -> None:
        while self.h_key[slot] >= 0:
            slot = (slot + 1) % len(self.h_key)
        self.h_key[slot], self.h_next[slot], self.h_emit[slot] = key, to, change

    def _hash_step(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states.astype(np.int64) << 16 | classes
        slot = self._slots(keys)
        while True:
            got = self.h_key[slot]
            other = (got != keys) & (got >= 0)
            if not other.any():
                break
            slot[other] = (slot[other] + 1) % len(self.h_key)
        return self.h_next[slot], self.h_emit[slot]

    def _look(self, states: np.ndarray, classes: np.ndarray, dense: bool) -> tuple[np.ndarray, np.ndarray]:
        if dense:
            return self.next[states, classes], self.emit[states, classes]
        low = np.minimum(classes, DENSE - 1)
        to, emitted = self.next[states, low], self.emit[states, low]
        far = np.flatnonzero(classes >= DENSE)
        if len(far):
            to[far], emitted[far] = self._hash_step(states[far], classes[far])
        return to, emitted

    def step(self, states: np.ndarray, classes: np.ndarray, dense: bool = False) -> tuple[np.ndarray, np.ndarray]:
        to, emitted = self._look(states, classes, dense)
        if to.min(initial=0) < 0:
            new = to < 0
            for s, c in {*zip(states[new].tolist(), classes[new].tolist(), strict=True)}:
                self._compile(s, c)
            to, emitted = self._look(states, classes, dense)
        return to, emitted

    def run(self, classes: np.ndarray, begin: np.ndarray, length: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's map at one start state: its end state and its count."""
        order = np.argsort(-length, kind="stable")
        begin, length, states = begin[order], length[order], states[order].copy()
        count = np.zeros(len(begin), np.int64)
        alive = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        dense = len(self.chars) + _BYTES <= DENSE
        for t, n in enumerate(alive):
            to, emitted = self.step(states[:n], classes[begin[:n] + t], dense)
            states[:n] = to
            count[:n] += emitted
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return states[back], count[back]

    def maps(self, classes: np.ndarray, begin: np.ndarray, length: np.ndarray, states: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, list[dict[int, tuple[int, int]]]]:
        """The kind of each chunk, equal chunks being of one kind, and each kind's map.

        ``states`` has each chunk's first start state. A map also holds every end state of the maps
        that stand before it.
        """
        kinds: dict[bytes, int] = {}
        kind = np.array([kinds.setdefault(classes[a : a + n].tobytes(), len(kinds)) for a, n in zip(begin.tolist(), length.tolist(), strict=True)], np.int64)
        _, of = np.unique(kind, return_index=True)
        after: list[set[int]] = [set() for _ in of]
        for i in np.flatnonzero(nth > 0).tolist():
            after[kind[i - 1]].add(int(kind[i]))
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in of]
        todo = {*zip(kind.tolist(), states.tolist(), strict=True)}
        while todo:
            which, first = (np.array(x, np.int64) for x in zip(*sorted(todo), strict=True))
            end, count = self.run(classes, begin[of[which]], length[of[which]], first.astype(np.int32))
            for k, s, e, c in zip(which.tolist(), first.tolist(), end.tolist(), count.tolist(), strict=True):
                maps[k][s] = e, c
            todo = {(k, e) for w, e in zip(which.tolist(), end.tolist(), strict=True) for k in after[w] if e not in maps[k]}
        return kind, maps

    def scan(self, classes: np.ndarray, lengths: np.ndarray, starts: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """The count and the end state of each of several texts in a row, none of them empty."""
        first = np.cumsum(lengths) - lengths
        chunks = -(-lengths // chunk)
        last = np.cumsum(chunks) - 1
        owner = np.repeat(np.arange(len(lengths)), chunks)
        nth = np.arange(len(owner)) - (last - chunks + 1)[owner]
        begin = first[owner] + nth * chunk
        length = np.minimum(chunk, first[owner] + lengths[owner] - begin)
        states = starts[owner].astype(np.int32)
        later = np.flatnonzero(nth > 0)
        if len(later):
            up = min(RUN_UP, chunk)
            states[later], _ = self.run(classes, begin[later] - up, np.full(len(later), up), np.full(len(later), self.start, np.int32))
        kind, maps = self.maps(classes, begin, length, states, nth)
        # a map as an array: the place in the next chunk's map, or of the end state, and the count
        width = max(map(len, maps))
        place = [{s: i for i, s in enumerate(m)} for m in maps]
        to, count = np.zeros((len(kind), width), np.int64), np.zeros((len(kind), width), np.int64)
        made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        final = np.zeros(len(kind), bool)
        final[last] = True
        for i, (k, end) in enumerate(zip(kind.tolist(), final.tolist(), strict=True)):
            pair = k, -1 if end else int(kind[i + 1])
            if pair not in made:
                got = list(maps[k].values())
                made[pair] = np.array([e if end else place[pair[1]][e] for e, _ in got]), np.array([c for _, c in got])
            to[i, : len(made[pair][0])], count[i, : len(made[pair][0])] = made[pair]
        step = 1
        while step < int(chunks.max(initial=0)):
            at = np.flatnonzero(nth >= step)
            before, added = to[at - step], count[at - step]
            to[at], count[at] = np.take_along_axis(to[at], before, 1), added + np.take_along_axis(count[at], before, 1)
            step *= 2
        k0 = np.array([place[kind[i]][s] for i, s in zip((last - chunks + 1).tolist(), starts.tolist(), strict=True)])
        return count[last, k0], to[last, k0]

    def _segment(self, parts: list[tuple[int, str]], carried: dict[int, tuple], total: np.ndarray, chunk: int) -> None:
        """Count parts of texts, each by its text's number; a text's state is carried on in words."""
        try:
            starts = np.array([self.numbered(carried[i]) if i in carried else self.start for i, _ in parts])
            classes = self.encode("".join(t for _, t in parts))
            if self.v.dummy_prefix:  # a space before each text that isn't empty
                new = np.array([i not in carried for i, _ in parts])
                to, emitted = self.step(np.array([self.start]), self.encode(" "))
                starts[new] = to[0]
            else:
                new, emitted = np.zeros(len(parts), bool), np.zeros(1, np.int64)
            count, end = self.scan(classes, np.array([len(t) for _, t in parts]), starts, chunk)
        except _Full:
            self.reset()
            size = sum(len(t) for _, t in parts)
            if size <= LEAST_SEGMENT:
                self.bounded = False  # so short a text can't take much
                try:
                    self._segment(parts, carried, total, chunk)
                finally:
                    self.bounded = True
                    self.reset()
                return
            for half in _cut(parts, -(-size // 2)):
                self._segment(half, carried, total, chunk)
            return
        for (i, _), n, first in zip(parts, count.tolist(), new.tolist(), strict=True):
            total[i] += n + (int(emitted[0]) if first else 0)
        carried[parts[-1][0]] = self.whole_state(int(end[-1]))  # only the last text can go on

    def count(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        """The number of tokens of each text."""
        total, carried = np.zeros(len(texts), np.int64), {}
        for parts in _cut([(i, t) for i, t in enumerate(texts) if t], SEGMENT):
            self._segment(parts, carried, total, chunk)
        return total


def _cut(parts: list[tuple[int, str]], most: int):
    """The parts in segments of at most ``most`` characters, long ones cut."""
    held, size = [], 0
    for i, text in parts:
        at = 0
        while at < len(text):
            piece = text[at : at + most - size]
            held.append((i, piece))
            at, size = at + len(piece), size + len(piece)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


_compiled: dict[str, Transducer] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of ``docs``.

    Null and empty texts count 0; texts of any length are counted whole, in bounded memory. Repeated
    rows are counted each; a null doc_id stays null; an empty table gives no rows; further columns
    are ignored, whatever their names. ``model_path`` must exist on every worker.
    """

    def make():
        if model_path not in _compiled:
            _compiled[model_path] = Transducer(Vocabulary.from_sentencepiece(model_path))
        t = _compiled[model_path]

        def fn(texts: list[str]) -> dict:
            return {"n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts], "n_tokens": t.count(texts)}

        return fn

    out = map_texts(docs, "doc_id long, n_bytes long, n_tokens long", make, most=2_000_000)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
