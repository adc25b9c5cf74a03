"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model's normaliser is compiled into two sequential transducers over characters (its rewriting
rules, and how spaces are treated), its pieces and byte fallback into a weighted one. Each input is
composed with them on the fly, and the path of least weight (tropical semiring) is read off by a
best-first search. A unigram model weighs a piece by its negative score. For a BPE model weights of
pieces alone could not give the encoding: there the state also holds the last piece, and an arc to a
piece that merging would not leave beside it weighs infinity, any other nothing, so that the one
path of finite weight is the BPE encoding. A character without a piece has an arc to its bytes'
pieces, heavier than any piece.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush, heappushpop
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, plus, rows_of

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: The model file's codes for kinds of pieces and models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: By how much an unknown character weighs more than the heaviest piece.
UNKNOWN_COST = 10.0
#: Most paths that a worker remembers.
REMEMBERED = 200_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message of the protocol-buffers wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


@dataclass
class Model:
    """Pieces (text, score, kind) in order of id, and how texts are normalised."""

    pieces: list[tuple[str, float, int]]
    kind: int = BPE
    byte_fallback: bool = False
    rules: dict[str, str] = field(default_factory=dict)
    dummy_prefix: bool = True
    squeeze: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls([], UNIGRAM, squeeze=True)
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                model.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], got.get(3, NORMAL)))
            elif number == 2:
                got = dict(_fields(value))
                model.kind, model.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
                if got.get(24, 0):
                    raise ValueError("pieces that end in white space are not supported")
            elif number == 3:
                got = dict(_fields(value))
                model.rules = _charsmap(got.get(2, b""))
                model.dummy_prefix, model.squeeze = bool(got.get(3, 1)), bool(got.get(4, 1))
                if not got.get(5, 1):
                    raise ValueError("models that keep spaces as they are are not supported")
        return model


def _charsmap(data: bytes) -> dict[str, str]:
    """The rewriting rules of a precompiled map: a double-array trie of keys, then the values, each ended by a zero byte."""
    if not data:
        return {}
    size = struct.unpack_from("<I", data)[0]
    units = struct.unpack_from(f"<{size // 4}I", data, 4)
    values, rules, open_ = data[4 + size :], {}, [(0, b"")]
    while open_:
        node, key = open_.pop()
        unit = units[node]
        base = node ^ ((unit >> 10) << ((unit & 512) >> 6))
        for c in range(256):
            child = base ^ c
            if child < len(units) and units[child] & 0x800000FF == c and (c or unit & 256):
                if not c:
                    at = units[child] & 0x7FFFFFFF
                    rules[key.decode()] = values[at : values.index(0, at)].decode()
                else:
                    open_.append((child, key + bytes([c])))
    return rules


class Trie:
    """A deterministic acceptor over characters; `out` holds what a final state stands for."""

    def __init__(self, words: dict):
        self.arcs: list[dict[str, int]] = [{}]
        self.out: list = [None]
        self.longest = max(map(len, words), default=0)
        for word, value in words.items():
            state = 0
            for c in word:
                state = self.arcs[state].setdefault(c, len(self.arcs))
                if state == len(self.out):
                    self.arcs.append({})
                    self.out.append(None)
            self.out[state] = value

        # what a walk that ends in a state has passed: (length, value), shortest first
        self.passed: list[tuple[tuple[int, object], ...]] = [()] * len(self.out)
        open_ = [(0, 0, ())]
        while open_:
            state, depth, found = open_.pop()
            if self.out[state] is not None:
                found = (*found, (depth, self.out[state]))
            self.passed[state] = found
            open_ += [(child, depth + 1, found) for child in self.arcs[state].values()]

    def matches(self, text: str, at: int) -> tuple[tuple[int, object], ...]:
        """(length, value) of the words that start here, shortest first."""
        state, arcs = 0, self.arcs
        for c in text[at : at + self.longest]:
            step = arcs[state].get(c)
            if step is None:
                break
            state = step
        return self.passed[state]


class Sequential:
    """A deterministic transducer over characters: `step` gives the next state and what is written, `final` what is written at the end."""

    start = 0

    def step(self, state: int, c: str) -> tuple[int, str]:
        raise NotImplementedError

    def final(self, state: int) -> str:
        return ""

    def write(self, text: str, state: int | None = None) -> str:
        """What the transducer writes for the text from the state on."""
        out, now, step = [], self.start if state is None else state, self.step
        for c in text:
            now, some = step(now, c)
            out.append(some)
        out.append(self.final(now))
        return "".join(out)


class Rules(Sequential):
    """Rewriting from left to right by the longest rule that fits; other characters are written as they are.

    States are those of the rules' trie. Where a state has no arc for a character, the longest rule
    passed is written, or one character as it is, and what was read after it is read again.
    """

    def __init__(self, rules: dict[str, str]):
        self.trie = Trie(rules)
        self.words = [""] * len(self.trie.arcs)
        open_ = [0]
        while open_:
            state = open_.pop()
            for c, child in self.trie.arcs[state].items():
                self.words[child] = self.words[state] + c
                open_.append(child)
        self._fallen: dict[int, tuple[str, str]] = {}

    def _fall(self, state: int) -> tuple[str, str]:
        """What is written on leaving the state, and what is read again."""
        if (found := self._fallen.get(state)) is None:
            word, passed = self.words[state], self.trie.passed[state]
            size, out = passed[-1] if passed else (1, word[0])
            found = self._fallen[state] = (out, word[size:])
        return found

    def step(self, state: int, c: str) -> tuple[int, str]:
        if (child := self.trie.arcs[state].get(c)) is not None:
            return child, ""
        if not state:
            return 0, c
        out, again = self._fall(state)
        now = 0
        for x in again + c:
            now, some = self.step(now, x)
            out += some
        return now, out

    def final(self, state: int) -> str:
        if not state:
            return ""
        out, again = self._fall(state)
        return out + self.write(again, 0)


class Spaces(Sequential):
    """Spaces as the model's mark: one before the text, and, if squeezed, one for each run within and none at the ends."""

    BEGUN, GAP = 1, 2

    def __init__(self, dummy_prefix: bool, squeeze: bool):
        self.before, self.squeeze = SPACE if dummy_prefix else "", squeeze

    def step(self, state: int, c: str) -> tuple[int, str]:
        if c == " " and self.squeeze:
            return (self.GAP if state else 0), ""
        c = SPACE if c == " " else c
        return self.BEGUN, (self.before if not state else SPACE if state == self.GAP else "") + c

    def write(self, text: str, state: int | None = None) -> str:
        """As step by step; where spaces are not squeezed, all at once."""
        if self.squeeze or not text:
            return super().write(text, state)
        return ("" if state else self.before) + text.replace(" ", SPACE)


class Composed(Sequential):
    """Two transducers after each other, composed as far as inputs need it: pairs of states, remembered arcs."""

    def __init__(self, first: Sequential, second: Sequential):
        self.first, self.second = first, second
        self.pairs: list[tuple[int, int]] = [(first.start, second.start)]
        self.numbers = {self.pairs[0]: 0}
        self.arcs: dict[tuple[int, str], tuple[int, str]] = {}

    def _number(self, pair: tuple[int, int]) -> int:
        if pair not in self.numbers:
            self.numbers[pair] = len(self.pairs)
            self.pairs.append(pair)
        return self.numbers[pair]

    def _through(self, state: int, some: str) -> tuple[int, str]:
        out = ""
        for c in some:
            state, x = self.second.step(state, c)
            out += x
        return state, out

    def step(self, state: int, c: str) -> tuple[int, str]:
        if (found := self.arcs.get((state, c))) is None:
            if len(self.arcs) > REMEMBERED:
                self.arcs.clear()
            a, b = self.pairs[state]
            a, some = self.first.step(a, c)
            b, out = self._through(b, some)
            found = self.arcs[state, c] = (self._number((a, b)), out)
        return found

    def final(self, state: int) -> str:
        a, b = self.pairs[state]
        b, out = self._through(b, self.first.final(a))
        return out + self.second.final(b)


class _Paths(dict):
    """Part of a text to its path's ids as int32 bytes; two generations, so that the commonest parts stay."""

    def __init__(self, search: Callable[[str], list[int]]):
        self.search, self.older = search, {}

    def __missing__(self, part: str) -> bytes:
        path = self.older.get(part) or array("i", self.search(part)).tobytes()
        if len(part) <= 64:
            self[part] = path
        return path

    def aged(self) -> None:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()


class Transducer:
    """Texts to ids and back."""

    def __init__(self, model: Model):
        self.model = model
        spaces = Spaces(model.dummy_prefix, model.squeeze)
        self.normaliser = Composed(Rules(model.rules), spaces) if model.rules else spaces
        own = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED) and p}
        self.ids, self.lattice = own, Trie(own)
        self.cost = [0.0 if kind == USER else -score for _, score, kind in model.pieces]
        # a BPE model's scores are ranks of merges and no weights of paths
        self.weight = [0.0] * len(model.pieces) if model.kind == BPE else self.cost
        if min((self.weight[i] for i in own.values()), default=0.0) < 0:
            raise ValueError("pieces of positive score are not supported")
        self.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        self.unknown_weight = UNKNOWN_COST - min((s for _, s, k in model.pieces if k == NORMAL), default=0.0)
        byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.byte_ids = byte_ids if model.byte_fallback and len(byte_ids) == 256 else None
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in model.pieces]
        self._beside: dict[int, bool] = {}
        self._passed: dict[int, list[tuple[float, int, int]]] = {}
        self._fallbacks: dict[str, tuple[int, tuple[int, ...]]] = {}
        self._first, self._paths = _Paths(lambda part: self._path(self.normaliser.write(part))), _Paths(lambda part: self._path(self.normaliser.write(part, Spaces.BEGUN)))
        # Without rules, where no piece has a space after another character, and none a line feed, all paths meet
        # before a space and at a line feed, and the normaliser is in one state there: such parts are composed alone.
        inner = any(SPACE in p.lstrip(SPACE) for p in own) or bool(model.rules) or model.squeeze
        gap = f"[ {SPACE}]"
        self._cut = None if inner else re.compile(f"\n|{gap}*[^ {SPACE}\n]+|{gap}+" if not any("\n" in p for p in own) else f"{gap}*[^ {SPACE}]+|{gap}+")

    def normalise(self, text: str) -> str:
        return self.normaliser.write(text)

    def _merged(self, text: str) -> list[str]:
        """Pieces after merging adjacent ones, best score first, leftmost on ties."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.cost[k] < best[0]):
                    best = self.cost[k], i
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _stays(self, a: int, b: int) -> bool:
        """Whether merging leaves these two pieces beside each other; a below 0: whether it makes piece b at all."""
        want = [self.model.pieces[k][0] for k in (a, b) if k >= 0]
        if len(self._beside) > 4 * REMEMBERED:
            self._beside.clear()
        found = self._beside[a << 32 | b] = self._merged("".join(want)) == want
        return found

    def _fallback(self, c: str) -> tuple[int, tuple[int, ...]]:
        """The state's mark (below 0: no piece) and the ids of the arc over a character without a piece: its bytes, or the unknown id."""
        if (found := self._fallbacks.get(c)) is None:
            ids = tuple(self.byte_ids[b] for b in c.encode("utf-8", "replace")) if self.byte_ids else (self.unknown,)
            found = self._fallbacks[c] = (-1 if self.byte_ids else -2, ids)
        return found

    def _arcs(self, text: str, at: int) -> list[tuple[float, int, int]]:
        """Arcs from a place, lightest and longest first: least weight, length, piece (-1: the fallback). A trie state's are made once."""
        state, steps = 0, self.lattice.arcs
        for c in text[at : at + self.lattice.longest]:
            step = steps[state].get(c)
            if step is None:
                break
            state = step
        if (found := self._passed.get(state)) is None:
            passed = self.lattice.passed[state]
            found = sorted(((self.weight[k], size, k) for size, k in passed), key=lambda x: (x[0], -x[1]))
            if not passed or passed[0][0] > 1:
                found.append((self.unknown_weight, 1, -1))
            self._passed[state] = found
        return found

    def _shortest(self, text: str) -> list[int]:
        """Ids on the path of least weight through the composition of a normalised text with the pieces.

        States are a place in the text and the last piece (of a unigram model only whether it was
        unknown: a run of unknown characters is one unknown id). Each state's next arc is queued by
        the least weight that it can have, that of the state reached last first, and weighed when taken.
        """
        n, bpe, beside = len(text), self.model.kind == BPE, self._beside.get
        if not n:
            return []
        # states in the order in which they were reached: place, last piece, weight, arcs, state before, ids of the arc to it
        states: list[tuple[int, int, float, list[tuple[float, int, int]], int, tuple[int, ...]]] = []
        settled: set[int | tuple[int, int]] = set()
        queue: list[tuple[float, int, int]] = []
        at, last, total, before, ids = 0, -1, 0.0, -1, ()
        arcs_at: dict[int, list[tuple[float, int, int]]] = {}
        while at < n:
            if (arcs := arcs_at.get(at)) is None:
                arcs = arcs_at[at] = self._arcs(text, at)
            item: tuple[float, int, int] | None = (total + arcs[0][0], -len(states), 0)
            states.append((at, last, total, arcs, before, ids))
            while True:
                if item is None and not queue:
                    raise ValueError("no path of finite weight")
                total, before, i = heappop(queue) if item is None else heappushpop(queue, item)
                at, last, base, arcs, _, _ = states[-before]
                _, size, k = arcs[i]
                i += 1
                item = (base + arcs[i][0], before, i) if i < len(arcs) else None
                if k >= 0:
                    if bpe:
                        # merging gives a beginning of the text one path only, so that a place reached has no second state
                        if at + size in settled:
                            continue
                        a = last if last >= 0 else -1
                        fits = beside(a << 32 | k)
                        if not fits and (fits is not None or not self._stays(a, k)):
                            continue  # infinitely heavy
                        new = k
                    else:
                        new = -1
                    ids = (k,)
                else:
                    new, ids = self._fallback(text[at])
                    if new == last == -2:
                        ids = ()
                mark = at + size if bpe else (at + size, new)
                if mark in settled:
                    continue
                settled.add(mark)
                at, last, before = at + size, new, -before
                if item is not None:
                    heappush(queue, item)
                break
        parts = [ids]
        while before > 0:
            *_, before, ids = states[before]
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def _straight(self, text: str) -> list[int] | None:
        """`_shortest` for a BPE model while pieces will do; None where a character's bytes may be needed.

        Pieces weigh nothing there, so that the search goes on from the state reached last and needs no
        queue: the same states are reached in the same order.
        """
        n, at, last, beside, passed, found = len(text), 0, -1, self._beside.get, self._passed.get, []
        steps, longest = self.lattice.arcs, self.lattice.longest
        ends: set[int] = set()
        left: list[tuple[int, int, Iterator[tuple[float, int, int]]]] = []
        while at < n:
            state = 0
            for c in text[at : at + longest]:
                if (step := steps[state].get(c)) is None:
                    break
                state = step
            arcs = iter(passed(state) or self._arcs(text, at))
            while True:
                for _, size, k in arcs:
                    if k < 0:
                        return None
                    # merging gives a beginning of the text one path only, so that a place reached has no second state
                    if at + size in ends:
                        continue
                    fits = beside(last << 32 | k)
                    if fits or fits is None and self._stays(last, k):
                        break
                else:
                    if not left:
                        return None
                    at, last, arcs = left.pop()
                    found.pop()
                    continue
                break
            left.append((at, last, arcs))
            found.append(k)
            at, last = at + size, k
            ends.add(at)
        return found

    def _path(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        path = self._straight(text) if self.model.kind == BPE else None
        return self._shortest(text) if path is None else path

    def packed(self, text: str | None) -> bytes:
        """Ids of the whole text as int32 in native order; none for null or empty text."""
        if not text:
            return b""
        if self._cut is None or not self.byte_ids and "\n" in text:
            return array("i", self._path(self.normaliser.write(text))).tobytes()
        first, *rest = self._cut.findall(text)
        paths = self._paths
        ids = self._first[first] + b"".join([paths[part] for part in rest])
        paths.aged()
        self._first.aged()
        return ids

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def _transducer(data: bytes) -> Transducer:
    """One for each worker process, so that remembered paths last over tasks."""
    return kept(("pieces", hash(data)), lambda: Transducer(Model.parse(data)))


def _encoded(fst: Transducer, texts: list[str | None]) -> tuple[list[pa.Array], list[bytes]]:
    """Columns token_ids and n_tokens, and the ids as bytes."""
    packed = [fst.packed(t) for t in texts]
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), np.int32))), pa.array(sizes)], packed


def encode_texts(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """The input's rows and columns plus token_ids and n_tokens; no ids for null or empty text.

    The driver reads the model file; executors get its bytes. Columns of these names are replaced.
    Repeated rows have equal ids, no rows give none.
    """
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("token_ids", "n_tokens")

    def run(batches):
        fst = _transducer(model.value)
        for part, (texts,) in rows_of(batches, "text", most_bytes=2 << 20):
            cols, _ = _encoded(fst, texts)
            yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, "token_ids", "n_tokens"])

    return docs.mapInArrow(run, plus(plus(docs.schema, "token_ids", T.ArrayType(T.IntegerType())), "n_tokens", T.LongType()))


def decode_ids(rows: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """The input's rows and columns plus decoded, the text of token_ids; null ids give an empty text."""
    with open(model_file, "rb") as f:
        model = rows.sparkSession.sparkContext.broadcast(f.read())
    rows = rows.drop("decoded")

    def run(batches):
        fst = _transducer(model.value)
        for part, (ids,) in rows_of(batches, "token_ids"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([fst.decode(x or []) for x in ids], pa.string())], names=[*part.schema.names, "decoded"])

    return rows.mapInArrow(run, plus(rows.schema, "decoded", T.StringType()))


def encoding_digest(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """The query's rows: doc_id, token_ids, n_tokens, round_trip (decoding gives the text; null counts as empty).

    Each text is encoded and its ids are decoded in one pass, so that ids cross to Python only once.
    """
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        fst = _transducer(model.value)
        for part, (texts,) in rows_of(batches, "text", most_bytes=2 << 20):
            cols, packed = _encoded(fst, texts)
            same = [fst.decode(array("i", ids)) == (t or "") for ids, t in zip(packed, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols, pa.array(same, pa.bool_())], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean")
