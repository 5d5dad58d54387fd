"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised. Code points map to classes, classes plus one look-ahead bit to ten symbols, and each
symbol is a transition function over eight states. Functions compose associatively, so a block scan finds the state
before every character at once and with it the places where a piece starts; no regular expression runs. The slices feed
byte-pair merging, which remembers the pieces it has met. Offsets of pieces are kept, so that a range of a text can be decoded alone.

Null texts count as empty; an empty text has no ids. Repeated rows give repeated results, an empty table an empty one.
Other columns of the input are not read. A text is encoded whole, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# The white space of the Unicode property White_Space, and the contractions of the public pattern.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

LETTER, NUMBER, OTHER, SPACE_LAST, SPACE_MORE, BLANK_LAST, BLANK_MORE, SHORT, LONG, RESET = range(10)
FRESH, LETTERS, NUMBERS, OTHERS, BLANKS, JOINED, TWO_LEFT, ONE_LEFT = range(8)


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 U+0020, 4 further white space, for every code point."""
    major = "".join(unicodedata.category(chr(c))[0] for c in range(0x40000)).encode()  # no letter or number lies beyond
    table = np.full(256, 2, np.uint8)
    table[ord("L")], table[ord("N")] = 0, 1
    classes = np.full(sys.maxunicode + 1, 2, np.uint8)
    classes[: len(major)] = table[np.frombuffer(major, np.uint8)]
    classes[WHITE_SPACE] = 4
    classes[0x20] = 3
    return classes


@lru_cache(maxsize=1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, at [state * 10 + symbol]."""
    to, starts = np.zeros((8, 10), np.uint8), np.zeros((8, 10), bool)
    for state in range(8):
        for symbol, inside in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
            to[state, symbol], starts[state, symbol] = inside, state not in (inside, JOINED)
        for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):  # a contraction only counts where a piece may start
            glued = state in (OTHERS, JOINED)
            to[state, symbol], starts[state, symbol] = OTHERS if glued else left, not glued
        to[state, SPACE_LAST], starts[state, SPACE_LAST] = JOINED, True
        to[state, BLANK_LAST], starts[state, BLANK_LAST] = FRESH, True
        for symbol in (SPACE_MORE, BLANK_MORE):
            to[state, symbol], starts[state, symbol] = BLANKS, state != BLANKS
        to[state, RESET] = FRESH
    to[TWO_LEFT, LETTER], starts[TWO_LEFT, LETTER] = ONE_LEFT, False
    to[ONE_LEFT, LETTER], starts[ONE_LEFT, LETTER] = FRESH, False
    return to.ravel(), starts.ravel()


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray]:
    """The functions that symbols generate, numbered: then[f * 10 + symbol], and functions[f] as maps of states. 0 is the identity."""
    to = transitions()[0].reshape(8, 10)
    functions, number, then = [tuple(range(8))], {tuple(range(8)): 0}, []
    for f in functions:  # grows while it is read
        for symbol in range(10):
            g = tuple(int(to[x, symbol]) for x in f)
            if g not in number:
                number[g] = len(functions)
                functions.append(g)
            then.append(number[g])
    return np.array(then, np.uint16), np.array(functions, np.uint8)


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One symbol a code point; `ends` are the places of the separators after each text."""
    kind = code_classes()[points]
    blank = kind >= 3
    more = np.ones(len(points), bool)
    more[:-1] = blank[1:]
    more[ends - 1] = True  # the end of a text takes no blank from a run
    more[-1] = True
    out = np.array([LETTER, NUMBER, OTHER, SPACE_LAST, BLANK_LAST], np.uint8)[kind]
    out[(kind == 3) & more], out[(kind == 4) & more] = SPACE_MORE, BLANK_MORE
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        after = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = after[quote + 1], after[quote + 2]
        for word in CONTRACTIONS:
            if len(word) == 2:
                out[quote[one == ord(word[1])]] = SHORT
            else:
                out[quote[(one == ord(word[1])) & (two == ord(word[2]))]] = LONG
    out[ends] = RESET
    return out


def scan(marks: np.ndarray, width: int = 64) -> np.ndarray:
    """True where a piece starts: each block's function by products in the monoid, a prefix scan over blocks, one replay."""
    (to, starts), (then, functions) = transitions(), monoid()
    n = len(marks)
    rows = -(-n // width)
    grid = np.full(rows * width, RESET, np.uint8)
    grid[:n] = marks
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    product = np.zeros(rows, np.uint16)
    for column in grid:
        product = then.take(product * np.uint16(10) + column)
    whole = functions[product]
    step = 1
    while step < rows:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = whole[:-1, FRESH]
    found = np.empty(grid.shape, bool)
    for j, column in enumerate(grid):
        at = state * np.uint8(10) + column
        starts.take(at, out=found[j])
        state = to.take(at)
    return found.T.ravel()[:n]


def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pieces of all texts with one separator after each text, the places of the separators, and each piece's first character."""
    joined = "\n".join([*texts, ""])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    if not joined:
        return [], ends, ends
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    begins = scan(symbols(points, ends))
    begins[ends] = True
    at = np.flatnonzero(begins)
    stops = np.append(at[1:], len(points)).tolist()
    return [joined[a:b] for a, b in zip(at.tolist(), stops)], np.searchsorted(at, ends), at


class PairTable:
    """Rank of the token that two adjacent tokens make, for arrays of pairs: open addressing over all splits of the vocabulary."""

    SIZE = 1 << 20

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        found = [((x << 32) | y, r) for t, r in ranks.items() for k in range(1, len(t)) if (x := get(t[:k])) is not None and (y := get(t[k:])) is not None]
        if 2 * len(found) > self.SIZE:
            raise ValueError(f"{len(found)} pairs need a larger table than {self.SIZE}")
        keys, values = np.array([k for k, _ in found], np.int64), np.array([v for _, v in found], np.int32)
        self.keys, self.values = np.full(self.SIZE, -1, np.int64), np.zeros(self.SIZE, np.int32)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & (self.SIZE - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self.slot(keys)
        there = self.keys.take(at)
        out = np.where(there == keys, self.values.take(at), NONE)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.SIZE - 1)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


NONE = np.int32(2**31 - 1)


class Codec:
    """Ranks of a public vocabulary, with a memory of merged pieces that is emptied at `remember` entries."""

    def __init__(self, path: str, remember: int = 250_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.remember = remember
        self.known = _Pieces(self)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of many pieces at once: in each round every unfinished piece merges its least pair."""
        out: list[bytes] = [b""] * len(pieces)
        flat = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        rank = np.full(len(flat), NONE, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.pairs.rank(flat[inner], flat[inner + 1])
        while len(flat):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(begin, len(flat)))
            least = np.minimum.reduceat(rank, begin)
            over = least == NONE
            if over.any():
                done = np.repeat(over, size)
                ids = flat[done].astype("<u4").tobytes()
                stops = (np.cumsum(size[over]) * 4).tolist()
                for k, a, b in zip(owner[begin[over]].tolist(), [0, *stops], stops):
                    out[k] = ids[a:b]
                flat, owner, rank = flat[~done], owner[~done], rank[~done]
                if not len(flat):
                    break
                size, least = size[~over], least[~over]
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            flat[at] = rank[at]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            flat, owner, rank = flat[keep], owner[keep], rank[keep]
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near] = NONE
            near = near[near + 1 < len(flat)]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self.pairs.rank(flat[near], flat[near + 1])
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the adjacent pair of least rank merges first, the leftmost of equals, until none is known."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 48:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get, none = ranks.get, len(ranks) + 1
        pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pair:
            least = min(pair)
            if least == none:
                break
            i = pair.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap and a linked list, n log n in the piece's length."""
        n, get = len(piece), self.ranks.get
        part = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] is not None else -1
            if j < 0 or len(part[i]) + len(part[j]) != size:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := before[i]) >= 0 and (r := get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [self.ranks[p] for p in part if p is not None]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces, seps, _ = cut(texts)
        known = self.known
        coded = list(map(known.get, pieces))
        if None in coded:
            new = list({p for p, c in zip(pieces, coded) if c is None and len(p) <= 48})
            known.update(zip(new, self.merge_all([p.encode("utf-8", "surrogatepass") for p in new])))
            coded = [known[p] if c is None else c for p, c in zip(pieces, coded)]
        stops = seps.tolist()
        out = [b"".join(coded[a:b]) for a, b in zip([0, *(x + 1 for x in stops)], stops)]
        if len(known) > self.remember:
            known.clear()
        return out

    def encode_with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, each piece's first character, and each piece's first id."""
        pieces, _, at = cut([text])
        at = at[:-1]
        coded = [np.frombuffer(self.known[p], "<u4") for p in pieces[:-1]]
        first = np.cumsum([0, *map(len, coded)])[: len(coded)]
        return (np.concatenate(coded) if coded else np.zeros(0, "<u4")), at, first

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_range(self, coded: tuple[np.ndarray, np.ndarray, np.ndarray], start: int, stop: int) -> str:
        """Characters [start, stop) of a text from its ids, decoding only the pieces that overlap them."""
        ids, at, first = coded
        if start >= stop or not len(at):
            return ""
        a, b = int(np.searchsorted(at, start, "right")) - 1, int(np.searchsorted(at, stop))
        last = int(first[b]) if b < len(first) else len(ids)
        text = self.decode(np.asarray(ids[int(first[a]) : last], "<u4").tobytes()).decode("utf-8", "surrogatepass")
        return text[start - int(at[a]) : stop - int(at[a])]


class _Pieces(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        coded = self[piece] = np.array(self.codec.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        return coded


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary) of every whole text."""

    def start():
        own = codec(path)
        return lambda cols: [cols[0], own.encode(cols[1])]

    return map_batches(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t")), f"{id_col} {dict(docs.dtypes)[id_col]}, ids binary", start, 256)


def bpe_decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text binary) from the ids; null ids count as none."""

    def start():
        own = codec(path)
        return lambda cols: [cols[0], [own.decode(x or b"") for x in cols[1]]]

    return map_batches(coded.select(id_col, ids_col), f"{id_col} {dict(coded.dtypes)[id_col]}, bytes binary", start, 256)


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes what was encoded, and returns lengths and digests of both; the ids themselves don't leave the task."""

    def start():
        own = codec(path)

        def work(cols):
            coded = own.encode(cols[1])
            back = [own.decode(x) for x in coded]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return [cols[0], [len(x) // 4 for x in coded], list(map(sha, coded)), list(map(sha, back)), [a == b.encode("utf-8", "surrogatepass") for a, b in zip(back, cols[1])]]

        work.close = own.known.clear
        return work

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"
    return map_batches(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t")), schema, start, 256)
