"""Byte-level BPE encoding and decoding by tree reduction.

Encodings of neighbouring byte strings form a monoid: ``join`` makes the encoding of
``x + y`` from those of x and y. It encodes a window around the seam anew and widens it
until both outer tokens are stable: a token string is what BPE gives if and only if every
two neighbours in it are what BPE gives for the two together, so once the pairs at the
window's edges hold, nothing outside can change. ``encode_piece`` encodes the halves of a
piece recursively and joins them, which keeps a piece of any length near linear; decoding
joins byte strings up the same kind of tree.

Texts are cut into pieces by the tokenizer's pattern; pieces are encoded apart, and a
piece that is a token stays one, as in the library. The rank table is read by the driver
from a path and sent to the tasks: a vocabulary of a fixed size.

Defined results: NULL counts as empty, an empty text has no ids and decodes to nothing;
ids outside the vocabulary fail the decoding. Other columns pass through; a column named
like an output is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Sequence
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import appended, name, whole

LEAF_BYTES = 6  # strings of no more are merged directly, and remembered
SHORT_BYTES = 24  # up to here merging looks at all pairs again, beyond it keeps a heap
LEAF_IDS = 1 << 16  # ids whose bytes decoding gathers at once
CACHE = 1 << 18  # words and leaves that a worker remembers; half as many of other pieces and of pairs
# White space before a blank and none but white space after it: the run belongs together.
UNSAFE = re.compile(r"[\s\x1c-\x1f\x85\xa0] (?:[\s\x1c-\x1f\x85\xa0]|$)").search
# Letters only: one piece under a pattern in which a blank and letters are one.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
NONE = 1 << 60  # no rank


class Memo(dict):
    """Remembers what a function gave for short strings, in two generations.

    When the younger one is full it becomes the older one, and what is looked up again
    moves back, so strings that are common stay. Strings with a line break are seldom
    seen again and not kept.
    """

    def __init__(self, of: Callable, size: int = CACHE):
        self.of, self.older, self.half = of, {}, size // 2

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.of(key)
            if len(key) > 64 or (isinstance(key, str) and "\n" in key):
                return value
        if len(self) >= self.half:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Ranks of byte strings, and BPE over them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.pairs: dict[tuple[int, int], bool] = {}
        self.leaves = Memo(self.merged)  # of byte strings
        self.pieces = Memo(self.packed_piece, CACHE // 2)
        self.stretches = Memo(self.packed_stretch)
        self.letters = LETTERS if r" ?\p{L}+" in pattern else lambda _: None

    def __getstate__(self) -> tuple:
        return self.ranks, self.pattern

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @cached_property
    def split(self):
        return regex.compile(self.pattern).findall

    @cached_property
    def strings(self) -> list[bytes | None]:
        out: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for s, i in self.ranks.items():
            out[i] = s
        return out

    def merged(self, s: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, as long as there is one."""
        get = self.ranks.get
        if len(s) > SHORT_BYTES:
            return self.merged_long(s)
        parts = [s[i : i + 1] for i in range(len(s))]
        pairs = [get(s[i : i + 2], NONE) for i in range(len(s) - 1)]
        while pairs:
            low = min(pairs)
            if low == NONE:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NONE)
        return [self.ranks[p] for p in parts]

    def merged_long(self, s: bytes) -> list[int]:
        """The same for wide windows: a heap of pairs over linked parts."""
        get, n = self.ranks.get, len(s)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at an index
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(s[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, middle, end = heappop(heap)
            if ends[i] != middle or middle >= n or ends[middle] != end:
                continue  # one of the two has been merged since
            ends[i], ends[middle] = end, -1
            if end < n:
                before[end] = i
                if (r := get(s[i : ends[end]])) is not None:
                    heappush(heap, (r, i, end, ends[end]))
            if (p := before[i]) >= 0 and (r := get(s[p:end])) is not None:
                heappush(heap, (r, p, i, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[s[i : ends[i]]])
            i = ends[i]
        return out

    def holds(self, a: int, b: int) -> bool:
        """Whether a, b is what BPE gives for their bytes together."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.merged(self.strings[a] + self.strings[b]) == [a, b]
            if len(self.pairs) >= CACHE // 2:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def join(self, x: Sequence[int], y: Sequence[int]) -> list[int]:
        """The encoding of two encoded strings together."""
        if not x or not y or self.holds(x[-1], y[0]):
            return [*x, *y]
        left = right = 1
        while True:
            left, right = min(left, len(x)), min(right, len(y))
            window = [*x[len(x) - left :], *y[:right]]
            middle = self.leaves[b"".join([self.strings[i] for i in window])]
            fits_left = left == len(x) or self.holds(x[len(x) - left - 1], middle[0])
            fits_right = right == len(y) or self.holds(middle[-1], y[right])
            if fits_left and fits_right:
                return [*x[: len(x) - left], *middle, *y[right:]]
            left, right = left + left * (not fits_left), right + right * (not fits_right)

    def encode_bytes(self, s: bytes, whole: bool = True) -> list[int]:
        if whole and s in self.ranks:
            return [self.ranks[s]]
        n = len(s)
        if n <= LEAF_BYTES:
            return self.leaves[s]
        half = n // 2
        if n <= 2 * LEAF_BYTES:
            x, y = self.leaves[s[:half]], self.leaves[s[half:]]
        else:
            x, y = self.encode_bytes(s[:half], False), self.encode_bytes(s[half:], False)
        return x + y if self.pairs.get((x[-1], y[0])) else self.join(x, y)

    def packed_piece(self, piece: str) -> bytes:
        return array("i", self.encode_bytes(piece.encode())).tobytes()

    def packed_stretch(self, word: str) -> bytes:
        """The ids of a blank and what follows up to the next one."""
        if self.letters(word):
            return self.packed_piece(" " + word)
        return b"".join(map(self.pieces.__getitem__, self.split(" " + word)))

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers.

        A blank next to a character that is no white space, on either side, starts a piece
        whatever else surrounds it, so most texts can be cut there and each stretch that
        occurs again be taken from memory.
        """
        if UNSAFE(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.pieces.__getitem__, self.split(first))) + b"".join(map(self.stretches.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    @cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all strings, where each id's start, how many they are: -1 for an id that is none)."""
        sizes = np.array([-1 if s is None else len(s) for s in self.strings], np.int64)
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        return np.frombuffer(b"".join(s or b"" for s in self.strings), np.uint8), starts, sizes

    def sizes_of(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.strings) or self.flat[2][ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        return self.flat[2][ids]

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of a leaf of ids are gathered at once; leaves are joined up the tree."""
        if len(ids) > LEAF_IDS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes_of(ids)
        text, starts, _ = self.flat
        ends = np.cumsum(sizes)
        at = np.repeat(starts[ids] - (ends - sizes), sizes)
        return text[at + np.arange(len(at))].tobytes()


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file: a line with the base64 of the bytes and the rank for each token."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encoded(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep=None, into: str = "ids") -> DataFrame:
    """Append the ids (array<int>) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        packed = shared.value.packed  # a worker's tasks share what it remembers

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [packed(t) for t in texts.to_pylist()]
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))]

        return work

    return appended(docs, whole(text_col), make, f"`{into}` array<int>", keep)


def decoded(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", keep=None, into: str = "bytes") -> DataFrame:
    """Append the bytes that every row's ids stand for; NULL ids give NULL."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        v = shared.value

        def work(lists: pa.Array) -> list[pa.Array]:
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            text = v.decode(ids)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(v.sizes_of(ids)))[np.append(0, np.cumsum(counts))].tolist()
            known = lists.is_valid().to_pylist()
            return [pa.array([text[a:b] if k else None for a, b, k in zip(ends, ends[1:], known)], pa.binary())]

        return work

    return appended(rows, name(ids_col), make, f"`{into}` binary", keep)
