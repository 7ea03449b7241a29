"""Token counts by a compiled finite-state transducer.

BPE of a growing string is deterministic: exactly one token can end at each position so
that it and the token before it are what BPE gives for the two together. What a further
byte does depends only on the longest suffix that can still begin a token, on the last
token at each position inside that suffix, and on the token counts there relative to now.
That is a state; its transitions carry the difference in tokens emitted. States and
transitions are compiled when a text first needs them and then shared by all texts.

A chunk of text acts on the states of the whole pretokenizer and transducer as a map: what
comes in before its first sure boundary continues the state it is entered with, the
inside adds a fixed count, and what follows its last sure boundary is the state it is
left in. ``StateMap`` holds just that, so chunks are mapped independently of each other
and their maps composed by a prefix scan, which doubles the span in each step.

Defined results: NULL counts as empty; an empty text has no bytes and no tokens; special
strings inside a text are one token each, as the library's default has it. Other columns
pass through; a column named like an output is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import appended, whole

CHUNK = 1 << 14  # characters to a state map
STATES = 1 << 18  # compiled states that a task holds before it starts anew
CACHE = 1 << 18
# The pretokenizer's pattern of byte-level vocabularies: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = r"\s\x1c-\x1f\x85\xa0"
# Between these two characters a new piece begins, whatever stands around them.
SURE = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")
RUN = re.compile(rf"[{SPACE}] (?:[{SPACE}]|$)").search


def bytes_of_symbols() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of byte strings; compiled lazily from a list of merges."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.merges = merges
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.clear()

    def __reduce__(self):
        return Transducer, (self.merges,)

    def clear(self) -> None:
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        # A state: the suffix, and (last token, count relative to now) at each position in it, the start included.
        self.ids = {(b"", ((None, 0),)): 0}
        self.states = [(b"", ((None, 0),))]
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, parts: list[bytes]) -> list[bytes]:
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def holds(self, before: bytes | None, token: bytes) -> bool:
        """Whether BPE keeps these two neighbours (or a first token alone) as they are."""
        key = before, token
        if key not in self.pairs:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            s = (before or b"") + token
            self.pairs[key] = self.merged([s[i : i + 1] for i in range(len(s))]) == [t for t in key if t is not None]
        return self.pairs[key]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: next state, difference in tokens."""
        suffix, spots = self.states[state]
        suffix += bytes([byte])
        for i in range(len(suffix)):  # the longest token that fits is the only one, so the order doesn't matter
            token = suffix[i:]
            if token in self.tokens and self.holds(spots[i][0], token):
                break
        count = spots[i][1] + 1
        start = next((i for i in range(len(suffix)) if suffix[i:] in self.prefixes), len(suffix))
        kept = tuple((t, n - count) for t, n in (*spots, (token, count))[start:])
        key = suffix[start:], kept
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        self.next[state][byte] = at, count
        return at, count

    def count(self, s: bytes) -> int:
        """Tokens of a piece, read byte by byte."""
        if len(self.states) >= STATES:
            self.clear()
        state = total = 0
        table = self.next
        for byte in s:
            step = table[state].get(byte)
            state, change = step if step is not None else self.compile(state, byte)
            total += change
        return total


@dataclass(frozen=True)
class StateMap:
    """What a stretch of text does: head goes on with the state before it, tail is the state after it.

    ``tail`` is None as long as no sure boundary has been seen: then all of it is head.
    """

    head: str
    count: int = 0
    tail: str | None = None


class Counter:
    """Pretokenizer and transducer together, over chunks."""

    def __init__(self, transducer: Transducer, pattern: str, specials: list[str]):
        self.transducer, self.pattern, self.specials = transducer, pattern, specials
        self.known: dict[str, int] = {}
        self.stretches: dict[str, int] = {}
        self.pieces = regex.compile(pattern).findall
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def __reduce__(self):
        return Counter, (self.transducer, self.pattern, self.specials)

    def piece(self, p: str) -> int:
        n = self.known.get(p)
        if n is None:
            n = self.transducer.count(p.encode())
            if len(p) <= 64:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[p] = n
        return n

    def stretch(self, word: str) -> int:
        """Tokens of a blank and the word after it, between sure boundaries."""
        n = sum(map(self.piece, self.pieces(" " + word)))
        if len(word) <= 64:
            if len(self.stretches) >= CACHE:
                self.stretches.clear()
            self.stretches[word] = n
        return n

    def between(self, s: str) -> int:
        """Tokens of text between two sure boundaries."""
        if RUN(s):
            return sum(map(self.piece, self.pieces(s)))
        first, *rest = s.split(" ")
        found = list(map(self.stretches.get, rest))
        new = [w for w, n in zip(rest, found, strict=True) if n is None] if None in found else ()
        return sum(map(self.piece, self.pieces(first))) + sum(n for n in found if n) + sum(map(self.stretch, new))

    def map_of(self, chunk: str) -> StateMap:
        first = SURE.search(chunk)
        if first is None:
            return StateMap(chunk)
        at = first.start()
        end = max(chunk.rfind(c) for c in " \n\t\r") if chunk[-1:].strip() else -1
        # The last sure boundary: before the white space that precedes the last word, if that can be told cheaply.
        while end > at and (chunk[end - 1].isspace() or not chunk[end].isspace()):
            end -= 1
        end = max(end, at)
        return StateMap(chunk[:at], self.between(chunk[at:end]), chunk[end:])

    def compose(self, x: StateMap, y: StateMap) -> StateMap:
        if x.tail is None:
            return StateMap(x.head + y.head, y.count, y.tail)
        if y.tail is None:
            return StateMap(x.head, x.count, x.tail + y.head)
        return StateMap(x.head, x.count + self.between(x.tail + y.head) + y.count, y.tail)

    def plain(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.between(text)
        maps = [self.map_of(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        return self.close(self.fold(maps))

    def fold(self, maps: list[StateMap]) -> StateMap:
        """The map of all chunks together: the scan's last one, by the tree's upward half alone.

        Neighbours are composed pair by pair, so of a text without a sure boundary no more
        than one copy is held besides the one being made.
        """
        while len(maps) > 1:
            pairs = [self.compose(x, y) for x, y in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """All prefixes' maps: each step composes with the map that ends ``step`` chunks before."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def close(self, m: StateMap) -> int:
        """Enter a map at the start of a text and end the text after it."""
        return self.between(m.head) + (m.count + self.between(m.tail) if m.tail is not None else 0)

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def read_counter(path: str, pattern: str = PATTERN) -> Counter:
    """From a tokenizer file with byte-level merges; its special tokens are single tokens in texts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = bytes_of_symbols()
    raw = lambda s: bytes(map(byte.__getitem__, s))
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    merges = [(raw(a), raw(b)) for a, b in pairs]
    return Counter(Transducer(merges), pattern, [t["content"] for t in spec.get("added_tokens", ())])


def counted(docs: DataFrame, counter: Counter, text_col: str = "text", keep=None, limit: int = 512) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(counter)

    def make():
        count = shared.value.count  # a worker's tasks share what has been compiled

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = texts.to_pylist()
            tokens = [count(t) for t in rows]
            sizes = [len(t.encode()) for t in rows]
            return [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])]

        return work

    return appended(docs, whole(text_col), make, "n_bytes bigint, n_tokens bigint, over_limit boolean", keep)
