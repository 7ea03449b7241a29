"""Plain-loop counterparts of the operators, for small tables."""

from __future__ import annotations

import re
import string
from collections import Counter

import xxhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Index of the class of each fingerprint, linked at two bits or fewer."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def shingles(ws):
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) > 4 else Counter([tuple(ws)] if ws else [])


def similarity(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def leaks(docs, items, least=0.8):
    """(doc, item) of all windows of the item's size, wherever they stand."""
    found = set()
    for d, text in docs:
        ws = words(text)
        for i, item in items:
            want = words(item)
            if not want or not ws:
                continue
            goal, size = shingles(want), min(len(want), len(ws))
            width = min(5, len(want))
            cut = lambda seq: Counter(tuple(seq[k : k + width]) for k in range(max(1, len(seq) - width + 1)))  # noqa: B023, E731
            if any(similarity(cut(ws[s : s + size]), goal) >= least for s in range(len(ws) - size + 1)):
                found.add((d, i))
    return found


def licence_places(text, phrases):
    ws = words(text)
    return len(ws), sorted(
        (i, label) for phrase, label in phrases for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()
    )
