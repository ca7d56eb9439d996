"""Word shingles of whole texts as sorted 64-bit hashes, batch by batch in numpy.

A word is a longest run of letters or digits of the lower-cased text. Built-in
expressions can hash n-grams too, but interpret a lambda per n-gram; here one
batch is split once and hashed as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash

WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_words(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, computed once per different word."""
    codes, unique = pd.factorize(np.array(words, dtype=object))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in unique), dtype=np.uint64, count=len(unique))
    return table[codes]


def shingle_batch(texts: Iterable[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the different shingles of text i are hashes[offsets[i]:offsets[i + 1]], ascending.

    A text with fewer than ``width`` words, an empty one and NULL have none.
    """
    lists = [words_of(t) for t in texts]
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    flat = [w for x in lists for w in x]
    offsets = np.zeros(len(lists) + 1, dtype=np.int64)
    if not flat:
        return offsets, np.empty(0, dtype=np.uint64)
    h = hash_words(flat)
    doc = np.repeat(np.arange(len(lists)), counts)
    if len(h) < width:
        return offsets, np.empty(0, dtype=np.uint64)
    size = len(h) - width + 1
    rolled = np.full(size, width, dtype=np.uint64)
    for k in range(width):
        rolled = mix(rolled ^ h[k : k + size]) + _U(0x9E3779B97F4A7C15)
    whole = doc[:size] == doc[width - 1 :]
    doc, rolled = doc[:size][whole], rolled[whole]
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    if len(doc):
        first = np.ones(len(doc), dtype=bool)
        first[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
        doc, rolled = doc[first], rolled[first]
    np.cumsum(np.bincount(doc, minlength=len(lists)), out=offsets[1:])
    return offsets, rolled


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all different shingles of two ascending arrays; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)
