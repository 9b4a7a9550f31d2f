"""Vectorised words, word hashes and shingles of a column of texts, used inside Arrow tasks.

A text is cut into words by one rule everywhere: lower case, runs of letters and digits, all else
separates. NULL counts as the empty text, which has no words. Columns are worked on in runs of rows
of a bounded number of bytes; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 4 << 20
RUN_ROWS = 1 << 17
SHINGLE = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) that hold about ``limit`` bytes each; at least one row, at most RUN_ROWS."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo, n = 0, len(texts)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = min(lo + RUN_ROWS, max(lo + 1, int(np.searchsorted(ends, base + limit, "right"))))
        yield lo, hi
        lo = hi


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of every word in text order, the distinct words, offsets of the texts in the codes).

    Blank-separated chunks are coded first, so that letters are looked at once per distinct chunk.
    """
    spaced = pc.replace_substring(pc.utf8_lower(pc.fill_null(texts, "")), "\n", " ")
    lists = pc.split_pattern(spaced, " ")
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = lists.flatten().dictionary_encode()
    chunks = coded.indices.to_numpy(zero_copy_only=False)
    inner = pc.utf8_trim(pc.replace_substring_regex(coded.dictionary, r"[^\pL\pN]+", " "), " ")
    parts = pc.split_pattern(inner, " ")
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    words = parts.flatten().dictionary_encode()
    word_of = words.indices.to_numpy(zero_copy_only=False)
    blank = pc.equal(pc.binary_length(inner), 0).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    sizes = np.where(blank, 0, sizes)  # a chunk without letters or digits splits into one empty word
    each = sizes[chunks]
    codes = word_of[first[chunks[each == 1]]] if each.max(initial=0) <= 1 else word_of[ragged(first[chunks], each)]
    return codes, words.dictionary, np.concatenate([[0], np.cumsum(each)])[ends]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, offsets of the texts)."""
    codes, words, offsets = split(texts)
    hashed = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return (hashed[codes] if len(codes) else np.zeros(0, np.uint64)), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for counts[0] values, then the same for the next, and so on."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(Karp-Rabin hash of every run of ``k`` words, offsets of the texts).

    A text of fewer than ``k`` words, but at least one, has one shingle of all its words.
    """
    n = np.diff(offsets)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = ragged(offsets[:-1], counts)
    end = np.repeat(offsets[1:], counts)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        pos = at + j
        inside = pos < end
        out *= MULTIPLIER
        if inside.all():
            out += hashes[pos]
        else:
            out += np.where(inside, hashes[np.minimum(pos, len(hashes) - 1)], np.uint64(0))
    return mix(out), np.concatenate([[0], np.cumsum(counts)])
