"""Sets of word shingles, and their sketches by fast similarity sketching."""

from __future__ import annotations

import numpy as np

from larkspur.llm.textkit import Words, mix

_STEP = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def folded(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words from each position on."""
    total = np.full(len(at), size, dtype=np.uint64)
    for j in range(size):
        total = total * _STEP + hashes[at + j]
    return mix(total)


def windows(words: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of size consecutive words, text by text.

    short: a text of fewer words, but not none, has them all as its only window.
    """
    hashes, count = words.hashes(), np.diff(words.first)
    left = np.repeat(words.first[1:], count) - np.arange(len(hashes))
    at = np.flatnonzero(left >= size)
    docs, out = words.doc[at], folded(hashes, at, size)
    few = np.flatnonzero((count > 0) & (count < size)) if short else np.zeros(0, np.int64)
    if len(few):
        docs, out = [docs], [out]
        for n in range(1, size):
            those = few[count[few] == n]
            docs.append(those)
            out.append(folded(hashes, words.first[those], n))
        docs, out = np.concatenate(docs), np.concatenate(out)
        order = np.argsort(docs, kind="stable")
        docs, out = docs[order], out[order]
    return docs, out


def distinct_sets(docs: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and where each text's begin."""
    bounds = np.searchsorted(docs, np.arange(texts + 1))
    parts, first = [], np.zeros(texts + 1, dtype=np.int64)
    for i in range(texts):
        s = np.sort(hashes[bounds[i] : bounds[i + 1]])
        if len(s) > 1:
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        parts.append(s)
        first[i + 1] = first[i] + len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), first


def digests(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on each set as a whole."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)))))
        out.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)))
    return out[0], out[1]


def _round(values: np.ndarray, r: int) -> np.ndarray:
    return mix(values ^ mix(np.full(1, (r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)))


def sketches(values: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """One row of that many coordinates for each non-empty set, by fast similarity sketching.

    In round r of the first `bins`, every element falls into one hashed bin with the value (r, hash); a
    bin keeps its least value, so that later rounds only fill what is still empty. Round bins + j throws
    every element into bin j, so that none stays empty. Two sets agree in a coordinate with
    probability their Jaccard similarity, and the count of equal coordinates is at least as
    concentrated as for independent ones. A set stops taking part once its bins are full.
    """
    sets = len(first) - 1
    sketch = np.full(sets * bins, _EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(first))
    grid = sketch.reshape(sets, bins)
    for r in range(2 * bins):
        if not len(values):
            break
        h = _round(values, r)
        place = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32) if r < bins else np.full(len(h), r - bins, dtype=np.uint64)
        value = (np.uint64(r) << np.uint64(48)) | (mix(h) >> np.uint64(16))
        np.minimum.at(sketch, owner * bins + place.astype(np.int64), value)
        if r < 4 or r % 4 == 3 or r >= bins:
            open_ = (grid == _EMPTY).any(axis=1)
            still = open_[owner]
            if not still.all():
                values, owner = values[still], owner[still]
    return grid


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of that many coordinates; keys of different bands differ."""
    out = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)[None, :].repeat(len(sketch), axis=0)
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    for j in range(rows):
        out = mix(out ^ parts[:, :, j])
    return out
