"""Hashes of words and word shingles of whole texts, a batch at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C55
GOLD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@np.errstate(over="ignore")
def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte (a capital A-Z has its small letter's), and the powers of BASE and of its inverse."""
    byte = mix(np.arange(1, 257, dtype=np.uint64) * GOLD) | np.uint64(1)
    byte[65:91] = byte[97:123]
    ones = np.ones(1, np.uint64)
    up = np.cumprod(np.concatenate([ones, np.full(CHUNK, BASE, np.uint64)]))
    down = np.cumprod(np.concatenate([ones, np.full(CHUNK, pow(BASE, -1, 1 << 64), np.uint64)]))
    return byte, up, down


@np.errstate(over="ignore")
def word_hashes(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes that aren't ASCII white space, A-Z as a-z) of texts that lie back to back, and
    how many each text has. A word's hash is a polynomial of its bytes, taken from running sums over CHUNK bytes."""
    word = ~SPACE[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[at] = True
    first = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    last = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    byte, up, down = tables()
    out, i = np.zeros(len(first), np.uint64), 0
    while i < len(first):
        j = int(np.searchsorted(last, first[i] + CHUNK, "right"))
        if j > i:
            low, high = int(first[i]), int(last[j - 1])
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[body[low:high]] * up[: high - low])])
            out[i:j] = (total[last[i:j] - low] - total[first[i:j] - low]) * down[first[i:j] - low]
        else:  # a word longer than a chunk
            j, shift = i + 1, np.uint64(1)
            for low in range(int(first[i]), int(last[i]), CHUNK):
                high = min(low + CHUNK, int(last[i]))
                out[i] += (byte[body[low:high]] * up[: high - low]).sum(dtype=np.uint64) * shift
                shift *= up[CHUNK]
        i = j
    out = mix(out + (last - first).astype(np.uint64) * GOLD)
    return out, np.diff(np.searchsorted(first, at))


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted numbers; of a text with fewer words the whole sequence; of none, none."""
    whole = np.full(max(0, len(hashes) - k + 1), k, np.uint64) * GOLD
    for j in range(k):
        whole = mix(whole * np.uint64(3) + hashes[j : len(hashes) - k + 1 + j]) if len(whole) else whole
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            s = np.sort(whole[at : at + n - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            s = np.full(min(n, 1), n, np.uint64) * GOLD
            for j in range(n):
                s = mix(s * np.uint64(3) + hashes[at + j])
            out.append(s)
        at += n
    return out


@np.errstate(over="ignore")
def fast_sketch(sets: list[np.ndarray], size: int = 128) -> np.ndarray:
    """Similarity sketches of `size` coordinates (a power of two), a line for each set (no line for an empty set is usable).

    In round r every element falls into a bin by a hash of this round, and a bin keeps its least (round, hash). After
    `size` such rounds come `size` more in which round r puts all elements into bin r - size; so each bin fills, most
    in the first round or two, and two sets agree in a coordinate with the probability of their Jaccard similarity.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    bits = np.uint64(64 - (size.bit_length() - 1))
    low = np.uint64((1 << 55) - 1)
    out = np.full(len(sets) * size, empty)
    counts = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), counts)
    for r in range(2 * size):
        if not len(x):
            break
        h = mix(x ^ mix(np.uint64(r + 1) * GOLD))
        place = owner * size + ((h >> bits).astype(np.int64) if r < size else r - size)
        value = (np.uint64(r) << np.uint64(55)) | (h & low)
        free = out[place] == empty
        np.minimum.at(out, place[free], value[free])
        lacking = (out.reshape(len(sets), size) == empty).any(axis=1)
        stay = lacking[owner]
        x, owner = x[stay], owner[stay]
    return out.reshape(len(sets), size)


def band_hashes(sketches: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of `rows` coordinates, different for each band."""
    n, size = sketches.shape
    parts = sketches.reshape(n, size // rows, rows)
    h = np.arange(size // rows, dtype=np.uint64)[None, :] * GOLD + np.zeros((n, 1), np.uint64)
    for j in range(rows):
        h = mix(h * np.uint64(3) + parts[:, :, j])
    return h.view(np.int64)
