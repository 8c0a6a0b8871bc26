"""Vectorised words and 64-bit word hashes of UTF-8 text, for Arrow batches.

A word is a maximal run of bytes that a 256-entry table marks; every byte of a multi-byte character is a word
byte. The hash of a word is a polynomial over its bytes modulo 2**64, taken from one running sum per segment:
the powers of an odd base can be inverted, so each word's part of the sum is shifted back to exponent zero. Words of
LONG bytes and more, for which such polynomials have known collisions, get XXH64 instead.
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 512
BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, *range(9, 14)]] = False

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text with A-Z in lower case
ALNUM = np.ones(256, bool)
ALNUM[:48] = ALNUM[58:97] = ALNUM[123:128] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, SEGMENT + 1), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the polynomial's low bits (a bijection on 64 bits)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(text: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and hash of each word, letters A-Z lower-cased. Works in segments that end between words."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, hashes, at, n = [], [], [], 0, len(data)
    while at < n:
        stop = min(at + SEGMENT, n)
        if stop < n:
            gap = np.flatnonzero(~is_word[data[at:stop]])
            if len(gap):
                stop = at + int(gap[-1]) + 1
            else:  # a word longer than a segment
                while stop < n and is_word[data[stop]]:
                    ahead = np.flatnonzero(~is_word[data[stop : stop + SEGMENT]])
                    stop = stop + int(ahead[0]) if len(ahead) else min(n, stop + SEGMENT)
        part = data[at:stop]
        marks = np.zeros(len(part) + 2, np.int8)
        marks[1:-1] = is_word[part]
        edges = np.flatnonzero(np.diff(marks))
        s, e = edges[::2], edges[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part)), out=total[1:])
        back = powers(pow(BASE, -1, 1 << 64), len(part) + 1)
        own = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
        for i in np.flatnonzero(e - s >= LONG).tolist():
            own[i] = xxhash.xxh64_intdigest(part[s[i] : e[i]])
        hashes.append(own)
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n])
    return out


def groups(column, limit: int = SEGMENT):
    """Runs of rows of an Arrow string column: (first row, texts as bytes, None for null) of about limit bytes each."""
    first, texts, size = 0, [], 0
    for i in range(len(column)):
        value = column[i]
        text = value.as_buffer().to_pybytes() if value.is_valid else None
        if texts and size + len(text or b"") > limit:
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(text)
        size += len(text or b"")
    if texts:
        yield first, texts


def words_of(texts: list[bytes | None], is_word: np.ndarray, gap: bytes = b"\n"):
    """words() of several texts at once: (joined bytes, starts, ends, hashes, index of each text's first word, with the end)."""
    joined = gap.join(t or b"" for t in texts)
    starts, ends, hashes = words(joined, is_word)
    offsets = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return joined, starts, ends, hashes, np.searchsorted(starts, offsets)
