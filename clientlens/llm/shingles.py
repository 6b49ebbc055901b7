"""Word-shingle sets as sorted 64-bit hashes (numpy, one Arrow batch at a time)."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x + _STEP
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Per text its distinct n-word shingles with A-Z lower-cased, as sorted hashes; with fewer
    words the whole sequence is one shingle; without words the set is empty.  bytes.lower
    and bytes.split touch ASCII only: exactly A-Z, and exactly [\\x20\\x09-\\x0D]."""
    size, parts = np.empty(len(texts), np.int64), []
    for i, t in enumerate(texts):
        tokens = (t or "").encode("utf-8", "surrogatepass").lower().split()
        size[i] = len(tokens)
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)))
    words = mix(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
    full = np.empty(0, np.uint64)
    if len(words) >= n:  # windows over all texts end to end; those across two texts are left out below
        full = words[: len(words) - n + 1].copy()
        for i in range(1, n):
            full = mix(full) + words[i : len(words) - n + 1 + i]
        full = mix(full)
    out, at = [], 0
    for k in size.tolist():
        if k >= n:
            x = np.sort(full[at : at + k - n + 1])
            x = x[np.append(True, x[1:] != x[:-1])]
        elif k:  # a short sequence is no shingle of a longer text
            x = words[at : at + 1].copy()
            for i in range(1, k):
                x = mix(x) + words[at + i]
            x = mix(x ^ np.uint64(k))
        else:
            x = np.empty(0, np.uint64)
        out.append(x)
        at += k
    return out


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    return shingle_sets([text], n)[0]
