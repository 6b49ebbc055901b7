"""Runs of bytes of a class in the texts of an Arrow batch, numbered by their distinct values.

Classes of single bytes are enough wherever a pattern's class is a set of ASCII characters or the
complement of one: in UTF-8, every byte of any other character is at least 0x80.  The token
alphabet also has some characters of two bytes, which are told by their byte pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clientlens.functions.text import TOKEN_LETTERS, TOKEN_SIGNS

#: Bytes of text handled at once in a worker, or one longer text.
SLICE = 1 << 22

#: Byte -> byte with only A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_slices(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string array (null counts as empty) of about ``size`` (SLICE) bytes: first and last row,
    the bytes of all its texts end to end, and where each text starts in them (and the last ends)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    where = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(where, where[at] + (size or SLICE), "right")) - 1)
        yield at, end, whole[where[at] : where[end]], where[at : end + 1] - where[at]
        at = end


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of the maximal runs of ``inside``; no run crosses one of ``starts``."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    return np.flatnonzero(after & (edge | ~before)), np.flatnonzero(before & (edge | ~after))


def numbered(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The runs' values: per run its number, and the distinct values in order of number."""
    # runs and the gaps between them are the strings of one Arrow array over the same bytes;
    # gaps are read as empty
    bounds = np.empty(2 * len(first) + 1, np.int64)
    bounds[:-1:2], bounds[1::2], bounds[-1] = first, end, end[-1] if len(end) else 0
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    own = both.take(pa.array(np.arange(0, 2 * len(first), 2))).dictionary_encode()
    return own.indices.to_numpy(), own.dictionary.cast(pa.large_string()).cast(pa.string())


_SIGN = np.zeros(256, bool)  # bytes that are token characters of their own
_SIGN[[b for b in range(128) if chr(b).isalnum() and not chr(b).isupper()] + [ord(c) for c in TOKEN_SIGNS]] = True
_PAIR = np.zeros((256, 256), bool)  # byte pairs that are
for _c in TOKEN_LETTERS:
    _PAIR[tuple(_c.encode("utf-8"))] = True
_LEAD = _PAIR.any(1)


def token_runs(data: np.ndarray, starts: np.ndarray, min_len: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of the tokens (see ``text.tokens``) of lower-cased texts."""
    inside = _SIGN[data]
    lead = np.flatnonzero(_LEAD[data[:-1]])  # a lead byte is always followed by its pair's second
    lead = lead[_PAIR[data[lead], data[lead + 1]]]
    inside[lead] = inside[lead + 1] = True
    first, end = runs(inside, starts[:-1])
    if min_len > 1:
        tail = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])  # bytes that begin no character
        long = (end - first) - (tail[end] - tail[first]) >= min_len
        first, end = first[long], end[long]
    return first, end
