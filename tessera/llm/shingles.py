"""Shingles of words as 64-bit hashes, a piece of the text at a time.

A text of any length is walked in pieces of about ``PIECE`` bytes that end before
white space, so what is held next to the text itself is bounded by a piece, or by its
longest word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEED = 42
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def texts_of(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text of a column, without a copy; none for null."""
    for value in column:
        yield memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")


def pieces(data: memoryview | bytes) -> Iterator[bytes]:
    """``data`` cut before white space."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        if end < n:
            space = _SPACE.search(data, end)
            end = space.start() if space else n
        yield bytes(data[at:end])
        at = end


def shingle_hashes(data: memoryview | bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of ``words`` words, in order, in parts.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and one
    space is between them.  Fewer words make one shingle, no word makes none.
    """
    hashed, held, full = xxhash.xxh64_intdigest, [], False
    for piece in pieces(data):
        found = held + piece.lower().split()
        n = len(found) - words + 1
        if n < 1:
            held = found
            continue
        full, held = True, found[n:]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths)[:n].tolist(), ends[words - 1 :].tolist())
        view = memoryview(b" ".join(found))
        yield np.fromiter((hashed(view[a:b], SEED) for a, b in spans), np.uint64, n)
    if held and not full:
        yield np.array([hashed(b" ".join(held), SEED)], np.uint64)


def distinct_hashes(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The different hashes of all parts, ascending; repeated ones are never held for long."""
    seen, fresh, n = np.empty(0, np.uint64), [], 0
    for h in parts:
        fresh.append(h)
        n += len(h)
        if n > max(len(seen), 1 << 17):
            seen, fresh, n = np.unique(np.concatenate([seen, *fresh])), [], 0
    return np.unique(np.concatenate([seen, *fresh])) if fresh else seen
