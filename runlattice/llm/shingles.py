"""Word shingles of whole texts as sorted arrays of 64-bit hashes, by array operations over the words of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from runlattice.llm.packed import mix64

WORDS = 5
#: Texts are hashed together until they have so many bytes; a longer one alone.
TOGETHER = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_STEP = np.uint64(0xBF58476D1CE4E5B9)
#: A-Z lowered, and the other white space as a space; a line feed between texts is white space, too.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_ENDS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _word_hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at ``start``, by eight bytes at a time; ``data`` goes on for eight bytes after the last."""
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))
    h = mix64(size.astype(np.uint64))
    left = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(left):
        n = np.minimum(size[left] - at, 8)
        h[left] = mix64((h[left] ^ (eight[start[left] + at] & _ENDS[n])) * _P[0] + _STEP)
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]])
    return h


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    data = (b" " + b" ".join(texts) + b" " * 9).translate(_TABLE)
    space = np.frombuffer(data, np.uint8) == 32
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    h = _word_hashes(data, start, size)
    # words of text k are those at cuts[k]..cuts[k + 1]
    cuts = np.searchsorted(start, np.cumsum([1] + [len(t) + 1 for t in texts])).tolist()
    total = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS if len(total) else 0):
        part = h[k : k + len(total)]
        total += (mix64(part) if k == 2 else part) * _P[k]
    total = mix64(total)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= WORDS:
            own = np.sort(total[a : b - WORDS + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:  # the number of words keeps these apart from the others
            yield mix64(mix64(np.array([sum(int(x) * int(p) for x, p in zip(h[a:b], _P)) + b - a & (1 << 64) - 1], np.uint64)) ^ _STEP)
        else:
            yield np.empty(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of WORDS lowered words; a shorter text is one shingle, an empty one none."""
    held: list[bytes] = []
    n = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if held and n + len(raw) > TOGETHER:
            yield from _sets(held)
            held, n = [], 0
        held.append(raw)
        n += len(raw)
    if held:
        yield from _sets(held)
