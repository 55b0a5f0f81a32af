"""Hashed subword features of whole texts, in numpy.

Texts are handled as UTF-8 bytes, about a megabyte at a time, so memory grows neither
with the batch nor with a text: a longer text is read in windows that end at a word's
border, and what its windows hold adds up. A word longer than a window is read as
several words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Odd multiplier of the hash functions, and the base of the polynomial word hash with its inverse modulo 2^64.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 20


class _Cache(dict):
    """Filled anew in each process."""

    def __reduce__(self) -> tuple:
        return _Cache, ()


_POWERS = _Cache()

#: ASCII white space becomes a space.
_SPACES = bytes(32 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256))


def pieces(texts: Sequence[str | None], size: int | None = None) -> Iterator[tuple[int, int, bytes, np.ndarray, int]]:
    """(first, last, bytes, starts, old) of runs of texts, or of a window of one text.

    Each text is preceded by a space, one more ends the run. The first ``old`` bytes
    are the word before the window, which the window before has held already.
    """
    size = size or PIECE
    first, parts, starts, at = 0, [], [], 0
    for k, text in enumerate(texts):
        raw = b" " + (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass").translate(_SPACES)
        if parts and at + len(raw) > size:
            yield first, k, b"".join(parts) + b" ", np.array(starts, dtype=np.int64), 0
            first, parts, starts, at = k, [], [], 0
        if len(raw) > size:
            for window, old in _windows(raw, size):
                yield k, k + 1, window + b" ", np.zeros(1, dtype=np.int64), old
            first = k + 1
            continue
        parts.append(raw)
        starts.append(at)
        at += len(raw)
    if parts:
        yield first, first + len(parts), b"".join(parts) + b" ", np.array(starts, dtype=np.int64), 0


def _windows(raw: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """Windows of about ``size`` bytes, each after the first led by the word before it and the length of that with its space."""
    at, before = 0, b""
    while at < len(raw):
        end = len(raw) if at + size >= len(raw) else raw.rfind(b" ", at + 1, at + size)
        if end <= at:
            end = at + size
        part = raw[at:end]
        yield before + (part if part.startswith(b" ") else b" " + part), len(before)
        last = part.rstrip(b" ")
        before = b" " + last[last.rfind(b" ") + 1 :] if last else before
        at = end


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, PIECE + 2), dtype=np.uint64)
        have[0] = 1
        filled, step = 1, base % (1 << 64)
        while filled < len(have):
            more = min(filled, len(have) - filled)
            have[filled : filled + more] = have[:more] * np.uint64(step)
            filled += more
            step = step * step % (1 << 64)
        _POWERS[base] = have
    return have[:n]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    gap = raw == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    return edge[0::2], edge[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash values of the words."""
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(raw.astype(np.uint64) * _powers(_BASE, len(raw)), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, len(raw))[starts]
    h ^= h >> np.uint64(29)
    return h * _MIX


def features(data: bytes, texts: np.ndarray, sizes: Sequence[int], buckets: int, old: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) of each feature: words first, then the byte n-grams inside words, last the word bigrams of one word with itself.

    A word's border counts as a character of its n-grams. Kind k has the buckets
    from k * buckets on; the bigrams of equal words share one bucket after all
    others. ``texts`` holds the texts' starts, which no bigram crosses. The first
    ``old`` bytes only count as the word before.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    starts, ends = word_spans(raw)
    hashes = word_hashes(raw, starts, ends)
    new = starts >= old
    out = [(starts[new], (hashes[new] >> shift).astype(np.int64))]
    inner = raw != 32
    inner[:old] = False
    for kind, n in enumerate(sizes, 1):
        if len(raw) < n:
            out.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            continue
        keep = inner[1 : len(raw) - n + 2].copy()
        for j in range(2, n - 1):
            keep &= inner[j : len(raw) - n + 1 + j]
        at = np.flatnonzero(keep)
        gram = raw[at].astype(np.uint64)
        for j in range(1, n):
            gram |= raw[at + j].astype(np.uint64) << np.uint64(8 * j)
        out.append((at, ((gram * _MIX) >> shift).astype(np.int64) + kind * buckets))
    again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    again = again[np.searchsorted(texts, starts[again], side="right") == np.searchsorted(texts, starts[again - 1], side="right")]
    out.append((starts[again], np.full(len(again), (len(sizes) + 1) * buckets)))
    return out
