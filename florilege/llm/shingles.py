"""Hashed word shingles of texts, on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_LANES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
#: Bytes of text that are hashed at a time.
PIECE = 1 << 19

def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values."""
    h = (h ^ np.uint64(salt)) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    both = np.ones((2, PIECE + 1), np.uint64)
    both[0, 1:] = _P
    both[1, 1:] = _P_INVERSE
    return tuple(np.multiply.accumulate(both, axis=1))


_POWER, _INVERSE = _powers()


def _spans(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and stop in at most ``PIECE`` bytes, and their polynomial sums. ``cut``: places
    (one more than bytes) at which a word ends though no white space stands there."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    blank = (low == 32) | ((low >= 9) & (low <= 13))
    padded = np.concatenate(([True], blank, [True]))
    starts = np.flatnonzero(~blank & (padded[:-2] | cut[:-1]))
    stops = np.flatnonzero(~blank & (padded[2:] | cut[1:])) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _POWER[: len(data)])))
    return starts, stops, (sums[stops] - sums[starts]) * _INVERSE[starts]


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word. ``ends``: where each text ends in ``data``."""
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = cut[ends] = True
    starts, stops, sums = _spans(data, cut)
    return mix(sums + (stops - starts).astype(np.uint64)), np.searchsorted(ends, starts, side="right")


def _long_words(data: np.ndarray) -> np.ndarray:
    """The hash of every word of one text, piece by piece; a word may reach over any number of pieces."""
    out, begun, size = [], 0, 0  # of a word that the pieces so far leave open: its sum and its bytes
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        starts, stops, sums = _spans(piece, np.zeros(len(piece) + 1, bool))
        sizes = (stops - starts).astype(np.uint64)
        if size and len(starts) and starts[0] == 0:
            sums[0] = np.uint64((begun + int(sums[0]) * pow(_P, size, 1 << 64)) % (1 << 64))
            sizes[0] += np.uint64(size)
        elif size:
            sums, sizes = np.concatenate(([np.uint64(begun)], sums)), np.concatenate(([np.uint64(size)], sizes))
        begun, size = 0, 0
        if len(stops) and stops[-1] == len(piece) and at + PIECE < len(data):
            begun, size = int(sums[-1]), int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        out.append(mix(sums + sizes))
    return np.concatenate(out)


def _sets(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    if len(data) > PIECE:  # one text
        words = _long_words(data)
        owner = np.zeros(len(words), np.int64)
    else:
        words, owner = _words(data, ends)
    first = np.searchsorted(owner, np.arange(len(ends) + 1))
    count = np.diff(first)
    if len(words) >= WORDS:
        h = sum(words[j : len(words) - WORDS + 1 + j] * np.uint64(_LANES[j]) for j in range(WORDS))
        h = mix(h)
    out = []
    for i, n in enumerate(count):
        a = first[i]
        if n >= WORDS:
            out.append(np.unique(h[a : a + n - WORDS + 1]))
        elif n:
            one = words[a : a + n] * np.array(_LANES[:n], np.uint64)
            out.append(mix(one.sum(dtype=np.uint64, keepdims=True), int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of hashed five-word shingles of each text (A-Z lower-cased, words cut at white
    space). A text of fewer words has one shingle, its whole sequence; one without words has none.
    A text of any length is hashed in pieces of ``PIECE`` bytes; what is held of it are 8 bytes a word."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        yield from _sets(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at])
        at = to


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers (signed) that tell a set of shingles."""
    pair = np.array([mix(hashes, 0x51).sum(dtype=np.uint64), mix(hashes, 0xA7).sum(dtype=np.uint64)], np.uint64)
    return tuple(int(x) for x in pair.view(np.int64))
