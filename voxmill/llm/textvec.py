"""Words of Arrow string arrays as numpy vectors: no Python object per word.

A word is a longest run of ASCII letters and digits and of non-ASCII characters
other than Unicode punctuation and spaces (U+00A0-00BF without the letters in it,
U+2000-207F, U+3000-303F). A character from U+3000 to U+9FFF, which is written
without spaces, is a word of its own. Hashes are of the lower-cased word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about ``size`` bytes a slice; a longer text is one slice."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)) if n else np.zeros(0, np.int64)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which words begin and end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _WORD[data]
    top = data.max()
    own = None
    if top >= 0xC2:
        following = np.append(data[1:], np.uint8(0))
        for lead, low, high, width in ((0xC2, 0xA0, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
            at = np.flatnonzero((data == lead) & (following >= low) & (following <= high))
            if lead == 0xC2 and len(at):
                at = at[~np.isin(following[at], (0xAA, 0xB5, 0xBA))]
            for k in range(width):
                word[np.minimum(at + k, n - 1)] = False
        if top >= 0xE3:
            lone = np.flatnonzero((data >= 0xE3) & (data <= 0xE9) & word)
            if len(lone):
                own = np.zeros(n + 1, bool)
                own[lone] = True
                own[np.minimum(lone + 3, n)] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    firsts = off[:-1][off[:-1] < n]
    begin[firsts] = word[firsts]
    end = word.copy()
    end[:-1] &= ~word[1:]
    lasts = off[1:][off[1:] > 0] - 1
    end[lasts] = word[lasts]
    if own is not None:
        begin |= word & own[:-1]
        end |= word & own[1:]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, CHUNK + 1), base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if n > 4 * CHUNK:  # one giant word: not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def range_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each range values[begin:end], mixed; begins and ends rise.

    The hash does not depend on where a range lies, so long inputs go block by block.
    """
    if len(values) <= 2 * CHUNK:
        return _range_hash(values, begin, end)
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        base = begin[i]
        j = max(i + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        out[i:j] = _range_hash(values[base : end[j - 1]], begin[i:j] - base, end[i:j] - base)
        i = j
    return out


def _range_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text where its words begin (one more at the end)."""
    data, off = byte_view(pc.utf8_lower(texts))
    begin, end = spans(data, off)
    return range_hash(data, begin, end), np.searchsorted(begin, off)


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets of texts, begins and ends of words, first word of each text; not lower-cased."""
    data, off = byte_view(texts)
    begin, end = spans(data, off)
    return data, off, begin, end, np.searchsorted(begin, off)


def window_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (at position of the first)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return range_hash(hashes, at, at + k)


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of each w consecutive values; the leftmost on ties."""
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    width = 1
    while width < w:
        step = min(width, w - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        width += step
    return best
