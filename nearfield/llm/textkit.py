"""Words, hashes and shingles of whole Arrow text columns with numpy, without a Python step per word.

All functions work on UTF-8 bytes. A word is ``[^\\x20\\x09-\\x0D]+``. Null texts count as empty. Texts are taken in
chunks of about CHUNK bytes (a longer text is a chunk of its own), which bounds memory whatever a batch holds.
Hashes have 64 bits: polynomial over random byte values, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
M64 = (1 << 64) - 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_STEP = U(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _BYTE = mix((np.arange(256, dtype=np.uint64) + U(1)) * _STEP)
_FOLDED = np.where(SPACE, U(0), _BYTE[LOWER])  # A-Z count as a-z, spaces as nothing
_EXACT = np.where(SPACE, U(0), _BYTE)
#: ASCII but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LETTERS = np.where(PUNCTUATION, U(0), _BYTE[LOWER])
_BASE = 0x5851F42D4C957F2D
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _power or len(_power["up"]) < n:
        size = max(CHUNK + 1, n)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            done, step = 1, base
            while done < size:  # doubling: out[d:2d] = out[:d] * base**d
                take = min(done, size - done)
                out[done : done + take] = out[:take] * U(step)
                done, step = done + take, step * step & M64
            _power[key] = out
    return _power["up"], _power["down"]


def capitals(b: np.ndarray) -> np.ndarray:
    """Which bytes from the second on end a Latin capital of two bytes."""
    return (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes, or of one text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_starts(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts of words in them, n + 1 offsets of the texts' words) of texts lo to hi. blank: which bytes end a word."""
    b = data[offsets[lo] : offsets[hi]]
    inner = offsets[lo : hi + 1] - offsets[lo]
    solid = ~blank[b]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = inner[:-1][inner[:-1] < len(b)]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    return b, starts, np.searchsorted(starts, inner)


def count_words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Words of each text."""
    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    for lo, hi in chunks(offsets):
        out[lo:hi] = np.diff(word_starts(data, offsets, lo, hi)[2])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, fold: bool = True, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, n + 1 offsets of the texts' words). fold: A-Z as a-z. letters: words are runs of letters and digits, Latin capitals folded too."""
    b, starts, bounds = word_starts(data, offsets, lo, hi, PUNCTUATION if letters else SPACE)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    up, down = _powers(len(b))
    v = (_LETTERS if letters else _FOLDED if fold else _EXACT)[b]
    if letters:
        v[1:][capitals(b)] = _LETTERS[b[1:][capitals(b)] + 0x20]
    v *= up[: len(b)]
    h = np.add.reduceat(v, starts)
    h *= down[starts]
    return mix(h), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words and the offsets of the texts' runs; a shorter text has one run, its whole sequence."""
    sizes = np.diff(bounds)
    each = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out_bounds = np.concatenate([[0], np.cumsum(each)])
    if len(words) >= n:
        span = len(words) - n + 1
        run = np.full(span, U(n), dtype=np.uint64)
        for j in range(n):
            run *= _STEP
            run += words[j : j + span]
            run ^= run >> U(29)
        whole = mix(run)
    else:
        whole = np.empty(0, np.uint64)
    if (sizes >= n).all():
        keep = np.ones(len(whole), dtype=bool)
        for j in range(1, n):
            last = bounds[1:-1] - j
            keep[last] = False
        return whole[keep], out_bounds
    out = np.empty(out_bounds[-1], dtype=np.uint64)
    for i in np.flatnonzero(sizes):
        a, b, size = out_bounds[i], bounds[i], sizes[i]
        if size >= n:
            out[a : a + size - n + 1] = whole[b : b + size - n + 1]
        else:
            run = U(size)
            for w in words[b : b + size]:
                run = U((int(run) * int(_STEP) + int(w)) & M64)
                run ^= run >> U(29)
            out[a] = mix(np.array([run], dtype=np.uint64))[0]
    return out, out_bounds


def shingle_sets(column: pa.Array | pa.ChunkedArray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text in order; empty for a text without words."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        words, bounds = word_hashes(data, offsets, lo, hi)
        runs, at = shingle_hashes(words, bounds, n)
        for i in range(hi - lo):
            x = np.sort(runs[at[i] : at[i + 1]])
            if len(x) > 1:
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
            yield lo + i, x
