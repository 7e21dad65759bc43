"""Words and shingles as 64-bit hashes, computed over whole blocks of UTF-8 bytes.

A word is a run of bytes other than ASCII white space. Its hash is a difference of prefix sums of
a polynomial in an odd base modulo 2**64, so no Python string is made and a word's hash does not
depend on where it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything of ASCII but letters and digits, for words without their punctuation.
LOOSE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_TABLES: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    if len(_TABLES.get("up", ())) <= n:
        size = max(BLOCK + 4096, n + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["up"], _TABLES["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and where each text begins; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK):
    """Runs of texts of about `size` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words; a word ends where its text ends. gaps: the bytes between words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~gaps[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    return np.flatnonzero(word & (before | cut[:-1])), np.flatnonzero(word & (after | cut[1:])) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: tuple[int, ...] = ()) -> np.ndarray:
    """Hashes of byte spans in order of their starts; long inputs are hashed piece by piece.

    heads: with lengths given, there is a further row for each with the hashes of the spans' first so
    many bytes (0 where a span has no more than that).
    """
    out = np.empty(len(starts), np.uint64)
    more = np.zeros((len(heads), len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = int(ends[i:j].max())
        up, down = _powers(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * down[a])
        for row, n in zip(more, heads, strict=True):
            long = b - a > n
            at = a[long]
            part = np.zeros(j - i, np.uint64)
            part[long] = mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n))
            row[i:j] = part
        i = j
    return np.vstack([out, more]) if heads else out


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a block, and where each text's words begin."""
    starts, ends = word_spans(data, bounds)
    return starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of `width` words; a shorter text that has words makes one shingle of them all."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n - width + 1 + k]
    return mix(out)


def texts_of(batch: pa.RecordBatch, column: str = "text", lower: bool = True):
    """Blocks of a batch: the first text's place, the bytes, and the texts' bounds in them."""
    texts = pc.fill_null(batch.column(column), "")
    data, offsets = buffers(pc.utf8_lower(texts) if lower else texts)
    for i, j in blocks(offsets):
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
