"""Words and word shingles of whole texts, computed over Arrow's buffers with numpy.

A batch's texts lie side by side as UTF-8 bytes; words are found and hashed for many texts at once, without making Python
strings. Texts are taken in chunks of about ``CHUNK`` bytes, so memory is bounded by the chunk or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64


def _mixed(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTES = _mixed(11, 256)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    if _powers["n"] < n:
        n = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Which bytes belong to words ``[^\\x20\\x09-\\x0D]+``, and to terms of ASCII letters, digits and all beyond ASCII.
IN_WORDS = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
IN_TERMS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_hashes(offsets: np.ndarray, data: np.ndarray, solids: np.ndarray = IN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts, the runs of ``solids``, A-Z lowered, and where each text's words begin."""
    base, n = int(offsets[0]), len(offsets) - 1
    b = data[base : int(offsets[-1])]
    if not len(b):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    solid = solids[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[offsets - base] = True
    starts = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | cut[:-1]))
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | cut[1:])) + 1
    lowered = np.where((b >= 65) & (b <= 90), b + 32, b)
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, _U)
    np.cumsum(BYTES[lowered] * up[: len(b)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, offsets - base).astype(np.int64)


_WEIGHTS = _mixed(23, 64) | _U(1)


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; a shorter text's words are one shingle."""
    offsets, data = texts(column)
    for i, j in chunks(offsets):
        words, first = word_hashes(offsets[i : j + 1], data)
        h = np.zeros(max(len(words) - width + 1, 0), _U)
        for k in range(width):
            h += words[k : k + len(h)] * _WEIGHTS[k]
        h = mix(h)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = z - a
            if n >= width:
                s = np.sort(h[a : z - width + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif n:
                yield mix(np.array([(words[a:z] * _WEIGHTS[width : width + n]).sum() + _U(n)], _U))
            else:
                yield np.zeros(0, _U)
