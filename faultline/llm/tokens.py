"""Token ids of whole texts under a public word-BPE vocabulary, with a cache of units.

The vocabulary's normaliser and splitter never look across white space, and in a plain word (ASCII and the letters U+00C0 to
U+00FF, without apostrophe or ``<``) they split where letters, digits and other signs meet. So a text is the concatenation of its
units: the runs of one kind in a plain word, A-Z lowered, and any other word whole. Units are found and hashed over Arrow's
buffers; those of a chunk of texts that aren't in the cache are tokenised in one call, and ids are gathered for all places.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from .shingles import BYTES, chunks, mix, powers, texts

_U = np.uint64
#: Bytes that one generation of a worker's cache may take.
CACHE_BYTES = 24 << 20
_LOADED: dict = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[start : start + size]`` for all starts, one behind the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def units(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, starts, ends): where each text's units begin among them, and where each lies from the first offset on."""
    base = int(offsets[0])
    b = data[base : int(offsets[-1])]
    if not len(b):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = (b >= 97) & (b <= 122)
    upper = (b >= 65) & (b <= 90)
    high = b >= 128
    solid = (b != 32) & ((b < 9) | (b > 13))
    cut = np.zeros(len(b) + 1, bool)
    cut[offsets - base] = True
    kind = np.where(lower | upper | high, 1, np.where((b >= 48) & (b <= 57), 2, 3)).astype(np.int8)
    kind[~solid] = 0
    after = np.concatenate(([False], b[:-1] == 0xC3))  # the second byte of U+00C0 to U+00FF, of which two are no letters
    odd = (high & (b != 0xC3) & ~after) | (after & ((b == 0x97) | (b == 0xB7))) | (b == 39) | (b == 60)
    begins = solid & (np.concatenate(([True], ~solid[:-1])) | cut[:-1])
    word = np.cumsum(begins) - 1
    n_words = int(begins.sum())
    plain = np.ones(n_words + 1, bool)
    plain[word[odd]] = False
    plain_byte = plain[word] & solid
    begins |= plain_byte & np.concatenate(([False], kind[1:] != kind[:-1]))
    starts = np.flatnonzero(begins)
    # a unit ends where the next begins or its word ends
    stop = np.concatenate((begins[1:] | ~solid[1:], [True])) | cut[1:]
    ends = np.flatnonzero(solid & stop) + 1
    folded = np.where(upper & plain_byte, b + 32, b)
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, _U)
    np.cumsum(BYTES[folded] * up[: len(b)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, offsets - base).astype(np.int64), starts, ends


class Store:
    """Ids by hash: sorted keys, and where the ids of each lie in one array."""

    def __init__(self):
        self.keys, self.starts, self.sizes, self.flat = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def bytes(self) -> int:
        return 24 * len(self.keys) + self.flat.nbytes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds keys in order that it doesn't hold."""
        at = np.searchsorted(self.keys, keys)
        self.starts = np.insert(self.starts, at, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes, self.keys, self.flat = np.insert(self.sizes, at, sizes), np.insert(self.keys, at, keys), np.concatenate((self.flat, ids))


class WordTokens:
    """``of_texts(column)``: for each text of an Arrow column, its ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # two generations, each bounded by bytes: when the newer one is full, it becomes the older and the older goes
        self.newer, self.older = Store(), Store()

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """One for each worker process and vocabulary."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def tokenised(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many, ids) of units, which are encoded as one text and told apart by their places."""
        encoding = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(encoding.ids, "<u4")
        begins = np.cumsum([0] + [len(w) + 1 for w in words])
        places = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(ids))
        return np.diff(np.searchsorted(places, begins)), ids

    def known(self, keys: np.ndarray, word_at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, flat ids) of distinct keys in order; ``word_at(k)`` is the unit of the k-th."""
        if self.newer.bytes() > CACHE_BYTES:
            self.newer, self.older = Store(), self.newer
        again = np.flatnonzero(self.newer.find(keys) < 0)
        at = self.older.find(keys[again])
        kept, at, missing = again[at >= 0], at[at >= 0], again[at < 0]
        if len(kept):
            sizes = self.older.sizes[at]
            self.newer.add(keys[kept], sizes, gathered(self.older.flat, self.older.starts[at], sizes))
        if len(missing):
            self.newer.add(keys[missing], *self.tokenised([word_at(k) for k in missing.tolist()]))
        at = self.newer.find(keys)
        return self.newer.starts[at], self.newer.sizes[at], self.newer.flat

    def of_texts(self, column) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), in order."""
        offsets, data = texts(column)
        for i, j in chunks(offsets):
            hashes, first, starts, ends = units(offsets[i : j + 1], data)
            keys, at, place = np.unique(hashes, return_index=True, return_inverse=True)
            b = data[offsets[i] : offsets[j]].tobytes()
            a, z = starts[at].tolist(), ends[at].tolist()
            begins, sizes, flat = self.known(keys, lambda k, b=b, a=a, z=z: b[a[k] : z[k]].decode())
            n = sizes[place]
            ids = gathered(flat, begins[place], n)
            upto = np.concatenate(([0], np.cumsum(n)))
            for x, y in zip(upto[first[:-1]].tolist(), upto[first[1:]].tolist(), strict=True):
                yield ids[x:y]
