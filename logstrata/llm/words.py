"""Words of texts and their hashes, for functions that run inside tasks.

A word is a longest run of characters other than space and \\t \\n \\v \\f \\r.
Texts are UTF-8 bytes, on which ``bytes.split`` does exactly that.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Most words that a task remembers (about 200 bytes each); more are looked up again.
REMEMBERED = 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Longer words, in bytes, are hashed one by one in :func:`span_hashes`.
_LONG = 256
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordHashes(dict):
    """64-bit hashes by word, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Spans(NamedTuple):
    """Where the words of several texts are: of ``data``, bytes ``starts`` to ``ends``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Words before each text, and words of all.
    before: np.ndarray


def spans(texts: pa.Array) -> Spans:
    """The words of a column of bytes, in order; null has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(values or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # A byte of a word, with a byte of none at both ends; numbers below zero wrap.
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = (data != 32) & (data - np.uint8(9) > 4)
    starts, ends = word[1:] & ~word[:-1], word[:-1] & ~word[1:]
    # A word that ends a text and one that begins the next are two.
    starts[offsets], ends[offsets] = word[1:][offsets], word[:-1][offsets]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return Spans(data, starts, ends, np.searchsorted(starts, offsets))


def span_hashes(found: Spans) -> np.ndarray:
    """64-bit hashes of words, taken eight bytes at a time; not those of :class:`WordHashes`."""
    data, starts, ends, _ = found
    sizes = ends - starts
    eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    hashes = sizes.astype(np.uint64)
    more, done = np.flatnonzero(sizes <= _LONG), 0
    while len(more):
        part = eight[starts[more] + done] & _FIRST[np.minimum(sizes[more] - done, 8)]
        hashes[more] = mixed(hashes[more] * _ODD ^ part)
        done += 8
        more = more[sizes[more] > done]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes


def mixed(values: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of ``values``."""
    values = (values ^ (values >> np.uint64(30))) * _MIX1
    values = (values ^ (values >> np.uint64(27))) * _MIX2
    return values ^ (values >> np.uint64(31))


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for each ``length`` consecutive words, in order; empty if there are fewer."""
    count = len(words) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(length):
        total = total * _ODD + words[i : i + count]
    return mixed(total)


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which of the values occur more than once."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``length`` that starts where ``starts`` is set."""
    change = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0
