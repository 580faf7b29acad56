"""Repeated passages: matching statistics against an FM-index for each shard.

All windows of a text that have the same smallest shingle form a segment, and
the shard of a segment is a hash of that shingle. Equal windows have equal
smallest shingles, so they meet in one shard, and each shard is searched by its
own segments alone. A shingle that only one document has needs no shard at all.

A shard puts its distinct segments into one sequence of word numbers and builds
an FM-index over it: the Burrows-Wheeler transform in a wavelet matrix.
Backward search gives, for every position, the length of the match that ends
there, up to the threshold, and its interval of suffixes; the smallest document
in the interval is the first one with that window. Where the row at a border of
an interval has the word searched for, its LF mapping replaces the count.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm import words as W
from logstrata.llm.common import forget, staged

#: Words of a window, and of the shingles among which it chooses its smallest.
WINDOW, SHINGLE = 13, 5
#: Words of the segments that one shard indexes, about.
SHARD_WORDS = 1 << 18
#: A shingle with more segments is cut into single windows with shards of their own.
HOT_SEGMENTS = 2000
_NO_DOC = np.int64(2**63 - 1)


# --- The index ---------------------------------------------------------------


class WaveletMatrix:
    """Rank of a symbol before a position, for many at a time, in a bit for each level."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.levels = max(1, int(count - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            ones = np.zeros(len(bits) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(bits) - int(ones[-1]))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        every = np.arange(count, dtype=np.int64)
        self.starts = self._down(every, np.zeros(count, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions go when the levels sort them by their symbol."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[i][at]
            at = np.where((symbols >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before a position."""
        return self._down(symbols, before) - self.starts[symbols]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the sorted length of those that do not differ yet."""
    n = len(symbols)
    bits = int(symbols.max() + 1).bit_length()
    length = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for i in range(length):
        key <<= bits
        key[: n - i] |= symbols[i:] + 1
    order, slots = np.arange(n), np.arange(n)
    rank = np.empty(n, np.int64)
    while True:
        # Suffixes that are equal so far hold neighbouring slots; the first is their rank.
        by_key = np.argsort(key)
        order[slots] = order[slots][by_key]
        key = key[by_key]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[slots]] = slots[new][np.cumsum(new) - 1]
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots):
            return order
        after = order[slots] + length
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[order[slots]] * (n + 1) + second
        length *= 2


class FMIndex:
    """Backward search over segments of words, and the smallest document of a match."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, docs: np.ndarray):
        """Segments one after the other, how long they are, and their documents."""
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        count = len(lengths)
        # A separator of its own after each segment, smaller than all words and
        # in falling order, so that no two suffixes are equal.
        size = len(words) + count
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(size, np.int64)
        is_word = np.ones(size, bool)
        is_word[ends] = False
        text[ends] = 0
        text[is_word] = numbers + 1
        distinct = text + count
        distinct[ends] = np.arange(count - 1, -1, -1)
        order = suffix_array(distinct)
        self.last = text[order - 1]
        self.matrix = WaveletMatrix(self.last, len(self.vocabulary) + 1)
        # Row of the suffix that is longer by the symbol in ``last``.
        row = np.empty(size, np.int64)
        row[order] = np.arange(size)
        self.longer = row[order - 1]
        counts = np.bincount(text, minlength=len(self.vocabulary) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.doc_of = np.repeat(docs, lengths + 1)[order]
        self.size = size

    def narrowed(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of the matches with a symbol put before them, empty where none is."""
        top = high - 1
        first, last = self.longer[low], self.longer[top] + 1
        other, several = self.last[low] != symbol, low < top
        last[other & ~several] = first[other & ~several]
        for at, where, out in (
            (low, other & several, first), (high, (self.last[top] != symbol) & several, last),
        ):
            rows = np.flatnonzero(where)
            out[rows] = self.matrix.rank(symbol[rows], at[rows]) + self.before[symbol[rows]]
        return first, last

    def matching(self, numbers: np.ndarray, ends: np.ndarray, most: int):
        """For each end in ``numbers``: the match that ends there, up to ``most``.

        Words that the index lacks are -1, as is the end of another text. The
        result is the length of the longest match and its interval of suffixes.
        """
        symbol = numbers[ends]
        known = symbol >= 0
        low = np.where(known, self.before[symbol + 1], 0)
        high = np.where(known, self.before[np.minimum(symbol + 2, len(self.before) - 1)], self.size)
        length = known.astype(np.int64)
        alive = np.flatnonzero(known)
        for back in range(1, most):
            at = ends[alive] - back
            symbol = np.where(at >= 0, numbers[np.maximum(at, 0)], -1)
            alive, symbol = alive[symbol >= 0], symbol[symbol >= 0] + 1
            if not len(alive):
                break
            first, last = self.narrowed(symbol, low[alive], high[alive])
            found = first < last
            alive, first, last = alive[found], first[found], last[found]
            low[alive], high[alive] = first, last
            length[alive] = back + 1
        return length, low, high

    def first_doc(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document of each interval, of which none partly overlap."""
        if not len(low):
            return np.zeros(0, np.int64)
        starts, inverse = np.unique(low, return_inverse=True)
        stops = np.zeros(len(starts), np.int64)
        stops[inverse] = high
        cuts = np.stack([starts, stops], 1).reshape(-1)
        padded = np.append(self.doc_of, _NO_DOC)
        least = np.minimum.reduceat(padded, cuts)[::2]
        return least[inverse]


# --- Segments ----------------------------------------------------------------


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest shingle of each window, given the hashes of all shingles."""
    width, span = 1, WINDOW - SHINGLE + 1
    while width < span:
        step = min(width, span - width)
        hashes = np.minimum(hashes[:-step], hashes[step:])
        width += step
    return hashes


def segments(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Smallest shingle, text, first window and number of windows of each segment.

    ``words``: of several texts, one after the other; ``before``: words before each, and of all.
    """
    least = smallest(W.gram_hashes(words, SHINGLE))
    # Windows that reach into the next text are left out.
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + WINDOW <= before[1:][text])
    least = least[at]
    starts = np.ones(len(at), bool)
    starts[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(starts)
    text = text[at[starts]]
    return least[starts], text, at[starts] - before[text], np.diff(np.append(starts, len(at)))


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = W.spans(batch.column("text"))
        shingle, text, start, windows = segments(W.span_hashes(found), found.before)
        own = [np.asarray(batch.column(c))[text] for c in ("doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(shingle.view(np.int64)), *map(pa.array, own),
                pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)),
            ],
            ["shingle", "doc_id", "text_hash", "start", "windows"],
        )


def _powers(count: int, base: int) -> np.ndarray:
    return np.cumprod(np.full(count, base, np.uint64)) if count else np.zeros(0, np.uint64)


def segment_keys(words: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the words of each segment.

    Sums of window hashes times powers of an odd number, from which those of any
    run of windows follow by a subtraction and a division.
    """
    grams = W.gram_hashes(words, WINDOW)
    keys = []
    for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        up, down = _powers(len(grams), base), _powers(len(grams), pow(base, -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * up)])
        part = (sums[starts + windows] - sums[starts]) * down[starts]
        keys.append(W.mixed(part + windows.astype(np.uint64)).view(np.int64))
    return keys


def _parts(found: W.Spans, at: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The bytes of so many words from a word on, with short gaps between them."""
    first, stop = found.starts[at], found.ends[at + lengths - 1]
    sizes = np.concatenate([[0], np.cumsum(found.ends - found.starts)])
    wide = stop - first > sizes[at + lengths] - sizes[at] + lengths - 1
    data = found.data.tobytes()
    parts = [data[a:b] for a, b in zip(first.tolist(), stop.tolist())]
    for i in np.flatnonzero(wide).tolist():
        parts[i] = b" ".join(parts[i].split())
    return parts


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of the wanted segments; of hot shingles a segment for each window."""
    for batch in batches:
        found = W.spans(batch.column("text"))
        wanted = batch.column("wanted")
        counts = np.diff(np.asarray(wanted.offsets))
        doc = np.repeat(np.arange(batch.num_rows), counts)
        parts = wanted.flatten()
        shingle, start, windows, hot = (
            np.asarray(parts.field(c).to_numpy(zero_copy_only=False))
            for c in ("shingle", "start", "windows", "hot")
        )
        times = np.where(hot, windows, 1)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        doc, shingle, hot = (np.repeat(x, times) for x in (doc, shingle, hot))
        start = np.repeat(start, times) + nth
        windows = np.where(hot, 1, np.repeat(windows, times)).astype(np.int64)
        at = found.before[doc] + start
        one, two = segment_keys(W.span_hashes(found), at, windows)
        part = _parts(found, at, windows + WINDOW - 1)
        own = [np.asarray(batch.column(c))[doc] for c in ("doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays(
            [
                *map(pa.array, own), pa.array(start.astype(np.int32)), pa.array(one), pa.array(two),
                pa.array(part, pa.binary()), pa.array(np.where(hot, one, shingle)),
            ],
            ["doc_id", "text_hash", "start", "one", "two", "part", "route"],
        )


def _searched(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index the segments of a shard and stream them past the index."""
    tables = list(batches)
    one, two, docs = (
        np.concatenate([np.asarray(b.column(c)) for b in tables]) for c in ("one", "two", "first_doc")
    )
    parts = [b.column("part") for b in tables]
    lengths = np.concatenate([np.diff(W.spans(p).before) for p in parts])
    # Words have numbers in the order they are met, so that the index keeps them.
    known = defaultdict(itertools.count().__next__)
    split = itertools.chain.from_iterable(b" ".join(p.to_pylist()).split() for p in parts)
    numbers = np.fromiter(map(known.__getitem__, split), np.int64, lengths.sum())
    index = FMIndex(numbers, lengths, docs)
    within = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends = np.flatnonzero(within >= WINDOW - 1)
    length, low, high = index.matching(numbers, ends, WINDOW)
    first = np.full(len(ends), _NO_DOC)
    hit = length >= WINDOW
    first[hit] = index.first_doc(low[hit], high[hit])
    offsets = np.concatenate([[0], np.cumsum(lengths - WINDOW + 1)]).astype(np.int32)
    firsts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(first))
    yield pa.RecordBatch.from_arrays(
        [pa.array(one), pa.array(two), firsts], ["one", "two", "firsts"]
    )


def repeats(
    docs: DataFrame, shard_words: int = SHARD_WORDS, hot: int = HOT_SEGMENTS
) -> DataFrame:
    """doc_id, text_hash and starts of the windows that a smaller document has.

    ``docs``: doc_id, text_hash and text (bytes), doc_id not null. Segments that
    documents share are indexed; ``firsts`` is the smallest doc_id that has each
    window of a segment, from ``start`` on.
    """
    routes = staged(
        docs.mapInArrow(
            _routes, "shingle long, doc_id long, text_hash long, start int, windows int"
        ),
        "zstd",
    )
    # Counted before the join, so that no task gets all rows of a frequent shingle.
    keys = routes.groupBy("shingle").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")
    )
    keys = keys.filter(F.col("low") < F.col("high"))
    keys = staged(keys.select("shingle", (F.col("n") > hot).alias("hot")))
    shared = routes.join(keys.hint("merge"), "shingle").groupBy("doc_id", "text_hash")
    # Each step is written before the next one shuffles, to hold few shuffle files at once.
    wanted = staged(
        shared.agg(F.collect_set(F.struct("shingle", "start", "windows", "hot")).alias("wanted")),
        "zstd",
    )
    forget(routes)
    cut = staged(
        docs.join(wanted, ["doc_id", "text_hash"]).mapInArrow(
            _cut,
            "doc_id long, text_hash long, start int, one long, two long, part binary, route long",
        ),
        "zstd",
    )
    forget(wanted)
    distinct = cut.groupBy("one", "two").agg(
        F.min("doc_id").alias("first_doc"),
        F.first("part").alias("part"),
        F.first("route").alias("route"),
    )
    # A segment has four windows on average, about.
    shards = max(1, -(-cut.count() * (WINDOW + 4) // shard_words))
    found = (
        distinct.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_searched, "one long, two long, firsts array<long>")
    )
    found = staged(found)
    occurrences = cut.select("doc_id", "text_hash", "start", "one", "two")
    earlier = F.transform(
        "firsts", lambda first, nth: F.when(first < F.col("doc_id"), F.col("start") + nth)
    )
    again = (
        occurrences.join(found, ["one", "two"])
        .select("doc_id", "text_hash", F.array_compact(earlier).alias("starts"))
        .filter(F.size("starts") > 0)
        .groupBy("doc_id", "text_hash")
        .agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )
    again = staged(again, "zstd")
    forget(cut)
    forget(found)
    return again


# --- Removal -----------------------------------------------------------------


_RESULT = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(),
    "kept_sha256": pa.string(), "kept_text": pa.string(),
}


def _removed(names: list[str]):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            taken = (batch.column(c).to_pylist() for c in ("doc_id", "text", "starts"))
            for doc_id, text, starts in zip(*taken):
                words = kept = (text or b"").split()
                if starts:
                    windows = np.zeros(len(words), bool)
                    windows[starts] = True
                    stays = ~W.covered(windows, WINDOW, len(words))
                    kept = [words[i] for i in np.flatnonzero(stays)]
                joined = b" ".join(kept)
                digest = hashlib.sha256(joined).hexdigest()
                out.append((doc_id, len(words), len(words) - len(kept), digest, joined)[: len(names)])
            columns = dict(zip(names, list(zip(*out)) or [()] * len(names)))
            if "kept_text" in columns:
                columns["kept_text"] = [t.decode() for t in columns["kept_text"]]
            arrays = [pa.array(columns[n], _RESULT[n]) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return remove


def remove_repeated(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text of every row.

    Removed is each word in a window of 13 words that also starts in a document
    with a smaller doc_id, as the documents were before. ``kept_text`` has the
    other words, joined by a space. Null, empty and blank texts have no words.
    Documents with a null id come before and after none: they lose nothing and
    take nothing. Rows of the same id are one document with several texts, which
    do not count against each other; repeated rows get equal results. Texts of
    any length are searched as a whole. An empty table gives no rows; other
    columns are not read. Bytes that are no UTF-8 read as U+FFFD.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.make_valid_utf8(F.col("text").cast("string")).cast("binary").alias("text"),
    )
    again = repeats(docs.filter(F.col("doc_id").isNotNull()))
    names = list(_RESULT)[: 5 if texts else 4]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    schema += ", kept_text string" if texts else ""
    joined = docs.join(again, ["doc_id", "text_hash"], "left")
    return joined.mapInArrow(_removed(names), schema)
