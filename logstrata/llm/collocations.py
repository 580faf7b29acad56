"""Collocations: phrases of words that occur together more often than apart.

Counts of all n-grams are one stream of rows. Sorted in suffix order (last word
first) an n-gram follows the shorter n-grams that it ends in, and sorted in
prefix order those that it begins with, so that one pass over the sorted rows
of a task meets the right counts, another the left ones, and both the most
frequent extension of a phrase to that side. Only the current word and pair are
held, nothing is looked up in a table. A task may begin in the middle of a run:
its first rows get their counts from the last word and pair of the tasks before
it, which are at most two rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.llm import words as W
from logstrata.llm.common import staged

#: Occurrences from which on a phrase is a candidate.
LEAST = 10
#: Share of a phrase's occurrences, in percent, that a longer candidate must have to replace it.
INSIDE_PERCENT = 50
#: Phrases reported for each language.
TOP = 2000
#: Parts of a language that are ranked on their own before their best are.
SALTS = 16
#: Words that a task counts at a time, and bytes of a text that it splits at a time.
HELD_WORDS, CHUNK = 1 << 19, 1 << 20
#: Most bits, as a power of two, that tell frequent pairs (2^28 are 32 MiB), and bits of a block.
MOST_BITS, BLOCK = 28, 1 << 15
#: Rows of a batch that a task passes on.
BATCH = 1 << 16
BREAK = b"."
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(
    _SEPARATORS + b"\t" + bytes(range(65, 91)),
    BREAK * len(_SEPARATORS) + b" " + bytes(range(97, 123)),
)


# --- Counts ------------------------------------------------------------------


class Numbers(dict):
    """Numbers of words in the order they are met; the break between pieces is 0."""

    def __init__(self):
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def chunks(text: bytes, size: int) -> Iterator[bytes]:
    """A text in lower case with one sign between pieces, cut at such signs."""
    text = text.translate(_CLEAN)
    start = 0
    while start < len(text):
        stop = text.find(BREAK, start + size)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].replace(BREAK, b" . ")
        start = stop


class Counter:
    """n-grams of some texts, counted by sorting the numbers of their words."""

    def __init__(self):
        self.numbers, self.found, self.size = Numbers(), {}, 0

    def add(self, lang: str, text: bytes) -> None:
        words = text.split()
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.found.setdefault(lang, []).extend((numbers, np.zeros(1, np.int64)))
        self.size += len(words)

    def rows(self, frequent: Frequent | None) -> Iterator[pa.RecordBatch]:
        """lang, phrase and count of words, pairs and, with a null phrase, of all words.

        With ``frequent`` instead of triples whose two pairs may be frequent.
        """
        words = list(self.numbers)
        names, many = pa.array(words, pa.binary()).cast(pa.string()), len(words)
        hashes = W.WordHashes().of(words) if frequent else None
        for lang, parts in self.found.items():
            every = np.concatenate(parts)
            two = np.flatnonzero((every[:-1] > 0) & (every[1:] > 0))
            keys = every[two] * many + every[two + 1]
            if frequent is None:
                one, f1 = np.unique(every[every > 0], return_counts=True)
                yield from _batches(lang, names, [], np.array([f1.sum()]))
                yield from _batches(lang, names, [one], f1)
                pairs, f2 = np.unique(keys, return_counts=True)
                yield from _batches(lang, names, [pairs // many, pairs % many], f2)
                continue
            pairs, rank = np.unique(keys, return_inverse=True)
            known = frequent.holds(lang, hashes[pairs // many], hashes[pairs % many])[rank]
            three = np.flatnonzero((np.diff(two) == 1) & known[:-1] & known[1:])
            triples, f3 = np.unique(rank[three] * many + every[two[three] + 2], return_counts=True)
            first = pairs[triples // many]
            yield from _batches(lang, names, [first // many, first % many, triples % many], f3)


def _batches(
    lang: str, names: pa.Array, words: list[np.ndarray], counts: np.ndarray
) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(counts), BATCH):
        part = slice(start, start + BATCH)
        size = len(counts[part])
        columns = [names.take(pa.array(w[part])) for w in words]
        phrase = pc.binary_join_element_wise(*columns, " ") if words else pa.nulls(size, pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * size, pa.string()), phrase, pa.array(counts[part])],
            ["lang", "phrase", "f"],
        )


class Frequent:
    """A bit for each hash value of a frequent pair: none of them is missed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        cells = pair_cells(lang, first, second, 8 * len(self.bits))
        return (self.bits[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 > 0


def pair_cells(lang: str, first: np.ndarray, second: np.ndarray, cells: int) -> np.ndarray:
    """The cells of pairs of a language, from the hashes of their words; a power of two."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    found = W.mixed(W.mixed(first + seed) * _ODD + second)
    return found & np.uint64(cells - 1)


def _blocks(cells: int):
    """(block, bits): which cells the pairs of a task fall into, by blocks of cells."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(lang, []).append(phrase.encode().split(b" "))
            hashes = W.WordHashes()
            found = [
                pair_cells(lang, *(hashes.of(list(w)) for w in zip(*pairs)), cells)
                for lang, pairs in parts.items()
            ]
            every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            out = {}
            for block in np.unique(every // np.uint64(BLOCK)).tolist():
                own = every[(every // np.uint64(BLOCK)) == block] % np.uint64(BLOCK)
                out[block] = _bits(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())],
                ["block", "bits"],
            )

    return mark


def _bits(cells: np.ndarray) -> bytes:
    out = np.zeros(BLOCK, np.uint8)
    out[cells.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _either(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK // 8, np.uint8)
    for batch in batches:
        for bits in batch.column("bits").to_pylist():
            total |= np.frombuffer(bits, np.uint8)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()]), pa.array([total.tobytes()])], ["block", "bits"]
    )


def frequent(pairs: DataFrame) -> Frequent:
    """The bits of all frequent pairs; at most 2^``MOST_BITS`` bits, whatever their number."""
    cells = max(BLOCK, 1 << min(MOST_BITS, (16 * pairs.count()).bit_length()))
    found = pairs.select("lang", "phrase").mapInArrow(_blocks(cells), "block long, bits binary")
    found = found.groupBy("block").applyInArrow(_either, "block long, bits binary").toArrow()
    bits = np.zeros(cells // 8, np.uint8)
    for block, own in zip(*(c.to_pylist() for c in found.columns)):
        bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(own, np.uint8)
    return Frequent(bits)


def _count(known, held: int, chunk: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, pairs = Counter(), known.value if known else None
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for part in chunks(text or b"", chunk):
                    counter.add(lang, part)
                    if counter.size > held:
                        yield from counter.rows(pairs)
                        counter = Counter()
        yield from counter.rows(pairs)

    return count


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, w1, w2, w3 (null beyond the phrase) and f of the n-grams that occur ``least`` times.

    A row without words has the number of all words of the language. Words and
    pairs are counted first. Triples are then counted where both their pairs
    may be frequent, as none can be frequent otherwise; that is told from bits,
    which may say so of a rare pair, but never miss a frequent one.
    """
    taken = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.make_valid_utf8(F.col("text").cast("string")).cast("binary").alias("text"),
    )

    def summed(known) -> DataFrame:
        found = taken.mapInArrow(_count(known, HELD_WORDS, CHUNK), "lang string, phrase string, f long")
        found = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        return staged(found.filter(F.col("phrase").isNull() | (F.col("f") >= least)))

    short = summed(None)
    pairs = short.filter(F.col("phrase").contains(" "))
    known = docs.sparkSession.sparkContext.broadcast(frequent(pairs))
    words = F.split("phrase", " ")
    return short.unionByName(summed(known)).select(
        "lang", *[F.get(words, F.lit(i)).alias(f"w{i + 1}") for i in range(3)], "f"
    )


# --- One pass over a sorted stream ---------------------------------------------


_ROW = ["lang", "w1", "w2", "w3", "f"]
_KINDS = "row", "word", "pair", "more"


def _lockstep(passed: list[str], size: int):
    """Rows with the counts of the word and the pair they begin with.

    Also, of the pairs, the count of their most frequent extension. Besides the
    rows themselves come, for other tasks, the last word and pair, and the
    extension of the pair whose run began before this task.
    """
    names = ["kind", *_ROW, *passed, "one", "two", "extended"]
    every = [pa.string()] * 5 + [pa.int64()] * (len(passed) + 4)
    blank = (None,) * len(passed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        word = pair = held = headless = None
        f1 = f2 = most = 0

        def close() -> None:
            """The run of a pair is over: its extension is known."""
            if held is not None:
                out.append((*held, None, most))
            elif headless is not None:
                out.append(("more", *headless, None, None, *blank, None, None, most))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*_ROW, *passed])):
                lang, w1, w2, w3, f = row[:5]
                one = f1 if word == (lang, w1) else None
                if w2 is None or w3 is None:
                    close()
                    held, headless, most = None, None, 0
                if w2 is None:
                    word, f1 = (lang, w1), f
                    out.append(("row", *row, None, None, None))
                elif w3 is None:
                    pair, f2 = (lang, w1, w2), f
                    held = ("row", *row, one)
                else:
                    own = (lang, w1, w2)
                    if own not in (pair, headless):
                        close()
                        held, headless, most = None, own, 0
                    most = max(most, f)
                    out.append(("row", *row, one, f2 if own == pair else None, None))
            while len(out) >= size:
                yield _table(out[:size], names, every)
                out = out[size:]
        close()
        if word is not None:
            out.append(("word", *word, None, None, f1, *blank, None, None, None))
        if pair is not None:
            out.append(("pair", *pair, None, f2, *blank, None, None, None))
        yield _table(out, names, every)

    return scan


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _ending(words: tuple[str, str, str]) -> list[Column]:
    """The words of an n-gram from its last to its first, in the columns ``words``."""
    last, middle, first = words
    return [
        F.coalesce("w3", "w2", "w1").alias(last),
        F.when(F.col("w3").isNotNull(), F.col("w2"))
        .when(F.col("w2").isNotNull(), F.col("w1"))
        .alias(middle),
        F.when(F.col("w3").isNotNull(), F.col("w1")).alias(first),
    ]


def lockstep(stream: DataFrame, passed: list[str], names: tuple[str, str, str]) -> DataFrame:
    """The stream with the columns ``names``: counts of the word and the pair, and extension.

    The words of each row are in w1, w2, w3 in the order of the stream, which is
    dealt out by ranges, sorted and passed over once. ``passed``: other long columns.
    """
    order = ("lang", "w1", "w2", "w3")
    ddl = "kind string, lang string, w1 string, w2 string, w3 string, f long, "
    ddl += "".join(f"{c} long, " for c in passed) + "one long, two long, extended long"
    ranges = stream.repartitionByRange(*order).sortWithinPartitions(*order)
    out = staged(ranges.select(*_ROW, *passed).mapInArrow(_lockstep(passed, BATCH), ddl))

    def of(kind: str, given: str, name: str, *keys: str) -> DataFrame:
        """What tasks pass on to others: one row of this kind a task."""
        own = out.filter(F.col("kind") == kind).groupBy("lang", *keys)
        return F.broadcast(own.agg(F.max(given).alias(name)))

    rows = out.filter(F.col("kind") == "row")
    rows = rows.join(of("word", "f", "_one", "w1"), ["lang", "w1"], "left")
    rows = rows.join(of("pair", "f", "_two", "w1", "w2"), ["lang", "w1", "w2"], "left")
    rows = rows.join(of("more", "extended", "_more", "w1", "w2"), ["lang", "w1", "w2"], "left")
    is_pair, is_triple = F.col("w2").isNotNull() & F.col("w3").isNull(), F.col("w3").isNotNull()
    one, two, extended = names
    return rows.select(
        *_ROW,
        *passed,
        F.when(F.col("w2").isNotNull(), F.coalesce("one", "_one")).alias(one),
        F.when(is_triple, F.coalesce("two", "_two")).alias(two),
        F.when(is_pair, F.greatest("extended", "_more")).alias(extended),
    )


# --- Phrases -----------------------------------------------------------------


def phrases(stream: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of all candidates that no longer one replaces.

    Counts of the streams meet in suffix order first; the rows that come out,
    with the counts to their right, are then sorted in prefix order.
    """
    grams = stream.filter(F.col("w1").isNotNull())
    backward = grams.select("lang", *_ending(("w1", "w2", "w3")), "f")
    right = lockstep(backward, [], ("last", "last_two", "before"))
    kept = ["last", "last_two", "before"]
    forward = right.select("lang", *_ending(("w1", "w2", "w3")), "f", *kept)
    both = lockstep(forward, kept, ("first", "first_two", "after"))

    def score(left: str, rest: str) -> Column:
        # Decimals of 38 digits: exact for counts up to 10^16.
        wide = "cast(1000000 as decimal(7,0)) * cast(f as decimal(16,0)) * cast(f as decimal(16,0))"
        return F.expr(f"{wide} div (cast({left} as decimal(19,0)) * cast({rest} as decimal(19,0)))")

    def cut(left: str, rest: str, place: int) -> Column:
        return F.struct(
            score(left, rest).alias("score"),
            F.lit(place).alias("k"),
            F.col(left).alias("l"),
            F.col(rest).alias("r"),
        )

    longer = F.greatest(F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0)))
    found = both.filter(F.col("w2").isNotNull() & (100 * longer < INSIDE_PERCENT * F.col("f")))
    lowest = F.when(F.col("w3").isNull(), cut("first", "last", 1)).otherwise(
        F.least(cut("first", "last_two", 1), cut("first_two", "last", 2))
    )
    return found.withColumn("cut", lowest).select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        F.col("f").alias("a"),
        *[F.col(f"cut.{c}").alias(c) for c in ("l", "r", "score")],
    )


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score, with their counts.

    Text is lower-cased (A-Z) and cut at ``.,;:!?`` and line ends; words lie
    between spaces and tabs, and phrases of two or three words within a piece.
    ``a`` counts a phrase, ``l`` and ``r`` its parts at the cut of the lowest
    score 10^6 a^2 / (l r), ``n`` all words of the language. Candidates occur
    ``least`` times. One that a longer candidate contains and that has at most
    twice its occurrences is left out. Ties are ordered by ``a`` and then by the
    bytes of the phrase.

    A null language is ``und``. Null and empty texts have no words; bytes that
    are no UTF-8 read as U+FFFD. Repeated rows count as often as they are there.
    Very long texts are counted in chunks, cut between pieces. Without
    candidates, as in an empty table, there are no rows. Other columns are not
    read, and a null or repeated ``doc_id`` makes no difference.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    stream = counts(docs, least)
    found = phrases(stream)
    total = stream.filter(F.col("w1").isNull()).select("lang", F.col("f").alias("n"))
    # The best of each part first, so that no task ranks a whole language.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    part = Window.partitionBy("lang", salt).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(whole).cast("long"))
    best = best.filter(F.col("rank") <= top).join(total, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
