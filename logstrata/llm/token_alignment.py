"""Which tokens of two vocabularies share the bytes of a text.

Both vocabularies cut the same bytes. Where tokens of both end is a border, and
the tokens between two borders are a group, whose tokens of the one vocabulary
are linked with those of the other. Borders come from merging the sorted ends
of both: diagonals of the merge path, found by binary search, divide the
merging of a long text into pieces of equal work, which are rows of their own
and merged by any task. A piece knows the groups that its borders close and how
many tokens are left open at its end; the pieces of a text are stitched in
order, which adds what is left open to the first group of the next piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.llm.common import staged

#: Ends of both vocabularies that one piece merges.
PIECE = 1 << 15
#: Links of a group beyond which its distinct ids are paired instead of its tokens.
SMALL_GROUP = 1 << 12
#: Distinct id pairs that a task adds up before it passes them on (16 bytes each).
HELD_PAIRS = 1 << 19
#: Most id pairs whose counts are broadcast (17 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 1 << 21
#: Rows that are scored together when counts are joined by a shuffle.
BLOCK = 128
SPACE_MARK = "▁"


# --- Vocabularies ------------------------------------------------------------


class ByteLevel:
    """Ids and bytes of tokens by a byte-level vocabulary: A, of which a space goes before a text."""

    def __init__(self, json_path: str, rank_path: str):
        import public_tokenizers
        import tiktoken

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.json_path, self.slow = json_path, None
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.size = max(ranks.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for token, number in ranks.items():
            self.lengths[number] = len(token)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(" " + text).astype(np.int64)
        except Exception:  # the pattern gives up on very long runs of white space
            return self._slow_ids(" " + text)

    def _slow_ids(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Ids and bytes of tokens by a vocabulary of pieces with byte fallback: B."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        found = [self._bytes(i) for i in range(self.size)]
        self.lengths = np.array([len(b) for b in found], np.int64)
        # The bytes of each token as words of eight, and of them those that count.
        width = 8 * -(-int(self.lengths.max()) // 8)
        filled = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in found), np.uint8)
        used = np.arange(width) < self.lengths[:, None]
        self.words = np.ascontiguousarray(filled.reshape(self.size, width)).view(np.uint64)
        self.masks = np.where(used, 255, 0).astype(np.uint8).view(np.uint64)

    def _bytes(self, number: int) -> bytes:
        piece = self.model.id_to_piece(number)
        if self.model.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE_MARK, " ").encode()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)

    def give(self, ids: np.ndarray, ends: np.ndarray, text: bytes) -> bool:
        """Whether the tokens that end there are the bytes of the text."""
        if not len(ids) or ends[-1] != len(text):
            return not len(ids) and not text
        padded = np.frombuffer(text + bytes(8 * self.words.shape[1]), np.uint8)
        eight = np.ndarray(len(padded) - 7, np.uint64, padded, strides=(1,))
        starts = ends - self.lengths[ids]
        for n in range(self.words.shape[1]):
            if n:
                long = self.lengths[ids] > 8 * n
                ids, starts = ids[long], starts[long]
            if not len(ids):
                break
            if ((eight[starts + 8 * n] ^ self.words[ids, n]) & self.masks[ids, n]).any():
                return False
        return True


@lru_cache(maxsize=1)
def vocabularies(json_path: str, rank_path: str, piece_path: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(json_path, rank_path), Pieces(piece_path)


# --- Merge path --------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of ``a`` and of ``b`` come before each cut of their merge path.

    A cut after every ``step`` merged ends, each found by a binary search along
    its diagonal, for all cuts at once; from (0, 0) to all ends. Equal ends
    stay on one side of a cut.
    """
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, step), total)
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    a, b = np.append(a, -1), np.append(b, np.iinfo(np.int64).max)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # Of a tie the end of ``a`` comes first.
        first = a[middle] <= b[np.maximum(at - middle - 1, 0)]
        low = np.where(open_ & first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    i, j = low, at - low
    return i, j + ((i > 0) & (a[i - 1] == b[j]))


def borders(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of ``a`` and of ``b`` in each group that a common end closes."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = min(a[0], b[0])
    at = np.full(max(a[-1], b[-1]) - first + 1, -1, np.int32)
    at[b - first] = np.arange(len(b))
    place = at[a - first]
    common = np.flatnonzero(place >= 0)
    place = place[common]
    many_a, many_b = common.copy(), place.astype(np.int64)
    many_a[1:] -= common[:-1]
    many_b[1:] -= place[:-1]
    many_a[:1] += 1
    many_b[:1] += 1
    return many_a, many_b


def stitched(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One text from its pieces (a, b, tokens of a, tokens of b in closed groups)."""
    a, b, many_a, many_b = map(list, zip(*parts))
    open_a = open_b = 0
    for i in range(len(parts)):
        if len(many_a[i]):
            many_a[i], many_b[i] = many_a[i].copy(), many_b[i].copy()
            many_a[i][0] += open_a
            many_b[i][0] += open_b
            open_a = open_b = 0
            open_a += len(a[i]) + (many_a[i][0] - parts[i][2][0]) - many_a[i].sum()
            open_b += len(b[i]) + (many_b[i][0] - parts[i][3][0]) - many_b[i].sum()
        else:
            open_a += len(a[i])
            open_b += len(b[i])
    return tuple(map(np.concatenate, (a, b, many_a, many_b)))


# --- Pieces as rows ----------------------------------------------------------


def _ints(values: np.ndarray) -> bytes:
    """Small integers as bytes: two each where that does, else four or eight."""
    most = int(values.max()) if len(values) else 0
    kind = np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _read(data: bytes) -> np.ndarray:
    kind = {2: np.uint16, 4: np.uint32, 8: np.uint64}[data[0]]
    return np.frombuffer(data, kind, offset=1).astype(np.int64)


def _rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types.values())], list(types)
    )


_PIECES = {
    "row": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "pieces": pa.int32(),
    "a": pa.binary(), "b": pa.binary(), "many_a": pa.binary(), "many_b": pa.binary(),
    "from_a": pa.int64(), "from_b": pa.int64(),
}
_GROUPS = {k: t for k, t in _PIECES.items() if k not in ("from_a", "from_b")}
_TEXT = "row long, doc_id long, piece int, pieces int, a binary, b binary"
_GROUPS_DDL = f"{_TEXT}, many_a binary, many_b binary"
_PIECES_DDL = f"{_GROUPS_DDL}, from_a long, from_b long"


def _encoded(paths: tuple[str, str, str], step: int):
    """Rows of texts with their groups; of long texts the pieces, which are yet to be merged."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = vocabularies(*paths)
        for batch in batches:
            out = []
            for row, doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                text = (data or b"").decode("utf-8", "replace")
                a = b = np.zeros(0, np.int64)
                if text:
                    a, b = first.ids(text), second.ids(text)
                ends_a, ends_b = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
                # Tokens of A are the bytes in order, if none is missing.
                if text and (ends_a[-1] != len(data) + 1 or not second.give(b, ends_b, b" " + data)):
                    a = b = ends_a = ends_b = a[:0]
                if len(a) + len(b) <= step:
                    own = (_ints(a), _ints(b), *map(_ints, borders(ends_a, ends_b)))
                    out.append((row, doc_id, 0, 1, *own, 0, 0))
                    continue
                i, j = diagonals(ends_a, ends_b, step)
                for n in range(len(i) - 1):
                    own = _ints(a[i[n] : i[n + 1]]), _ints(b[j[n] : j[n + 1]])
                    before = [int(e[k[n] - 1]) if k[n] else 0 for e, k in ((ends_a, i), (ends_b, j))]
                    out.append((row, doc_id, n, len(i) - 1, *own, None, None, *before))
            yield _rows(out, _PIECES)

    return encode


def _merged(paths: tuple[str, str, str]):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = vocabularies(*paths)
        for batch in batches:
            out = []
            for *keys, a, b, _, _, from_a, from_b in zip(*(c.to_pylist() for c in batch.columns)):
                ends_a = from_a + np.cumsum(first.lengths[_read(a)])
                ends_b = from_b + np.cumsum(second.lengths[_read(b)])
                out.append((*keys, a, b, *map(_ints, borders(ends_a, ends_b))))
            yield _rows(out, _GROUPS)

    return merge


def _stitch(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of one text, which is no longer than the text was as a row."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    rows.sort(key=lambda r: r["piece"])
    parts = [tuple(_read(r[c]) for c in ("a", "b", "many_a", "many_b")) for r in rows]
    yield _rows([(rows[0]["row"], rows[0]["doc_id"], 0, 1, *map(_ints, stitched(parts)))], _GROUPS)


def groups(docs: DataFrame, paths: tuple[str, str, str], step: int) -> DataFrame:
    """Tokens and group sizes of every row; pieces of long texts are merged by any task."""
    pieces = staged(docs.mapInArrow(_encoded(paths, step), _PIECES_DDL), "zstd")
    long = pieces.filter(F.col("pieces") > 1).mapInArrow(_merged(paths), _GROUPS_DDL)
    long = staged(long.groupBy("row").applyInArrow(_stitch, _GROUPS_DDL), "zstd")
    whole = pieces.filter(F.col("pieces") == 1).drop("from_a", "from_b")
    return whole.unionByName(long).drop("piece", "pieces")


# --- Links -------------------------------------------------------------------


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``times`` for each."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(times, starts) if len(starts) else times


def links(
    a: np.ndarray, b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of linked ids as ``a * size + b``, and how many links each has."""
    from_a, from_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    small = many_a * many_b <= SMALL_GROUP
    if (many_a == 1).all() and (many_b == 1).all():
        return _counts(a * size + b)
    times = np.repeat(np.where(small, many_b, 0), many_a)
    start = np.repeat(from_b, many_a)
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    plain = np.repeat(a, times) * size + b[np.repeat(start, times) + place]
    if small.all():
        return _counts(plain)
    found, counts = [plain], [np.ones(len(plain), np.int64)]
    for g in np.flatnonzero(~small):
        own_a, times_a = np.unique(a[from_a[g] : from_a[g] + many_a[g]], return_counts=True)
        own_b, times_b = np.unique(b[from_b[g] : from_b[g] + many_b[g]], return_counts=True)
        found.append((own_a[:, None] * size + own_b).reshape(-1))
        counts.append((times_a[:, None] * times_b).reshape(-1))
    return _summed(np.concatenate(found), np.concatenate(counts))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """row, doc_id and the four arrays of every row that has tokens; None without."""
    names = ("row", "doc_id", "a", "b", "many_a", "many_b")
    for row, doc_id, *data in zip(*(batch.column(n).to_pylist() for n in names)):
        yield row, doc_id, list(map(_read, data)) if len(data[0]) > 1 else None


def _pairs(size: int, held: int):
    """(key, n): rows of a task that hold a pair, for as many rows as fit in memory at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, waiting, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for _, _, parts in _unpacked(batch):
                if parts is not None:
                    waiting.append(links(*parts, size)[0])
                    n += len(waiting[-1])
            if n > held:
                keys, times = _added(keys, times, waiting)
                waiting, n = [], 0
            if len(keys) > held:
                yield _counted(keys, times)
                keys, times = keys[:0], times[:0]
        yield _counted(*_added(keys, times, waiting))

    return count


def _added(keys: np.ndarray, times: np.ndarray, more: list[np.ndarray]):
    if not more:
        return keys, times
    own, counts = _counts(np.concatenate(more))
    return _summed(np.concatenate([keys, own]), np.concatenate([times, counts]))


def _counted(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])


def _block_pairs(size: int):
    """(block, key) of the pairs that a block of rows holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, blocks = [], []
            for row, _, parts in _unpacked(batch):
                if parts is not None:
                    found.append(links(*parts, size)[0])
                    blocks.append(np.full(len(found[-1]), row // BLOCK))
            if found:
                both = np.unique(np.stack([np.concatenate(blocks), np.concatenate(found)]), axis=1)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, both)), ["block", "key"])

    return count


_SCORES = {
    "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
    "n_links": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64(),
    "groups_sha256": pa.string(),
}
_SCORES_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
    "count_sum long, groups_sha256 string"
)


@lru_cache(maxsize=1)
def _decimals(size: int) -> np.ndarray:
    """Ids as decimal text, with each sign that may follow one; zero bytes fill up."""
    return np.array([b"%d%b" % (i, sign) for sign in (b",", b"|", b";") for i in range(size)])


def written(a: np.ndarray, b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray, size: int) -> bytes:
    """The groups of a text as ``a1,a2|b1;a3|b2,b3``; ids are below ``size``."""
    last_a, last_b = np.cumsum(many_a) - 1, np.cumsum(many_b) - 1
    place_a = np.arange(len(a)) + np.repeat(last_b + 1 - many_b, many_a)
    place_b = np.arange(len(b)) + np.repeat(last_a + 1, many_b)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    signs = np.zeros(len(ids), np.int64)
    signs[place_a[last_a]], signs[place_b[last_b]] = 1, 2
    filled = _decimals(size)[ids + signs * size].tobytes()
    return filled.translate(None, b"\0")[:-1]


def _score(doc_id, parts, sizes: tuple[int, int], keys, counts, best) -> tuple:
    """A row of the result, from the pairs of all documents with their counts."""
    if parts is None:
        return doc_id, 0, 0, 0, 0, 0, 0, ""
    a, b, many_a, many_b = parts
    pairs, times = links(*parts, sizes[1])
    at = np.searchsorted(keys, pairs)
    digest = hashlib.sha256(written(*parts, max(sizes))).hexdigest()
    return (
        doc_id, len(a), len(b), len(many_a), int(times.sum()), int(times[best[at]].sum()),
        int((times * counts[at]).sum()), digest,
    )


def _scored(sizes: tuple[int, int], known):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            yield _rows([_score(d, p, sizes, *table) for _, d, p in _unpacked(batch)], _SCORES)

    return score


def _sorted(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their counts and whether those are the highest of their A id."""
    keys, counts, best = (found.column(c).to_numpy() for c in ("key", "n", "best"))
    order = np.argsort(keys)
    return keys[order], counts[order], best[order].astype(bool)


def _scored_block(sizes: tuple[int, int]):
    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        table = _sorted(found)
        out = [_rows([_score(d, p, sizes, *table) for _, d, p in _unpacked(b)], _SCORES)
               for b in rows.to_batches()]
        return pa.Table.from_batches(out, pa.schema(list(_SCORES.items())))

    return score


def _block() -> Column:
    return F.floor(F.col("row") / BLOCK).cast("long").alias("block")


def align(
    docs: DataFrame, paths: tuple[str, str, str], step: int = PIECE, most: int = BROADCAST_PAIRS
) -> DataFrame:
    """Groups, links and their counts over all documents, for every row of ``docs``.

    ``paths``: the JSON and the rank file of the byte-level vocabulary A, and
    the model of the pieces B; every executor has them. A text gets a space in
    front. Of the links, ``count_sum`` adds up in how many documents each pair
    of ids is linked, and ``n_best`` counts those whose pair is linked in as
    many as any pair of the same A id, so that ties are all best.

    Texts that are null, empty or not given back by both vocabularies have no
    tokens: zeros and an empty digest. Bytes that are no UTF-8 are such a case.
    Each row is a document of its own, also where it repeats another or its id
    is null. Texts may have any length: their tokens are merged in pieces of
    ``step`` ends. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    first, second = vocabularies(*paths)
    size, sizes = second.size, (first.size, second.size)
    if first.size * size >= 1 << 62:
        raise ValueError("pairs of these vocabularies do not fit in 62 bits")
    taken = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    )
    found = groups(taken, paths, step)
    pairs = found.mapInArrow(_pairs(size, HELD_PAIRS), "key long, n long")
    pairs = staged(pairs.groupBy("key").agg(F.sum("n").alias("n")))
    of_a = F.expr(f"key div {size}").alias("id_a")
    highest = pairs.groupBy(of_a).agg(F.max("n").alias("most"))
    counts = pairs.select("key", "n", of_a).join(highest, "id_a")
    counts = counts.select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    if pairs.count() <= most:
        known = spark.sparkContext.broadcast(_sorted(counts.toArrow()))
        return found.mapInArrow(_scored(sizes, known), _SCORES_DDL)
    own = found.mapInArrow(_block_pairs(size), "block long, key long").distinct()
    own = own.join(counts, "key").select("block", "key", "n", "best")
    blocks = found.withColumn("block", _block()).groupBy("block")
    return blocks.cogroup(own.groupBy("block")).applyInArrow(_scored_block(sizes), _SCORES_DDL)
