"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two strings sums over all subsequences of four symbols that they
share, each weighted by a decay to the power of the stretch it takes, so that
``i-d-i-o-t`` and ``idiiot`` still resemble ``idiot``. Strings are the short
windows of a text. Words that are more frequent in toxic than in other
documents are the landmarks of a Nyström map, in which a linear machine is
trained. Only documents are labelled: a toxic one stands for its most toxic
window, any other for its least harmless one, chosen anew in each round.

A machine that is linear in the kernel values of its landmarks is a sum over
the subsequences of a window, so that one table of weights, looked up for every
subsequence of a text, gives the exact value of all its windows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.llm.common import staged

#: Symbols: 0 matches nothing, 1-26 letters, 27 a space, others by their number.
SYMBOLS, SPACE, OTHER = 32, 27, 28
#: Signs that are written for letters.
LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Symbols of a subsequence, the longest stretch it may take, and the decay for each symbol of it.
LENGTH, STRETCH, DECAY = 4, 7, 0.4
#: Symbols of a window, and how many of the texts are looked at together.
WINDOW, PART = 16, 1 << 16
#: Most landmarks, the part of them that are common words, and how many there are at least.
LANDMARKS, COMMON, LEAST = 256, 0.25, 8
#: Beginnings of words that may be landmarks beside whole words, with the space before them.
BEGINNINGS = range(5, 9)
#: Most labelled documents, toxic and other, that are learnt from; all are while there are fewer.
MOST_TOXIC, MOST_OTHER = 3000, 6000
#: Windows of a text, apart from each other, whose values its score comes from.
BEST = 3
#: Rounds of choosing windows, and the weight of errors beside that of the norm.
ROUNDS, COST = 4, 1.0
#: From this score on a document is called toxic.
THRESHOLD = 0.3
#: Weight of the norm when scores are fitted to values.
RIDGE = 0.1
_STEPS = np.array([(0, *c) for c in combinations(range(1, STRETCH), LENGTH - 1)])
_WEIGHTS = (DECAY ** (_STEPS[:, -1] + 1 - LENGTH)).astype(np.float32)


# --- The kernel --------------------------------------------------------------


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """The symbol of each character of the basic plane."""
    out = np.zeros(1 << 16, np.uint8)
    for point in range(1 << 16):
        sign = LIKE.get(chr(point), chr(point))
        first = unicodedata.normalize("NFKD", sign).lower()[:1]
        if "a" <= first <= "z":
            out[point] = ord(first) - 96
        elif sign.isspace():
            out[point] = SPACE
        elif sign.isalpha():
            out[point] = OTHER + point % (SYMBOLS - OTHER)
    return out


def symbols(text: str) -> np.ndarray:
    """The symbols of a text, between spaces; runs of spaces are one."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    found = _table()[np.minimum(points, 0xFFFF)]
    space = found == SPACE
    return found[~(space & np.concatenate([[False], space[:-1]]))]


def subsequences(found: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the subsequences that begin in the first symbols of a string."""
    padded = np.concatenate([found, np.zeros(STRETCH, found.dtype)]).astype(np.int32)
    at = np.arange(min(begin, len(found)))[:, None, None] + _STEPS
    parts = padded[at]
    codes = (parts * SYMBOLS ** np.arange(LENGTH - 1, -1, -1)).sum(axis=2)
    whole = (parts > 0).all(axis=2)
    return codes[whole], np.broadcast_to(_WEIGHTS, whole.shape)[whole]


class Landmarks:
    """Subsequences of some strings, each string scaled to the norm one."""

    def __init__(self, words: list[np.ndarray]):
        found = [subsequences(w, WINDOW) for w in words]
        codes = np.concatenate([c for c, _ in found])
        weights = np.concatenate([w for _, w in found])
        of = np.repeat(np.arange(len(words)), [len(c) for c, _ in found])
        self.codes, at = np.unique(codes, return_inverse=True)
        self.matrix = np.zeros((len(self.codes), len(words)), np.float32)
        np.add.at(self.matrix, (at, of), weights)
        norm = np.sqrt((self.matrix**2).sum(axis=0))
        self.matrix /= np.where(norm > 0, norm, 1)

    def kernel(self, windows: list[np.ndarray]) -> np.ndarray:
        """Kernel values of windows with all landmarks."""
        out = np.zeros((len(windows), self.matrix.shape[1]), np.float32)
        for i, window in enumerate(windows):
            codes, weights = subsequences(window, WINDOW)
            at = np.searchsorted(self.codes, codes)
            hit = self.codes[np.minimum(at, len(self.codes) - 1)] == codes
            out[i] = weights[hit] @ self.matrix[at[hit]]
        return out

    def weights(self, beta: np.ndarray) -> np.ndarray:
        """The weight of every subsequence for a combination of landmarks."""
        out = np.zeros(SYMBOLS**LENGTH, np.float32)
        out[self.codes] = self.matrix @ beta.astype(np.float32)
        return out


def _values(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each symbol the weighted sum of the subsequences that begin with it."""
    padded = np.concatenate([found, np.zeros(STRETCH, found.dtype)]).astype(np.int32)
    columns = [padded[i : i + len(found)] for i in range(STRETCH)]
    begun = {(0,): columns[0]}
    total = np.zeros(len(found), np.float32)
    for steps, decay in zip(_STEPS.tolist(), _WEIGHTS):
        for n in range(2, LENGTH):
            if (own := tuple(steps[:n])) not in begun:
                begun[own] = begun[own[:-1]] * SYMBOLS + columns[own[-1]]
        code = begun[tuple(steps[:-1])] * SYMBOLS + columns[steps[-1]]
        total += weights[code] * decay
    return total


class Best:
    """The most toxic windows of texts that lie apart from each other.

    A window has ``WINDOW`` symbols, or what is left of the text, in which its
    subsequences begin. Values are at least 0, as that of a text without symbols
    is. A very long text is looked at in parts, and short ones are together.
    """

    def __init__(self, weights: np.ndarray):
        self.weights = weights  # 0 for any subsequence with the symbol 0
        self.found: list[list[tuple[float, bytes]]] = []
        self.waiting: list[tuple[int, int, np.ndarray]] = []
        self.size = 0

    def add(self, text: str) -> None:
        every, beyond = symbols(text), WINDOW + STRETCH - 1
        self.found.append([])
        for start in range(0, len(every), PART):
            part = every[start : start + PART + beyond]
            own = min(PART, len(every) - start)
            self.waiting.append((len(self.found) - 1, own, part))
            self.size += len(part)
            if self.size >= PART:
                self._look()

    def _look(self) -> None:
        gap = np.zeros(WINDOW + STRETCH, np.uint8)
        joined = np.concatenate([x for _, _, p in self.waiting for x in (p, gap)])
        sums = np.concatenate([[0.0], np.cumsum(_values(joined, self.weights), dtype=np.float64)])
        values = sums[np.minimum(np.arange(len(joined)) + WINDOW, len(joined))] - sums[:-1]
        start = 0
        for text, size, part in self.waiting:
            own = values[start : start + size]
            for _ in range(BEST):
                at = int(own.argmax())
                if own[at] <= 0:
                    break
                window = joined[start + at : start + at + WINDOW + STRETCH - 1].tobytes()
                self.found[text].append((float(own[at]), window))
                own[max(0, at - WINDOW + 1) : at + WINDOW] = 0
            start += len(part) + len(gap)
        self.waiting, self.size = [], 0

    def done(self) -> tuple[np.ndarray, list[bytes]]:
        """The ``BEST`` largest values of each text in falling order, and its first window."""
        if self.waiting:
            self._look()
        values, windows = np.zeros((len(self.found), BEST)), []
        for i, found in enumerate(self.found):
            best = sorted(found, reverse=True)[:BEST]
            values[i, : len(best)] = [v for v, _ in best]
            windows.append(best[0][1] if best else b"")
        return values, windows


# --- Training ------------------------------------------------------------------


def _inverse_root(within: np.ndarray) -> np.ndarray:
    """The inverse square root of a kernel matrix, without its null space."""
    values, vectors = np.linalg.eigh(within.astype(np.float64))
    keep = values > 1e-6 * values[-1]
    return (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T


def machine(features: np.ndarray, toxic: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps.

    Both classes weigh the same.
    """
    x = np.column_stack([features, np.ones(len(features))]).astype(np.float64)
    y = np.where(toxic, 1.0, -1.0)
    share = np.where(toxic, 1 / max(toxic.sum(), 1), 1 / max((~toxic).sum(), 1))
    share *= cost * len(y) / 2
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(30):
        own = x[active] * share[active, None]
        w = np.linalg.solve(ridge + own.T @ x[active], own.T @ y[active])
        new = y * (x @ w) < 1
        if (new == active).all():
            break
        active = new
    return w[:-1], float(w[-1])


def curve(values: np.ndarray, toxic: np.ndarray, counts: tuple[float, float]) -> np.ndarray:
    """A logistic curve over columns of values, by Newton steps on smoothed labels.

    ``counts``: other and toxic labels altogether, of which these are a sample.
    """
    many = np.array([(~toxic).sum(), toxic.sum()], float)
    target = np.where(toxic, (many[1] + 1) / (many[1] + 2), 1 / (many[0] + 2))
    weight = np.where(toxic, counts[1] / max(many[1], 1), counts[0] / max(many[0], 1))
    x = np.column_stack([values, np.ones(len(values))])
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + RIDGE * (w**2).sum() / 2)

    for _ in range(100):
        p = _logistic(x @ w)
        down = x.T @ (weight * (p - target)) + RIDGE * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step, size = np.linalg.solve(bend, down), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# --- Labels and texts on Spark ---------------------------------------------------


def held_out() -> Column:
    """Rows whose labels are not learnt from."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """Labelled texts to learn from, and the numbers of other and toxic labels.

    All of them, up to ``MOST_TOXIC`` and ``MOST_OTHER``; beyond that, those
    whose ids have the smallest hashes.
    """
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")
    )
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    parts = [
        known.filter(F.col("toxic") == toxic).orderBy(*order).limit(most)
        for toxic, most in ((True, MOST_TOXIC), (False, MOST_OTHER))
    ]
    taken = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text())
    return staged(texts.join(taken, "doc_id")), (counts.get(False, 0), counts.get(True, 0))


def _text() -> Column:
    return F.make_valid_utf8(F.col("text").cast("string")).alias("text")


def _strings(text: str) -> set[bytes]:
    """The words of a text between spaces, and beginnings of them."""
    space, out = bytes([SPACE]), set()
    for word in set(symbols(text).tobytes().split(space)):
        word = space + word.replace(b"\0", b"")[: WINDOW - 2]
        out.add(word + space)
        out.update(word[:k] for k in BEGINNINGS if len(word) > k)
    return {w for w in out if len(w) >= LENGTH}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents of a batch have a string."""
    for batch in batches:
        counts: dict[bytes, list[int]] = {}
        for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic"))):
            for word in _strings(text or ""):
                counts.setdefault(word, [0, 0])[toxic] += 1
        other, toxic = zip(*counts.values()) if counts else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(toxic, pa.int64()), pa.array(other, pa.int64())],
            ["word", "toxic", "other"],
        )


def _landmarks(sample: DataFrame, others: int, toxic: int) -> tuple[list[bytes], np.ndarray]:
    """Strings that tell toxic documents by a likelihood ratio, then common ones; and first weights."""
    words = sample.mapInArrow(_counted, "word binary, toxic long, other long").groupBy("word")
    words = words.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).filter("t > 1")

    def part(count: Column, of: Column) -> Column:
        return F.when(count > 0, count * F.log(count / of)).otherwise(0.0)

    t, o, many, rest = F.col("t"), F.col("o"), F.lit(float(toxic)), F.lit(float(others))
    apart = part(t, many) + part(many - t, many) + part(o, rest) + part(rest - o, rest)
    together = part(t + o, many + rest) + part(many + rest - t - o, many + rest)
    ratio = F.when(t / many > o / rest, 2 * (apart - together)).otherwise(0.0)
    words = staged(words.withColumn("ratio", F.round(ratio, 9)))
    sure = 2 * np.log(max(words.count(), 1))
    telling = words.orderBy(F.col("ratio").desc(), F.length("word").desc(), "word")
    first, seen, taken = [], set(), set()
    for row in telling.limit(8 * LANDMARKS).collect():
        word, key = bytes(row["word"]), (row["t"], row["o"], bytes(row["word"])[: min(BEGINNINGS)])
        enough = len(first) >= LEAST and row["ratio"] < sure
        if row["ratio"] <= 0 or enough or len(first) >= LANDMARKS * (1 - COMMON):
            break
        if key not in seen:  # not a beginning beside the word it is one of
            seen.add(key)
            taken.add(word)
            first.append((word, row["ratio"]))
    many_common = max(LEAST, int(len(first) * COMMON / (1 - COMMON)))
    often = words.orderBy((F.col("t") + F.col("o")).desc(), "word").limit(2 * LANDMARKS)
    common = [w for w in (bytes(r["word"]) for r in often.collect()) if w not in taken]
    strings = [w for w, _ in first] + common[:many_common]
    begin = np.zeros(len(strings))
    begin[: len(first)] = np.sqrt([r for _, r in first])
    return strings, begin


def _looked(known):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = Best(known.value)
            for text in batch.column("text").to_pylist():
                best.add(text or "")
            values, windows = best.done()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("toxic"),
                    pa.array(values.tolist(), pa.list_(pa.float64())), pa.array(windows, pa.binary()),
                ],
                ["doc_id", "toxic", "best", "window"],
            )

    return look


class Model:
    """Weights of subsequences and the curve from the values of windows to a score."""

    def __init__(self, weights: np.ndarray, line: np.ndarray):
        self.weights, self.line = weights.astype(np.float32), line

    def scores(self, texts: list[str | None]) -> np.ndarray:
        best = Best(self.weights)
        for text in texts:
            best.add(text or "")
        values, _ = best.done()
        return _logistic(np.column_stack([values, np.ones(len(values))]) @ self.line)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels (doc_id, toxic) of rows that are not held out.

    Learns from at most ``MOST_TOXIC`` toxic and ``MOST_OTHER`` other documents,
    whose texts stay in Spark: the driver gets counts of the strings that may be
    landmarks and one window of each document in each round. Labels that are
    null, of no document or of a null id are left out; of several labels of an
    id the toxic one counts. Without labels of both kinds every text gets the
    same score, the share of toxic labels (0 without any).
    """
    spark = docs.sparkSession
    sample, counts = _sample(docs, labels)
    have = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(have) < 2:
        share = counts[1] / max(sum(counts), 1)
        line = np.zeros(BEST + 1)
        line[-1] = np.log(share / (1 - share)) if 0 < share < 1 else 500.0 if share else -500.0
        return Model(np.zeros(SYMBOLS**LENGTH), line)
    strings, begin = _landmarks(sample, have[False], have[True])
    landmarks = Landmarks([np.frombuffer(s, np.uint8) for s in strings])
    root = _inverse_root(landmarks.matrix.T @ landmarks.matrix)
    weights, other = landmarks.weights(begin), {}

    def look() -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        known = spark.sparkContext.broadcast(weights)
        schema = "doc_id long, toxic boolean, best array<double>, window binary"
        found = sample.mapInArrow(_looked(known), schema).toArrow()
        found = found.sort_by([("doc_id", "ascending"), ("window", "ascending")])
        known.unpersist()
        toxic = found.column("toxic").to_numpy().astype(bool)
        return np.array(found.column("best").to_pylist()), toxic, found.column("window").to_pylist()

    def features(windows: list[bytes]) -> np.ndarray:
        return landmarks.kernel([np.frombuffer(w, np.uint8) for w in windows]) @ root

    for _ in range(ROUNDS):
        _, toxic, windows = look()
        new = {w for w, t in zip(windows, toxic) if not t} - other.keys()
        other.update(zip(sorted(new), features(sorted(new))))
        x = np.concatenate([features([w for w, t in zip(windows, toxic) if t]), list(other.values())])
        w, _ = machine(x, np.arange(len(x)) < toxic.sum())
        weights = landmarks.weights(root @ w)
    values, toxic, _ = look()
    return Model(weights, curve(values, toxic, counts))


def _scored(known):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = known.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                    pa.array((scores >= THRESHOLD).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its text alone.

    Null and empty texts, and those without letters, have windows of value 0 and
    their score. Bytes that are no UTF-8 read as U+FFFD, which matches nothing.
    Texts of any length are looked at as a whole, in parts. Repeated rows and
    rows with a null id, which is not held out, each give a row; an empty table
    gives none. The model is one table of 4 MiB, which is broadcast.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), _text()
    )
    schema = "doc_id long, held_out boolean, score double, predicted int"
    return taken.mapInArrow(_scored(known), schema)
