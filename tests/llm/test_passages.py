"""Repeated passages beside a brute-force version, and the index beside plain search."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from logstrata.llm import passages
from logstrata.llm import words as W

SCHEMA = "doc_id long, text string, kept_text string, starts string"


def brute(rows):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - 12):
            if i is not None:
                w = tuple(words[k : k + 13])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - 12):
            if i is not None and first[tuple(words[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def rows():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [list(rng.choice(vocabulary, n)) for n in (13, 14, 20, 55, 120)]
    out = []
    for i in range(80):
        words = list(rng.choice(vocabulary, rng.integers(0, 90)))
        for s in rng.choice(len(shared), rng.integers(0, 3)):
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = shared[s]
        out.append((int(rng.integers(0, 10**6)), " ".join(words)))
    out += [(7, "a " * 60), (8, "a " * 13), (9, "a " * 12), (10, "b " + "a " * 30)]
    out += [(5, out[0][1]), (5, out[0][1]), (5, out[1][1]), (None, out[1][1]), (6, None), (4, "")]
    out += [(3, "é ü " * 40 + "\n\t x"), (2, "\x1c " * 20), (1, " ".join(vocabulary * 40))]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_words": 200}, {"hot": 3, "shard_words": 500}])
def test_same_as_brute_force(spark, monkeypatch, options):
    found = passages.repeats
    monkeypatch.setattr(passages, "repeats", lambda docs: found(docs, **options))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows()], SCHEMA)
    got = sorted((tuple(r) for r in passages.remove_repeated(df).collect()), key=repr)
    assert got == brute(rows())


def test_empty_table(spark):
    assert passages.remove_repeated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_gives_matching_statistics():
    rng = np.random.default_rng(2)
    segments = [rng.integers(0, 4, n).astype(np.uint64) for n in (5, 9, 30, 1, 17)]
    lengths = np.array([len(s) for s in segments])
    docs = np.array([50, 40, 30, 20, 10])
    index = passages.FMIndex(np.concatenate(segments), lengths, docs)
    query = rng.integers(0, 4, 60).astype(np.uint64)
    numbers = np.searchsorted(index.vocabulary, query)
    length, low, high = index.matching(numbers, np.arange(60), 8)
    first = index.first_doc(low[length == 3], high[length == 3])
    plain = [s.tolist() for s in segments]

    def holders(part):
        return [
            d for s, d in zip(plain, docs)
            if any(s[k : k + len(part)] == part for k in range(len(s) - len(part) + 1))
        ]

    for end in range(60):
        best = 0
        for n in range(1, min(8, end + 1) + 1):
            if holders(query[end - n + 1 : end + 1].tolist()):
                best = n
        assert length[end] == best
    for end, doc in zip(np.flatnonzero(length == 3), first):
        assert doc == min(holders(query[end - 2 : end + 1].tolist()))


def test_segment_keys_depend_on_words_alone():
    words = np.arange(40, dtype=np.uint64) % np.uint64(20)
    keys = passages.segment_keys(words, np.array([0, 20, 1]), np.array([5, 5, 5]))
    assert all(k[0] == k[1] != k[2] for k in keys)
    assert W.covered(np.array([1, 0, 0, 0], bool), 2, 4).tolist() == [True, True, False, False]


def batch(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    arrays = [ids, ids, pa.array([t.encode() for t in texts], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "text"])


def test_segments_of_a_batch_are_those_of_its_texts():
    texts = [(t or "") for _, t in rows()]
    (got,) = passages._routes(iter([batch(texts)]))
    for i, text in enumerate(texts):
        (one,) = passages._routes(iter([batch([text])]))
        mine = got.filter(pc.equal(got["doc_id"], i)).select(["shingle", "start", "windows"])
        assert mine.equals(one.select(["shingle", "start", "windows"]))
        covered = [s + k for s, n in zip(*map(pa.Array.to_pylist, mine.columns[1:])) for k in range(n)]
        assert covered == list(range(max(0, len(text.encode().split()) - 12)))


def test_suffix_array_sorts_all_suffixes():
    rng = np.random.default_rng(5)
    for most in (1, 2, 9, 2**40):
        for n in (1, 2, 30, 200):
            symbols = rng.integers(0, most, n)
            plain = sorted(range(n), key=lambda i: symbols[i:].tolist())
            assert passages.suffix_array(symbols).tolist() == plain


def test_parts_are_the_words_with_short_gaps():
    texts = ["a  b \t c", "", "d e" + " " * 99 + "f g"]
    found = W.spans(batch(texts).column("text"))
    parts = passages._parts(found, np.array([0, 3, 5]), np.array([3, 2, 2]))
    assert parts == [b"a b c", b"d e", b"f g"]


def test_rare_words_cost_no_call_each(monkeypatch):
    """Before, a task hashed each word again that it could not remember."""
    calls = []
    monkeypatch.setattr(W, "REMEMBERED", 10)
    monkeypatch.setattr(W.xxhash, "xxh3_64_intdigest", lambda word: calls.append(word) or len(calls))
    texts = [" ".join(f"w{i}" for i in range(k, k + 200)) for k in range(0, 2000, 100)]
    (routes,) = passages._routes(iter([batch(texts)]))
    assert routes.num_rows > 0 and not calls


def test_deep_matches_need_few_counts(monkeypatch):
    """Before, each step of each search counted twice through all levels."""
    asked, rank = [], passages.WaveletMatrix.rank

    def counted(matrix, symbols, at):
        asked.append(len(symbols))
        return rank(matrix, symbols, at)

    monkeypatch.setattr(passages.WaveletMatrix, "rank", counted)
    words = np.random.default_rng(6).integers(0, 2000, 20_000)
    lengths = np.full(1000, 20)
    index = passages.FMIndex(words, lengths, np.arange(1000))
    ends = np.flatnonzero(np.arange(20_000) % 20 >= 12)
    length, low, high = index.matching(np.searchsorted(index.vocabulary, words), ends, 13)
    assert (length == 13).all() and (high > low).all()
    assert (index.first_doc(low, high) == ends // 20).all()
    assert sum(asked) < 2 * 12 * len(ends) / 5
