"""Alignment beside a brute force with the libraries' own encoders, and merge paths beside sorting."""

import collections
import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logstrata.llm import token_alignment as T
from logstrata.llm.query_fertility import vocabulary

PATHS = tuple(map(vocabulary, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
SCHEMA = "doc_id long, text string, row long, a string, key string"


def byte_of():
    """The byte for each character of the byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def brute(texts):
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    a.encode_special_tokens = True
    names, byte = {i: t for t, i in a.get_vocab().items()}, byte_of()
    every = []
    for text in texts:
        found = []
        if text:
            one = a.encode(" " + text, add_special_tokens=False).ids
            two = b.encode(text)
            cut_a = [bytes(byte[c] for c in names[i]) for i in one]
            cut_b = [
                bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, b.id_to_piece(i)) for i in two)
            ]
            if b"".join(cut_a) == (" " + text).encode() == b"".join(cut_b):
                ends_a, ends_b = (np.cumsum([len(c) for c in cut]).tolist() for cut in (cut_a, cut_b))
                before = 0
                for border in sorted(set(ends_a) & set(ends_b)):
                    found.append(
                        (
                            [i for i, e in zip(one, ends_a) if before < e <= border],
                            [i for i, e in zip(two, ends_b) if before < e <= border],
                        )
                    )
                    before = border
        every.append(found)
    pairs = [{(x, y) for one, two in found for x in one for y in two} for found in every]
    counts = collections.Counter(p for own in pairs for p in own)
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for found in every:
        linked = [(x, y) for one, two in found for x in one for y in two]
        text = ";".join(f"{','.join(map(str, one))}|{','.join(map(str, two))}" for one, two in found)
        out.append(
            (
                sum(len(o) for o, _ in found), sum(len(t) for _, t in found), len(found), len(linked),
                sum(counts[p] == most[p[0]] for p in linked), sum(counts[p] for p in linked),
                hashlib.sha256(text.encode()).hexdigest() if found else "",
            )
        )
    return out


TEXTS = [
    None, "", " ", "a", "hello world", "hello world", "  two  spaces\tand\nlines \n\n", "naïve café ▁ mark",
    "<|endoftext|> <s> </s> <0x41> <unk>", "日本語 🙂 Привет", "=" * 333, "-" * 1000 + "x" + "*" * 777,
    "the cat the cat sat", "\x00\x01\x7f", "é ﬁ ½", "word " * 3000, " " * 500 + "end", "aaaaaaa" * 400,
]


@pytest.mark.parametrize(("step", "most"), [(T.PIECE, T.BROADCAST_PAIRS), (7, 0), (64, T.BROADCAST_PAIRS)])
def test_beside_brute_force(spark, step, most):
    rows = [(i, t, -1, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "hello there", 1, "a", "b")]
    got = T.align(spark.createDataFrame(rows, SCHEMA).repartition(3), PATHS, step, most).collect()
    have = sorted(((r["doc_id"], *r[1:]) for r in got), key=repr)
    want = brute([r[1] for r in rows])
    assert have == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)


def test_empty_table(spark):
    assert T.align(spark.createDataFrame([], SCHEMA), PATHS).collect() == []


def test_million_spaces(spark):
    text = "x" + " " * 1_000_000 + "y"
    row = T.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATHS).first()
    assert row["n_a"] > 900_000 and row["n_groups"] > 1000 and row["n_links"] >= row["n_a"]


ENDS = st.lists(st.integers(1, 60), unique=True).map(sorted).map(lambda x: np.array(x, np.int64))


@settings(max_examples=200, deadline=None)
@given(ENDS, ENDS, st.integers(2, 9))
def test_merge_path_cuts_evenly_and_gives_the_same_groups(a, b, step):
    i, j = T.diagonals(a, b, step)
    assert (i[0], j[0]) == (0, 0) and (i[-1], j[-1]) == (len(a), len(b))
    work = np.diff(i) + np.diff(j)
    assert (work <= step + 1).all() and (work >= 0).all()
    parts = []
    for n in range(len(i) - 1):
        own = a[i[n] : i[n + 1]], b[j[n] : j[n + 1]]
        assert not set(own[0].tolist()) & set(b.tolist()) - set(own[1].tolist())
        parts.append((*own, *T.borders(*own)))
    if parts:
        _, _, many_a, many_b = T.stitched(parts)
        assert [many_a.tolist(), many_b.tolist()] == [x.tolist() for x in T.borders(a, b)]


def test_large_groups_count_their_links_by_distinct_ids():
    a, b = np.array([1] * 900 + [2] * 100), np.array([3] * 500)
    keys, times = T.links(a, b, np.array([1000]), np.array([500]), 10)
    assert keys.tolist() == [13, 23] and times.tolist() == [450_000, 50_000]


def test_pieces_give_their_bytes_and_no_others():
    pieces = T.Pieces(PATHS[2])
    for text in ("hello extraordinarily long internationalization words", "日本 🙂\n\t\x00", " " * 40 + "=" * 90):
        ids = pieces.ids(text)
        ends, whole = np.cumsum(pieces.lengths[ids]), b" " + text.encode()
        assert pieces.give(ids, ends, whole)
        for at in range(len(whole)):
            changed = bytearray(whole)
            changed[at] ^= 1
            assert not pieces.give(ids, ends, bytes(changed))
        assert not pieces.give(ids, ends, whole + b"x") and not pieces.give(ids[:-1], ends[:-1], whole)
    assert pieces.give(ids[:0], ends[:0], b"")
