"""Words of a column of bytes beside a plain split."""

import numpy as np
import pyarrow as pa

from logstrata.llm import words as W


def texts():
    rng = np.random.default_rng(4)
    signs = np.frombuffer(b"ab\x00\xff \t\n\x0b\x0c\r\x1c\x08\x0e!", np.uint8)
    out = [rng.choice(signs, rng.integers(0, 60)).tobytes() for _ in range(300)]
    out += [None, b"", b"  ", b"a", b"a", b"a", None, "é ü x".encode(), b"end "]
    long = [bytes([97 + n % 5]) * n for n in (1, 7, 8, 9, 15, 16, 17, 255, 256, 257, 264, 3000)]
    return out + [b" ".join(long), b"\t".join(long[::-1])]


def test_spans_are_the_words_of_split():
    for part in (slice(None), slice(7, 250), slice(0, 0), slice(300, 301)):
        found = W.spans(pa.array(texts(), pa.binary())[part])
        split = [(t or b"").split() for t in texts()[part]]
        data = found.data.tobytes()
        got = [data[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist())]
        assert got == [w for s in split for w in s]
        assert np.diff(found.before).tolist() == [len(s) for s in split]


def test_hashes_are_equal_where_words_are():
    found = W.spans(pa.array(texts(), pa.binary()))
    words = [w for t in texts() for w in (t or b"").split()]
    pairs = set(zip(words, W.span_hashes(found).tolist()))
    assert len(pairs) == len(set(words)) == len({h for _, h in pairs})
    alone = W.span_hashes(W.spans(pa.array([words[-1], words[-1]], pa.binary())))
    assert (words[-1], int(alone[0])) in pairs and alone[0] == alone[1]
