"""Phrases beside a brute-force version, with tasks that begin anywhere in a run."""

import collections
import random
import re

import pytest

from logstrata.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, w1 string, f long, n long"


def brute(rows, least, top):
    grams, out = collections.defaultdict(collections.Counter), []
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    grams[lang or "und"][tuple(words[i : i + k])] += 1
    for lang, f in grams.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        most = collections.Counter()
        for g, c in f.items():
            if len(g) == 3 and c >= least:
                for inner in (g[:2], g[1:]):
                    most[inner] = max(most[inner], c)
        found = []
        for g, a in f.items():
            if len(g) > 1 and a >= least and not 100 * most[g] >= 50 * a:
                cuts = [(10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, rest) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, rest, n, -score))
    return sorted(out)


def rows_of(seed):
    chance = random.Random(seed)
    words = ["the", "The", "a", "of", "new", "york", "city", "né", "x\x01", "x", "日本", "it's"]
    rows = []
    for _ in range(150):
        text = "".join(
            chance.choices(words, [9, 2, 3, 3, 4, 4, 4, 2, 2, 2, 1, 1])[0] + chance.choice([" "] * 9 + ["\t", ", ", ".", "\n", "  "])
            for _ in range(chance.randrange(40))
        )
        rows.append((text, chance.choice(["en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), (" . ,", "fr"), ("one word", "xx"), ("a b " * 3000, "big"), ("\xa0 \x0b\x1c " * 30, "en")]


@pytest.mark.parametrize(("seed", "least", "top", "parts"), [(1, 10, 2000, 1), (2, 3, 7, 9), (3, 2, 50, 40)])
def test_beside_brute_force(spark, monkeypatch, seed, least, top, parts):
    monkeypatch.setattr(C, "HELD_WORDS", 50)
    monkeypatch.setattr(C, "CHUNK", 30)
    monkeypatch.setattr(C, "BATCH", 5)
    rows = rows_of(seed)
    docs = spark.createDataFrame([(i % 7, t, g, "w", 1, 2) for i, (t, g) in enumerate(rows)], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.mine(docs.repartition(3), least, top).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, got)) == brute(rows, least, top)
    assert len(got) > 5


def test_bits_miss_no_frequent_pair(spark):
    pairs = [("en" if i % 3 else "de", f"word{i} né{i * i}") for i in range(300)]
    found = C.frequent(spark.createDataFrame(pairs, "lang string, phrase string").repartition(3))
    for lang, phrase in pairs:
        one, two = (C.W.WordHashes().of([w.encode()]) for w in phrase.split())
        assert found.holds(lang, one, two).all()
    one, two = (C.W.WordHashes().of([f"{w}{i}".encode() for i in range(300)]) for w in "xy")
    assert found.holds("en", one, two).mean() < 0.1


def test_empty_table(spark):
    assert C.mine(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    rows = [("en", None, None, None, 10 * big)]
    rows += [("en", w, None, None, f) for w, f in (("a", big), ("b", big + 7), ("c", big + 11))]
    rows += [("en", "a", "b", None, big - 1), ("en", "b", "c", None, big - 5)]
    stream = spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, f long")
    got = {r["phrase"]: r["score"] for r in C.phrases(stream).collect()}
    assert got == {
        "a b": 10**6 * (big - 1) ** 2 // (big * (big + 7)),
        "b c": 10**6 * (big - 5) ** 2 // ((big + 7) * (big + 11)),
    }
