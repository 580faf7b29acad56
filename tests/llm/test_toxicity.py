"""The kernel beside its definition, the table of weights beside the kernel, and accuracy on held-out rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from logstrata.llm import toxicity as T

SCHEMA = "doc_id long, text string, toxic string, score string, held_out string"
LABELS = "doc_id long, toxic int, text string"


def features(found):
    """Weights of all subsequences of a window, by going through all places."""
    out = {}
    for places in itertools.combinations(range(len(found)), T.LENGTH):
        stretch = places[-1] - places[0] + 1
        if stretch <= T.STRETCH and places[0] < T.WINDOW and all(found[p] for p in places):
            key = tuple(int(found[p]) for p in places)
            out[key] = out.get(key, 0.0) + T.DECAY ** (stretch - T.LENGTH)
    return out


def test_kernel_is_the_sum_over_shared_subsequences():
    chance = random.Random(5)
    strings = [np.array([chance.choice([0, 1, 2, 3, 27]) for _ in range(n)], np.uint8) for n in (4, 9, 20, 22)]
    landmarks = T.Landmarks(strings[:3])
    got = landmarks.kernel(strings)
    for i, j in itertools.product(range(4), range(3)):
        one, two = features(strings[i]), features(strings[j])
        norm = sum(w * w for w in two.values()) ** 0.5 or 1
        want = sum(w * two.get(k, 0) for k, w in one.items()) / norm
        assert got[i, j] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_table_gives_the_kernel_values_of_all_windows(monkeypatch):
    chance = np.random.default_rng(3)
    landmarks = T.Landmarks([T.symbols(w) for w in ("idiot", "moron", "the", "loser")])
    beta = chance.normal(size=4)
    texts = ["you i-d-i-o-t of a mo ron", "", "the loser", "?!", "plain words only " * 60, "idiot " * 40]
    want = []
    for text in texts:
        every = T.symbols(text)
        windows = [every[i : i + T.WINDOW + T.STRETCH - 1] for i in range(len(every))]
        want.append(max([0.0, *(landmarks.kernel(windows) @ beta)]))
    for part in (T.PART, 50):
        monkeypatch.setattr(T, "PART", part)
        best = T.Best(landmarks.weights(beta))
        for text in texts:
            best.add(text)
        values, windows = best.done()
        assert values[:, 0] == pytest.approx(want, rel=1e-3, abs=1e-4)
        assert (np.diff(values, axis=1) <= 0).all() and len(windows) == len(texts)


def test_signs_and_accents_stand_for_letters():
    assert T.symbols("Ïd10t $cum").tolist() == T.symbols(" idiot \n scum").tolist()


INSULTS = ["blorkhead", "snivelwit", "grumplord", "vexfool"]


def corpus(seed, count):
    chance = random.Random(seed)
    words = ["".join(chance.choices(["ta", "ri", "mon", "el", "is", "or", "an", "te"], k=chance.randrange(1, 5))) for _ in range(900)]
    rows = []
    for i in range(count):
        text, toxic = chance.choices(words, k=chance.randrange(1, 120)), i % 8 == 0
        if toxic:
            insult = chance.choice(INSULTS)
            if chance.random() < 0.4:  # a sign or a letter inserted
                at = chance.randrange(1, len(insult))
                insult = insult[:at] + chance.choice("-.*xq") + insult[at:]
            elif chance.random() < 0.2:
                insult = "-".join(insult)
            text.insert(chance.randrange(len(text) + 1), insult)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1, 1600)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t, _ in rows], SCHEMA).repartition(4)
    others = [(None, 1, "w"), (99_999, 1, "w"), (5, None, "")]
    labels = spark.createDataFrame([(i, y, "w") for i, _, y in rows] + others, LABELS)
    got = {r["doc_id"]: r for r in T.score(docs, T.fit(docs, labels)).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    caught = sum(r["predicted"] for r, y in held if y) / sum(y for _, y in held)
    alone = sum(not r["predicted"] for r, y in held if not y) / sum(not y for _, y in held)
    assert caught >= 0.9 and alone >= 0.97

    # Labels of held-out rows, and all columns but the text, make no difference.
    other = [(i, 1 - y if got[i]["held_out"] else y, "v") for i, _, y in rows]
    again = T.score(docs, T.fit(docs, spark.createDataFrame(other + others, LABELS))).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {i: r["score"] for i, r in got.items()}


def test_edge_rows_and_few_labels(spark):
    rows = [(1, None), (2, ""), (3, "a fine day"), (3, "a fine day"), (None, "x"), (4, "word " * 100_000), (5, "\x00é")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    model = T.fit(docs, spark.createDataFrame([], LABELS))
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) and max(r["score"] for r in got) < 1e-9
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert T.score(spark.createDataFrame([], SCHEMA), model).collect() == []
    only = spark.createDataFrame([(i, 0, "") for i in (1, 2, 3)], LABELS)
    assert max(r["score"] for r in T.score(docs, T.fit(docs, only)).collect()) < 0.3
