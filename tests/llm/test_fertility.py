"""Fertility: base rules beside brute force, measures by hand, bands and kept rows."""

import collections
import math
import re

import sentencepiece

from logstrata.llm import fertility
from logstrata.llm.query_fertility import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, kept string, h1 string, language string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 8))
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, lines, len(covered), failed


def rows_of():
    good = [f"The quick brown fox number {i} jumps over a lazy dog and runs away {i * 7} times, "
            f"then it sleeps for {i} hours in the warm sun near the old mill" for i in range(80)]  # fmt: skip
    rows = [(i, t, "en") for i, t in enumerate(good)]
    rows += [(100, None, "en"), (101, "", None), (102, "a b c " * 50, "en"), (103, "x\nx\n\n \nx\ny", "en")]
    rows += [(104, "\x1c ü   # <b> " * 9, None), (105, "Привет мир " * 30, None), (None, good[0], "en")]
    rows += [(106, "ᚠᛇᚻ᛫ᛒᛦᚦ᛫ᚠᚱᚩᚠᚢᚱ " + " ".join(f"ᚠ{chr(0x16A0 + i)}ᛦ" for i in range(60)), "en")]
    rows += [(107, " ".join(f"word{i}" for i in range(30_000)), "de"), (1, good[1], "en"), (1, good[1], "en")]
    return [(*r, "k", "h", "l") for r in rows]


def test_measures_and_verdicts(spark):
    rows = rows_of()
    got = fertility.judge(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    have = sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=repr)
    assert have == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    by = {r["doc_id"]: r for r in got}
    ids = [i for w in rows[5][1].split() for i in model.encode(w)]
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in collections.Counter(ids).values())
    assert by[5]["n_tokens"] == len(ids) and math.isclose(by[5]["entropy"], entropy / math.log2(len(ids)))
    assert all(by[i]["kept"] for i in range(80))
    assert by[106]["outside"] and not by[106]["kept"] and by[106]["byte_share"] > 0.5
    assert by[105]["language"] == "Cyrl" and by[104]["language"] == "Latn"
    assert by[107]["kept"] and not by[100]["kept"]


def test_kept_rows(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(repr, (r["doc_id"] for r in fertility.judge(df, PATH).collect() if r["kept"])))
    kept = fertility.keep(df, PATH)
    assert kept.columns == df.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == want
    assert fertility.keep(df.limit(0), PATH).count() == fertility.judge(df.limit(0), PATH).count() == 0


def test_junk_in_thin_languages(spark):
    rows = [r for r in rows_of() if r[2] == "en" and r[0] is not None and r[0] < 100]
    junk = " ".join(f"ᚠ{chr(0x16A0 + i)}ᛦ" for i in range(60))
    good = ("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu "
            "järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä, jokaisella on "
            "oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen")  # fmt: skip
    rows += [(200, junk, "xx", *"khl"), (201, junk + " ᛒ", None, *"khl"), (202, good, "fi", *"khl")]
    rows += [(203, junk, "yy", *"khl"), (204, "и " + junk + " ᛦ" * 3, "yy", *"khl")]
    # Of twenty good documents and one of junk, the language itself says which.
    rows += [(300 + i, f"{good} {i} {i * 7}", "sv", *"khl") for i in range(20)] + [(320, junk, "sv", *"khl")]
    # A script beyond the vocabulary is the rule in a language of its own.
    runes = [" ".join(chr(0x16A0 + (i * 7 + j) % 75) + chr(0x16A0 + j) for j in range(60)) for i in range(15)]
    rows += [(400 + i, t, "rn", *"khl") for i, t in enumerate(runes)]
    by = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, SCHEMA), PATH).collect()}
    for i in (200, 201, 203, 204, 320):
        assert not by[i]["base_failed"] and by[i]["outside"] and not by[i]["kept"]
    assert all(by[i]["kept"] for i in (202, *range(80), *range(300, 320), *range(400, 415)))


def test_a_table_of_one_row(spark):
    rows = rows_of()
    (one,) = fertility.judge(spark.createDataFrame(rows[5:6], SCHEMA), PATH).collect()
    assert one["kept"] and not one["outside"]
