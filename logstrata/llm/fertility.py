"""Quality by tokeniser fertility: how a public vocabulary cuts a text.

Each word is encoded with a public byte-fallback vocabulary. A text then has
characters per token, the share of tokens that stand for single bytes, and the
entropy of its tokens. Bands for each language (or script, where the language
is null) come from all documents; what falls outside is rejected, besides what
fails the base rules. Of a language with few documents the band leans on that
of the script, and of a rare script on that of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.llm import words as W
from logstrata.llm.common import staged, text_hashes, without

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Interquartile ranges beyond the quartiles that a band reaches.
REACH = 3.5
#: Tokens below which a band is wider, by the standard error of a mean.
SURE_TOKENS = 512
#: Tokens beyond which more of them are not expected to raise the entropy.
FULL_TOKENS = 1024
#: Documents from which on the quartiles of a language or script are its own;
#: with fewer they lean on those above it, with one they are those.
OWN_DOCS = 10
#: Documents from which on a band is as narrow as its quartiles make it.
SURE_DOCS = 50
#: How far one document of an unknown language may be from the band above:
#: shares of the quartile for characters per token and entropy; byte share.
APART = (0.4, 0.25, 0.6)
#: Least widths of the bands: characters per token, byte share, entropy.
LEAST_WIDTH = (0.1, 0.05, 0.05)
#: Most languages whose bands are broadcast; more are joined by a shuffle.
BROADCAST_BANDS = 10_000
MEASURES = ("chars_per_token", "byte_share", "entropy")
#: First and last code points of scripts; letters elsewhere count as Latin.
SCRIPTS = {
    "Grek": (0x370, 0x3FF),
    "Cyrl": (0x400, 0x52F),
    "Hebr": (0x590, 0x5FF),
    "Arab": (0x600, 0x6FF),
    "Deva": (0x900, 0x97F),
    "Thai": (0xE00, 0xE7F),
    "Kana": (0x3040, 0x30FF),
    "Hani": (0x4E00, 0x9FFF),
    "Hang": (0xAC00, 0xD7AF),
}


def script(text: str) -> str:
    """The script of most characters that are in one of ``SCRIPTS``; else Latin."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = {k: int(((points >= a) & (points <= b)).sum()) for k, (a, b) in SCRIPTS.items()}
    most = max(counts, key=counts.get)
    letters = int((((points | 32) >= 97) & ((points | 32) <= 122)).sum())
    return most if counts[most] > letters else "Latn"


class Encoder(dict):
    """Token ids of words, as bytes of two each, made when first asked for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self.model.encode(word.decode()), self.kind).tobytes()
        if len(self) < W.REMEMBERED:
            self[word] = ids
        return ids

    def counts(self, found: list[bytes]) -> np.ndarray:
        ids = np.frombuffer(b"".join(map(self.__getitem__, found)), self.kind)
        return np.bincount(ids, minlength=len(self.is_byte))


def base(text: bytes, found: list[bytes], hashes: W.WordHashes) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    chars = len(text.decode()) - (len(text) - len(text.translate(None, SPACE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    windows = W.gram_hashes(hashes.of(found), WINDOW)
    repeats = 0
    if len(windows) > 1 and (twice := W.repeated(windows)).any():
        repeats = int(W.covered(twice, WINDOW, len(found)).sum())
    return chars, symbols, len(lines) - len(set(lines)), repeats


def _measures(path: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, hashes = Encoder(path), W.WordHashes()
        for batch in batches:
            rows = []
            for *keys, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or b""
                found = text.split()
                counts = encoder.counts(found)
                used = counts[counts > 0]
                tokens = int(used.sum())
                own = base(text, found, hashes)
                written = "Latn" if text.isascii() else script(text.decode())
                share = used / max(tokens, 1)
                entropy = float(-(share * np.log2(share)).sum())
                full = math.log2(min(tokens, FULL_TOKENS)) if tokens > 1 else 1.0
                rows.append(
                    (
                        *keys, lang, written, lang if lang is not None else written,
                        len(found), *own, tokens, own[0] / max(tokens, 1),
                        float(counts[encoder.is_byte].sum()) / max(tokens, 1), entropy / full,
                    )
                )
            columns = list(zip(*rows)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES
            )

    return measure


_NAMES = (
    "doc_id h1 h2 lang script language n_words word_chars n_symbols n_dup_lines n_repeat_words n_tokens "
    "chars_per_token byte_share entropy"
).split()
_TYPES = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.int64()] * 6 + [pa.float64()] * 3
_SCHEMA = ", ".join(
    f"{n} {'string' if t == pa.string() else 'double' if t == pa.float64() else 'long'}"
    for n, t in zip(_NAMES, _TYPES)
)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def measure(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The measures of every document and hashes of its text, without a shuffle.

    ``vocabulary`` is the path of a SentencePiece model with byte fallback,
    which every executor has. Null and empty texts have no words and no tokens,
    texts of any length are measured as a whole, and bytes that are no UTF-8 read
    as U+FFFD. Other columns are not read.
    """
    taken = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *text_hashes(),
        F.make_valid_utf8(F.col("text").cast("string")).cast("binary").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    return taken.mapInArrow(_measures(vocabulary), _SCHEMA)


def _quartiles(measured: DataFrame, *by: str) -> DataFrame:
    """The number of documents that pass the base rules, and their quartiles."""
    passed = ~base_failed()
    return measured.groupBy(*by).agg(
        F.count(F.when(passed, 1)).alias("docs"),
        *[
            F.percentile_approx(
                F.when(passed, F.col(m)), F.array(F.lit(0.25), F.lit(0.75)), 10_000
            ).alias(m)
            for m in MEASURES
        ],
    )


def _band(above: str | None) -> list[Column]:
    """For each measure q1, q3, reach and apart, from ``docs`` and its quartiles.

    ``above`` is the prefix of the columns of the band to lean on.
    """
    docs = F.coalesce("docs", F.lit(0))
    own = F.least(F.lit(1.0), F.greatest(F.lit(0), docs - 1) / (OWN_DOCS - 1))
    unsure = F.least(F.lit(1.0), F.greatest(F.lit(0), SURE_DOCS - docs) / (SURE_DOCS - 1))

    def leant(value: Column, name: str) -> Column:
        if above is None:
            return value
        upper = F.col(above + name)
        return F.coalesce(own * value + (1 - own) * upper, upper)

    out = []
    for name, least, apart in zip(MEASURES, LEAST_WIDTH, APART):
        low, high = F.col(name)[0], F.col(name)[1]
        reach = F.greatest(REACH * (high - low), F.lit(least))
        upper = F.col(f"{above}{name}_apart") if above else F.lit(0.0)
        out += [
            leant(low, f"{name}_q1").alias(f"{name}_q1"),
            leant(high, f"{name}_q3").alias(f"{name}_q3"),
            leant(reach, f"{name}_reach").alias(f"{name}_reach"),
            F.greatest(apart * unsure, (1 - own) * upper).alias(f"{name}_apart"),
        ]
    return out


def bands(measured: DataFrame) -> DataFrame:
    """The middle band of each language and script that occur together.

    Quartiles come from all documents that pass the base rules. A language of
    ``SURE_DOCS`` of them has its own band alone. With fewer the band is wider,
    the more so the fewer there are, and below ``OWN_DOCS`` it passes over into
    the band of the script, which in the same way passes over into that of all
    documents. So every document has a band, and one that is alone in its
    language is no measure of itself.
    """
    both = measured.select("language", "script").distinct()
    total = _quartiles(measured).select(*_band(None))
    total = F.broadcast(total.select(*[F.col(c).alias(f"all_{c}") for c in total.columns]))
    scripts = _quartiles(measured, "script").crossJoin(total).select("script", *_band("all_"))
    scripts = scripts.select(
        F.col("script").alias("band_in"),
        *[F.col(c).alias(f"script_{c}") for c in scripts.columns if c != "script"],
    )
    languages = _quartiles(measured, "language").withColumnRenamed("language", "band_of")
    pairs = both.join(F.broadcast(scripts), F.col("script") == F.col("band_in"))
    pairs = pairs.join(languages, F.col("language") == F.col("band_of"))
    return pairs.select("band_of", "band_in", *_band("script_"))


def judge(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The measures of every document, base_failed, outside (of a band) and kept.

    A document is kept if it does not fail the base rules and all measures lie
    within the bands of its language; too even token counts (a high entropy)
    are no fault. Short texts get wider bands, as their measures vary more.
    Every row of ``docs`` gives a row; an empty table gives none.
    """
    measured = staged(measure(docs, vocabulary))
    wider = F.sqrt(F.greatest(F.lit(1.0), SURE_TOKENS / F.greatest("n_tokens", F.lit(1))))

    def beyond(name: str, share: bool) -> tuple[Column, Column]:
        low, high, apart = (F.col(f"{name}_{c}") for c in ("q1", "q3", "apart"))
        reach = F.col(f"{name}_reach") * wider
        return (
            F.col(name) < low - reach - (apart * low if share else apart),
            F.col(name) > high + reach + (apart * high if share else apart),
        )

    (few, many), (_, odd), (dull, _) = map(beyond, MEASURES, (True, False, True))
    outside = F.coalesce(few | many | odd | dull, F.lit(False))
    known = staged(bands(measured))
    if known.count() <= BROADCAST_BANDS:
        known = F.broadcast(known)
    of = (F.col("language") == F.col("band_of")) & (F.col("script") == F.col("band_in"))
    joined = measured.join(known, of, "left")
    return joined.select(
        *[n for n in _NAMES if n != "script"],
        base_failed().alias("base_failed"),
        outside.alias("outside"),
        (~base_failed() & ~outside).alias("kept"),
    )


def keep(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    A verdict depends on text and language alone, which are the keys that
    rejected rows are found by.
    """
    rejected = judge(docs, vocabulary).filter(~F.col("kept"))
    columns = docs.columns
    language = F.col("lang").cast("string")
    keyed = docs.withColumns(dict(zip(("_h1_", "_h2_"), text_hashes())))
    keyed = keyed.withColumn("_lang_", language)
    given = rejected.select(
        F.col("h1").alias("_h1_"), F.col("h2").alias("_h2_"), F.col("lang").alias("_lang_")
    )
    return without(keyed, given, ["_h1_", "_h2_", "_lang_"]).select(columns)
