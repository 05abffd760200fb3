"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback is applied to every word. Characters per token, the share of byte tokens and the
entropy of a document's tokens are held against bands per language (or script, where no language is known) and per
octave of length. The bands come from the quartiles of all documents that pass the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, kept, staged, utf8, words

#: Words a worker keeps before it starts anew; bounds its memory only.
KEPT = 300_000
WINDOW = 8
#: Half widths of a band: so many interquartile ranges, and never less than the floor.
REACH = 6.0
FLOORS = {"chars_per_token": 0.35, "byte_share": 0.03, "entropy": 0.6}

FEATURES = ("script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_tokens long, n_byte_tokens long, entropy double")
_SPACE = b" \t\n\r\x0b\x0c"


class Fertility(dict):
    """Word (bytes) to its token ids (bytes of unsigned 16-bit integers)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.size, self.is_byte = size, np.array([self.model.is_byte(i) for i in range(size)])

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        ids = self[word] = np.asarray(self.model.encode(word.decode("utf-8", "replace")), "<u2").tobytes()
        return ids


def fertility(path: str) -> Fertility:
    return kept(("fertility", path), lambda: Fertility(path))


_STEPS = np.random.Generator(np.random.PCG64(8)).integers(1, 2**63, WINDOW).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, the first one included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for k in range(window):
        windows += hashes[k:k + n] * _STEPS[k]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


#: First and last code points of the scripts that are told apart; fixed values of the character table.
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
           ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


def script_of(text: str) -> str:
    """The script of most letters; none: 'none'."""
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le", "replace"), "<u4")
    if not len(points):
        return "none"
    counts = {name: int(((points >= a) & (points <= b)).sum()) for name, a, b in SCRIPTS}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def measure(text: bytes, model: Fertility, with_script: bool) -> tuple:
    """The base counts and token figures of one whole text."""
    found = words(text)
    decoded = text.decode("utf-8", "replace")
    spaces = len(text) - len(text.translate(None, _SPACE))
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)] if b"\n" in text else []
    repeats = 0
    if len(found) > WINDOW:
        repeats = repeated_words(np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64))
    ids = np.frombuffer(b"".join(map(model.__getitem__, found)), "<u2")
    entropy = 0.0
    if len(ids):
        counts = np.bincount(ids, minlength=model.size) if len(ids) > 4000 else np.unique(ids, return_counts=True)[1]
        share = counts[counts > 0] / len(ids)
        entropy = float(-(share * np.log2(share)).sum())
    return (script_of(decoded) if with_script else None, len(found), len(decoded) - spaces,
            len(text) - len(text.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeats,
            len(ids), int(model.is_byte[ids].sum()), entropy)


def features(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, group (language, else script), base counts and token figures."""
    kinds = (pa.string(), *[pa.int64()] * 7, pa.float64())
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fertility(vocabulary)
        for batch in chunks(batches, "text"):
            langs = batch.column("lang")
            rows = [measure(body, model, lang is None) for body, lang in zip(batch.column("text").to_pylist(), langs.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), langs, *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))],
                names=["doc_id", "lang", *names])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), utf8(text).alias("text"))
    return rows.mapInArrow(measured, f"doc_id long, lang string, {FEATURES}").select(
        "doc_id", F.coalesce("lang", F.concat(F.lit("script:"), "script")).alias("group"), *names[1:])


def judge(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """features() with chars_per_token, byte_share, base_failed and kept.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows. kept: not base_failed, and
    each figure inside its band. A null text has no words and fails. Null languages are judged by script. Equal rows get
    equal results, an empty table gives no rows, other columns are not read.
    """
    rows = staged(features(documents, vocabulary, key, text, lang).withColumns({
        "chars_per_token": F.when(F.col("n_tokens") > 0, F.col("word_chars") / F.col("n_tokens")),
        "byte_share": F.when(F.col("n_tokens") > 0, F.col("n_byte_tokens") / F.col("n_tokens")),
        "octave": F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    }), "fertility")
    quartiles = [F.percentile_approx(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 1000).alias(c) for c in FLOORS]
    bands = rows.filter("NOT base_failed").groupBy("group", "octave").agg(*quartiles).select(
        F.col("group").alias("_group"), F.col("octave").alias("_octave"), *(
            edge for c, floor in FLOORS.items() for edge in (
                (F.col(c)[1] - F.greatest(REACH * (F.col(c)[2] - F.col(c)[0]), F.lit(floor))).alias(f"_{c}_low"),
                (F.col(c)[1] + F.greatest(REACH * (F.col(c)[2] - F.col(c)[0]), F.lit(floor))).alias(f"_{c}_high"))))
    held = rows.join(bands, F.col("group").eqNullSafe(F.col("_group")) & (F.col("octave") == F.col("_octave")), "left")
    inside = [F.coalesce(F.col(c).between(F.col(f"_{c}_low"), F.col(f"_{c}_high")), F.lit(False)) for c in FLOORS]
    return held.withColumn("kept", ~F.col("base_failed") & inside[0] & inside[1] & inside[2]).drop(
        "_group", "_octave", *(f"_{c}_{e}" for c in FLOORS for e in ("low", "high")))
