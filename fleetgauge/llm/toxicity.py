"""Toxicity by compression distance.

Two zstandard dictionaries are made, one trained on ordinary text, one that adds what sets toxic text apart: beginnings of
words and words whose share of toxic documents could not come by chance, as short as their evidence allows, since a
compressor finds them inside longer words as well. Windows of words of several sizes are compressed with both; one that the
toxic dictionary shortens more than the ordinary one speaks against its document. A logistic curve, whose thresholds on
these savings are fitted too, turns them into a probability. It is fitted on labelled documents scored with dictionaries of
the other half of them; the final dictionaries are made from all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, staged, utf8

#: Labelled documents the model is fitted on, at most: toxic and ordinary, chosen by a hash of their ids.
SAMPLE = (8000, 16000)
#: Windows of ordinary text that its dictionary is trained on, at most.
ORDINARY_WINDOWS = 40_000
DICTIONARY = 32 << 10
#: Words to a window.
WINDOWS = (6, 12)
#: Bytes of a beginning of a word, with the blank before it.
BEGIN = range(4, 13)
#: Least ratio of document frequencies of what sets toxic text apart, and the share of evidence that a longer form keeps.
RATIO, KEEP = 10.0, 0.8
THRESHOLD = 0.7

_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(text: bytes, size: int) -> list[bytes]:
    """The text's words in lower case, so many to a window, none cut in two."""
    found = _words(text)
    return [b" " + b" ".join(found[i:i + size]) + b" " for i in range(0, len(found), size)]


def segments(text: bytes) -> set[bytes]:
    """The text's words with the blanks around them, and the beginnings of words."""
    found = {b" " + w + b" " for w in _words(text)}
    return found | {w[:n] for w in found for n in BEGIN if n < len(w)}


def _features(saved: list[int]) -> tuple[float, ...]:
    """Largest saving, mean of the three largest, windows that save so many bytes (by logarithm, as a share), the mean."""
    s = np.array(sorted(saved, reverse=True) or [0])
    return (float(s[0]), float(s[:3].mean()), *(float(np.log1p((s >= n).sum())) for n in (2, 3, 4)), float((s >= 3).mean()), float(s.mean()))


N_FEATURES = 7 * len(WINDOWS) + 2


@dataclass
class Model:
    """Dictionaries (contents) and the calibration: weights of (1, *savings())."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def _compressors(self):
        import zstandard

        if self._pair is None:
            self._pair = []
            # What comes last in a dictionary is cheapest to point at; ordinary text costs nearly the same with both.
            for content in (self.ordinary, self.ordinary + self.toxic):
                options = zstandard.ZstdCompressionParameters(
                    format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_GREEDY, min_match=5, window_log=18,
                    hash_log=17, chain_log=17, search_log=6, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0)
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=options)
                self._pair.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=options))
        return self._pair

    def savings(self, text: bytes) -> tuple[float, ...]:
        """_features() of the windows of each size, and the logarithm of the number of windows."""
        if not self.toxic:
            return (0.0,) * (N_FEATURES - 1)
        plain, marked = (c.compress for c in self._compressors())
        found = [windows(text, size) for size in WINDOWS]
        return (*(x for each in found for x in _features([len(plain(w)) - len(marked(w)) for w in each])), float(np.log1p(len(found[-1]))))

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([(1.0, *self.savings(t)) for t in texts]).reshape(len(texts), N_FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples that are too few or too short to train on, their text itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, on features scaled to unit variance; the constant is not shrunk."""
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    middle[0], scale[0] = 0.0, 1.0
    x = (x - middle) / scale
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    w[0] -= (w * middle)[1:].sum()
    return w


def _evidence(a: Column, b: Column, toxic: int, ordinary: int) -> Column:
    """Twice the log likelihood ratio of a segment in `a` toxic and `b` ordinary documents."""
    def part(k: Column, n: int, p: Column) -> Column:
        p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
        return k * F.log(p) + (F.lit(n) - k) * F.log(1 - p)

    both = (a + b) / float(toxic + ordinary)
    return 2 * (part(a, toxic, a / float(toxic)) + part(b, ordinary, b / float(max(1, ordinary)))
                - part(a, toxic, both) - part(b, ordinary, both))


def chosen_segments(evidence: dict[bytes, float]) -> list[bytes]:
    """Of segments that begin alike one: the longest that keeps the evidence of the one with most; by evidence."""
    longest: dict[bytes, bytes] = {}
    for x in sorted(evidence):
        for n in range(BEGIN[0], len(x) + 1):
            if x[:n] in evidence and evidence[x] >= KEEP * evidence[x[:n]] and len(x) > len(longest.get(x[:n], b"")):
                longest[x[:n]] = x
    chosen, held, begun = [], set(), set()
    for w in sorted(evidence, key=lambda w: (-evidence[w], w)):
        if w not in begun and not any(w[:n] in held for n in range(BEGIN[0], len(w) + 1)):
            found = longest[w]
            chosen.append(found)
            held.add(found)
            begun.update(found[:n] for n in range(BEGIN[0], len(found) + 1))
    return chosen


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on a bounded sample (SAMPLE) of the given labelled documents.

    Labels other than 0 and 1 and ids without a document are left aside; of contradicting labels of one id the larger
    counts. Without a toxic and an ordinary document in each half the score of every text is the share of toxic labels.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("doc_id")).agg(F.max(label).alias("toxic"))
    sizes = {row["toxic"]: row["count"] for row in marks.groupBy("toxic").count().collect()}
    some = [marks.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for value, most in ((1, SAMPLE[0]), (0, SAMPLE[1]))]
    rows = documents.select(F.col(key).alias("_id"), utf8(text).alias("text")).join(
        F.broadcast(some[0].unionByName(some[1])), F.col("_id") == F.col("doc_id"))  # at most the sum of SAMPLE rows
    sample = staged(rows.select("toxic", (F.xxhash64(F.lit(1), "doc_id") % 2 == 0).cast("int").alias("half"), "text"), "toxicity-sample")
    parts = {(row["toxic"], row["half"]): row["count"] for row in sample.groupBy("toxic", "half").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(parts) < 4:
        constant = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(b"", b"", np.array([constant] + [0.0] * (N_FEATURES - 1)))

    def frequencies(wanted: frozenset[bytes] | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[int, Counter] = {}
            for batch in chunks(batches, "text"):
                for half, body in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist()):
                    found = segments(body)
                    counts.setdefault(half, Counter()).update(found if wanted is None else found & wanted)
            for half, found in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), pa.array([half] * len(found), pa.int32()), pa.array(found.values(), pa.int64())],
                    names=["segment", "half", "n"])
        return count

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = [(half, w) for half, t in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist()) for w in windows(t, WINDOWS[0])]
            yield pa.RecordBatch.from_pylist([{"half": h, "window": w} for h, w in rows], pa.schema({"half": pa.int32(), "window": pa.binary()}))

    in_half = lambda half, name: F.sum(F.when(F.col("half") == half, F.col("n")).otherwise(0)).cast("double").alias(f"{name}{half}")
    counted = lambda mark, wanted, name: sample.filter(F.col("toxic") == mark).select("half", "text").mapInArrow(
        frequencies(wanted), "segment binary, half int, n long").groupBy("segment").agg(in_half(0, name), in_half(1, name))
    # With fewer toxic documents a segment cannot have the evidence that is asked for below, even if no other has it.
    least = min(4 * log(sum(parts[mark, half] for mark in (0, 1))) / (2 * log(sum(parts[mark, half] for mark in (0, 1)) / parts[1, half])) for half in (0, 1))
    every = staged(counted(1, None, "a"), "toxic-segments")
    different = every.count()
    often = staged(every.filter(F.col("a0") + F.col("a1") >= ceil(least)), "toxic-often")
    # Each stands in several of at most SAMPLE[0] documents.
    wanted = frozenset(bytes(x) for x in often.select("segment").toArrow().column(0).to_pylist())
    known = staged(often.join(counted(0, wanted, "b"), "segment", "left").fillna(0.0, ["b0", "b1"]), "toxic-evidence")
    plain = sample.filter("toxic = 0").select("half", "text").mapInArrow(cut, "half int, window binary").orderBy(
        F.xxhash64("window"), "window", "half").limit(ORDINARY_WINDOWS).collect()

    def dictionaries(halves: tuple[int, ...]) -> Model:
        toxic, ordinary = (sum(parts[mark, half] for half in halves) for mark in (1, 0))
        a, b = (sum((F.col(f"{name}{half}") for half in halves), F.lit(0.0)) for name in "ab")
        # Beyond chance, as often as segments were tried.
        need = 2 * log(toxic + ordinary) + 2 * log(max(different, 1))
        found = known.select("segment", a.alias("a"), b.alias("b")).filter(F.col("a") * ordinary >= RATIO * F.col("b") * toxic).select(
            "segment", _evidence(F.col("a"), F.col("b"), toxic, ordinary).alias("e")).filter(F.col("e") >= need).collect()
        best = chosen_segments({bytes(r["segment"]): r["e"] for r in found})
        return Model(b"".join(reversed(best))[-DICTIONARY:], train_dictionary([bytes(r["window"]) for r in plain if r["half"] in halves], DICTIONARY))

    first, second, model = dictionaries((0,)), dictionaries((1,)), dictionaries((0, 1))

    def saved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = [(first if half else second).savings(t) for half, t in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    held = sorted((row["toxic"], *row["x"]) for row in sample.mapInArrow(saved, "toxic int, x array<double>").collect())  # the sample
    y, x = np.array([row[0] for row in held], float), np.array([(1.0, *row[1:]) for row in held])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # the sample is not drawn in proportion
    model.weights = _fit(x, y, weight)
    return model


def score(text: Column, model: Model) -> Column:
    """The probability that a text is labelled toxic; null counts as empty."""
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(model.score(part.tolist()), index=part.index, dtype="float64")

    return scored(utf8(text))


def classify(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `documents` with toxic_score and toxic_predicted (1 from the threshold on).

    Columns of these two names are replaced. Null and empty texts get the score of a text without any window, equal
    texts equal scores; an empty table stays empty.
    """
    return documents.withColumn("toxic_score", score(F.col(text), model)).withColumn(
        "toxic_predicted", (F.col("toxic_score") >= threshold).cast("int"))
