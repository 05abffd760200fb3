"""Multilingual mixture inference.

Every language has a model of byte trigrams inside words. A document is a mixture of languages, one per word;
expectation-maximisation estimates its proportions from the words' likelihoods, and languages are dropped one by one as
long as the penalised likelihood (half the logarithm of the number of words for each language) gets better.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

#: Trigrams are hashed to so many cells; with the number of languages this bounds the model.
CELLS = 1 << 16
UNKNOWN = "und"
STEPS = 12
#: Trigrams of a word that count as independent evidence: neighbours overlap.
WEIGHT = 0.6
#: Languages with a smaller share than this (or less than half a word) go without a test.
SLIGHT = 0.004

# ASCII letters in lower case and bytes of longer characters stay, the rest parts words.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the trigrams of all words, with the word of each trigram and the text of each word."""
    data = np.frombuffer(b" " + b"  ".join(texts).translate(_FOLD) + b" ", np.uint8)
    space = data == 32
    centre = np.flatnonzero(~space)  # one trigram around each letter, so no word is without
    cells = (data[centre - 1].astype(np.uint32) << 16) | (data[centre].astype(np.uint32) << 8) | data[centre + 1]
    cells = ((cells * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % CELLS
    word = np.cumsum(space[centre - 1]) - 1
    first = centre[space[centre - 1]]
    ends = np.cumsum([len(t) + 2 for t in texts])
    return cells, word, np.searchsorted(ends, first, "right")


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # CELLS x languages, log probabilities

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Likelihoods of all words under each language, the best being 1, and the text of each word."""
        cells, word, text = trigrams(texts)
        if not len(text):
            return np.zeros((0, len(self.languages)), np.float32), text
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        logs = np.add.reduceat(self.weights[cells], starts, axis=0) * np.float32(WEIGHT)
        logs -= logs.max(axis=1, keepdims=True)
        return np.exp(logs), text

    def mixtures(self, texts: list[bytes]) -> np.ndarray:
        """Proportions of the selected languages, one row per text (zeros where it has no word)."""
        like, text = self.words(texts)
        n = np.bincount(text, minlength=len(texts)).astype(np.float64)
        shares = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            at = np.searchsorted(some, text)
            shares[some] = select(like, at, n[some])
        return shares


def maximise(like: np.ndarray, text: np.ndarray, shares: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some steps of expectation and maximisation, and the log likelihood of each text before the last."""
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    counts = np.diff(np.append(starts, len(text)))[:, None]
    score = np.zeros(len(shares))
    for step in range(steps):
        joint = like * shares.astype(np.float32)[text]
        total = joint.sum(axis=1, keepdims=True)
        if step == steps - 1:
            score = np.add.reduceat(np.log(np.maximum(total[:, 0], 1e-30)).astype(np.float64), starts)
        joint /= np.maximum(total, 1e-30)
        shares = np.add.reduceat(joint, starts, axis=0) / counts
    return shares, score


def select(like: np.ndarray, text: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions for the language set of best penalised likelihood, by backward elimination."""
    k = like.shape[1]
    shares, score = maximise(like, text, np.full((len(n), k), 1.0 / k), STEPS)
    slight = (shares < SLIGHT) | (shares * n[:, None] < 0.5)
    slight[np.arange(len(n)), shares.argmax(axis=1)] = False
    shares = np.where(slight, 0, shares)
    shares /= shares.sum(axis=1, keepdims=True)
    busy = np.flatnonzero((shares > 0).sum(axis=1) > 1)
    while len(busy):
        chosen = np.zeros(len(n), bool)
        chosen[busy] = True
        rows = np.flatnonzero(chosen[text])
        sub, at = like[rows], np.searchsorted(busy, text[rows])
        full, full_score = maximise(sub, at, shares[busy], 4)
        least = np.where(full > 0, full, 2).argmin(axis=1)
        fewer = full.copy()
        fewer[np.arange(len(busy)), least] = 0
        fewer, fewer_score = maximise(sub, at, fewer / np.maximum(fewer.sum(axis=1, keepdims=True), 1e-30), 5)
        drop = fewer_score + 0.5 * np.log(np.maximum(n[busy], 2)) > full_score
        shares[busy] = np.where(drop[:, None], fewer, full)
        busy = busy[drop & ((fewer > 0).sum(axis=1) > 1)]
    return shares


def train(documents: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram counts of all given documents with a language and a text; one cell table per language is collected."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "text"):
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist())
            cells, word, of = trigrams(texts)
            owner = langs[of[word]] if len(word) else langs[:0]
            for name in set(langs.tolist()):
                totals[name] = totals.get(name, 0) + np.bincount(cells[owner == name], minlength=CELLS)
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "cell": at, "n": counts[at]})

    rows = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), utf8(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names, cells, n = (counts.column(c).to_pylist() for c in ("lang", "cell", "n"))
    languages = sorted(set(names))
    table = np.full((CELLS, max(1, len(languages))), 0.5)
    table[cells, [languages.index(x) for x in names]] += n
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def predict(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (its proportion) and mixture (language to proportion) of every row.

    `und` with score 0 where the text is null or empty, has no letter, or nothing was learned. Ties go to the first
    language by name. Repeated rows get equal results; an empty table gives no rows; other columns are not read.
    """
    kinds = "doc_id long, lang_pred string, score double, mixture map<string,double>"

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            shares = model.mixtures(texts) if model.languages else np.zeros((len(texts), 1))
            best = shares.argmax(axis=1)
            names, scores, mixtures = [], [], []
            for i, body in enumerate(texts):
                top = float(shares[i, best[i]])
                known = top > 0 and _LETTER.search(body.decode("utf-8", "replace")) is not None
                names.append(model.languages[best[i]] if known else UNKNOWN)
                scores.append(min(1.0, top) if known else 0.0)
                mixtures.append([(model.languages[j], float(shares[i, j])) for j in np.flatnonzero(shares[i])] if known else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(mixtures, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "mixture"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text")).mapInArrow(predicted, kinds)
