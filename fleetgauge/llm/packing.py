"""Sequence packing by non-negative least squares over length combinations.

Documents are cut into whole windows and a rest. Combinations of two or three rest lengths that fill a window are
enumerated, their repeat counts are solved for against the histogram of rest lengths (least squares, none negative),
rounded down and trimmed to what there is; what is left over is packed greedily, longest first, again as combinations
with counts. All of that works on a histogram of at most `window` bins. Pieces then find their place by their rank
among the pieces of their length, which needs no group to come together.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, staged, utf8
from .vocabulary import encoder, wide

WINDOW = 1024
#: Combinations of three lengths that enter the least squares, those of the most frequent lengths first.
TRIPLES = 4000
SWEEPS = 40

PIECES = "doc_id long, start long, length int, doc_tokens long, width int, ids binary, part int, nth long"


def combinations(counts: np.ndarray, window: int, triples: int = TRIPLES) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths with sum `window`; counts[n] pieces have length n."""
    have = np.flatnonzero(counts[:window])
    found = [(window - a, a) for a in have.tolist() if a <= window - a < window and counts[window - a]]
    i, j = np.meshgrid(have, have, indexing="ij")
    k = window - i - j
    ok = (i <= j) & (j <= k) & (k > 0)
    i, j, k = i[ok], j[ok], k[ok]
    ok = counts[k] > 0
    i, j, k = i[ok], j[ok], k[ok]
    best = np.lexsort((j, i, -np.minimum(np.minimum(counts[i], counts[j]), counts[k])))[:triples]
    return found + [(int(k[x]), int(j[x]), int(i[x])) for x in best]


def solve(counts: np.ndarray, patterns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 with least squared error of sum(x * pattern) against counts, by coordinate descent."""
    rest, x = counts.astype(float), np.zeros(len(patterns))
    parts = [Counter(p) for p in patterns]
    bins = [np.fromiter(p, int) for p in parts]
    times = [np.fromiter(p.values(), float) for p in parts]
    norms = [float(t @ t) for t in times]
    for _ in range(sweeps):
        moved = 0.0
        for p in range(len(patterns)):
            step = max(-x[p], float(times[p] @ rest[bins[p]]) / norms[p])
            if abs(step) > 1e-6:
                x[p] += step
                rest[bins[p]] -= step * times[p]
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) such that every piece of the histogram is used exactly once."""
    left = counts.astype(np.int64).copy()
    made: list[tuple[tuple[int, ...], int]] = []
    if window < len(left) and left[window]:
        made.append(((window,), int(left[window])))
        left[window] = 0
    patterns = combinations(left, window)
    wanted = np.floor(solve(left, patterns) + 1e-9).astype(np.int64)
    for p in np.argsort(-wanted, kind="stable"):
        times = Counter(patterns[p])
        n = int(min([wanted[p], *(left[a] // t for a, t in times.items())]))
        if n > 0:
            made.append((patterns[p], n))
            for a, t in times.items():
                left[a] -= n * t
    while len(have := np.flatnonzero(left)):
        space, used = window, Counter()
        while space and len(fit := have[have <= space]):
            a = int(fit[-1])
            n = int(min(left[a] - used[a], space // a))
            if n <= 0:
                have = have[have != a]
                continue
            used[a] += n
            space -= n * a
        n = int(min(left[a] // t for a, t in used.items()))
        made.append((tuple(sorted(used.elements(), reverse=True)), n))
        for a, t in used.items():
            left[a] -= n * t
    return made


def places(made: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, ranges of ranks: (length, first rank, first sequence, ranks per sequence, offsets of these)."""
    rows, base, rank = [], 0, Counter()
    for lengths, n in made:
        offsets: dict[int, list[int]] = {}
        at = 0
        for a in lengths:
            offsets.setdefault(a, []).append(at)
            at += a
        for a, offset in offsets.items():
            for o in offset:
                rows.append((a, rank[a], base, o))
                rank[a] += n
        base += n
    table = pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"])
    return table.sort_values(["length", "rank"], ignore_index=True)


def cut(documents: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole texts as ids with an end id, cut into windows and a rest: one row per piece, written to the shared folder.

    nth numbers the pieces of one length within the part (the task) that cut them.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, seen = encoder(vocabulary, False), TaskContext.get().partitionId(), Counter()
        end = np.asarray([end_id], codec.dtype).tobytes()
        for batch in chunks(batches, "text"):
            rows = []
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = codec.ids(body) + end
                n = len(ids) // codec.width
                for start in range(0, n, window):
                    length = min(window, n - start)
                    rows.append((doc_id, start, length, n, codec.width, ids[start * codec.width:(start + length) * codec.width], part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (
                pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()))],
                names=["doc_id", "start", "length", "doc_tokens", "width", "ids", "part", "nth"])

    rows = documents.select(F.col(key).alias("doc_id"), utf8(text).alias("text"))
    return staged(rows.mapInArrow(pieces, PIECES), "pieces")


def pack(documents: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (binary, `width` bytes each), sequence_id and offset of every piece.

    A sequence is what shares a sequence_id; it is padded to `window`. A null text is an empty one and gives the end id
    alone. Null keys and repeated rows are packed like any others; an empty table gives no rows. Other columns are not
    read.
    """
    cuts = cut(documents, vocabulary, end_id, window, key, text)
    counts = np.zeros(window + 1, np.int64)
    for row in cuts.groupBy("length").count().collect():  # at most `window` rows
        counts[row["length"]] = row["count"]
    table = places(plan(counts, window))
    step = int(counts.max()) + 1
    keys = (table["length"] * step + table["rank"]).to_numpy()
    firsts, sequences, offsets = (table[c].to_numpy() for c in ("rank", "sequence", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * step + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank.to_numpy() - firsts[at], "offset": offsets[at]})

    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cuts.groupBy(F.col("length").alias("_length"), F.col("part").alias("_part")).count().select(
        "_length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = cuts.join(starts, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")))
    return ranked.withColumn("_p", placed(F.col("length").cast("long"), F.col("_before") + F.col("nth"))).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "width", "ids",
        "_p.sequence_id", "_p.offset")


def ids_crc32(ids: Column, width: Column) -> Column:
    """Checksum of ids as little-endian unsigned 32-bit integers."""
    @F.pandas_udf("long")
    def crc(ids: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(wide(x, w)) for x, w in zip(ids, width)], dtype="int64")

    return crc(ids, width)
