"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of their keys, the number is permuted within [0, n) by a Feistel network that walks its
cycle until it lands inside, and shard and slot are remainder and quotient of the result. Shard and slot of any row
number, and the row number at any shard and slot, can so be computed without looking at data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

ROUNDS = 6
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(seed: int) -> list[np.uint64]:
    return [np.uint64(x) for x in np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, ROUNDS)]


def _round(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = (half + key) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return (x >> np.uint64(32)) & mask


def _network(x: np.ndarray, bits: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    if back:
        for key in reversed(keys):
            left, right = right ^ _round(left, key, mask), left
    else:
        for key in keys:
            left, right = right, left ^ _round(right, key, mask)
    return (left << shift) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Where the permutation of [0, n) puts each row number (`back`: which row number each place holds)."""
    bits, keys = _half_bits(n), _keys(seed)
    out = _network(np.asarray(rows, np.uint64), bits, keys, back)
    outside = np.flatnonzero(out >= n)
    while len(outside):  # walks the cycle; the domain is below four times n
        out[outside] = _network(out[outside], bits, keys, back)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def place(rows: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers."""
    at = permute(rows, n, seed)
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The global row number that lies in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(frame: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Gapless numbers from 0 in the order of the given columns, nulls first, and how many there are.

    Rows are dealt to ranges, sorted there and numbered by adding up the sizes of the ranges; only these sizes, one per
    range, meet on the driver. Rows equal in all columns of `order` are interchangeable: a salt spreads them, so that a
    key with a large part of all rows fills several ranges.
    """
    spark = frame.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = frame.withColumn("_salt", F.monotonically_increasing_id() % 1024)
    local = staged(
        salted.repartitionByRange(ranges, *order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
        .withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted(local.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for row in sizes:
        starts.append((row["part"], total))
        total += row["count"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_part bigint, _start bigint"))  # one row per range
    numbered = local.join(offsets, part == F.col("_part")).withColumn(
        name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop("_at", "_part", "_start"), total


def assign_shards(documents: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, row_number, shard and slot of every row; counts of shards differ by one at most.

    Size is the UTF-8 bytes of the text plus 1. A null text has size 1 and the checksum of the empty text. Repeated rows
    and null keys are numbered like any other (nulls first); an empty table gives no rows. Other columns are not read.
    """
    rows = documents.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(rows, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("shard int, slot bigint")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for numbers in batches:
            shard, slot = place(numbers.to_numpy(), n, shards, seed)
            yield pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    return numbered.withColumn("_p", placed("row_number")).select("*", "_p.shard", "_p.slot").drop("_p")


def write_shards(documents: DataFrame, path: str, shards: int, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the documents, with their slot, to a folder per shard, and returns them as read back.

    A shard is written by many tasks: rows are dealt by shard and by ranges of slots, and every file is sorted by slot.
    """
    place_of = assign_shards(documents, shards, seed, key, text).select(
        F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    # the n-th of equal rows takes the n-th place of them
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    spare = [c for c in documents.columns if c not in ("shard", "slot")]
    if place_of.groupBy("_id", "_crc").count().filter("count > 1").isEmpty():
        both = documents.select(*spare).join(place_of, F.col(key).eqNullSafe(F.col("_id")) & (crc == F.col("_crc")))
    else:
        from pyspark.sql import Window
        nth = F.row_number().over(Window.partitionBy("_id", "_crc").orderBy("_tie"))
        a = documents.select(*spare, F.col(key).alias("_id0"), crc.alias("_crc0"), F.monotonically_increasing_id().alias("_tie"))
        a = a.withColumn("_nth0", F.row_number().over(Window.partitionBy("_id0", "_crc0").orderBy("_tie"))).drop("_tie")
        b = place_of.withColumn("_tie", F.col("shard") + F.col("slot") * shards).withColumn("_nth", nth).drop("_tie")
        both = a.join(b, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_crc0") == F.col("_crc")) & (F.col("_nth0") == F.col("_nth")))
        both = both.drop("_id0", "_crc0", "_nth0", "_nth")
    both.drop("_id", "_crc").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return documents.sparkSession.read.parquet(path)


def digest(frame: DataFrame) -> DataFrame:
    return frame.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "row_number")


__all__ = ["assign_shards", "digest", "number_rows", "permute", "place", "row_at", "write_shards"]
