"""N-gram Jaccard join, size-aware: small sets by fixed-size subsets, large sets by inverted lists.

Sets of word shingles are ordered rarest first, as far as frequent shingles are known. Two sets that are similar enough
share a shingle of their prefixes, and two shingles of prefixes that are one longer. A small set therefore states all
two-element subsets of the longer prefix (few keys, and rarely shared by chance); a large set states the shingles of the
shorter prefix, which are scanned as inverted lists, also by the small sets that could match a large one. The boundary
is the size from which stating subsets costs more than scanning lists.

Keys that several sets share are buckets. In a few rounds every set is compared with one hub of its buckets, first the
set whose keys are shared most, which joins groups of copies in linear work. Then, in buckets that still hold several
components, every set outside the largest one is compared with all others of another component. Pairs inside a component
need no comparing: no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, forget, let_go_of_shuffles, staged, utf8
from .components import components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Frequent shingles that are known to all tasks, at most (16 bytes each). They only order sets; fewer are as right.
FREQUENT = 400_000
#: Sets of one bucket that are sorted in one task: larger buckets are split.
BUCKET = 4096
#: The boundary is sought up to this size, which bounds the subsets of one set.
LARGEST_SMALL = 64
#: Rounds in which every set is compared with one hub; they save comparisons and decide nothing.
ROUNDS = 1
#: Bytes of a shingle's hash in the sets that are compared. Two sets of a thousand shingles share one by chance once in a
#: million pairs, and only a pair at the very edge of linking is decided by one.
HELD = 5
#: Bits of the filter that texts pass before they are read as sets again. Fixed: 2 MB, whatever the number of documents.
FILTER_BITS = 1 << 24
#: Bytes of words that are hashed together with others, eight at a time; longer ones are hashed one by one.
LONG = 64

_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEPS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, SHINGLE).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and their 64-bit hashes."""
    import xxhash

    data = np.frombuffer(b" " + text + b" " * 8, np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    hashes = _mix(sizes.astype(np.uint64) * _STEPS[1])
    at, done = np.flatnonzero(sizes <= LONG), 0
    while len(at):
        left = sizes[at] - done
        hashes[at] = _mix((hashes[at] ^ (eights[starts[at] + done] & _MASKS[np.minimum(left, 8)])) + _STEPS[0])
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + sizes[i]])
    return starts - 1, hashes


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; a shorter text is one shingle, one without words none."""
    starts, flat = word_hashes(b" ".join(texts).lower())
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
    rolled = np.zeros(max(0, len(flat) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled += flat[k:k + len(rolled)] * _STEPS[k]
    rolled = _mix(rolled)
    sets, start = [], 0
    for n in sizes.tolist():
        if n >= SHINGLE:
            ordered = np.sort(rolled[start:start + n - SHINGLE + 1])
            sets.append(ordered[np.append(True, ordered[1:] != ordered[:-1])])
        elif n:
            sets.append(_mix((flat[start:start + n] * _STEPS[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            sets.append(flat[:0])
        start += n
    return sets


def set_id(shingles: np.ndarray) -> int:
    """A hash of the whole set: equal sets have one id."""
    return int(_mix(_mix(shingles + np.uint64(1)).sum(keepdims=True) + np.uint64(len(shingles) << 32)).view(np.int64)[0])


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any set it links to, at least."""
    return -(-PERCENT * n // 100)


def _boundary(mean_list: float) -> int:
    """The largest size for which all two-element subsets cost no more than scanning the lists of single shingles."""
    best = 0
    for n in range(3, LARGEST_SMALL + 1):
        p = n - least_overlap(n) + 2
        if p * (p - 1) / 2 <= (p - 1) * (1 + mean_list):
            best = n
    return best


def _order(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `take` shingles, rarest first, and their known frequencies (1 where unknown)."""
    if not len(frequent):
        return shingles[:take], np.ones(min(take, len(shingles)), np.int64)
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    common = frequent[at] == shingles
    rare = shingles[~common]
    if len(rare) >= take:
        return rare[:take], np.ones(take, np.int64)
    rest, n = shingles[common], counts[at[common]]
    by = np.lexsort((rest, n))[:take - len(rare)]
    return np.append(rare, rest[by]), np.append(np.ones(len(rare), np.int64), n[by])


def read_sets(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Staged (doc_id, row_key, id, n) of all rows, and (shingle, n) of shingles that repeat within a task's rows."""
    kinds = "doc_id long, row_key long, id long, n long, shingle long, count long"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def repeated(parts):
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            values, counts = values[counts > 1], counts[counts > 1]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(values.view(np.int64)), pa.array(counts)], names=names)

        names = ["doc_id", "row_key", "id", "n", "shingle", "count"]
        for batch in chunks(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist())
            ids = [set_id(s) if len(s) else None for s in sets]
            for i, s in zip(ids, sets):
                if len(s) and i not in seen:  # copies say nothing about a shingle's frequency
                    seen.add(i)
                    held.append(s)
                    size += len(s)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(ids, pa.int64()),
                                              pa.array([len(s) for s in sets], pa.int64()), none, none], names=names)
            if size > 2_000_000:  # 16 MB
                yield repeated(held)
                held, size = [], 0
        if held:
            yield repeated(held)

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("row_key"), utf8(text).alias("text"))
    both = staged(rows.mapInArrow(measure, kinds), "shingle-sets")
    return (both.filter("n IS NOT NULL").select("doc_id", "row_key", "id", "n"),
            both.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("count").alias("n")))


KEYS = "key long, slice int, slices int, id long, n int, pos int"


def state_keys(documents: DataFrame, text: str, frequent: np.ndarray, counts: np.ndarray, boundary: int) -> DataFrame:
    """A row for each key of each set: subsets of small sets (pos -1), shingles of large ones and their possible partners."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((frequent, counts))  # at most FREQUENT entries

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (frequent, counts), seen = shared.value, set()
        for batch in chunks(batches, "text"):
            keys, times, ids, sizes, places = [], [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                n = len(s)
                if n < 3:  # such a set links to equal ones only
                    continue
                own = set_id(s)
                if own in seen:  # copies within a task state their keys once
                    continue
                seen.add(own)
                p = n - least_overlap(n) + 1
                first, often = _order(s, frequent, counts, min(n, p + 1))
                parts = []
                if n <= boundary:
                    i, j = np.triu_indices(len(first), 1)
                    low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
                    parts.append((_mix(low * _STEPS[1] + high * _STEPS[2]), np.minimum(often[i], often[j]), np.full(len(i), -1)))
                if n > boundary or 100 * n >= PERCENT * (boundary + 1):
                    parts.append((first[:p], often[:p], np.arange(p)))
                for key, often, place in parts:
                    keys.append(key)
                    times.append(often)
                    places.append(place)
                    ids.append(np.full(len(key), own))
                    sizes.append(np.full(len(key), n))
            if keys:
                owners = np.concatenate(ids)
                slices = -(-np.concatenate(times) // BUCKET)
                piece = (_mix(owners.view(np.uint64)) % slices.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(piece), pa.array(slices.astype(np.int32)), pa.array(owners),
                     pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))],
                    names=["key", "slice", "slices", "id", "n", "pos"])

    return documents.select(utf8(text).alias("text")).mapInArrow(state, KEYS)


def shared_keys(keys: DataFrame) -> DataFrame:
    """Distinct rows of the keys that several sets state: the buckets.

    Rows come sorted, so one pass with one row in hand suffices, however large a bucket is. Frequent keys are split into
    slices; a slice is kept even when one set is alone in it.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed, newest = None, False, 0  # first row of the bucket that may go on, whether it went out, its last set
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "slice", "slices", "id", "n", "pos")])
            if held is not None:
                table = np.vstack([held, table])
            key, ids = table[:, :2], table[:, 3]
            opens = np.append(True, (key[1:] != key[:-1]).any(axis=1))
            bucket, starts = np.cumsum(opens) - 1, np.flatnonzero(opens)
            leader = ids[starts][bucket]
            fresh = np.append(True, opens[1:] | (ids[1:] != ids[:-1]))  # a set counts once in a bucket
            several = (np.logical_or.reduceat(ids != leader, starts))[bucket] | (table[:, 2] > 1)
            if held is not None:
                fresh[0] = not passed
                if len(table) > 1 and not opens[1]:
                    fresh[1] = ids[1] != newest
                several |= passed & (bucket == 0)
            at = np.flatnonzero(fresh & several)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table[at, i].astype(t)) for i, t in ((0, np.int64), (3, np.int64), (4, np.int32), (5, np.int32))],
                    names=["key", "id", "n", "pos"])
            held, passed, newest = table[[starts[-1]]], bool(several[-1]), int(ids[-1])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartition(parts, "key", "slice").sortWithinPartitions("key", "slice", "id")
    return ordered.mapInArrow(scan, "key long, id long, n int, pos int")


def _needed(n: Column, m: Column) -> Column:
    """Shingles that linked sets of n and m share at least."""
    return F.ceil((n + m) * PERCENT / (100 + PERCENT) - 1e-9)


def _sized(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _rest(n: Column, m: Column) -> Column:
    """Shingles after the prefix of either set, at most."""
    return F.ceil(F.greatest(n, m) * PERCENT / 100 - 1e-9) - 1


def _met(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), with how many keys they share, that can link by that number.

    What two sets share beyond the keys they meet at lies after the prefix of one of them, and that rest has one shingle
    less than least_overlap(). Sets that meet at subsets are not judged by the number.
    """
    return rows.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"), F.min("i").alias("i")).filter(
        (F.col("i") < 0) | (F.col("k") + _rest(F.col("n"), F.col("m")) >= _needed(F.col("n"), F.col("m"))))


def _packed(shingles: np.ndarray) -> bytes:
    """The low bytes of the hashes."""
    return np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HELD]).tobytes()


def _unpacked(held: pa.Scalar) -> np.ndarray:
    """Sorted hashes as numbers."""
    bytes_ = np.frombuffer(held.as_buffer(), np.uint8).reshape(-1, HELD)
    wide = np.zeros((len(bytes_), 8), np.uint8)
    wide[:, :HELD] = bytes_
    return np.sort(wide.view("<u8").ravel())


def whole_sets(ids: DataFrame, documents: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """Staged (id, shingles) of the given sets, read from the texts again."""
    wanted = staged(ids.join(rows.groupBy("id").agg(F.min("row_key").alias("row_key")), "id"), "wanted-sets")
    bits = wanted.select(F.shiftrightunsigned("row_key", 40).alias("bit")).groupBy(F.shiftright("bit", 3).alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")).alias("bits")).toArrow()  # at most FILTER_BITS / 8 rows
    keep = np.zeros(FILTER_BITS // 8, np.uint8)
    keep[bits.column("byte").to_numpy()] = bits.column("bits").to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        for batch in batches:
            at = (batch.column("row_key").to_numpy().view(np.uint64) >> np.uint64(40)).astype(np.int64)
            chosen = batch.filter(pa.array((keep[at >> 3] >> (at & 7) & 1).astype(bool)))
            for part in chunks(iter([chosen]), "text"):
                sets = shingle_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row_key"), pa.array(map(_packed, sets), pa.binary())], names=["row_key", "shingles"])

    texts = documents.select(F.xxhash64(F.col(key), F.col(text)).alias("row_key"), utf8(text).alias("text"))
    found = texts.mapInArrow(read, "row_key long, shingles binary").join(wanted, "row_key")
    # A set has one row_key; where that row is there several times, its copies lie in one partition already.
    sets = staged(found.groupBy("row_key", "id").agg(F.first("shingles").alias("shingles")).select("id", "shingles"), "sets")
    forget(wanted)
    return sets


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of set ids that link, by their whole sets; staged."""
    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b in zip(batch.column("left"), batch.column("right")):
                x, y = _unpacked(a), _unpacked(b)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                links.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    return staged(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(overlap, "a long, b long"), "links")


def labelled(buckets: DataFrame, links: DataFrame | None) -> DataFrame:
    """Rows of buckets that hold several components, each with its component's label."""
    if links is None:
        rows = buckets.withColumn("label", F.col("id"))
    else:
        rows = buckets.join(components(links), F.col("id") == F.col("node"), "left").select(
            *buckets.columns, F.coalesce("component", "id").alias("label"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    return staged(rows.join(mixed, "key"), "mixed-buckets")


def hub_pairs(rows: DataFrame, score: Column) -> DataFrame:
    """For each set of the buckets the hub of another component that it shares most keys with; a hub has the highest score."""
    hubs = rows.groupBy("key").agg(F.max(F.struct(score.alias("score"), "id", "n", "label")).alias("h")).select("key", "h.*")
    near = rows.join(hubs.select("key", *(F.col(c).alias(f"h{c}") for c in ("id", "n", "label"))), "key").filter(
        (F.col("label") != F.col("hlabel")) & _sized(F.col("n"), F.col("hn")))
    met = _met(near.select(F.col("id").alias("a"), F.col("hid").alias("b"), "n", F.col("hn").alias("m"), F.col("pos").alias("i")))
    return met.groupBy("a").agg(F.max(F.struct("k", "b")).alias("m")).select("a", F.col("m.b").alias("b"))


def cross_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different components that share a bucket and can link.

    In each bucket the sets outside its largest component meet all others, so that component is never paired with itself.
    A set's keys are ranked by the size of their buckets, largest first. Of the k keys that two sets must share, the
    rarest has at least rank k with both: they need not meet at any key of lower rank.
    """
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(
        F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("size")).select("key", F.col("m.label").alias("major"), "size")
    ranked = staged(rows.join(sizes, "key").withColumn(
        "rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("size"), "key"))), "ranked-buckets")  # one set's keys
    minor = ranked.filter("label != major").select("key", F.col("id").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"), F.col("label").alias("al"), F.col("rank").alias("ar"))
    others = ranked.select("key", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("label").alias("bl"), F.col("rank").alias("br"), (F.col("label") == F.col("major")).alias("is_major"))
    enough = F.least("ar", "br") + _rest(F.col("an"), F.col("bn")) >= _needed(F.col("an"), F.col("bn"))
    met = minor.join(others, "key").filter(
        (F.col("al") != F.col("bl")) & (F.col("is_major") | (F.col("a") < F.col("b"))) & _sized(F.col("an"), F.col("bn")) & ((F.col("ap") < 0) | enough))
    # One pair may be met from either side, as the largest component differs between buckets.
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, id (of the set), n_shingles, component_id and leader of every row.

    component_id is the least doc_id that links lead to. Rows without words have no set, no links and their own doc_id.
    A null doc_id is never the least one while there is another; rows with equal sets are linked, however many there
    are. row_key is a hash of doc_id and text, leader the row_key of the row that stands for the component. Other columns are not read; an empty table gives no rows. Sets and
    shingles are told apart by 64-bit hashes.
    """
    rows, repeats = read_sets(documents, key, text)
    top = repeats.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    frequent, counts = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(frequent)
    frequent, counts = frequent[order], counts[order].astype(np.int64)
    total = rows.agg(F.sum("n")).first()[0] or 1
    # Mean length of the list that an occurrence of a shingle is in, as far as it is known.
    mean_list = 1 + float((counts.astype(float) ** 2).sum()) / total
    buckets = staged(shared_keys(state_keys(documents, text, frequent, counts, _boundary(mean_list))), "buckets")
    let_go_of_shuffles(documents.sparkSession)
    sets = whole_sets(buckets.select("id").distinct(), documents, rows, key, text)
    let_go_of_shuffles(documents.sparkSession)
    # How much of a set's prefix is shared: a text and its edited copies share most where nothing was edited.
    share = buckets.groupBy("id").agg((F.count("*") / F.first("n")).alias("share"))
    scored = staged(buckets.join(share, "id"), "scored-buckets")
    mixed, links = labelled(scored, None), None
    forget(buckets)
    forget(scored)
    for turn in range(ROUNDS):
        pairs = staged(hub_pairs(mixed, F.col("share") if not turn else F.xxhash64("id", F.lit(turn))), "hub-pairs")
        if pairs.isEmpty():
            break
        found = verified(pairs, sets)
        forget(pairs)
        let_go_of_shuffles(documents.sparkSession)
        links = found if links is None else links.union(found)
        before, mixed = mixed, labelled(mixed.drop("label"), links)
        forget(before)
    crossed = staged(cross_pairs(mixed), "cross-pairs")
    forget(mixed)
    more = verified(crossed, sets)
    forget(crossed)
    joined = staged(components(more if links is None else links.union(more)), "components")
    forget(sets)
    let_go_of_shuffles(documents.sparkSession)

    ids = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least"))
    named = ids.join(joined, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("component", "id").alias("label"))
    leaders = named.groupBy("label").agg(F.min("least").alias("first"))
    groups = named.join(leaders, "label").select("id", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("leader"))
    with_set = rows.filter("id IS NOT NULL").join(groups, "id").select("doc_id", "row_key", "id", F.col("n").alias("n_shingles"), "component_id", "leader")
    return with_set.unionByName(rows.filter("id IS NULL").select(
        "doc_id", "row_key", "id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("row_key").alias("leader")))


def deduplicated(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked documents, the one with the least key, with all its columns; rows without words stay.

    Of rows with equal key and text one stays (an arbitrary one where other columns differ).
    """
    found = near_duplicates(documents, key, text).select("id", "row_key", "leader")
    found = staged(found.filter("id IS NOT NULL").groupBy("row_key", "leader").agg(F.count("*").alias("rows")).filter(
        "row_key != leader OR rows > 1"), "duplicates")
    keyed = documents.withColumn("_row_key", F.xxhash64(F.col(key), F.col(text)))
    names = F.col("row_key") == F.col("_row_key")
    single = keyed.join(found, names, "left_anti")
    again = keyed.join(found.filter("row_key = leader"), names, "left_semi").dropDuplicates(["_row_key"])
    return single.unionByName(again).drop("_row_key")
