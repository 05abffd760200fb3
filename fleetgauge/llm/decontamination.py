"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and documents become templates: numbers, names and units are replaced with typed placeholders,
their values are kept as slots. Windows of template words are hash-joined; in the windows that one alignment of an
item and a document shares, each value of the item must stand for one value of the document. Inserted and deleted words shift the alignment, so
windows are summed over the alignments in one stretch of the document. A question is found as it stands (`exact`) and
with other numbers, names or units put in (`reparameterised`). Windows of the plain words, in lower case, are joined
beside the templates, so that a copy is found whatever its words and its capitals are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, kept, staged, utf8, words

WINDOW = 8
#: Words of a window that must be literal to be searched for as a template: placeholders alone say nothing.
LITERAL = 4
#: Least share of an item's windows that one stretch of a document must hold.
COVERAGE = 0.3
#: Words in a row, equal in item and document, that are a hit by themselves, however long the item is.
RUN = 13
#: Bits of the filter that document windows pass before they are joined. Fixed: 1 MB, whatever the benchmark's size.
FILTER_BITS = 1 << 23

#: Units of measure and currency; fixed values, in lower case.
UNITS = frozenset("""mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec secs min mins h hr hrs second seconds minute minutes
    hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre
    kilometres centimeter centimeters gram grams kilogram kilograms liter liters litre litres inch inches foot feet yard
    yards mile miles pound pounds ounce ounces dollar dollars cent cents euro euros usd eur gbp percent % $ € £ °c °f mph
    kph km/h m/s w kw kwh v a hz khz mhz ghz kb mb gb tb""".split())

_NUMBER = re.compile(r"^[-+$€£]?[0-9]+(?:[.,:/][0-9]+)*(?:%|st|nd|rd|th)?$")
_COUNTED = re.compile(r"^([-+]?[0-9]+(?:[.,][0-9]+)*)([a-z%°/]+)$")
_EDGES = "\"'`.,;:!?()[]{}<>*#&|_~“”‘’«»…"
_KINDS = ("", "<num>", "<unit>", "<name>")
_NAME = 3


class Templates(dict):
    """Word (bytes) to its number; the other fields hold what is known of the words by number.

    plain: hash of the word in lower case. hashes: that of its template. kinds: its placeholder (0: literal). A word's
    kind does not depend on what precedes it. ends: whether it ends a sentence.
    """

    KEPT = 300_000

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.values: list[str] = []
        self.plain, self.hashes, self.kinds, self.ends = array("Q"), array("Q"), array("q"), array("b")

    def __missing__(self, word: bytes) -> int:
        import xxhash

        text = word.decode("utf-8", "replace")
        core = text.strip(_EDGES) or text
        low = core.lower()
        kind = 0
        if _NUMBER.match(core):
            kind = 1
        elif low in UNITS:
            kind = 2
        elif (m := _COUNTED.match(low)) and m[2] in UNITS:
            kind = 1
        # all capitals are emphasis, not names
        elif core[:1].isupper() and core[1:2].islower():
            kind = _NAME
        self.values.append(low)
        self.plain.append(xxhash.xxh64_intdigest(low.encode()))
        self.hashes.append(xxhash.xxh64_intdigest(_KINDS[kind].encode()) if kind else self.plain[-1])
        self.kinds.append(kind)
        self.ends.append(text.rstrip("\"')]”’»")[-1:] in (".", "!", "?", ":", ""))
        found = self[word] = len(self.values) - 1
        return found

    def numbers(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words; those of texts before may be void."""
        if len(self) >= self.KEPT:
            self.forget()
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))

    def of(self, field: str, ids: np.ndarray) -> np.ndarray:
        held = getattr(self, field)
        return np.frombuffer(held, held.typecode)[ids] if len(ids) else np.empty(0, held.typecode)


_STEPS = np.random.Generator(np.random.PCG64(2)).integers(1, 2**63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(size))
    for k in range(size):
        total += hashes[k:k + n] * _STEPS[k]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))


def _holds(kinds: np.ndarray, size: int) -> np.ndarray:
    """How many words of each window are no literals."""
    edges = np.append(0, np.cumsum(kinds != 0))
    return edges[size:] - edges[:-size]


def _slots(kinds: np.ndarray, ids: np.ndarray, values: list[str], at: int, size: int) -> list[str]:
    return [f"{_KINDS[kinds[i]]}\x00{values[ids[i]]}" for i in range(at, at + size) if kinds[i]]


#: literal: whether enough words are. n_windows: all of the item; n_literal: those with enough literal words.
PROBES = "item_id long, pos int, hash long, slots array<string>, literal boolean, n_windows int, n_literal int, n_words int"
_PROBES = pa.schema([("item_id", pa.int64()), ("pos", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string())),
                     ("literal", pa.bool_()), ("n_windows", pa.int32()), ("n_literal", pa.int32()), ("n_words", pa.int32())])


def probes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows to search for. An item shorter than a window is one window.

    Each window is searched for as its plain words. With enough literal words it is searched for as a template too: once
    with all capitalised words as names and once with those that open a sentence as literals, which they are where the
    sentence goes on from another one. Words that open a sentence count as literal ones.
    """
    known = kept("templates", Templates)
    for batch in chunks(batches, "text"):
        rows = []
        for item_id, body in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist()):
            ids = known.numbers(body)
            if not len(ids):
                continue
            size, plain, kinds = min(WINDOW, len(ids)), known.of("plain", ids), known.of("kinds", ids)
            opens = np.append(True, known.of("ends", ids)[:-1].astype(bool)) & (kinds == _NAME)
            within = np.where(opens, 0, kinds)
            literal = (size - _holds(within, size)) * WINDOW >= LITERAL * size
            counts = (len(literal), int(literal.sum()), len(ids))
            forms = [(kinds, known.of("hashes", ids)), (within, np.where(opens, plain, known.of("hashes", ids)))]
            hashed = [(kinds, window_hashes(hashes, size), literal) for kinds, hashes in forms]
            hashed.append((np.zeros_like(kinds), window_hashes(plain, size), np.ones_like(literal)))
            for at in range(len(literal)):
                seen = set()
                for form, found, wanted in hashed:
                    value = int(found[at].view(np.int64))
                    if wanted[at] and value not in seen:
                        seen.add(value)
                        rows.append((item_id, at, value, _slots(form, ids, known.values, at, size), bool(literal[at]), *counts))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PROBES.types)], schema=_PROBES)


HITS = "row_key long, at int, hash long, theirs array<string>"
_HITS = pa.schema([("row_key", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()), ("theirs", pa.list_(pa.string()))])


def _windows(sizes: list[int], keep: np.ndarray):
    """Arrow function from (row_key, text) to the windows that pass the filter, as templates and as plain words."""
    def passing(found: np.ndarray) -> np.ndarray:
        bits = (found >> np.uint64(41)).astype(np.int64)
        return (keep[bits >> 3] >> (bits & 7) & 1).astype(bool)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept("templates", Templates)
        for batch in chunks(batches, "text"):
            rows = []
            for row_key, body in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist()):
                ids = known.numbers(body)
                plain, hashes, kinds = (known.of(x, ids) for x in ("plain", "hashes", "kinds"))
                for size in sizes:
                    if len(ids) < size:
                        continue
                    found = window_hashes(hashes, size)
                    for at in np.flatnonzero(passing(found)).tolist():
                        rows.append((row_key, at, int(found[at].view(np.int64)), _slots(kinds, ids, known.values, at, size)))
                    # without placeholders both are the same
                    other = np.flatnonzero(_holds(kinds, size))
                    if len(other):
                        found = window_hashes(plain, size)[other]
                        rows += [(row_key, int(other[i]), int(found[i].view(np.int64)), []) for i in np.flatnonzero(passing(found)).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _HITS.types)], schema=_HITS)

    return cut


def longest_run(places: Column) -> Column:
    """The most numbers in a row that follow each other in an array of numbers."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == a.last + 1, a.run + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a.best, run).alias("best"))

    return F.aggregate(F.array_sort(F.array_distinct(places)), start, step, lambda a: a.best)


def consistent(windows: str, pairs: str) -> Column:
    """The windows of an alignment with changed slots, none of which has a value that stands for several ones.

    Two values of the item may become equal in the document. `pairs` holds the distinct pairs of slots.
    """
    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("clashing"))
    step = lambda a, p: F.struct(
        p.ours.alias("last"), F.when(a.last == p.ours, F.concat(a.clashing, F.array(p.ours))).otherwise(a.clashing).alias("clashing"))
    return F.aggregate(F.array_sort(F.col(pairs)), start, step, lambda a: F.filter(
        windows, lambda w: ~w.same & ~F.arrays_overlap(w.slots, a.clashing)))


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, row_key, item_id, n_windows, coverage and kind for each pair of a document and an item it holds.

    coverage is the share of the item's windows that the best stretch of the document holds;
    kind is `exact` if all slots are equal, else `reparameterised`. Alignments are of one stretch if
    their shifts are no farther apart than the item is long. Windows without a changed slot always count; windows with one
    do if no slot of theirs clashes (one value of the item, several ones in the alignment), and if they outnumber those of
    the alignment that hold a clash. A pair is listed if its coverage is reached, or if RUN words
    in a row (the whole item, where it is shorter) are equal; then coverage may be less, and kind is `exact`. Coverage is
    that of all windows or of those with enough literal words, whichever is more. Items of any length are searched for; without
    enough literal words only as they stand, in any capitals. row_key is a hash of key and text, so equal rows share it
    and are listed once for each of them.
    Null texts hold nothing; null keys are kept as null; empty tables give no rows; other columns are not read.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("row_key"), utf8(item_text).alias("text")).filter(F.octet_length("text") > 0)
    probes = items.mapInArrow(probes_of, PROBES)
    sizes_of = items.mapInArrow(_sizes, "size int").distinct()
    sizes = sorted(r["size"] for r in sizes_of.collect() if r["size"])  # at most WINDOW values
    # One word of 64 bits for each stretch of the filter: at most FILTER_BITS / 64 rows.
    bit = F.shiftrightunsigned("hash", 41)
    filled = probes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 3).alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")).alias("bits")).toArrow()
    keep = np.zeros(FILTER_BITS // 8, np.uint8)
    keep[filled.column("byte").to_numpy()] = filled.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(keep)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _windows(sizes, shared.value)(batches)

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("row_key"), utf8(text).alias("text"))
    hits = rows.select("row_key", "text").mapInArrow(search, HITS).distinct()
    joined = probes.join(hits, "hash")
    # Equal templates have their slots at equal places.
    paired = F.zip_with("slots", "theirs", lambda a, b: F.struct(a.alias("ours"), b.alias("theirs")))
    same = F.forall(paired, lambda p: p.ours == p.theirs)
    window = F.struct("pos", "literal", same.alias("same"), "slots")
    first = lambda *names: [F.first(name).alias(name) for name in names]
    aligned = joined.groupBy("row_key", "item_id", (F.col("at") - F.col("pos")).alias("shift")).agg(
        *first("n_windows", "n_literal", "n_words"), F.collect_set(window).alias("windows"), F.array_distinct(F.flatten(F.collect_set(paired))).alias("pairs"))
    sorted_out = aligned.withColumns({
        "equal": F.filter("windows", lambda w: w.same), "changed": consistent("windows", "pairs")})
    judged = sorted_out.select(
        "row_key", "item_id", "shift", "n_windows", "n_literal", "n_words",
        longest_run(F.transform(F.filter("equal", lambda w: w.literal), lambda w: w.pos)).alias("run"),
        F.when(2 * F.size("changed") > F.size("windows") - F.size("equal"), F.concat("equal", "changed")).otherwise(F.col("equal")).alias("windows"))
    # Stretches overlap by half: shifts up to an item's length apart have one in common.
    half = F.greatest("n_words", F.lit(WINDOW))
    placed = judged.select("*", F.explode("windows").alias("w"), half.alias("half")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    stretch = F.floor((F.col("shift") + F.col("turn") * F.col("half")) / (2 * F.col("half")))
    stretches = placed.groupBy("row_key", "item_id", "turn", stretch.alias("stretch")).agg(
        *first("n_windows", "n_literal", "n_words"), F.max("run").alias("run"), *(
            F.size(F.collect_set(F.when(which, F.col("w.pos")))).alias(name) for name, which in (
                ("hit", F.lit(True)), ("hit_same", F.col("w.same")), ("hit_literal", F.col("w.literal")), ("hit_both", F.col("w.literal") & F.col("w.same")))))
    # Of all windows, or of those with enough literal words alone, whichever is more.
    share = F.greatest(*(F.struct((F.col(hit) / of).alias("coverage"), F.col(hit).alias("n_windows"), (F.col(hit) == F.col(same)).alias("same"))
                         for hit, of, same in (("hit", F.col("n_windows"), "hit_same"), ("hit_literal", F.nullif("n_literal", F.lit(0)), "hit_both"))))
    long_run = F.col("run") >= F.least("n_words", F.lit(RUN)) - F.least("n_words", F.lit(WINDOW)) + 1
    held = stretches.select("row_key", "item_id", "run", "n_words", share.alias("share")).select("*", "share.*").withColumn("enough", F.col("coverage") >= coverage)
    best = held.filter(F.col("enough") | long_run).groupBy("row_key", "item_id").agg(
        F.max(F.struct("coverage", "n_windows", (F.col("same") | ~F.col("enough")).alias("same"))).alias("b"))
    found = best.select("row_key", "item_id", "b.n_windows", "b.coverage", F.when(F.col("b.same"), "exact").otherwise("reparameterised").alias("kind"))
    return rows.select("doc_id", "row_key").join(found, "row_key").select("doc_id", "row_key", "item_id", "n_windows", "coverage", "kind")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = {min(WINDOW, len(words(t))) for t in batch.column("text").to_pylist()}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(sizes), pa.int32())], names=["size"])


def decontaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with all their columns; the search has run when this returns."""
    found = staged(contaminated(documents, benchmark, key, text, **options).select(F.col("row_key").alias("_found")).distinct(), "contaminated")
    return documents.join(found, F.xxhash64(F.col(key), F.col(text)) == F.col("_found"), "left_anti")
