"""Periodic runs of words, by a suffix automaton with link-cut access.

The words of a text are appended one by one. In the tree of suffix links of its automaton the path from the state of the
text so far to the root holds all its suffixes, cut into segments of states that occurred last at the same place. An access
of a link-cut tree walks these segments and gives the whole path the new place. Where a segment's longest suffix is no
shorter than the distance of its last and its new end, the suffix and what stood before it are a square; the segment's
length says how far the period reaches back, and the square is part of a run that ends here or goes on with the next word.

Most words of a text can be in no run: every short window of a run comes twice in it. Stretches of windows that do, counted
again within each stretch, are all that is appended; this is exact, and what is left is mostly runs.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

#: A run has at least so many words, and so many periods.
SHORTEST, PERIODS = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Stretches are counted anew as long as this share of their windows falls away.
WORTH = 0.02


class SuffixLinks:
    """The suffix automaton of a sequence, of which the tree of suffix links, lengths and prefix states are kept."""

    def __init__(self, sequence: Sequence[int]):
        n = len(sequence)
        # Most states have one successor, which two arrays hold; others are in a table.
        letter, successor, more = array("i", [-1]) * (2 * n + 2), array("i", [0]) * (2 * n + 2), {}
        link, length = array("i", [0]) * (2 * n + 2), array("i", [0]) * (2 * n + 2)
        self.link, self.length, self.prefix = link, length, array("i", [0]) * n
        last, size = 1, 1  # 1 is the root, 0 stands for none

        def add(state: int, c: int, target: int) -> None:
            if letter[state] < 0 or letter[state] == c:
                letter[state], successor[state] = c, target
            else:
                more.setdefault(state, {})[c] = target

        def after(state: int, c: int) -> int:
            if letter[state] == c:
                return successor[state]
            others = more.get(state)
            return others.get(c, 0) if others else 0

        for i, c in enumerate(sequence):
            size += 1
            new, at = size, last
            length[new] = length[last] + 1
            while at and not after(at, c):
                add(at, c, new)
                at = link[at]
            if not at:
                link[new] = 1
            else:
                to = after(at, c)
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    size += 1
                    copy = size
                    length[copy], link[copy] = length[at] + 1, link[to]
                    letter[copy], successor[copy] = letter[to], successor[to]
                    if to in more:
                        more[copy] = dict(more[to])
                    while at and after(at, c) == to:
                        add(at, c, copy)
                        at = link[at]
                    link[to] = link[new] = copy
            last = self.prefix[i] = new
        self.size = size


class Segments:
    """Paths of equal last occurrence in a tree, as splay trees (a link-cut tree without changes of links).

    All nodes of a splay tree have the same last occurrence, so it is kept at its root alone.
    """

    def __init__(self, parents: array, size: int):
        self.up = array("i", parents[:size + 1])
        self.upper, self.lower = array("i", [0]) * (size + 1), array("i", [0]) * (size + 1)
        self.seen = array("i", [-1]) * (size + 1)

    def _splay(self, x: int) -> None:
        up, upper, lower = self.up, self.upper, self.lower
        root = x
        while (p := up[root]) and (upper[p] == root or lower[p] == root):
            root = p
        if root == x:
            return
        self.seen[x] = self.seen[root]
        while (p := up[x]) and (upper[p] == x or lower[p] == x):
            g = up[p]
            turn = (x,)
            if g and (upper[g] == p or lower[g] == p):
                turn = (p, x) if (upper[g] == p) == (upper[p] == x) else (x, x)
            for y in turn:
                p = up[y]
                g = up[p]
                if upper[p] == y:
                    b = upper[p] = lower[y]
                    lower[y] = p
                else:
                    b = lower[p] = upper[y]
                    upper[y] = p
                if b:
                    up[b] = p
                up[p], up[y] = y, g
                if g:
                    if upper[g] == p:
                        upper[g] = y
                    elif lower[g] == p:
                        lower[g] = y

    def access(self, node: int, place: int) -> Iterator[tuple[int, int]]:
        """(lowest node, last place) of each segment on the path to the root; the path's nodes were then last at `place`."""
        up, lower, seen = self.up, self.lower, self.seen
        below, x = 0, node
        while x:
            self._splay(x)
            if seen[x] >= 0:
                yield x, seen[x]
            cut = lower[x]
            if cut:
                seen[cut] = seen[x]
            lower[x] = below
            below, x = x, up[x]
        seen[below] = place


def runs(sequence: Sequence[int], shortest: int = SHORTEST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """start, length, smallest period of every maximal stretch of at least `shortest` items and `periods` >= 2 periods."""
    tree = SuffixLinks(sequence)
    segments = Segments(tree.link, tree.size)
    found, length, last = [], tree.length, len(sequence) - 1
    for i, state in enumerate(tree.prefix):
        for lowest, end in segments.access(state, i):
            # The longest suffix that stood at `end` as well reaches back length[lowest] items from both places.
            period, reach = i - end, length[lowest]
            if reach >= (periods - 1) * period and reach + period >= shortest and (i == last or sequence[i + 1] != sequence[i + 1 - period]):
                found.append((i + 1 - reach - period, reach + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def window_of(shortest: int, periods: int) -> int:
    """The longest window of which a run has at least two more than twice its period, so that each comes twice in it."""
    return min(max(shortest, periods * q) - 2 * q + 1 for q in range(1, shortest + 1))


def stretches(ids: np.ndarray, group: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> list[tuple[int, int]]:
    """First and last place (exclusive) of the parts of the groups that may hold runs.

    All windows of a run, one after the other, have an equal one in the same stretch; other windows end a stretch.
    """
    k = window_of(shortest, periods)
    if len(ids) < shortest:
        return []
    at = np.flatnonzero(group[:len(ids) - k + 1] == group[k - 1:])
    hashes = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        hashes = (hashes ^ (ids[j:len(ids) - k + 1 + j].astype(np.uint64) + np.uint64(1))) * _ODD
        hashes ^= hashes >> np.uint64(29)
    part, hashes = group[at].astype(np.uint64), hashes[at]
    while len(at):
        keys = (hashes ^ (part * _ODD)) * _ODD
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        equal = ranked[1:] == ranked[:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][equal]] = again[order[:-1][equal]] = True
        fewer, hashes, old = at[again], hashes[again], part[again]
        if not len(fewer):
            return []
        begins = np.concatenate([[True], (np.diff(fewer) != 1) | (old[1:] != old[:-1])])
        part = np.cumsum(begins).astype(np.uint64)
        sizes = np.bincount(part.astype(np.int64))
        long = sizes[part.astype(np.int64)] + k - 1 >= shortest
        fewer, hashes, part = fewer[long], hashes[long], part[long]
        done = len(at) - len(fewer) <= WORTH * len(at)
        at = fewer
        if done:
            break
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return list(zip(at[first].tolist(), (at[last] + k).tolist()))


class Words:
    """The words of several texts, cut at once: their numbers, the text of each, and where they stand."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        space = _IS_SPACE[self.data]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        self.first, self.past = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(self.past - self.first)]).astype(np.int64)
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.first), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[~space])])
        self.ids = each.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.text = np.searchsorted(self.ends, self.first, side="right")
        #: The first word of each text; one more says where the last text ends.
        self.begin = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def joined(self, kept: np.ndarray) -> list[bytes]:
        """The kept words of each text, with one space between."""
        size = np.where(kept, self.past - self.first + 1, 0)
        stay = np.zeros(len(self.data) + 1, np.int8)
        stay[self.first[kept]] += 1
        stay[self.past[kept] + 1] -= 1
        data = self.data.copy()
        data[self.past] = 0x20  # what separates a word from the next
        out = data[np.cumsum(stay[:-1], dtype=np.int8).astype(bool)].tobytes()
        place = np.concatenate([[0], np.cumsum(size)])[self.begin]
        return [out[a:max(a, b - 1)] for a, b in zip(place[:-1].tolist(), place[1:].tolist())]


def collapse(texts: list[bytes], shortest: int = SHORTEST, periods: int = PERIODS) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Per text its runs (in words, by start and period) and the words that are not repeats, joined by one space.

    A word is a repeat if a run holds it after the run's first period.
    """
    words = Words(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    kept = np.ones(len(words.ids), bool)
    for a, b in stretches(words.ids, words.text, shortest, periods):
        text = int(words.text[a])
        begin = int(words.begin[text])
        for start, length, period in runs(words.ids[a:b].tolist(), shortest, periods):
            found[text].append((a - begin + start, length, period))
            kept[a + start + period:a + start + length] = False
    for each in found:
        each.sort(key=lambda r: (r[0], r[2]))
    return found, words.joined(kept)


def find(documents: DataFrame, shortest: int = SHORTEST, periods: int = PERIODS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs, collapsed: the periodic runs of every whole text, and the text without their repeats.

    A run is a stretch of words (anything but spaces and the control characters 9 to 13) with smallest period q, at least
    `shortest` words and `periods` periods long, that no neighbouring word extends. Runs are listed by start and period;
    they may overlap. `collapsed` has the words that no run holds after its first period, joined by one space.

    A null text is empty and has no runs and the empty text; equal rows give equal results; null keys stay null; an empty
    table gives no rows; other columns are not read. A text is one value and must fit a task, with some ten times its
    size for the words and 100 bytes for each word that may be in a run.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
        for batch in chunks(batches, "text"):
            found, texts = collapse(batch.column("text").to_pylist(), shortest, periods)
            rows = [[{"start": a, "length": n, "period": q} for a, n, q in each] for each in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind), pa.array(texts, pa.binary())],
                                             names=["doc_id", "runs", "collapsed"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id long, runs {RUNS}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))
