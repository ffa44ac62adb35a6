"""Benchmark decontamination by SimHash over windows as long as the benchmark's items.

A document is read in windows of as many words as each item has. Windows are looked at where
they can be similar enough: a window that shares SIMILARITY of an item's shingles has at least
one of any that number more than the others of them, and the rarest such shingles among all
items are the item's marks. A document of fewer words than an item is one window, the whole of it.

Each window's SimHash is looked up in multi-index tables, one per block of 8 bits: fingerprints
within RADIUS bits agree in at least one of 8 blocks up to RADIUS // 8 bits, so the buckets of
all such values miss none of them. Candidates within RADIUS are verified by the exact
similarity of their five-word shingles, weighted by how often each occurs (sum of the smaller
counts over sum of the larger).

The benchmark is read in blocks of bounded size, each sent to all tasks; the documents are
scanned once per block and never shuffled. Memory in a task is bounded by the block, by
REGION words of one document and by the candidates of PAIRS windows times items.

Words are runs of letters, digits and ``_``, in lower case. Defined results: null or
wordless texts, and null or wordless items, match nothing; an item of fewer than five words
is one shingle of all its words; repeated rows give repeated matches; an item_id that is
null matches with item_id null. Extra columns are ignored, or passed through by
``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Remembered, per_value, spread, word_hash

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Most differing bits between the fingerprints of an item and of a window.
RADIUS = 23
#: Characters of benchmark text in one block, about.
BLOCK_CHARS = 16_000_000
#: Words of a document that are worked on at a time.
REGION = 20_000
#: Windows times items of one length that are looked up at a time.
PAIRS = 1_000_000

MATCH = "array<struct<item_id:bigint,start:int,end:int,distance:int,similarity:double>>"

_WORD = re.compile(r"\w+")
_HASHES = Remembered(word_hash)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width neighbouring words."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    mixed = np.zeros(count, np.uint64)
    for i in range(width):
        mixed = mixed * _MIX[0] + hashes[i : i + count]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX[1]
    mixed = (mixed ^ (mixed >> np.uint64(27))) * _MIX[2]
    return mixed ^ (mixed >> np.uint64(31))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)


def window_prints(shingles: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash, as 8 bytes, of the count shingles from each start."""
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(_bits(shingles), axis=0, dtype=np.int32, out=sums[1:])
    inside = sums[starts + count] - sums[starts]
    return np.packbits(2 * inside > count, axis=1, bitorder="little")


def similarity(one: Counter, other: Counter) -> float:
    shared = sum((one & other).values())
    return shared / (sum(one.values()) + sum(other.values()) - shared)


def counted(words: list[str], width: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(width)), strict=False))


_VALUES = np.arange(256, dtype=np.uint8)


class Group:
    """The items of one length, with multi-index tables of their fingerprints: for each block
    of bits the items by value."""

    def __init__(self, items: list[tuple[int | None, list[str]]], radius: int):
        self.length = len(items[0][1])
        self.width = min(SHINGLE_WORDS, self.length)
        self.shingles = self.length - self.width + 1
        self.radius = radius
        self.ids = [item_id for item_id, _ in items]
        self.words = [words for _, words in items]
        hashes = [shingle_hashes(hashed(words), self.width) for _, words in items]
        self.hashes = np.concatenate(hashes)
        start = np.zeros(1, np.int64)
        self.prints = np.concatenate([window_prints(h, start, self.shingles) for h in hashes])
        # a bucket lookup takes in all values within that many bits
        self.near = np.array([np.flatnonzero(_POPCOUNT[_VALUES ^ v] <= radius // 8) for v in _VALUES])
        self.order = np.argsort(self.prints, axis=0, kind="stable")
        self.starts = np.array(
            [np.searchsorted(self.prints[self.order[:, b], b], np.arange(257)) for b in range(8)]
        )
        self.own = np.empty((0, 0), np.uint64)
        self.marks = np.empty(0, np.uint64)

    def mark(self, known: np.ndarray, counts: np.ndarray, least: float) -> None:
        """Chooses the shingles of which every window similar to an item has one: its rarest,
        one more than such a window may lack."""
        hashes = self.hashes.reshape(len(self.ids), self.shingles)
        rarity = counts[np.searchsorted(known, hashes)]
        # a window of as many shingles shares more than this share of them, a shorter one this
        lacking = self.shingles - math.ceil(least * self.shingles - 1e-9)
        rarest = np.lexsort((hashes, rarity), axis=1)[:, : lacking + 1]
        self.own = np.take_along_axis(hashes, rarest, axis=1)
        self.marks = np.unique(self.own)

    def candidates(
        self, prints: np.ndarray, chosen: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of every pair of a chosen item within the radius."""
        found = [np.empty((3, 0), np.int64)]
        items = len(self.ids)
        step = max(1, PAIRS // items)
        for first in range(0, len(prints), step):
            part = prints[first : first + step]
            pairs = []
            for block in range(8):
                values = self.near[part[:, block]]
                lows = self.starts[block][values]
                sizes = self.starts[block][values + 1] - lows
                held = self.order[spread(lows.ravel(), sizes.ravel()), block]
                here = chosen[held]
                pairs.append((np.repeat(np.arange(len(part)) * items, sizes.sum(1)) + held)[here])
            window, item = np.divmod(np.unique(np.concatenate(pairs)), items)
            distance = _POPCOUNT[part[window] ^ self.prints[item]].sum(1, dtype=np.int64)
            near = distance <= self.radius
            found.append(np.array([window[near] + first, item[near], distance[near]]))
        window, item, distance = np.concatenate(found, axis=1)
        return window, item, distance


class Marks:
    """Where a text has marks of a group's items."""

    def __init__(self, group: Group, shingles: np.ndarray, at: np.ndarray):
        self.group = group
        self.width = len(shingles) + 1
        self.known, ranks = np.unique(shingles[at], return_inverse=True)
        self.places = np.sort(ranks * self.width + at)
        #: the items that have a mark anywhere in the text
        self.items = np.isin(group.own, self.known).any(axis=1)

    def shared(self, starts: np.ndarray, items: np.ndarray, held: int) -> np.ndarray:
        """Whether the held shingles from each start have a mark of the item beside it."""
        found = np.zeros(len(starts), bool)
        step = max(1, PAIRS // self.group.own.shape[1])
        for first in range(0, len(starts), step):
            own = self.group.own[items[first : first + step]]
            ranks = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
            low = ranks * self.width + starts[first : first + step, None]
            next_ = np.minimum(np.searchsorted(self.places, low), len(self.places) - 1)
            inside = (self.places[next_] >= low) & (self.places[next_] < low + held)
            found[first : first + step] = (inside & (self.known[ranks] == own)).any(axis=1)
        return found


class Index:
    """A block of benchmark items."""

    def __init__(
        self,
        items: list[tuple[int | None, str | None]],
        radius: int = RADIUS,
        least: float = SIMILARITY,
    ):
        self.least = least
        by_length: dict[int, list] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                by_length.setdefault(len(words), []).append((item_id, words))
        self.groups = [Group(by_length[n], radius) for n in sorted(by_length)]
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.uint64]] = {}
        #: of each known mark the groups that have it, and where they begin
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in {group.width for group in self.groups}:
            groups = [group for group in self.groups if group.width == width]
            hashes, counts = np.unique(np.concatenate([g.hashes for g in groups]), return_counts=True)
            for group in groups:
                group.mark(hashes, counts, least)
            hashes = np.unique(np.concatenate([group.marks for group in groups]))
            ranks = np.searchsorted(hashes, np.concatenate([group.marks for group in groups]))
            numbers = [n for n, group in enumerate(self.groups) if group.width == width]
            owners = np.repeat(numbers, [len(group.marks) for group in groups])
            order = np.argsort(ranks, kind="stable")
            self.owners[width] = owners[order], np.searchsorted(ranks[order], np.arange(len(hashes) + 1))
            bits = max(10, int(len(hashes) * 16).bit_length())
            shift = np.uint64(64 - bits)
            table = np.zeros(1 << bits, bool)
            table[hashes >> shift] = True
            self.known[width] = hashes, table, shift
        words = sorted({word for group in self.groups for item in group.words for word in item})
        self.vocabulary = dict(zip(words, hashed(words).tolist(), strict=True))

    def shared(self, shingles: np.ndarray, width: int) -> np.ndarray:
        """Positions of the shingles that are a mark of some item."""
        hashes, table, shift = self.known[width]
        at = np.flatnonzero(table[shingles >> shift])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(hashes, shingles[at]), len(hashes) - 1)
        return at[hashes[place] == shingles[at]]

    def marked(self, words: list[str]) -> bool:
        """Whether the words may have a mark: a mark's words are words of items, no other is hashed."""
        hashes = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        return any(len(self.shared(shingle_hashes(hashes, width), width)) for width in self.known)

    def matches(self, text: str | None) -> list[dict]:
        """The best window of every item that is found in the text."""
        least = self.least
        words = words_of(text)
        if not self.marked(words):
            return []
        best: dict[tuple[int, int], dict] = {}
        hashes = hashed(words)
        spots, met = {}, []
        for width in self.known:
            shingles = shingle_hashes(hashes, width)
            at = self.shared(shingles, width)
            if len(at):
                spots[width] = shingles, at
                owners, begins = self.owners[width]
                ranks = np.searchsorted(self.known[width][0], np.unique(shingles[at]))
                met.append(owners[spread(begins[ranks], begins[ranks + 1] - begins[ranks])])
        for number in sorted({int(number) for numbers in met for number in numbers}):
            group = self.groups[number]
            shingles, at = spots[group.width]
            at = at[np.isin(shingles[at], group.marks)]
            marks = Marks(group, shingles, at)
            if len(words) < group.length:
                # the similarity is this ratio at most
                if len(shingles) / group.shingles >= least:
                    self._verify(number, marks, words, shingles, np.zeros(1, np.int64), best)
                continue
            reach = np.arange(group.shingles)
            for first in range(0, len(at), REGION // group.shingles + 1):
                part = at[first : first + REGION // group.shingles + 1]
                starts = np.unique(part[:, None] - reach[None, :])
                starts = starts[(starts >= 0) & (starts + group.length <= len(words))]
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > REGION) + 1):
                    self._verify(number, marks, words, shingles, run, best)
        return [best[key] for key in sorted(best)]

    def _verify(self, number, marks, words, shingles, starts, best) -> None:
        if not len(starts):
            return
        group, least = marks.group, self.least
        low, high = int(starts[0]), int(starts[-1]) + group.shingles
        if high - low > 2 * REGION:
            half = len(starts) // 2
            self._verify(number, marks, words, shingles, starts[:half], best)
            self._verify(number, marks, words, shingles, starts[half:], best)
            return
        held = min(group.shingles, len(shingles))
        prints = window_prints(shingles[low:high], starts - low, held)
        seen: dict[int, Counter] = {}
        windows, items, distances = group.candidates(prints, marks.items)
        alike = marks.shared(starts[windows], items, held)
        found = zip(windows[alike], items[alike], distances[alike], strict=True)
        for window, item, distance in found:
            start = int(starts[window])
            if start not in seen:
                seen[start] = counted(words[start : start + group.length], group.width)
            exact = similarity(seen[start], counted(group.words[item], group.width))
            key = (number, int(item))
            if exact >= least and (key not in best or exact > best[key]["similarity"]):
                best[key] = {
                    "item_id": group.ids[item],
                    "start": start,
                    "end": min(start + group.length, len(words)),
                    "distance": int(distance),
                    "similarity": exact,
                }


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """An Index of each block of the benchmark; items go to blocks by a hash of their text."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_chars) if total else 0
    for block in range(count):
        here = F.pmod(F.xxhash64("text"), F.lit(count)) == block
        rows = benchmark.filter(F.col("text").isNotNull() & here).select("item_id", "text")
        items = [(row["item_id"], row["text"]) for row in rows.toLocalIterator()]
        yield Index(sorted(set(items), key=lambda item: (item[0] is None, item[0] or 0, item[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (words), distance, similarity: the best window of each item."""
    empty = docs.select("doc_id", F.lit(None).cast(MATCH).alias("found")).limit(0)
    found = empty
    for index in blocks(benchmark):
        part = docs.select("doc_id", per_value(index.matches, MATCH)("text").alias("found"))
        found = part if found is empty else found.unionByName(part)
    return found.select("doc_id", F.inline("found"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that no benchmark item is found in."""
    for index in blocks(benchmark):
        docs = docs.filter(~_any(index)(F.col("text")))
    return docs


def _any(index: Index):
    def found(text: str | None) -> bool:
        return bool(index.matches(text))

    def column(text: Column) -> Column:
        return per_value(found, "boolean")(text)

    return column
