"""Toxicity by nearest labelled examples: exact TF-IDF cosine on a block-max inverted index.

A bounded sample of labelled rows gives the examples. Every word of every example (runs of
letters, lower case) is a term; its inverse document frequency is counted over all documents.
A term's weight in a text is (1 + log count) times that frequency times its relevance, which is
1 for words that go with label 1 no more often than chance and grows with the square of the
excess, in standard deviations, for others. Words that no example has change no text's nearest
examples and are left out.

The index keeps postings by term in blocks of examples, with each term's largest weight in each
block that has the term. A text's cosine with a block's examples is at most the sum of its
weights times these maxima. Weights are not negative, so the k-th best cosine is at least what any one term
gives to the k-th largest of its postings: all blocks whose bound reaches the largest such share are scored,
and the nearest examples are exact. Examples are ordered by their
commonest word, which puts those of one language together and keeps bounds apart.

Votes fall with distance, are pulled towards the rate of label 1, and are calibrated by isotonic
regression on the examples, each scored without itself. ``evidence`` lists the neighbours.

Memory: the index is bounded by ``EXAMPLE_ROWS``; it is sent to the tasks, which hold one Arrow
batch of texts beside it. Documents are not shuffled: each becomes its known terms and their
counts once, which are put down, counted and scored.

Defined results: a null, empty or wordless text, and one without any word of an example,
has no neighbours and scores the calibrated base rate; without labelled rows every score is
0; equal cosines prefer the earlier example; repeated rows score alike; a text of any length
is read as a whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import labelled_sample, remainder, ship, spread, stash

#: Bound on the labelled rows that examples are taken from.
EXAMPLE_ROWS = 3_000
NEIGHBOURS = 16
#: A neighbour's vote is its cosine to this power.
FALL = 2
#: Weight of the base rate among the votes, in votes of a neighbour at distance zero.
BASE_VOTES = 0.02
TOXIC_FROM = 0.3
#: Examples in a block.
BLOCK = 128

#: Most neighbours that are looked for with a floor of their cosines: a text leaves itself out.
FLOOR = NEIGHBOURS + 1

_WORD = re.compile(r"[^\W\d_]+")
SCORED = "doc_id long, score double, evidence array<struct<doc_id:bigint,cosine:double,label:int>>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class BlockMaxIndex:
    """Unit vectors of examples by term, with the largest weight of a term in each block.

    A vector is a weight for each of its terms.
    """

    def __init__(self, vectors: list[dict[int, float]], terms: int):
        self.size = len(vectors)
        self.blocks = -(-self.size // BLOCK)
        numbers = np.repeat(np.arange(self.size), [len(vector) for vector in vectors])
        ids = np.array([term for vector in vectors for term in vector], np.int64)
        weights = np.array([weight for vector in vectors for weight in vector.values()], float)
        order = np.argsort(ids, kind="stable")
        ids, self.numbers, self.weights = ids[order], numbers[order], weights[order]
        # a cell is a term in a block: its postings lie together, in ascending order
        cells = ids * max(1, self.blocks) + self.numbers // BLOCK
        self.cell_at = np.flatnonzero(np.diff(cells, prepend=-1))
        self.cell_size = np.diff(self.cell_at, append=len(cells))
        self.cell_block = self.numbers[self.cell_at] // BLOCK
        self.cell_best = np.maximum.reduceat(self.weights, self.cell_at) if len(cells) else np.empty(0)
        self.term_at = np.searchsorted(ids[self.cell_at], np.arange(terms + 1))
        #: the weight that so many postings of a term reach; zero if it has fewer
        self.floor = np.zeros(terms)
        order = np.lexsort((-self.weights, ids))
        begins = np.searchsorted(ids, np.arange(terms + 1))
        enough = np.flatnonzero(np.diff(begins) >= FLOOR)
        self.floor[enough] = self.weights[order[begins[enough] + FLOOR - 1]]
        #: whether a cell is the first of its term
        self.opens = np.diff(ids[self.cell_at], prepend=-1) != 0

    def _sums(self, cells: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Products of the postings of these cells, summed by example."""
        # neighbouring cells of one term are one run of postings
        starts = np.flatnonzero((np.diff(cells, prepend=-2) != 1) | self.opens[cells])
        lasts = cells[np.append(starts[1:], len(cells)) - 1]
        lows = self.cell_at[cells[starts]]
        sizes = self.cell_at[lasts] + self.cell_size[lasts] - lows
        places = spread(lows, sizes)
        products = np.take(self.weights, places, mode="clip")
        products *= np.repeat(values[starts], sizes)
        return np.bincount(np.take(self.numbers, places, mode="clip"), products, self.size)

    def nearest(self, vector: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a cosine above zero, best first."""
        return self.nearest_to(np.array(list(vector), np.int64), np.array(list(vector.values()), float), k)

    def nearest_to(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        lows = self.term_at[terms]
        sizes = self.term_at[terms + 1] - lows
        cells, values = spread(lows, sizes), np.repeat(weights, sizes)
        if not len(cells):
            return []
        blocks = self.cell_block[cells]
        bounds = np.bincount(blocks, values * self.cell_best[cells], self.blocks)
        floor = float((weights * self.floor[terms]).max()) if k <= FLOOR else 0.0
        # the margin covers rounding: a bound is a sum in another order
        near = (bounds > 0) & (bounds >= floor - 1e-9)
        if not near.any():
            return []
        if not near.all():
            chosen = near[blocks]
            # whole terms are fewer runs than their cells, and quicker unless many cells are left out
            if 4 * np.count_nonzero(chosen) < 3 * len(cells):
                cells, values = cells[chosen], values[chosen]
        cosines = self._sums(cells, values)
        cosines = np.round(cosines, 12)
        kth = np.partition(cosines, -k)[-k] if k < self.size else 0.0
        hits = np.flatnonzero((cosines >= kth) & (cosines > 0))
        hits = hits[np.argsort(-cosines[hits], kind="stable")][:k]
        return list(zip(cosines[hits].tolist(), hits.tolist(), strict=True))


#: Terms of a text, ascending, and how often it has each.
Counts = tuple[np.ndarray, np.ndarray]


@dataclass
class Model:
    """Weights of terms, the index, its labels and document ids, the base rate."""

    weight: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    ids: np.ndarray
    base: float

    def votes(self, found: Counts, without: int | None = None) -> tuple[float, list[tuple[float, int]]]:
        """The share of label 1 among the votes, and the neighbours."""
        near = self.index.nearest_to(*unit(found, self.weight), NEIGHBOURS + (without is not None))
        near = [pair for pair in near if pair[1] != without][:NEIGHBOURS]
        weights = np.array([cosine**FALL for cosine, _ in near])
        voted = float(weights @ self.labels[[n for _, n in near]]) if near else 0.0
        return (voted + BASE_VOTES * self.base) / (weights.sum() + BASE_VOTES), near

    def scored(self, found: Iterator[Counts], knots: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, pa.Array]:
        """The calibrated scores, and the neighbours with their cosines, of texts in turn."""
        shares, cosines, numbers, ends = [], [], [], [0]
        for one in found:
            share, near = self.votes(one)
            shares.append(share)
            cosines += [cosine for cosine, _ in near]
            numbers += [number for _, number in near]
            ends.append(len(numbers))
        scores = np.interp(shares, *knots) if len(knots[0]) else np.array(shares)
        at = np.array(numbers, np.int64)
        columns = [pa.array(self.ids[at]), pa.array(cosines, pa.float64()), pa.array(self.labels[at].astype(np.int32))]
        evidence = pa.StructArray.from_arrays(columns, ["doc_id", "cosine", "label"])
        return pa.array(np.clip(scores, 0.0, 1.0)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), evidence)


def counted(text: str | None, terms: dict[str, int]) -> Counts:
    """The known terms of a text, ascending, and how often it has each."""
    words = words_of(text)
    found = np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))
    return np.unique(found[found >= 0], return_counts=True)


def unit(found: Counts, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, counts = found
    raw = (1.0 + np.log(counts)) * weight[terms]
    norm = math.sqrt(float(raw @ raw))
    return terms, raw / norm if norm else raw


def relevance(held: np.ndarray, with_label: np.ndarray, rate: float) -> np.ndarray:
    """1 plus the squared excess of label 1 among a term's texts, in standard deviations."""
    excess = (with_label - held * rate) / np.sqrt(held * rate * (1 - rate) + 1)
    return 1.0 + np.maximum(0.0, excess) ** 2


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step means of y over x (pool adjacent violators)."""
    pools: list[list[float]] = []  # mean, weight, sum of x
    for value in np.unique(x):
        at = x == value
        pools.append([float(y[at].mean()), float(at.sum()), float(value * at.sum())])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            mean, weight, total = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + mean * weight) / (last[1] + weight)
            last[1] += weight
            last[2] += total
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] for p in pools])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def _parted(lists: pa.Array) -> list[np.ndarray]:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def known_terms(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(doc_id, terms, counts): what each text has of the terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [counted(text, known) for text in batch.column(1).to_pylist()]
            lists = [_lists([one[side] for one in found]) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "terms", "counts"])

    columns = "doc_id long, terms array<int>, counts array<int>"
    return docs.select("doc_id", "text").mapInArrow(count, columns)


def document_counts(found: DataFrame, terms: int) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many of them have each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms + 1, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            held[:terms] += np.bincount(flat, minlength=terms)[:terms]
            held[terms] += len(batch)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["term", "held"])

    # a task sends a row for each term it has met; the sums are as many as the terms
    partial = found.select("terms").mapInArrow(count, "term long, held long")
    sums = partial.groupBy("term").agg(F.sum("held").alias("held")).toPandas()
    held = np.zeros(terms + 1, np.int64)
    held[sums["term"].to_numpy(np.int64)] = sums["held"].to_numpy(np.int64)
    return int(held[terms]), held[:terms]


def vocabulary(examples: list[tuple[int, str, int]]) -> dict[str, int]:
    """The number of every word of the examples."""
    return {word: n for n, word in enumerate(sorted({w for _, text, _ in examples for w in words_of(text)}))}


def fit(
    found: DataFrame, examples: list[tuple[int, str, int]], terms: dict[str, int]
) -> Model:
    """The model of examples (doc_id, text, label), with word counts over all documents."""
    counts = [counted(text, terms) for _, text, _ in examples]
    commonest = np.bincount(np.concatenate([np.empty(0, np.int64), *(at for at, _ in counts)]), minlength=len(terms))
    total, held = document_counts(found, len(terms))
    labels = np.array([label for _, _, label in examples], float)
    # a text that several examples share counts once for the relevance of its words
    once: dict[str, int] = {}
    for number, (_, text, label) in enumerate(examples):
        if text not in once or label > labels[once[text]]:
            once[text] = number
    texts, toxic = np.zeros(len(terms)), np.zeros(len(terms))
    for number in once.values():
        at = counts[number][0]
        texts[at] += 1
        toxic[at] += labels[number]
    rate = float(labels.mean()) if examples else 0.0
    weight = np.log((1 + total) / (1 + held)) + 1e-3
    weight = weight * relevance(texts, toxic, rate)

    def place(number: int) -> tuple:
        # the commonest word comes first, and with it the language
        at = counts[number][0]
        return (int(at[np.argmax(commonest[at])]), number) if len(at) else (-1, number)

    order = sorted(range(len(examples)), key=place)
    units = [unit(counts[n], weight) for n in order]
    vectors = [dict(zip(found.tolist(), values.tolist(), strict=True)) for found, values in units]
    ids = np.array([examples[n][0] for n in order], np.int64)
    return Model(weight, BlockMaxIndex(vectors, len(terms)), labels[order], ids, rate)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence; fold 2 of 4 is held out."""
    spark = docs.sparkSession
    ship(spark)
    fold = remainder(F.col("doc_id"), 4)
    sample = stash(labelled_sample(labels, label, fold != 2, EXAMPLE_ROWS), "sample")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    known = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    examples = sorted((row["doc_id"], row["text"], row["label"]) for row in known.collect())
    terms = vocabulary(examples)
    found = stash(known_terms(texts, terms), "terms")
    model = fit(found, examples, terms)
    shared = spark.sparkContext.broadcast(model)
    knots = (np.empty(0), np.empty(0))
    if examples:
        place = {int(doc_id): n for n, doc_id in enumerate(model.ids)}
        rows = [(place[doc_id], *(side.tolist() for side in counted(text, terms))) for doc_id, text, _ in examples]
        tasks = spark.createDataFrame(rows, "n long, terms array<int>, counts array<int>").repartition(
            max(1, min(len(rows) // 50, 2 * spark.sparkContext.defaultParallelism))
        )

        def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = zip(batch.column(0).to_pylist(), *map(_parted, batch.columns[1:]), strict=True)
                voted = [shared.value.votes(one, without=n)[0] for n, *one in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(voted, pa.float64())], ["n", "share"])

        told = tasks.mapInArrow(shares, "n long, share double").toPandas()
        knots = isotonic(told["share"].to_numpy(), model.labels[told["n"].to_numpy(np.int64)])

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(*map(_parted, batch.columns[1:]), strict=True)
            columns = [batch.column(0), *shared.value.scored(parts, knots)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence"])

    return found.mapInArrow(score_all, SCORED).select(
        "doc_id",
        F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        "evidence",
    )
