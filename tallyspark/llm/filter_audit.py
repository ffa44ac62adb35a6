"""Which filter removes what, under every order of the filters.

Each text gets a mask, one bit for every filter it fails. Documents only matter by part, mask
and labels from there on, so they are added up to one histogram of 32 masks for each part, and
the orders are worked out on histograms. With ``FAIL[m, f]`` zero where mask m fails filter f
and infinite elsewhere, and ``PLACE[o, f]`` the place of filter f in order o (the inverse
permutation), the step at which order o removes mask m is

    step[m, o] = min over f of FAIL[m, f] + PLACE[o, f],

a min-plus product; a mask that fails nothing is never removed. The weights of a part's masks
are scattered by that step into removed, good and toxic documents of each order and step;
what was removed before and fails the step's filter too is redundant.

Texts are read once, by JVM functions, and only hashes leave the scan. Whether a text repeats
one of a smaller doc_id is decided without a join of documents: masks A to D belong to the
text, so rows of one (text, part, labels) are added up, with their smallest doc_id and the
rows that have it, and only these few rows meet the smallest doc_id of the whole text. A text
that a third of all rows share collapses inside the map tasks.

Defined results: a null or empty text has no words and fails A alone (0 < 0 is false for B),
and repeats other empty texts. A null source is the part ``''``, the same as an empty one. A
row without doc_id repeats nothing, no text repeats it, and it has no labels; rows of one
doc_id do not repeat one another. A document labelled twice takes the larger label. A part has
600 rows whatever it holds; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import ship

# The filters and their limits.
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # of 100 words
MOST_CAPITALS = 5  # of 100 code points
SIGNS = "[#$%&*|]"
SPACES = "\t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MASKS = 1 << len(FILTERS)
WEIGHTS = ["held", "good", "toxic"]
#: Parts whose rows are worked out at a time.
PARTS = 200

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def _without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; a text is not null."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    chars = F.length(text)
    capitals = chars - F.length(_without(text, CAPITALS))
    fails = [
        count < LEAST_WORDS,
        distinct.cast("long") * 100 < count.cast("long") * LEAST_DISTINCT,
        capitals.cast("long") * 100 > chars.cast("long") * MOST_CAPITALS,
        text.rlike(SIGNS),
    ]
    bits = [F.when(failed, 1 << number).otherwise(0) for number, failed in enumerate(fails)]
    return sum(bits[1:], bits[0])


def _text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_hash, mask, rows): equal rows are added up."""
    text = F.coalesce("text", F.lit(""))
    return (
        docs.select(
            F.col("doc_id").cast("long"),
            F.coalesce("source", F.lit("")).alias("part"),
            # never null, and known not to be: a filter on nulls would make one reading of texts two
            F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("text_hash"),
            text_mask(text).alias("mask"),
        )
        .groupBy("doc_id", "part", "text_hash", "mask")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic) as 0 or 1, one row a document."""
    return (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .select(
            "doc_id",
            F.when(F.col("quality") == 1, 1).otherwise(0).alias("good"),
            F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"),
        )
    )


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, held, good, toxic): documents of a part that fail exactly a mask's filters."""
    # rows without doc_id have no labels; dealt by their texts they do not share one task of the join
    key = F.coalesce("doc_id", F.xxhash64("text_hash"))
    rows = _text_rows(docs).withColumn("key", key)
    marks = _labels(labels).withColumnRenamed("doc_id", "labelled")
    same = F.col("doc_id").isNotNull() & (F.col("key") == F.col("labelled"))
    labelled = rows.join(marks, same, "left").withColumns(
        {name: F.coalesce(F.col(name).cast("int"), F.lit(0)) for name in ("good", "toxic")}
    )
    kind = ["text_hash", "part", "mask", "good", "toxic"]
    per_id = labelled.groupBy(*kind, "doc_id").agg(F.sum("rows").alias("rows"))
    # of the rows of a kind: those with its smallest doc_id, and those without any
    kinds = per_id.groupBy(*kind).agg(
        F.sum("rows").alias("held"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("rows"))), F.lit(0)).alias("without"),
        F.min("doc_id").alias("first"),
        F.coalesce(F.min_by("rows", "doc_id"), F.lit(0)).alias("at_first"),
    )
    # kinds are made for both from the same shuffled rows, so that texts are read once
    several = (
        kinds.groupBy("text_hash")
        .agg(F.min("first").alias("smallest"), F.sum("held").alias("copies"))
        .filter((F.col("copies") > 1) & F.col("smallest").isNotNull())
        .select("text_hash", "smallest")
    )
    joined = kinds.join(several, "text_hash", "left")
    # a text of one row is its own first, and one that only rows without doc_id hold repeats nothing
    at_first = F.when(F.col("first") == F.col("smallest"), F.col("at_first")).otherwise(0)
    first = F.when(F.col("smallest").isNull(), F.col("held")).otherwise(F.col("without") + at_first)
    mask = F.col("mask")
    repeats = F.array(
        F.struct(mask.alias("mask"), first.alias("n")),
        F.struct((mask + (MASKS >> 1)).alias("mask"), (F.col("held") - first).alias("n")),
    )
    return (
        joined.select("part", "good", "toxic", F.explode(repeats).alias("one"))
        .groupBy("part", F.col("one.mask").alias("mask"))
        .agg(
            F.sum("one.n").alias("held"),
            F.sum(F.col("one.n") * F.col("good")).alias("good"),
            F.sum(F.col("one.n") * F.col("toxic")).alias("toxic"),
        )
    )


def orders(filters: int = len(FILTERS)) -> np.ndarray:
    """All orders of the filters: the filter at each step, in lexical order."""
    return np.array(list(permutations(range(filters))))


def places(by_step: np.ndarray) -> np.ndarray:
    """The inverse permutations: the step (from 1) of each filter."""
    return np.argsort(by_step, axis=1) + 1


def failures(filters: int = len(FILTERS)) -> np.ndarray:
    """Whether each mask fails each filter."""
    return (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1 == 1


def removal_steps(fails: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The min-plus product of masks and places; one step behind the last for masks that stay."""
    never = place.shape[1] + 1
    steps = np.full((len(fails), len(place)), never)
    for number in range(place.shape[1]):
        cost = np.where(fails[:, number, None], 0, never) + place[None, :, number]
        np.minimum(steps, cost, out=steps)
    return steps


def audit(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by part, order and step from weights (part, mask, held/good/toxic)."""
    by_step, fails = orders(), failures()
    steps = removal_steps(fails, places(by_step))
    parts, (count, width) = len(weights), by_step.shape
    lost = np.zeros((parts, len(WEIGHTS), count * (width + 1)), np.int64)
    cells = np.arange(count) * (width + 1) + steps - 1  # mask, order
    for mask in range(len(fails)):
        lost[:, :, cells[mask]] += weights[:, mask, :, None]
    lost = lost.reshape(parts, len(WEIGHTS), count, width + 1)[..., :width]
    removed = lost[:, 0]
    held = weights[:, :, 0]
    # documents that fail a filter, whether they come to it or not
    failing = held @ fails.astype(np.int64)
    alone = held[:, 1 << np.arange(width)]
    shapley = np.zeros((parts, width), np.int64)
    for number in range(width):
        shapley[:, number] = removed[:, by_step == number].sum(axis=1)
    return {
        "kept": held.sum(axis=1)[:, None, None] - removed.cumsum(axis=2),
        "removed": removed,
        "redundant": failing[:, by_step] - removed,
        "unique_fails": alone[:, by_step],
        "good_lost": lost[:, 1],
        "toxic_lost": lost[:, 2],
        "shapley": shapley[:, by_step],
    }


def _audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["".join(FILTERS[f] for f in order) for order in orders()]
    steps = len(FILTERS)
    for batch in batches:
        for start in range(0, len(batch), PARTS):
            parts = batch.iloc[start : start + PARTS]
            weights = np.zeros((len(parts), MASKS, len(WEIGHTS)), np.int64)
            for row, masks in enumerate(parts["masks"]):
                for one in masks:
                    weights[row, one["mask"]] = [one[name] for name in WEIGHTS]
            yield pd.DataFrame(
                {
                    "part": np.repeat(parts["part"].to_numpy(), len(names) * steps),
                    "filter_order": np.tile(np.repeat(names, steps), len(parts)),
                    "step": np.tile(np.arange(1, steps + 1), len(parts) * len(names)),
                    **{name: values.reshape(-1) for name, values in audit(weights).items()},
                }
            )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    ship(docs.sparkSession)
    one = F.struct("mask", *WEIGHTS)
    # at most one row for each of the 32 masks
    masks = histogram(docs, labels).groupBy("part").agg(F.collect_list(one).alias("masks"))
    return masks.mapInPandas(_audited, RESULT)
