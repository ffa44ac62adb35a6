"""SimHash near-dedup on a grid of segment popcounts.

A fingerprint's 64 bits are cut into 32 segments of two; the number of set bits of each
segment places it in a grid of 32 dimensions. The Manhattan distance of two places is never
above the fingerprints' Hamming distance. Within 3 bits, one half of the dimensions is
therefore at Manhattan distance 1 at most: a range join on the cells of each half finds all
such pairs (equal cells, and cells one step up in one dimension; the step down is the other
side's step up), and the Hamming distance of each pair is then verified.

Only distinct fingerprints are joined, so exact copies collapse before, however many.

Defined results: a null text counts as empty; texts without words have fingerprint zero and
are linked like any other; null ids are never the smallest id, and a group of null ids alone
has component_id null; repeated rows give repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import per_value, stash
from tallyspark.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
#: Shingles whose bits are counted at a time, which bounds memory in very long texts.
CHUNK = 1 << 15

_EVERY_SECOND = 0x55555555  # the lower bit of each segment of a half
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit SimHash of the text's word shingles; zero without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    hashes = np.fromiter(map(_hash, shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK].view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _cells(prints: DataFrame) -> DataFrame:
    """(fp, key): the cell of either half, the half in the bits above it."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)

    def popcounts(half):
        return half - F.shiftright(half, 1).bitwiseAND(F.lit(_EVERY_SECOND))

    return prints.select(
        "fp",
        F.explode(F.array(popcounts(low), popcounts(high) + F.lit(1 << 32))).alias("key"),
    )


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) once for every two fp of prints (distinct) that differ in max_bits bits or fewer.

    ``max_bits`` may be 0 to 3: the range join covers one step in one half.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    placed = _cells(prints)
    up = F.expr(
        "filter(transform(sequence(0, 15), i ->"
        " if((shiftright(key, 2 * i) & 3) < 2, key + shiftleft(1L, 2 * i), null)), x -> x is not null)"
    )
    probes = placed.select(F.col("fp").alias("a"), "key", F.lit(False).alias("stepped"))
    if max_bits > 1:
        probes = probes.unionByName(
            placed.select(F.col("fp").alias("a"), F.explode(up).alias("key"), F.lit(True).alias("stepped"))
        )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return (
        probes.join(placed.select(F.col("fp").alias("b"), "key"), "key")
        .filter((F.col("stepped") | (F.col("a") < F.col("b"))) & near)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def grouped(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) for the rows (doc_id, fp) of prints, once per fp."""
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = components(links(distinct.select("fp")))
    rooted = stash(
        distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    first = stash(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "first")
    return stash(rooted.select("fp", "root").join(first, "root"), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stash(docs.select("doc_id", per_value(fingerprint, "long")("text").alias("fp")), "documents")
    return prints.join(grouped(prints), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, of each group: that of the smallest doc_id.

    Among rows of the same id the smallest hash over all columns decides; of wholly equal
    rows one stays.
    """
    row_hash = F.xxhash64(*(F.col(f"`{name}`") for name in docs.columns))
    prints = stash(
        docs.select("doc_id", row_hash.alias("row_hash"), per_value(fingerprint, "long")("text").alias("fp")),
        "documents",
    )
    rows = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    chosen = stash(
        prints.join(grouped(prints).select("fp", "root"), "fp")
        .groupBy("root")
        .agg(F.min(rows).alias("row"))
        .select("row.doc_id", "row.row_hash"),
        "chosen",
    )
    name = "row_hash"
    while name in docs.columns:
        name += "_"
    here, there = docs.withColumn(name, row_hash), chosen.alias("chosen")
    kept = here.join(
        there,
        here["doc_id"].eqNullSafe(F.col("chosen.doc_id")) & (here[name] == F.col("chosen.row_hash")),
        "left_semi",
    )
    repeated = prints.groupBy("doc_id", "row_hash").count().filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", name])
    return kept.drop(name)
