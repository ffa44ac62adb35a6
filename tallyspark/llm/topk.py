"""Exact inner-product top-k by norm buckets.

Vectors become integers, x to floor(256 x), and are sorted by length, longest first, so that
what a task reads at a time is a bucket of similar lengths. A first look at the longest vectors
gives each query a score that its k-th best reaches at least. Queries then go in blocks, those
that reach equally far together: a block is sent to all tasks, which read the buckets no
shorter than the block's reach, and no row of the table is shuffled for it. With a query's
score and length and the longest vector of a bucket, the bucket asks for a local cosine. Above
one, no vector of it can do, and the query skips it. From COORDINATE_FROM on, the vectors'
coordinates are held against the range that the local cosine leaves for the query's largest
ones; below, the vectors that are long enough meet all such queries in one matrix product.
Products decide among what is left, so pruning never changes a result.

Products are exact: sums of doubles below 2^53, of longs below 2^63, and of integers without
bound beyond that, by the lengths of both sides.

Memory: a task holds a block of queries, one Arrow batch, and products of SCORES cells. Scanning
all rows once for each block of BLOCK_ROWS queries is the part that grows with queries times rows.

Defined results: vectors that are null, or hold a null or non-finite component, and rows
with a null id take no part, nor do those with a component whose 256-fold is beyond a long; a
score beyond a long is the nearest long; a candidate of another dimension than the query is none; of
equal scores the smaller vec_id comes first; of repeated ids each row is a candidate, but
no row of the query's own id; zero vectors are candidates like any other. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import ship, stash

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Longest vectors of the first look, queries of a block, and cells of a product.
FIRST_ROWS, BLOCK_ROWS, SCORES = 1024, 4096, 4_000_000
#: Local cosine from which on coordinates are compared, and how many of them.
COORDINATE_FROM, COORDINATES = 0.5, 3

FOUND = "query_id long, vec_id long, score long"
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (integers), norm, size of the vectors that take part."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    # a null, a NaN or an infinity is no number within these bounds; 2^63 itself is no long
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < 2.0**63, F.lit(False)))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(fits)
        .select("vec_id", F.transform(scaled, lambda x: x.cast("long")).alias("v"))
        .withColumn("norm", F.sqrt(square))
        .withColumn("size", F.size("v"))
    )


class Block:
    """Some queries, by dimension: their ids, vectors, lengths and least scores."""

    def __init__(self, rows: pd.DataFrame):
        self.parts = []
        for size, part in rows.groupby("size"):
            matrix = np.stack(part["v"].to_numpy()).astype(np.int64).reshape(len(part), int(size))
            least = part["least"].to_numpy(float) if "least" in part else np.full(len(part), -np.inf)
            self.parts.append(
                (int(size), part["vec_id"].to_numpy(np.int64), matrix, part["norm"].to_numpy(float), least)
            )

    def best(self, bucket: pd.DataFrame, k: int) -> pd.DataFrame:
        """The k best of a bucket for every query that it may have any for."""
        found = [np.empty((3, 0), np.int64)]
        for size, asked, queries, lengths, least in self.parts:
            part = bucket[bucket["size"] == size].sort_values(["norm", "vec_id"], ascending=[False, True])
            if not len(part):
                continue
            ids, norms = part["vec_id"].to_numpy(np.int64), part["norm"].to_numpy(float)
            matrix = np.stack(part["v"].to_numpy()).astype(np.int64).reshape(len(part), size)
            found += _best(ids, matrix, norms, asked, queries, lengths, least, k)
        query, vec, score = np.concatenate(found, axis=1)
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})


def products(matrix: np.ndarray, queries: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products (row, query) as longs; none is above ``bound`` in size."""
    if bound < 2.0**53:
        return (matrix.astype(float) @ queries.astype(float).T).astype(np.int64)
    if bound < 2.0**62:
        return matrix @ queries.T
    exact = matrix.astype(object) @ queries.astype(object).T
    return np.clip(exact, _LOWEST, _HIGHEST).astype(np.int64)


def _best(ids, matrix, norms, asked, queries, lengths, least, k) -> list[np.ndarray]:
    """(query, vec_id, score) of the k best for each query, in parts."""
    longest = norms[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosines = np.where((least > 0) & (lengths > 0), least / (lengths * max(longest, 1e-300)), 0.0)
    cosines *= 1 - 1e-9
    found = []
    unit = None
    for q in np.flatnonzero((cosines <= 1) & (cosines >= COORDINATE_FROM)):
        unit = matrix / np.maximum(norms, 1e-300)[:, None] if unit is None else unit
        rows = candidates(queries[q].astype(float), lengths[q], least[q], unit, norms)
        if len(rows):
            scores = products(matrix[rows], queries[q : q + 1], norms[rows[0]] * lengths[q])
            found += _kept(ids[rows], scores, asked[q : q + 1], least[q : q + 1], k)
    # the others by one product, from the longest vector down to what the farthest one reaches
    broad = np.flatnonzero(cosines < COORDINATE_FROM)
    if len(broad):
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where((least > 0) & (lengths > 0), least / lengths, 0.0)[broad].min() * (1 - 1e-9)
        held = int(np.searchsorted(-norms, -reach, "right"))
        step = max(1, SCORES // max(1, held))
        for first in range(0, len(broad) if held else 0, step):
            some = broad[first : first + step]
            scores = products(matrix[:held], queries[some], longest * lengths[some].max())
            found += _kept(ids[:held], scores, asked[some], least[some], k)
    return found


def _kept(ids, scores, asked, least, k) -> list[np.ndarray]:
    """The k best rows (row, query) of each query among those that reach its least score."""
    # a least score is a double: one below it may be the same long
    row, query = np.nonzero((scores >= least * (1 - 1e-12 * np.sign(least))) & (ids[:, None] != asked))
    values, vec = scores[row, query], ids[row]
    # the complement orders as the negative does and fits every long
    order = np.lexsort((vec, ~values, query))
    query, vec, values = query[order], vec[order], values[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, "left")
    top = place < k
    return [np.array([asked[query[top]], vec[top], values[top]])]


def candidates(v: np.ndarray, norm: float, least: float, unit: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows, sorted by falling length, whose product with v may reach ``least``."""
    everything = np.arange(len(norms))
    if least <= 0 or norm == 0:
        return everything
    # a slight margin keeps what rounding would lose; products are exact
    cosine = least / (norm * max(norms[0], 1e-300)) * (1 - 1e-9)
    if cosine > 1:
        return everything[:0]
    long_enough = int(np.searchsorted(-norms, -least / norm * (1 - 1e-9), "right"))
    rows = everything[:long_enough]
    if cosine < COORDINATE_FROM or not len(rows):
        return rows
    q = v / norm
    # a vector's own local cosine is higher the shorter it is, so the bucket's is safe
    for at in np.argsort(-np.abs(q), kind="stable")[:COORDINATES]:
        spread = np.sqrt(max(0.0, (1 - cosine**2) * (1 - q[at] ** 2))) + 1e-9
        column = unit[rows, at]
        rows = rows[_below(-column, -q[at], cosine, spread) & _below(column, q[at], cosine, spread)]
    return rows


def _below(column: np.ndarray, q: float, cosine: float, spread: float) -> np.ndarray:
    """The upper end of the range; one if the axis itself lies within the local cosine.

    The lower end is the upper one of the other direction.
    """
    high = 1.0 if q >= cosine else q * cosine + spread
    return column <= high + 1e-9


def _scored(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """The k best rows of each batch for the queries of a block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pandas(shared.value.best(batch.to_pandas(), k), preserve_index=False)

    return rows.select("vec_id", "v", "norm", "size").mapInArrow(score, FOUND)


def _least(queries: DataFrame, longest: pd.DataFrame, k: int) -> DataFrame:
    """queries with a score that the k-th best of each reaches at least, if there is one."""
    shared = queries.sparkSession.sparkContext.broadcast(longest)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Block(batch).best(shared.value, k)
            reached = found.groupby("query_id")["score"].agg(["size", "min"])
            known = reached[reached["size"] >= k]["min"].astype(float)
            yield batch.assign(least=batch["vec_id"].map(known).fillna(-np.inf).astype(float))

    columns = "vec_id long, v array<long>, norm double, size int, least double"
    return queries.select("vec_id", "v", "norm", "size").mapInPandas(look, columns)


def _top(found: DataFrame, k: int) -> DataFrame:
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every query."""
    spark = vectors.sparkSession
    ship(spark)
    is_query = F.col("vec_id") % QUERY_EVERY == 0 if is_query is None else is_query
    whole = integer_vectors(vectors.select(F.col("vec_id").cast("long"), "embedding"))
    dealt = whole.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    buckets = stash(dealt, "vectors")
    longest = buckets.orderBy(F.desc("norm"), "vec_id").limit(FIRST_ROWS).toPandas()
    asked = stash(buckets.filter(is_query).dropDuplicates(["vec_id", "v"]), "asked")
    # a query reaches vectors down to that length
    reach = F.when((F.col("least") > 0) & (F.col("norm") > 0), F.col("least") / F.col("norm")).otherwise(0.0)
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    ordered = _least(asked, longest, k).withColumn("reach", reach).repartitionByRange(blocks, F.desc("reach"), "vec_id")
    queries = stash(ordered.withColumn("block", F.spark_partition_id()), "queries")
    found = None
    for number in range(blocks):
        block = queries.filter(F.col("block") == number)
        for rows in _bounded(block):
            near = buckets.filter(F.col("norm") >= float(rows["reach"].min()) * (1 - 1e-9))
            part = _scored(near, Block(rows), k)
            part = stash(part, "found") if blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    return _top(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _bounded(block: DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a block in frames of BLOCK_ROWS: ranges hold about as many, not at most."""
    rows = []
    for row in block.toLocalIterator():
        rows.append(row.asDict())
        if len(rows) == BLOCK_ROWS:
            yield pd.DataFrame(rows)
            rows = []
    if rows:
        yield pd.DataFrame(rows)
