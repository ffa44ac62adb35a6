"""Mixing sources to target weights, on a tree of domains, languages and sources.

Each node's budget is shared among its children by their weights. A child that has fewer
tokens than its share (over all epochs allowed) gets what it has, and its siblings share the
rest by their weights; only what no sibling can take goes back to the ancestors, because a
node is never given more than its whole subtree holds. A leaf's documents are put in order
by a seeded hash, anew for each epoch; the leaf takes the longest run of whole documents, from
the first on, whose tokens fit into its budget, through as many epochs as that takes.

No group is sorted whole: hashes fall into buckets of about BUCKET_ROWS rows, whose token
sums tell which bucket the budget ends in; only that one is sorted.

Tokens are words (runs without white space). Defined results: a null text has no words and a
document without words is always taken with the documents before it; null names of a level
form a node of their own; a weight that is missing is DEFAULT_WEIGHT, a negative one
zero; with a budget or a weight of zero a node gets nothing; an empty table gives no rows.
Rows with equal ids are ordered by a hash of their text. Columns other than doc_id, lang,
source and text are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import stash

LEVELS = ("domain", "lang", "source")
DEFAULT_WEIGHT = 1
#: Target weights by level and name; whole numbers, so that sums are exact.
WEIGHTS = {
    ("domain", "d0"): 4,
    ("domain", "d1"): 3,
    ("domain", "d2"): 2,
    ("domain", "d3"): 1,
    ("lang", "en"): 5,
    ("lang", "de"): 2,
    ("lang", "fr"): 2,
    ("lang", "es"): 1,
}
#: The mixture's size as parts of all tokens at hand.
BUDGET = (3, 5)
EPOCHS = 2
SEED = 42
BUCKET_ROWS = 4096
#: Values of the order hash, 15 hex digits of an MD5.
ORDER_RANGE = 1 << 60


def domain() -> Column:
    """The domain of a source: its number modulo four, ``d0`` for a source without one."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int)")
    return F.concat(F.lit("d"), F.pmod(F.coalesce(number, F.lit(0)), F.lit(4)).cast("string"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    """60 bits that depend on seed, epoch and key."""
    name = F.coalesce(key.cast("string"), F.lit(""))
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _weight(level: str) -> Column:
    column: Column = F.lit(DEFAULT_WEIGHT)
    for (at, name), weight in WEIGHTS.items():
        if at == level:
            column = F.when(F.col(level) == name, F.lit(max(0, weight))).otherwise(column)
    return column.cast("long")


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds budget: each parent's parent_budget shared among its nodes (weight, capacity).

    In the order of capacity per weight, the first nodes are filled; the budget they leave,
    by the weights they leave, is the level that the others are filled to.
    """
    line = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *LEVELS)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    on = line.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    is_open = F.col("capacity") / F.col("weight") > F.col("level")
    levelled = (
        nodes.filter("weight > 0")
        .withColumn("level", left / F.sum("weight").over(on))
        .withColumn("final", F.max(F.when(is_open, F.col("level"))).over(Window.partitionBy(*parent)))
    )
    filled = F.floor(F.col("weight") * F.greatest(F.col("final"), F.lit(0.0))).cast("long")
    budget = F.coalesce(F.least(F.col("capacity"), filled), F.col("capacity"))
    return levelled.withColumn("budget", F.when(F.col("final").isNull(), F.col("capacity")).otherwise(budget))


def _same(prefix: str, names: tuple[str, ...] = LEVELS) -> Column:
    """Levels equal their namesakes with a prefix, nulls included."""
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"{prefix}{name}"))
    return same


def _renamed(prefix: str, names: tuple[str, ...] = LEVELS) -> list[Column]:
    return [F.col(name).alias(f"{prefix}{name}") for name in names]


def leaf_budgets(leaves: DataFrame, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Adds budget to leaves (levels, rows, tokens); leaves that get nothing are left out."""
    root = leaves.agg(F.expr(f"sum(tokens) * {budget[0]} div {budget[1]}")).scalar()
    tree = leaves.withColumn("parent_budget", root)
    for depth, level in enumerate(LEVELS):
        node = LEVELS[: depth + 1]
        nodes = tree.groupBy(*node).agg(
            (F.sum("tokens") * epochs).alias("capacity"),
            F.first("parent_budget").alias("parent_budget"),
        )
        missing = [F.lit(None).cast("string").alias(name) for name in LEVELS[depth + 1 :]]
        nodes = nodes.select("*", *missing, _weight(level).alias("weight"))
        given = share(nodes, list(node[:-1])).select(*_renamed("n_", node), "budget")
        tree = tree.join(given, _same("n_", node)).select(
            *LEVELS, "rows", "tokens", F.col("budget").alias("parent_budget")
        )
    return tree.withColumnRenamed("parent_budget", "budget").filter("budget > 0")


def _measures() -> dict[str, Column]:
    return {
        "domain": domain(),
        "words": words(F.col("text")),
        "tie": F.md5(F.coalesce("text", F.lit("")).cast("binary")),
    }


def _order(seed: int) -> dict[str, Column]:
    """The place of a row in its leaf's last epoch, and its bucket."""
    return {
        "order": order_hash(seed, F.col("full"), F.col("doc_id")),
        "bucket": F.expr(f"`order` div ({ORDER_RANGE} div buckets + 1)"),
    }


def plan(
    docs: DataFrame, seed: int = SEED, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS
) -> DataFrame:
    """A row a leaf (p_ levels): its budget, full epochs, and where its last epoch ends.

    All rows before ``cut_bucket`` are taken; ``before`` is the number of their words. A null
    cut_bucket means that all rows are taken once more.
    """
    measured = stash(docs.withColumns(_measures()).select("doc_id", *LEVELS, "words"), "measured")
    leaves = measured.groupBy(*LEVELS).agg(F.count("*").alias("rows"), F.sum("words").alias("tokens"))
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    budgets = stash(
        leaf_budgets(stash(leaves, "leaves"), budget, epochs)
        .withColumn("full", full.cast("int"))
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
        .withColumn("buckets", F.greatest(F.lit(1), F.expr(f"rows div {BUCKET_ROWS}")))
        .select(*_renamed("p_"), "budget", "full", "rest", "buckets"),
        "budgets",
    )
    held = (
        measured.join(budgets, _same("p_"))
        .withColumn("order", _order(seed)["order"])
        .withColumn("bucket", _order(seed)["bucket"])
        .groupBy(*(f"p_{name}" for name in LEVELS), "bucket")
        .agg(F.sum("words").alias("held"), F.first("rest").alias("rest"))
    )
    line = Window.partitionBy(*(f"p_{name}" for name in LEVELS)).orderBy("bucket")
    through = F.sum("held").over(line.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.struct("bucket", (F.col("through") - F.col("held")).alias("before")))
    cuts = (
        held.withColumn("through", through)
        .filter("through > rest")
        .groupBy(*(F.col(f"p_{name}").alias(name) for name in LEVELS))
        .agg(first.alias("cut"))
        .select(*LEVELS, F.col("cut.bucket").alias("cut_bucket"), "cut.before")
    )
    return stash(budgets.join(cuts, _same("p_"), "left").drop(*LEVELS), "plan")


def taken(
    docs: DataFrame, seed: int = SEED, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS
) -> DataFrame:
    """(row, epoch, words, levels, budget): row holds all columns of docs, once an epoch."""
    whole = F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row")
    packed = docs.select(whole, "doc_id", "lang", "source", "text")
    placed = (
        packed.withColumns(_measures())
        .drop("text")
        .join(plan(docs.select("doc_id", "lang", "source", "text"), seed, budget, epochs), _same("p_"))
        .withColumn("order", _order(seed)["order"])
        .withColumn("bucket", _order(seed)["bucket"])
    )
    inside = placed.filter("cut_bucket is null or bucket < cut_bucket")
    line = Window.partitionBy(*LEVELS).orderBy("order", "doc_id", "tie")
    until = F.col("before") + F.sum("words").over(line.rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.filter("bucket = cut_bucket").withColumn("until", until).filter("until <= rest")
    # every row is read once: whole epochs it is in, and the last one unless that ended before
    result = ["row", "epoch", "words", *LEVELS, "budget"]
    last = inside.unionByName(edge.drop("until")).withColumn("epoch", F.col("full"))
    early = placed.filter("full > 0").withColumn("epoch", F.explode(F.expr("sequence(0, full - 1)")))
    return last.select(*result).unionByName(early.select(*result))


def selection(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, epoch, words, the levels and the leaf's budget of every document taken."""
    narrow = docs.select("doc_id", "lang", "source", "text")
    return taken(narrow, seed).select("row.doc_id", "epoch", "words", *LEVELS, "budget")


def mix(
    docs: DataFrame, seed: int = SEED, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS
) -> DataFrame:
    """The rows of docs, all columns, that the mixture takes; once for every epoch."""
    return taken(docs, seed, budget, epochs).select("row.*")
