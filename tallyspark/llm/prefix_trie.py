"""The trie of all prefixes of conversations, built by halving depths.

Every distinct sequence of the first d turns of a rebuilt conversation is a node. It is named
by the smallest conversation that begins with it, so a node is (conv_id, depth). The trie is
laid out as in a van Emde Boas tree: sequences are cut at half of the greatest depth, a power
of two; the cut prefixes get their names; what lies above the cut is one upper trie, what lies
below is a forest with one lower trie for each cut prefix; and all of these are cut at half
their depth again, level by level, all tries of a level in one job. At blocks of one turn
the nodes are left. Of each block only distinct paths go on: conversations that
agree above a cut are one path there. A path shorter than half its block needs no cut and
waits for the level that has its length. Blocks are compared by digests built from those of
their halves beforehand, so no conversation is ever gathered in one place.

Totals are grafted upward along the same cuts. Going up, a block's total is that of its upper
half and those of the lower tries that hang on its cut nodes. Then a node's subtree is its own
aligned block and the subtrees of the nodes at the end of that block, which lie on a greater
power of two and are known first. Each takes one join a level over distinct nodes.

Turns are numbered without a task for a whole conversation: rows are sorted by range, which
spreads a long conversation over tasks, and counted by range. ``ends_sha256`` reads
sorted ids as a stream: SHA-256 of one text is sequential, but a task only holds a part of it.

Defined results: rows without conv_id take no part. Turns with equal numbers are ordered by
role and then by the digest of the text, so repeated rows are repeated turns. Null role or
text is empty. A conversation without turns after rebuilding is a member of the root only.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import ship, stash

# Conversations that share a beginning, and the longest shared one.
FAMILY = 5
SHARED = 9
#: Bits of the ids that are joined to one string before strings are read in order.
IDS_BITS = 8
#: Rows of one partition are numbered by Spark below this bit, partitions above.
_PARTITION_BIT = 33

ENDS = "whole binary, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(SHARED))


def _base(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, row, token, n_bytes) sorted by range, and (conv_id, part, first, before,
    turns): the row number of turn p in its range is first + p - before."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"),
        "turn",
        role.alias("role"),
        _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("token"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = ["conv_id", "turn", "role", "token"]
    row = F.monotonically_increasing_id()
    turns = stash(
        own.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", row.alias("row"), "token", "n_bytes"),
        "turns",
    ).withColumn("part", F.shiftright("row", _PARTITION_BIT))
    runs = stash(
        turns.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("held")),
        "runs",
    )
    # a conversation has one run for each range it crosses
    run = Window.partitionBy("conv_id").orderBy("part")
    placed = runs.select(
        "conv_id",
        "part",
        "first",
        (F.sum("held").over(run) - F.col("held")).alias("before"),
        F.sum("held").over(Window.partitionBy("conv_id")).alias("turns"),
    )
    return turns, stash(placed, "runs")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, token, n_bytes) of all rebuilt conversations, depths from 0, and all
    (conv_id)."""
    turns, runs = numbered_turns(conversations)
    lengths = runs.select("conv_id", "turns").distinct()
    base = lengths.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    shared = shared_turns(F.col("conv_id")).cast("long")
    places = (
        runs.withColumn("base", _base(F.col("conv_id")))
        .join(base, "base", "left")
        .withColumns({"shared": shared, "taken": F.least(shared, F.coalesce("base_turns", F.lit(0)))})
        .drop("base", "base_turns", "turns")
    )
    numbered = (
        turns.join(places, ["conv_id", "part"])
        .withColumn("at", F.col("row") - F.col("first") + F.col("before"))
        .select("conv_id", "at", "shared", "taken", "token", "n_bytes")
    )
    numbered = stash(numbered, "numbered")
    own = numbered.filter("at >= shared").withColumn("depth", F.col("at") - F.col("shared") + F.col("taken"))
    # the first turns of a family's first conversation, for each member that takes them
    steps = F.explode(F.array(*map(F.lit, range(1 - FAMILY, FAMILY))))
    first = numbered.filter((F.col("at") < SHARED) & (F.col("conv_id") % FAMILY == 0))
    member = F.try_add(F.col("conv_id"), F.col("step").cast("long"))
    heads = (
        first.withColumn("step", steps)
        .withColumns({"base": F.col("conv_id"), "conv_id": member})
        .filter((_base(F.col("conv_id")) == F.col("base")) & (F.col("at") < shared_turns(F.col("conv_id"))))
        .withColumn("depth", F.col("at"))
        .join(lengths.select("conv_id"), "conv_id", "left_semi")
    )
    columns = ["conv_id", "depth", "token", "n_bytes"]
    rebuilt = stash(own.select(columns).unionByName(heads.select(columns)), "rebuilt")
    return rebuilt, lengths.select("conv_id")


def _level(length: Column, most: int) -> Column:
    """The level of the smallest block that a path is not shorter than the half of."""
    power = reduce(lambda found, k: F.when(length >= 1 << k, k + 1).otherwise(found), range(most), F.lit(0))
    return F.least(power, F.lit(most))


def block_digests(rebuilt: DataFrame, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, digest, length) of whole sequences, and for each level the aligned blocks of
    2**level turns that reach into their second half: (conv_id, block, upper, lower, lower_length).

    The digest of a block that ends in its first half is that half's.
    """
    # the size of the turn's text goes along with its digest, so that nodes have it
    size = F.unhex(F.lpad(F.hex("n_bytes"), 16, "0"))
    blocks = rebuilt.select(
        "conv_id", F.col("depth").alias("block"), F.concat("token", size).alias("digest"), F.lit(1).cast("long").alias("length")
    )
    whole, halved = [], []
    for level in range(1, levels + 1):
        is_lower = F.col("block").bitwiseAND(1) == 1
        pairs = stash(
            blocks.groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(
                F.max(F.when(~is_lower, F.col("digest"))).alias("upper"),
                F.max(F.when(is_lower, F.col("digest"))).alias("lower"),
                F.sum("length").alias("length"),
            ),
            "blocks",
        )
        half = 1 << level - 1
        reaches = F.col("lower").isNotNull()
        halved.append(
            pairs.filter(reaches).select("conv_id", "block", "upper", "lower", (F.col("length") - half).alias("lower_length"))
        )
        done = (F.col("block") == 0) & ~reaches
        whole.append(pairs.filter(done).select("conv_id", F.col("upper").alias("digest"), "length"))
        both = F.when(reaches, _digest(F.col("upper"), F.col("lower"))).otherwise(F.col("upper"))
        blocks = pairs.filter(~done).select("conv_id", "block", both.alias("digest"), "length")
    whole.append(blocks.select("conv_id", "digest", "length"))
    return reduce(DataFrame.unionByName, whole), halved


_PATH = ["anchor", "start", "digest", "length", "name", "n_convs", "whole"]
_KEY = ["anchor", "start", "upper"]


def cut_all(paths: DataFrame, halved: list[DataFrame]) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Cuts all blocks, level by level down to one turn: the nodes, and for each level the cut
    nodes and the lower paths.

    A path is the distinct content of one block below the node (anchor, start). ``name`` is the
    smallest conversation on it, ``whole`` the sequence that ends where the path ends, if any.
    """
    top = len(halved)
    placed = [paths.withColumn("level", _level(F.col("length"), top))]
    all_cuts: list[DataFrame] = []
    all_lower: list[DataFrame] = []
    upper_paths: list[DataFrame] = []
    for level in range(top, 0, -1):
        half = 1 << level - 1
        here = [part.filter(F.col("level") == level).select(_PATH) for part in placed]
        active = reduce(DataFrame.unionByName, here + upper_paths)
        blocks = halved[level - 1].select(F.col("conv_id").alias("name"), "block", "upper", "lower", "lower_length")
        longer = (
            active.filter(F.col("length") > half)
            .withColumn("block", F.shiftright("start", level))
            .join(blocks, ["name", "block"])
        )
        ending = active.filter(F.col("length") == half).withColumn("upper", F.col("digest"))
        columns = [*_KEY, "name", "n_convs"]
        above = ending.select(*columns, "whole").unionByName(
            longer.select(*columns, F.lit(None).cast("binary").alias("whole"))
        )
        cuts = stash(
            above.groupBy(_KEY).agg(
                F.min("name").alias("name"), F.sum("n_convs").alias("n_convs"), F.max("whole").alias("whole")
            ),
            "cuts",
        )
        named = cuts.select(*_KEY, F.col("name").alias("cut"))
        lower = stash(
            longer.join(named, _KEY).select(
                F.col("cut").alias("anchor"),
                (F.col("start") + half).alias("start"),
                F.col("lower").alias("digest"),
                F.col("lower_length").alias("length"),
                "name",
                "n_convs",
                "whole",
                _level(F.col("lower_length"), level - 1).alias("level"),
            ),
            "lower",
        )
        upper_paths = [
            cuts.select(
                "anchor", "start", F.col("upper").alias("digest"), F.lit(half).cast("long").alias("length"),
                "name", "n_convs", "whole",
            )
        ]
        placed.append(lower)
        all_cuts.append(cuts)
        all_lower.append(lower)
    left = [part.filter(F.col("level") == 0).select(_PATH) for part in placed]
    return reduce(DataFrame.unionByName, left + upper_paths), all_cuts[::-1], all_lower[::-1]


_NODE = ["conv_id", "depth"]
_SUMS = ["n_leaves", "saved_tokens"]


def _summed(parts: list[DataFrame]) -> DataFrame:
    union = reduce(DataFrame.unionByName, [part.select(*_NODE, *_SUMS) for part in parts])
    return union.groupBy(_NODE).agg(*[F.sum(name).alias(name) for name in _SUMS])


def below(nodes: DataFrame, cuts: list[DataFrame], lower: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) summed over all nodes below each node that has
    any. ``nodes`` have their own n_leaves and saved_tokens, and their parent_conv_id."""
    children = stash(
        nodes.select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), *_SUMS)
        .groupBy(_NODE)
        .agg(*[F.sum(name).alias(name) for name in _SUMS]),
        "children",
    )

    def at(parts: list[DataFrame], zeros: int) -> list[DataFrame]:
        """Rows at depths that end in exactly that many binary zeros; the root has all."""
        step = 1 << zeros
        return [part.filter(F.col("depth") % (2 * step) == step) for part in parts]

    # up: what lies below a node within its aligned block
    grafts = [children]
    for level in range(1, len(cuts) + 1):
        half = 1 << level - 1
        hung = cuts[level - 1].select(
            F.col("name").alias("conv_id"), (F.col("start") + half).alias("depth"), "anchor", "start"
        )
        grafts.append(
            stash(
                hung.join(_summed(at(grafts, level - 1)), _NODE)
                .groupBy(F.col("anchor").alias("conv_id"), F.col("start").alias("depth"))
                .agg(*[F.sum(name).alias(name) for name in _SUMS]),
                "grafts",
            )
        )
    # down: and what lies beyond the block's end
    known = [stash(_summed([part.filter("depth = 0") for part in grafts]), "subtrees")]
    for level in range(len(cuts), 0, -1):
        half = 1 << level - 1
        ends = (
            lower[level - 1]
            .filter(F.col("length") == half)
            .select(F.col("name").alias("conv_id"), (F.col("start") + half).alias("depth"), "anchor", "start")
        )
        further = reduce(DataFrame.unionByName, known)
        beyond = ends.join(further, _NODE).select(
            F.col("anchor").alias("conv_id"), F.col("start").alias("depth"), *_SUMS
        )
        known.append(stash(_summed([*at(grafts, level - 1), beyond]), "subtrees"))
    return reduce(DataFrame.unionByName, known)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 over the strings of each sequence; rows come in order."""
    whole, sha = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        columns = [pa.array([whole], pa.binary()), pa.array([sha.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, ["whole", "ends_sha256"])

    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest == whole:
                sha.update(b",")
            else:
                if whole is not None:
                    yield row()
                whole, sha = digest, hashlib.sha256()
            sha.update(ids.encode())
    if whole is not None:
        yield row()


def ends(members: DataFrame) -> DataFrame:
    """(whole, ends_sha256): the hash of the ids, in order and comma-joined, of the conversations
    that are the same sequence as a whole."""
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    # the ids of a few hundred neighbours at a time; ids are distinct
    parts = members.groupBy("whole", F.shiftright("conv_id", IDS_BITS).alias("bucket")).agg(
        F.concat_ws(",", ids).alias("ids")
    )
    ordered = parts.repartition("whole").sortWithinPartitions("whole", "bucket")
    return ordered.select("whole", "ids").mapInArrow(_hashed, ENDS)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    of every node."""
    ship(conversations.sparkSession)
    rebuilt, convs = rebuilt_turns(conversations)
    longest = rebuilt.agg(F.max("depth") + 1).first()[0]
    smallest, count = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    levels = max(0, (longest or 1) - 1).bit_length()
    sequences, halved = block_digests(rebuilt, levels)
    sequences = stash(sequences, "sequences")
    groups = sequences.groupBy("digest", "length").agg(
        F.min("conv_id").alias("name"), F.count(F.lit(1)).alias("n_convs")
    )
    root, top = F.lit(smallest).cast("long"), F.lit(0).cast("long")
    paths = stash(
        groups.withColumns({"anchor": root, "start": top, "whole": F.col("digest")}).select(_PATH), "paths"
    )
    nodes, cuts, lower = cut_all(paths, halved)
    n_bytes = F.conv(F.hex(F.substring("digest", 33, 8)), 16, 10).cast("long")
    nodes = nodes.select(
        F.col("name").alias("conv_id"),
        (F.col("start") + 1).alias("depth"),
        F.col("anchor").alias("parent_conv_id"),
        "n_convs",
        ((F.col("n_convs") - 1) * n_bytes).alias("saved_tokens"),
        "whole",
    )
    # conversations without any turn end at the root
    empty = F.lit(b"")
    turnless = convs.join(sequences.select("conv_id"), "conv_id", "left_anti").withColumn("whole", empty)
    spark = conversations.sparkSession
    nothing = F.lit(0).cast("long")
    if count:
        top_node = spark.range(1).select(
            root.alias("conv_id"),
            top.alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"),
            F.lit(count).cast("long").alias("n_convs"),
            nothing.alias("saved_tokens"),
            empty.alias("whole"),
        )
        nodes = nodes.unionByName(top_node)
    fans = nodes.filter("depth > 0").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stash(
        nodes.join(fans, _NODE, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long")),
        "nodes",
    )
    subtrees = below(nodes.filter("depth > 0"), cuts, lower).select(
        *_NODE, F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved")
    )
    members = sequences.select("conv_id", F.col("digest").alias("whole")).unionByName(turnless.select("conv_id", "whole"))
    return (
        nodes.join(subtrees, _NODE, "left")
        .join(ends(members), "whole", "left")
        .select(
            *_NODE,
            "parent_conv_id",
            "n_convs",
            "n_children",
            (F.col("n_leaves") + F.coalesce("more_leaves", nothing)).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", nothing)).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        )
    )
