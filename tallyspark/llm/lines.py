"""Line dedup by a tree of log templates: lines that recur across documents are dropped.

A line's tokens are what spaces part; a token with a digit, ``@`` or ``://`` is a variable
field and becomes ``<*>``. A leaf of the tree is a number of tokens and the leading tokens, at
most LEADING and at most half of them. Two kinds of templates are found:

- a line as it reads once its variable fields are masked, if they are at most half of it;
- within a leaf, lines cut into even parts, at most SEGMENTS, of which a quarter may differ: for
  each choice of that many parts, the lines that agree in all others are instances of one
  template. A leaf has as many templates as its lines show, and a line may be of several.

A template is dropped, with all its lines, if it occurs in MIN_TEXTS different texts, whatever
its length. Exact copies of a document count as one text, so that copies alone do not make a
line recur; nor does a template within one text. Blank lines hold no tokens and stay.

The texts are read twice, once for hashes of lines and parts, once to drop lines. Counting is
by partial sums in two steps (template and text, then template), and joins are on plain
columns of written tables, which AQE splits where one line has made a key large.

Defined results: a null text is empty and has one empty line; repeated rows are cleaned
alike and count once; a document of dropped lines alone gets the text ``""``. Extra columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import stash

LEADING = 4
#: Different texts that a template is in once it is dropped.
MIN_TEXTS = 3
#: Most parts of a line, and of how many parts one may differ.
SEGMENTS, DIFFER_OF = 8, 4

_FIELD = r"[0-9@]|://"
_VARIABLE = r"(?<![^ ])(?:[^ 0-9@:]|:(?!//))*+(?:[0-9@]|://)[^ ]*"
#: A text is known by its hash and its length.
TEXT = ["text_hash", "text_bytes"]


def _known_by(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_bytes")]


def _placed(docs: DataFrame) -> DataFrame:
    """(text, place, tokens, line, leaf, parts) of every line; hashes for line, leaf, parts."""
    text = F.coalesce("text", F.lit(""))
    line = F.trim("col")
    masked = F.when(F.rlike(line, F.lit(_FIELD)), F.regexp_replace(line, _VARIABLE, "<*>"))
    # a line of fields for the most part tells nothing once they are masked
    fields = F.size(F.filter(F.split("masked", " "), lambda token: token == "<*>"))
    told = F.when(fields * 2 <= F.size(F.split("masked", " ")), F.col("masked"))
    size = F.size("tokens")
    count = F.least(size, F.lit(SEGMENTS))

    def part(i: int) -> Column:
        start, end = (F.floor(size * at / count).cast("int") for at in (i, i + 1))
        return F.when(count > i, F.hash(F.slice("tokens", start + 1, end - start)))

    parts = F.array(*(part(i) for i in range(SEGMENTS)))
    leading = F.least(F.lit(LEADING), F.floor(size / 2).cast("int"))
    return (
        # hashed before lines are told apart, so once for each text
        docs.select(*_known_by(text), F.split(text, "\n").alias("every"))
        .select(*TEXT, F.posexplode("every").alias("place", "col"))
        .select(*TEXT, "place", line.alias("line"), masked.alias("masked"))
        .filter(F.col("line") != "")
        .select(*TEXT, "place", F.coalesce(told, "line").alias("masked"))
        .withColumn("tokens", F.split("masked", " "))
        .select(
            *TEXT,
            "place",
            size.alias("tokens"),
            F.xxhash64("masked").alias("line"),
            F.xxhash64(size, F.slice("tokens", 1, leading)).alias("leaf"),
            # shorter lines have no part that may differ
            F.when(size >= DIFFER_OF, parts).alias("parts"),
        )
    )


def _signatures(lines: DataFrame) -> DataFrame:
    """(template, line, texts): each line once for every choice of the parts that may differ."""
    by_count = []
    for count in range(DIFFER_OF, SEGMENTS + 1):
        chosen = [
            F.xxhash64("leaf", F.lit(number), *(F.col("parts")[i] for i in range(count) if i not in left_out))
            for number, left_out in enumerate(combinations(range(count), count // DIFFER_OF))
        ]
        by_count.append(F.when(F.least("tokens", F.lit(SEGMENTS)) == count, F.array(*chosen)))
    return lines.select(F.explode(F.coalesce(*by_count)).alias("template"), "line", "texts")


def _instances(placed: DataFrame, counted: DataFrame) -> DataFrame:
    """line of the lines that recur together, as instances of one template."""
    several = F.count("*") > 1
    enough = F.sum("texts") >= MIN_TEXTS
    # where a leaf or a template cannot do, a text counted for each of its lines, none is sought
    varied = counted.filter(F.col("parts").isNotNull())
    leaves = varied.groupBy("leaf").agg(several.alias("several"), enough.alias("enough"))
    leaves = stash(leaves.filter("several and enough").select("leaf"), "leaves")
    candidates = stash(_signatures(varied.join(leaves, "leaf", "left_semi")), "templates")
    groups = stash(
        candidates.groupBy("template")
        .agg(several.alias("several"), enough.alias("enough"), (F.max("texts") >= MIN_TEXTS).alias("sure"))
        .filter("several and enough")
        .select("template", "sure"),
        "groups",
    )
    # one line in enough texts settles it; other lines are in few texts each, which are told apart
    open_ = candidates.join(groups.filter("not sure").select("template"), "template").select("template", "line")
    told = (
        open_.join(placed.select("line", *TEXT), "line")
        .groupBy("template", *TEXT)
        .agg(F.lit(1).alias("one"))
        .groupBy("template")
        .agg(F.count("*").alias("texts"))
        .filter(F.col("texts") >= MIN_TEXTS)
        .select("template")
    )
    found = groups.filter("sure").select("template").unionByName(told)
    return candidates.join(stash(found, "found"), "template", "left_semi").select("line")


def _flags(hits: DataFrame) -> DataFrame:
    """(text, flags, n_dropped): whether each line of a text is dropped, up to the last that is."""
    places = F.col("places")
    before = F.concat(F.array(F.lit(-1)), F.slice(places, 1, F.size(places) - 1))
    runs = F.zip_with(
        places, before, lambda at, last: F.concat(F.array_repeat(F.lit(False), at - last - 1), F.array(F.lit(True)))
    )
    return (
        hits.groupBy(*TEXT)
        .agg(F.sort_array(F.collect_set("place")).alias("places"))
        .select(*TEXT, F.flatten(runs).alias("flags"), F.size(places).alias("n_dropped"))
    )


def clean(docs: DataFrame) -> DataFrame:
    """doc_id, text without dropped lines, n_lines, n_dropped of every document."""
    placed = stash(_placed(docs), "placed")
    counted = stash(
        placed.groupBy("line", "leaf", "tokens", "parts", *TEXT)
        .agg(F.lit(1).alias("one"))
        .groupBy("line", "leaf", "tokens", "parts")
        .agg(F.count("*").alias("texts")),
        "counted",
    )
    recurring = counted.filter(F.col("texts") >= MIN_TEXTS).select("line")
    dropped = stash(recurring.unionByName(_instances(placed, counted)).distinct(), "dropped")
    hits = placed.select(*TEXT, "place", "line").join(dropped, "line").drop("line")
    flags = stash(_flags(stash(hits, "hits")), "flags")
    text = F.coalesce("text", F.lit(""))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, at: ~F.coalesce(F.get("flags", at), F.lit(False)))
    return (
        docs.select("doc_id", text.alias("text"), *_known_by(text))
        .join(flags, TEXT, "left")
        .select(
            "doc_id",
            F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
            F.size(lines).alias("n_lines"),
            F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        )
    )
