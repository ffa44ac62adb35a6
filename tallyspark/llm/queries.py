"""The queries of this subpackage, and the same in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import (
    decontam,
    filter_audit,
    html,
    lines,
    mixing,
    prefix_trie,
    quality,
    secrets,
    simhash,
    token_counts,
    token_shards,
    topk,
    toxicity,
)
from tallyspark.llm.common import table


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contaminated(documents, benchmark)


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.round_trip(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_html": op3_html,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_topk": op9_topk,
    "op10_token_shards": op10_token_shards,
    "op11_token_counts": op11_token_counts,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}


def _filled(level: str, parents: str, weight: str, above: str) -> str:
    """SQL: each parent's budget (of table above) shared among its nodes, as mixing.share does."""
    node = f"{parents}, {level}" if parents else level
    by = f"partition by {parents}" if parents else ""
    join = f"join {above} using ({parents})" if parents else f"cross join {above}"
    # nodes of null names do not occur in the given tables
    return f"""
nodes_{level} as (
  select {node}, sum(tokens) * {mixing.EPOCHS} as capacity, {weight} as weight, any_value({above}.budget) as pot
  from leaves {join} group by all),
levels_{level} as (
  select *, case when weight > 0 then
    (pot - coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (w rows between current row and unbounded following) end as lev
  from nodes_{level} where weight > 0
  window w as ({by} order by capacity / weight, {node})),
finals_{level} as (
  select *, max(case when capacity / weight > lev then lev end) over ({by}) as fin from levels_{level}),
budget_{level} as (
  select {node}, case when fin is null then capacity
    else least(capacity, floor(weight * greatest(fin, 0.0))::bigint) end::bigint as budget
  from finals_{level})"""


def _weights(level: str) -> str:
    cases = "".join(f" when {level} = '{n}' then {w}" for (at, n), w in mixing.WEIGHTS.items() if at == level)
    return f"case{cases} else {mixing.DEFAULT_WEIGHT} end" if cases else str(mixing.DEFAULT_WEIGHT)


_MIXING = f"""
with docs as (
  select doc_id, lang, source, text,
    'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as int), 0) % 4) as domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as words,
    md5(coalesce(text, '')) as tie
  from documents),
leaves as (select domain, lang, source, count(*) as held, sum(words)::bigint as tokens from docs group by all),
root as (select (sum(tokens) * {mixing.BUDGET[0]} // {mixing.BUDGET[1]})::bigint as budget from leaves),
{_filled("domain", "", _weights("domain"), "root")},
{_filled("lang", "domain", _weights("lang"), "budget_domain")},
{_filled("source", "domain, lang", _weights("source"), "budget_lang")},
plan as (
  select *, case when tokens > 0 then budget // tokens else 0 end as full_epochs
  from leaves join budget_source using (domain, lang, source) where budget > 0),
placed as (
  select docs.*, budget, full_epochs, budget - full_epochs * tokens as rest, tokens,
    ('0x' || substr(md5('{mixing.SEED}:' || full_epochs || ':' || coalesce(doc_id::varchar, '')), 1, 15))::bigint
      as place
  from docs join plan using (domain, lang, source)),
run as (
  select *, sum(words) over (partition by domain, lang, source order by place, doc_id, tie
    rows between unbounded preceding and current row) as until from placed),
taken as (
  select *, full_epochs as epoch from run where until <= rest or tokens <= rest
  union all
  select * from (select *, unnest(range(full_epochs)) as epoch from run))
select doc_id, epoch::int as epoch, words::bigint as words, domain, lang, source, budget from taken
"""


# crc32 byte by byte and bit by bit; 3988292384 is its polynomial
_CRC = """
list_reduce(list_prepend(4294967295::bigint, [ascii(d)::bigint for d in regexp_split_to_array(conv_id::varchar, '')]),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, bit: xor(c >> 1, 3988292384 * (c & 1))))"""

_TRIE = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id
      order by turn nulls first, coalesce(role, ''),
        sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as nr,
    struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as one
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % {prefix_trie.FAMILY} as base,
    xor(4294967295, {_CRC}) % {prefix_trie.SHARED} as shared
  from (select distinct conv_id from turns)),
rebuilt as (
  select convs.conv_id, 0 as own, nr, one from convs join turns on turns.conv_id = base where nr < shared
  union all
  select conv_id, 1 as own, nr, one from convs join turns using (conv_id) where nr >= shared),
prefixes as (
  select conv_id, list(one) over w as seq, row_number() over w as depth
  from rebuilt window w as (partition by conv_id order by own, nr rows unbounded preceding)
  union all select conv_id, [] as seq, 0 as depth from convs),
placed as (
  select *, min(conv_id) over (partition by seq) as node, max(depth) over (partition by conv_id) as last
  from prefixes),
nodes as (
  select node, depth, count(*) as n_convs,
    case when depth > 0 then strlen(any_value(seq)[-1].text) else 0 end as n_bytes,
    coalesce(sha256(string_agg(conv_id::varchar, ',' order by conv_id) filter (last = depth)), sha256('')) as ends_sha256
  from placed group by node, depth),
parents as (
  select nodes.node, nodes.depth, above.node as parent from nodes
  join placed above on above.conv_id = nodes.node and above.depth = nodes.depth - 1),
fans as (select parent as node, depth - 1 as depth, count(*) as n_children from parents group by all),
subtrees as (
  select above.node, above.depth, count(*) filter (n_children is null) as n_leaves,
    sum((n_convs - 1) * n_bytes) as saved_tokens
  from nodes left join fans using (node, depth)
  join placed above on above.conv_id = nodes.node and above.depth <= nodes.depth
  group by above.node, above.depth)
select node as conv_id, depth::bigint as depth, parent as parent_conv_id, n_convs,
  coalesce(n_children, 0) as n_children, n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256
from nodes join subtrees using (node, depth) left join parents using (node, depth) left join fans using (node, depth)
"""

_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
_STEPS = range(1, len(filter_audit.FILTERS) + 1)
_FAILS = {
    "A": f"words < {filter_audit.LEAST_WORDS}",
    "B": f"100 * distinct_words < {filter_audit.LEAST_DISTINCT} * words",
    "C": f"100 * capitals > {filter_audit.MOST_CAPITALS} * length(text)",
    "D": f"regexp_matches(text, '{filter_audit.SIGNS}')",
    "E": "coalesce(doc_id > first_id, false)",
}
_AUDIT = f"""
with counted as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
measured as (
  select *, len({_WORDS}) as words, list_unique({_WORDS}) as distinct_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as capitals,
    min(doc_id) over (partition by text) as first_id
  from counted),
marked as (
  select doc_id, part, {", ".join(f"{test} as {name}" for name, test in _FAILS.items())} from measured),
flags as (
  select part, {", ".join(_FAILS)}, coalesce(max_quality = 1, false) as good, coalesce(max_toxic = 1, false) as toxic
  from marked left join (select doc_id, max(quality) as max_quality, max(toxic) as max_toxic from labels group by 1)
    using (doc_id)),
letters as (select unnest(split('{filter_audit.FILTERS}', '')) as l),
orders as (
  select l1.l || l2.l || l3.l || l4.l || l5.l as filter_order
  from letters l1 join letters l2 on l2.l <> l1.l join letters l3 on l3.l not in (l1.l, l2.l)
  join letters l4 on l4.l not in (l1.l, l2.l, l3.l) join letters l5 on l5.l not in (l1.l, l2.l, l3.l, l4.l)),
kinds as (
  select part, {", ".join(_FAILS)}, count(*) as held, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from flags group by all),
stepped as (
  select *, least({", ".join(f"case when {name} then strpos(filter_order, '{name}') else 6 end" for name in _FAILS)}) as out
  from kinds, orders),
cells as (
  select *, substr(filter_order, step, 1) as letter,
    case letter {" ".join(f"when '{name}' then {name}" for name in _FAILS)} end as failing,
    ({" + ".join(f"{name}::int" for name in _FAILS)}) as failed
  from stepped, (select unnest([{", ".join(map(str, _STEPS))}]) as step)),
steps as (
  select part, filter_order, step, letter,
    coalesce(sum(held) filter (out > step), 0) as kept,
    coalesce(sum(held) filter (out = step), 0) as removed,
    coalesce(sum(held) filter (failing and out < step), 0) as redundant,
    coalesce(sum(held) filter (failing and failed = 1), 0) as unique_fails,
    coalesce(sum(good) filter (out = step), 0) as good_lost,
    coalesce(sum(toxic) filter (out = step), 0) as toxic_lost
  from cells group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
  redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley
from steps
"""

ORACLES: dict[str, str] = {"op4_mixing": _MIXING, "op12_prefix_trie": _TRIE, "op13_filter_audit": _AUDIT}
