"""Token counts, the conversation trie and the filter audit against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import common, filter_audit, prefix_trie, queries, token_counts, token_shards

SMALL = "/root/testdata/sf0.01"
MODEL = token_shards.public_tokenizer()
LIBRARY = Tokenizer.from_str(MODEL)


# --- token counts


def library_count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = queries.op11_token_counts(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]]
        n = library_count(text)
        assert tuple(row) == (row["doc_id"], len(text.encode()), n, n > 512)


def test_counts_of_odd_rows(spark):
    texts = [None, "", " ", "\n \t\n", "a<|endoftext|>b<|endoftext|>", "it's 'S  \x1c\x85x", "é天 地 \U0001f600 ١٢", "a" * 70_000]
    rows = [(i, text, 9) for i, text in enumerate(texts)] + [(None, "a b", 1), (1, "again", 1), (1, "again", 1)]
    counted = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id int, text string, n_tokens int"))
    assert counted.schema.simpleString() == "struct<doc_id:bigint,n_bytes:bigint,n_tokens:bigint,over_limit:boolean>"
    expected = [(i, len((t or "").encode()), library_count(t or ""), library_count(t or "") > 512) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, counted.collect()))) == sorted(map(str, expected))
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("span", [30, 1_000_000])
def test_counts_of_random_texts(monkeypatch, span):
    monkeypatch.setattr(token_counts, "SLICE", span)
    counter, draw = token_counts.Counter(MODEL), random.Random(4)
    parts = [*"ab 'sS\n\t\r .,1-٣é天\x1c\x85", "<|endoftext|>", "'ll", "  ", "the", " and", " house", "aaaa"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(200))) for _ in range(1500)]
    assert counter.count(texts) == [library_count(text) for text in texts]


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "天地人"])
def test_long_words_by_both_ways(letters):
    counter, draw = token_counts.Counter(MODEL), random.Random(5)
    for length in (1, 2, 3, 50, 3_000):
        word = "".join(draw.choice(letters) for _ in range(length))
        expected = library_count(word)
        assert token_counts.merged_size(word.encode(), counter.merges) == expected
        assert token_counts.merged_sizes([word.encode()] * 2, counter.merges).tolist() == [expected] * 2


def test_characters_cut_without_the_library():
    """Every character that the pattern may meet is cut as the vocabulary's library cuts it."""
    agreed = [chr(n) for n in range(0x110000) if not 0xD800 <= n < 0xE000 and not token_counts._ODD.search(chr(n))]
    assert len(agreed) > 30_000
    for c in agreed:
        text = f"a{c}b 1{c}2 .{c}. {c}{c}  {c}\n{c} '{c}s"
        cut = [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
        assert cut == token_counts._PRE_TOKEN.findall(text), hex(ord(c))


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        token_counts.Counter(file.read())
    letters = {letter: n for n, letter in enumerate(token_counts.byte_letters())}
    with pytest.raises(ValueError):  # "ab" joins before it is made
        token_counts.Merges({**letters, "ab": 256, "abc": 257}, [("ab", "c"), ("a", "b")])


# --- trie of conversations


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(
            key=lambda t: (
                t[0] is not None,
                t[0] or 0,
                t[1],
                hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest(),
            )
        )
    sequences = {}
    for conv in own:
        shared = zlib.crc32(str(conv).encode()) % 9
        base = conv - int(np.fmod(conv, 5))
        sequences[conv] = tuple((r, t) for _, r, t in own.get(base, [])[:shared] + own[conv][shared:])
    members = defaultdict(list)
    for conv in sorted(sequences):
        for depth in range(len(sequences[conv]) + 1):
            members[sequences[conv][:depth]].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    found, below = {}, {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below[node] = (
            sum(below[child][0] for child in children[node]) or 1,
            saved + sum(below[child][1] for child in children[node]),
        )
        ends = ",".join(str(c) for c in members[node] if len(sequences[c]) == len(node))
        found[members[node][0], len(node)] = (
            members[node[:-1]][0] if node else None,
            len(members[node]),
            len(children[node]),
            *below[node],
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return found


def spark_trie(conversations):
    rows = prefix_trie.trie(conversations).collect()
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_trie_of_the_given_conversations(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in queries.op12_prefix_trie(spark, SMALL).collect()}
    assert found == plain_trie(map(tuple, rows.collect()))


@pytest.mark.parametrize("lengths", [[1], [1, 2, 3, 9], [1, 5, 17, 40]])
def test_trie_of_odd_rows(spark, lengths):
    """Nulls, equal turn numbers, repeated rows, negative ids, absent bases, long sequences."""
    draw = random.Random(len(lengths))
    rows = []
    for conv in [None, *range(-7, 40)]:
        for turn in range(draw.choice(lengths) if conv != 5 else 0):
            texts = ["a", "a", "a", "é" if conv and conv > 20 else "a", None]
            rows.append((conv, draw.choice([turn, turn, None]), draw.choice(["u", "u", None]), draw.choice(texts), 1, "x"))
    schema = "conv_id long, turn int, role string, text string, anchor int, whole string"
    assert spark_trie(spark.createDataFrame(rows, schema).repartition(5)) == plain_trie([r[:4] for r in rows])


def test_trie_of_one_long_conversation_over_ranges(spark):
    rows = [(10, turn, "user", f"t{turn % 3}") for turn in range(700)] + [(11, turn, "user", f"t{turn % 3}") for turn in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, runs = prefix_trie.numbered_turns(frame)
        assert runs.filter("conv_id = 10").count() > 1
        assert spark_trie(frame) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0


# --- filter audit


def plain_audit(docs, labels):
    """``docs`` of (doc_id, text, source), ``labels`` of (doc_id, quality, toxic)."""
    marks = defaultdict(lambda: [0, 0])
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            marks[doc_id] = [max(marks[doc_id][0], quality or 0), max(marks[doc_id][1], toxic or 0)]
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    by_part = defaultdict(list)
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > least[text],
        }
        good, toxic = marks[doc_id] if doc_id in marks else (0, 0)
        by_part[source or ""].append(({f for f, failed in fails.items() if failed}, good == 1, toxic == 1))
    found = {}
    for part, rows in by_part.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [row for row in left if f in row[0]]
                left = [row for row in left if f not in row[0]]
                total[f] += len(gone)
                failing = sum(f in row[0] for row in rows)
                found[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    failing - len(gone),
                    sum(row[0] == {f} for row in rows),
                    sum(row[1] for row in gone),
                    sum(row[2] for row in gone),
                ]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                found[part, "".join(order), step].append(total[f])
    return found


def spark_audit(frame):
    rows = frame.collect()
    found = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    assert spark_audit(queries.op13_filter_audit(spark, SMALL)) == plain_audit(docs, labels)


def test_audit_of_odd_rows(spark):
    draw = random.Random(6)
    texts = [None, "", " ", "A", "a b", "a$", " ".join(map(str, range(60))), "w " * 60, "w " * 60 + "|", "é" * 19 + "A", "x " * 40_000]
    docs = [
        (draw.choice([None, *range(25)]), draw.choice(texts), draw.choice([None, "", "s", "t"]), 1, "m") for _ in range(120)
    ]
    labels = [(draw.choice([None, *range(25)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(30)]
    frame = spark.createDataFrame(docs, "doc_id int, text string, source string, part int, mask string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert spark_audit(filter_audit.interactions(frame, marks)) == plain_audit([d[:3] for d in docs], labels)
    assert filter_audit.interactions(frame.limit(0), marks).count() == 0
    assert spark_audit(filter_audit.interactions(frame, marks.limit(0))) == plain_audit([d[:3] for d in docs], [])


def test_audit_reads_texts_once_and_writes_nothing(spark, monkeypatch):
    def written(*_):
        raise AssertionError("an intermediate table")

    monkeypatch.setattr(common, "scratch_folder", written)
    found = queries.op13_filter_audit(spark, SMALL)
    assert found.count() > 0
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # documents and labels
    assert plan.count("FileScan") == 2


def test_audit_of_many_rows_without_ids(spark):
    docs = [(None, f"text {n % 40}", None if n % 3 else "s") for n in range(400)]
    docs += [(n, f"text {n}", "s") for n in range(0, 40, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = [(None, 1, 1), (0, 1, 0), (2, 0, 1), (2, 1, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert spark_audit(filter_audit.interactions(frame, marks)) == plain_audit(docs, labels)


def test_removal_steps_are_the_first_failed_filter():
    by_step, fails = filter_audit.orders(), filter_audit.failures()
    steps = filter_audit.removal_steps(fails, filter_audit.places(by_step))
    for mask in range(32):
        for number, order in enumerate(by_step):
            failed = [step for step, f in enumerate(order, 1) if mask >> f & 1]
            assert steps[mask, number] == min(failed, default=6)
