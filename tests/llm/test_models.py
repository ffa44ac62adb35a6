"""Classifier, toxicity, mixing, top-k, token shards and the pipeline against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import common, mixing, quality, queries, token_shards, topk, toxicity

SMALL = "/root/testdata/sf0.01"


def accuracy(frame, labels, column):
    joined = frame.join(labels.select("doc_id", column), "doc_id").filter("held_out")
    return joined.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scored = queries.op7_quality(spark, SMALL)
    assert scored.count() == 1000 and accuracy(scored, labels, "quality") > 0.97
    folds = {r["doc_id"]: r["held_out"] for r in scored.collect()}
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) for i, held in folds.items())


def test_quality_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "x y", 0), (4, "a b c", 0), (4, "a b c", 0), (5, "w " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None), (4, 0)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 6
    assert quality.keep_good(docs, labels).columns == docs.columns
    nothing = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = queries.op2_toxicity(spark, "/root/testdata/sf0.1").cache()
    assert accuracy(scored, labels, "toxic") > 0.96
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0


def test_block_max_index_is_exact():
    draw = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        terms = draw.choice(40, size=draw.integers(1, 8), replace=False)
        weights = draw.random(len(terms)) + 0.1
        weights /= np.sqrt((weights**2).sum())
        vectors.append(dict(zip(terms.tolist(), weights.tolist(), strict=True)))
    index = toxicity.BlockMaxIndex(vectors, 40)
    for query in vectors[:60]:
        cosines = [round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12) for v in vectors]
        expected = sorted(((-c, i) for i, c in enumerate(cosines) if c > 0))[:16]
        found = index.nearest(query, 16)
        assert np.allclose([c for c, _ in found], [-c for c, _ in expected], atol=1e-9)


def test_postings_of_neighbouring_cells_are_one_run(monkeypatch):
    # term 0 is in every block, its neighbour term 1 too, term 2 in every third example
    vectors = [{0: 0.5, 1: 0.25, **({2: 0.75} if n % 3 == 0 else {})} for n in range(4 * toxicity.BLOCK + 5)]
    index = toxicity.BlockMaxIndex(vectors, 4)
    runs = []

    def spread(lows, sizes):
        runs.append(len(sizes))
        return common.spread(lows, sizes)

    cells = np.arange(len(index.cell_at))
    monkeypatch.setattr(toxicity, "spread", spread)
    values = np.repeat([1.0, 2.0, 3.0], np.diff(index.term_at)[:3])
    sums = index._sums(cells, values)
    assert runs == [3]
    assert np.array_equal(sums, [v[0] + 2 * v[1] + 3 * v.get(2, 0) for v in vectors])
    # cells apart are runs of their own, and cells left out add nothing
    some = cells[[0, 1, 3, 6, 12]]
    sums = index._sums(some, values[some])
    assert runs == [3, 4]
    block = np.arange(len(vectors)) // toxicity.BLOCK
    weights = {0: [(0, 1.0)], 1: [(0, 1.0), (1, 2.0)], 2: [(2, 3.0)], 3: [(0, 1.0)], 4: []}
    assert np.array_equal(sums, [sum(w * v.get(t, 0) for t, w in weights[b]) for v, b in zip(vectors, block, strict=True)])


def test_postings_are_summed_once_for_a_text(monkeypatch):
    draw = random.Random(4)
    vectors = [{t: draw.random() for t in draw.sample(range(60), 12)} for _ in range(700)]
    # blocks of another language, which the floor of the cosines leaves out
    vectors += [{t: draw.random() for t in draw.sample(range(58, 300), 12)} for _ in range(1400)]
    index = toxicity.BlockMaxIndex(vectors, 400)
    sums, summed = index._sums, []
    monkeypatch.setattr(index, "_sums", lambda cells, values: summed.append(len(cells)) or sums(cells, values))
    for k in (1, 16, 17, 18, 900, 3000):
        for _ in range(20):
            vector = {t: draw.random() for t in draw.sample(range(60), 9)} | {399: 1.0}
            cosines = [round(sum(w * v.get(t, 0) for t, w in sorted(vector.items())), 12) for v in vectors]
            best = sorted(((-c, n) for n, c in enumerate(cosines) if c > 0))[:k]
            found = index.nearest(dict(sorted(vector.items())), k)
            assert [n for _, n in found] == [n for _, n in best]
            assert [c for c, _ in found] == pytest.approx([-c for c, _ in best], abs=2e-12)
    assert len(summed) == 120


def test_a_word_is_looked_up_once():
    class Terms(dict):
        lookups = 0

        def __contains__(self, word):
            self.lookups += 1
            return super().__contains__(word)

        def __getitem__(self, word):
            self.lookups += 1
            return super().__getitem__(word)

        def get(self, word, default=None):
            self.lookups += 1
            return super().get(word, default)

    terms = Terms(a=0, b=1, c=2)
    at, counts = toxicity.counted("c a x, C a\ny c", terms)
    assert (at.tolist(), counts.tolist()) == ([0, 2], [2, 3])
    assert terms.lookups == 7
    assert [len(side) for side in toxicity.counted(None, terms)] == [0, 0]


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 4
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def plain_toxicity(docs, labels):
    """Neighbours and votes of every document, straight from the definitions."""
    examples = sorted(
        (d, t or "", max(y for e, y in labels if e == d and y is not None))
        for d, t in docs
        if zlib.crc32(str(d).encode()) % 4 != 2 and any(e == d and y is not None for e, y in labels)
    )
    words = {d: Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for d, t in docs}
    held = Counter(w for d, _ in docs for w in words[d])
    rate = sum(y for *_, y in examples) / len(examples)
    by_text = {}
    for d, t, y in examples:
        by_text[t] = d, max(y, by_text.get(t, (0, 0))[1])
    weight = {}
    for word in {w for d, *_ in examples for w in words[d]}:
        having = [y for d, y in by_text.values() if word in words[d]]
        excess = (sum(having) - len(having) * rate) / (len(having) * rate * (1 - rate) + 1) ** 0.5
        idf = math.log((1 + len(docs)) / (1 + held[word])) + 1e-3
        weight[word] = idf * (1 + max(0.0, excess) ** 2)

    def unit(d):
        raw = {w: (1 + math.log(n)) * weight[w] for w, n in words[d].items() if w in weight}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()} if norm else {}

    vectors = {d: unit(d) for d, *_ in examples}
    near = {}
    for d, _ in docs:
        mine = unit(d)
        cosines = ((sum(x * v.get(w, 0.0) for w, x in mine.items()), e) for e, v in vectors.items())
        near[d] = sorted(((c, e) for c, e in cosines if c > 1e-12), reverse=True)[:17]
    return near, rate


def test_toxicity_neighbours_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    copy = docs.join(labels.filter("toxic = 1"), "doc_id").orderBy("doc_id").first()
    planted = spark.createDataFrame([(90_001, copy["text"])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(planted)
    rows = toxicity.score(both, labels).collect()
    near, _ = plain_toxicity(
        [tuple(r) for r in both.collect()], [tuple(r) for r in labels.select("doc_id", "toxic").collect()]
    )
    assert len(rows) == len(near) and len({r["score"] for r in rows}) > 50
    for row in rows:
        expected = near[row["doc_id"]]
        assert np.allclose([e["cosine"] for e in row["evidence"]], [c for c, _ in expected[:16]], atol=1e-9)
        clear = {e for c, e in expected[:16] if len(expected) < 17 or c > expected[16][0] + 1e-9}
        assert clear <= {e["doc_id"] for e in row["evidence"]}
    (found,) = (r for r in rows if r["doc_id"] == 90_001)
    assert found["predicted"] == 1 and abs(found["evidence"][0]["cosine"] - 1) < 1e-9


def test_toxicity_of_repeated_long_and_clashing_rows(spark):
    rude, kind = "you idiot go away", "thank you so much"
    known = [(i, (rude if i % 3 == 0 else kind) + f" w{i}", 0.5, "l") for i in range(60)]
    odd = [(100, rude, 0.1, "x"), (100, rude, 0.1, "x"), (101, f"{kind} " * 60_000, 0.2, "y"), (None, None, None, None)]
    docs = spark.createDataFrame(known + odd, "doc_id int, text string, score double, label string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(60)] * 2, "doc_id long, toxic int, text int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 64
    by_id = {r["doc_id"]: r for r in rows}
    assert [r["predicted"] for r in rows if r["doc_id"] == 100] == [1, 1]
    assert by_id[101]["predicted"] == 0 and by_id[None]["evidence"] == []


# --- mixing


def fill(budget, children):
    """{name: share} by pouring: children are (name, weight, capacity)."""
    given = {}
    open_ = [c for c in children if c[1] > 0]
    while open_:
        level = budget / sum(w for _, w, _ in open_)
        full = [c for c in open_ if c[2] / c[1] <= level]
        if not full:
            given.update({name: min(cap, int(w * level)) for name, w, cap in open_})
            break
        for name, _, cap in full:
            given[name] = cap
            budget -= cap
        open_ = [c for c in open_ if c not in full]
    return given


@pytest.mark.parametrize("epochs", [1, 2])
def test_leaf_budgets_equal_pouring(spark, epochs):
    draw = random.Random(epochs)
    leaves = [
        (f"d{d}", lang, f"s{s}", 10, draw.choice((0, 5, 700, 5000, 90_000)))
        for d in range(4)
        for lang in ("en", "de", "fr", "es", None)
        for s in range(3)
    ]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, rows long, tokens long")
    found = {r[:3]: r["budget"] for r in mixing.leaf_budgets(frame, (3, 5), epochs).select(
        "domain", "lang", "source", "budget").collect()}

    def weight(level, name):
        return mixing.WEIGHTS.get((level, name), mixing.DEFAULT_WEIGHT)

    expected = {}

    def descend(prefix, rows, budget):
        depth = len(prefix)
        if depth == 3:
            if budget > 0:
                expected[prefix] = budget
            return
        names = {r[depth] for r in rows}
        children = [
            (n, weight(mixing.LEVELS[depth], n), epochs * sum(r[4] for r in rows if r[depth] == n)) for n in names
        ]
        for name, share in fill(budget, children).items():
            descend((*prefix, name), [r for r in rows if r[depth] == name], share)

    descend((), leaves, sum(r[4] for r in leaves) * 3 // 5)
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) <= 1 for k in found)


def test_mixing_equals_duckdb(spark):
    found = queries.op4_mixing(spark, SMALL).toPandas()
    names = list(found.columns)
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
        expected = db.execute(queries.ORACLES["op4_mixing"]).df()[names]
    key = ["doc_id", "epoch"]
    assert found.sort_values(key).values.tolist() == expected.sort_values(key).values.tolist()


def test_mixing_odd_rows(spark):
    rows = [(1, "a b c", "en", None), (1, "a b c", "en", None), (None, None, None, "x"), (3, "", "de", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn(
        "words", F.lit("clash")
    )
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() <= 8
    assert mixing.mix(docs.limit(0)).count() == 0


# --- top-k


def test_topk_equals_brute_force(spark):
    draw = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in draw.normal(size=16) * draw.choice((0.1, 1, 5))]) for i in range(3000)]
    vectors += [(3000 + i, vectors[7][1]) for i in range(1500)]
    odd = [(9000, None), (9001, [1.0, None] * 8), (9002, [float("nan")] * 16), (9003, [float("inf")] * 16)]
    odd += [(None, [1.0] * 16), (9050, [0.0] * 16), (9100, [1.0, 2.0])]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    found = topk.top_k(frame).toPandas()
    vectors.append((9050, [0.0] * 16))
    ids = np.array([i for i, _ in vectors])
    matrix = np.floor(np.array([v for _, v in vectors]) * 256).astype(np.int64)
    for at in np.flatnonzero(ids % 50 == 0):
        scores = matrix @ matrix[at]
        order = [i for i in np.lexsort((ids, -scores)) if i != at][:5]
        mine = found[found["query_id"] == ids[at]].sort_values("rank")
        assert mine["vec_id"].tolist() == ids[order].tolist()
        assert mine["score"].tolist() == scores[order].tolist()
    assert topk.top_k(frame.limit(0)).count() == 0


def test_topk_of_negative_coordinates_equals_brute_force(spark):
    draw = np.random.default_rng(6)
    matrix = draw.normal(size=(4000, 16))
    matrix *= 1.2 / np.linalg.norm(matrix, axis=1)[:, None]  # the longest lie in all directions
    matrix[1200:] *= draw.choice((0.02, 0.2, 0.4), (2800, 1))
    matrix[np.arange(1200, 4000), draw.integers(0, 16, 2800)] = -0.95
    matrix[2001::50] = matrix[2000::50]  # copies of queries
    matrix[3000:3040] = -np.eye(16)[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    whole, ids = np.floor(matrix * 256).astype(np.int64), np.arange(4000)
    for at in range(0, 4000, 50):
        scores = whole @ whole[at]
        order = [i for i in np.lexsort((ids, -scores)) if i != at][:5]
        mine = found[found["query_id"] == at].sort_values("rank")
        assert mine["vec_id"].tolist() == order and mine["score"].tolist() == scores[order].tolist()


def test_pruning_keeps_what_reaches_the_score():
    draw = np.random.default_rng(7)
    matrix = np.concatenate([draw.normal(size=(3000, 4)), -np.eye(4)])
    matrix[:2000, 0] = -np.abs(matrix[:2000, 0]) * 8
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    for v in (*unit[:40], *unit[-4:], *-unit[:20]):
        for least in (0.5, 0.6, 0.8, 0.99, 1.0):
            kept = topk.candidates(v, 1.0, least, unit, np.ones(len(unit)))
            assert set(np.flatnonzero(unit @ v >= least + 1e-12)) <= set(kept)
            same = np.flatnonzero((unit == v).all(axis=1))
            assert set(same) <= set(kept)


# --- token shards


def test_perfect_hash_is_minimal_and_knows_its_keys(tmp_path):
    draw = np.random.default_rng(1)
    docs = np.unique(draw.integers(-(2**62), 2**62, 20_000))
    ordinals = draw.integers(0, 3, len(docs))
    hashed = token_shards.PerfectHash.of(docs, ordinals)
    assert sorted(hashed.slots(docs, ordinals)) == list(range(len(docs)))
    place = np.arange(len(docs))
    token_shards.write_index(str(tmp_path), 0, docs, ordinals, place % 7, place * 3, place)
    found = token_shards.lookup(str(tmp_path), 0, docs, ordinals)
    assert (found["first"] == place * 3).all() and (found["shard"] == place % 7).all()
    strangers = token_shards.lookup(str(tmp_path), 0, docs + 1, ordinals + 5)
    assert (strangers["shard"] == -1).mean() > 0.999


@pytest.mark.parametrize("remembered", [3, 1_000_000])
def test_encoder_equals_the_tokenizer(monkeypatch, remembered):
    monkeypatch.setattr(token_shards, "REMEMBERED_UNITS", remembered)
    monkeypatch.setattr(token_shards, "GATHERED_UNITS", 50)
    encoder = token_shards.Encoder(token_shards.public_tokenizer())
    pieces = ["a", "b é", " ", "  ", "\n", "\t", " \n", "\u3000", "\x85", "1'", "'s", "中文", "<|endoftext|>"]
    pieces += ["\0", "it's", "don't.", "9a", "a9", "ж", "ы.", "ß\r", "a\u0301", "ab.\nCd", "a\n\n", "🙂", "!", "..."]
    draw = random.Random(3)
    texts = ["".join(draw.choices(pieces, k=draw.randrange(12))) for _ in range(2000)]
    for first, some in token_shards._slices(pa.array(texts), 4000):
        ids, counts = encoder.encode(some)
        wanted = [[*encoder.whole(text).tolist(), 0] for text in texts[first : first + len(some)]]
        assert counts.tolist() == list(map(len, wanted))
        assert ids.tolist() == [one for row in wanted for one in row]


def test_token_shards_round_trip(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(token_shards.public_tokenizer())
    texts = [None, "", " ", "Hello  world", "a \n b\n\n  c", "x" * 5000, "it's é ü　 z   y", "a   b", "\t a"]
    texts += [" ".join(random.Random(i).choice(("the", "of,", "ing.\nA", "zü")) for _ in range(300)) for i in range(40)]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(5, "same"), (5, "same"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = token_shards.round_trip(docs).orderBy("start").collect()
    start = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in found] == [r[0] for r in order]
    for row, (_, text) in zip(found, order, strict=True):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_shards.round_trip(docs.limit(0)).count() == 0


def test_added_tokens_have_their_ids(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(token_shards.public_tokenizer())
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"word{end}{end}\nnext", f"  {end}  x", "<|endoftext |>", "<|endof", "text|> plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = token_shards.round_trip(docs).orderBy("start").collect()
    start = 0
    for row, text in zip(found, texts, strict=True):
        ids = [*model.encode(text, add_special_tokens=False).ids, 0]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert model.encode(texts[0], add_special_tokens=False).ids == [50256]


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, kept = docs.columns, docs
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001").cache()
        assert kept.columns == names
        assert kept.join(docs, names, "left_anti").count() == 0
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 50
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in kept.collect()}


# --- top-k of large components


def exact_top(rows, k=5):
    """(query, rank, vec_id, score) with Python's integers; rows of (vec_id, vector)."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    found = []
    for query, q in whole:
        if query % 50 == 0:
            scores = [
                (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), i)
                for i, v in whole
                if i != query and len(v) == len(q)
            ]
            found += [(query, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("scale", [1.0, 2.0**20, 1e7, 2.0**30, 1e14])
@pytest.mark.parametrize("block", [3, 4096])
def test_topk_is_exact_for_large_components(spark, monkeypatch, scale, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    draw = np.random.default_rng(11)
    rows = [(i, [float(x) for x in draw.normal(size=3) * scale * draw.choice((0.01, 1.0))]) for i in range(400)]
    rows += [(400 + i, [rows[0][1][0], rows[0][1][1], rows[0][1][2] + i / 256]) for i in range(20)]
    odd = [(900, [1e300, 1.0, 1.0]), (901, None), (902, [2.0**55, 0.0, 0.0]), (903, [1.0, 2.0])]
    frame = spark.createDataFrame(
        [(*row, 7, "x") for row in rows + odd], "vec_id int, embedding array<double>, score int, query_id string"
    )
    found = topk.top_k(frame)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == exact_top(rows + [odd[3]])


def test_topk_of_repeated_rows_and_ids(spark):
    rows = [(i % 30 * 10, [1.0, float(i % 7)]) for i in range(60)] + [(50, [1.0, 3.0])] * 3
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 6 * 5 and all(r["vec_id"] != r["query_id"] for r in found)
