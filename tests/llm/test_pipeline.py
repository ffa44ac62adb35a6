"""The pipeline behind the trained classifier against brute force."""

import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F
from test_texts import plain_best_or_whole, plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from tallyspark.llm import decontam, mixing, quality, queries, token_shards

GIVEN = "/root/testdata/sf0.001"


def plain_leak(text, items):
    words = decontam.words_of(text)
    shingles = {width: set(decontam.counted(words, width)) for width in range(1, 6)}
    for item in items:
        wanted = decontam.words_of(item)
        width = min(5, len(wanted))
        if not shingles[width].isdisjoint(decontam.counted(wanted, width)):
            if plain_best_or_whole(text, item) >= 0.8:
                return True
    return False


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{GIVEN}/benchmark.parquet").collect()]
    short = [(10_000 + i, " ".join(item.split()[:-2])) for i, item in enumerate(items)]
    planted = spark.createDataFrame(short, "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length("text").alias("n_chars")
    )
    both = docs.unionByName(planted.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{GIVEN}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    good = quality.keep_good(both, spark.read.parquet(f"{tmp_path}/labels.parquet")).toPandas()
    prints = {int(i): plain_fingerprint(t) for i, t in zip(good["doc_id"], good["text"], strict=True)}
    first = good[good["doc_id"].isin(set(plain_components(prints).values()))]
    leaks = first["text"].map(lambda text: plain_leak(text, items))
    assert (first["doc_id"][leaks] >= 10_000).any()
    documents = first[~leaks]
    capacity = f"sum(tokens) * {mixing.EPOCHS} as capacity"
    with duckdb.connect() as db:
        db.register("documents", documents)
        mixed = db.execute(queries.ORACLES["op4_mixing"].replace(capacity, "sum(tokens) as capacity")).df()
    texts = documents.set_index("doc_id")["text"]
    model = Tokenizer.from_str(token_shards.public_tokenizer())
    expected, start = [], 0
    for doc_id in sorted(mixed["doc_id"]):
        ids = [*model.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == expected


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, empty and very long texts, extra and clashing columns."""
    good = spark.read.parquet(f"{GIVEN}/documents.parquet").filter("doc_id < 40")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", "en", "s1", 0), (7_001, "", None, "s1", 0)]
        + [(7_002, "one more text, quite short.", "en", None, 5)] * 3
        + [(7_003, "A long text goes on, and on it goes. " * 20_000, "en", "s9", 9)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    typed = odd.select([F.col(c).cast(good.schema[c].dataType) for c in good.columns])
    docs = good.unionByName(typed)
    for name in ("__row_hash", "row_hash", "fp", "root", "label", "words", "bucket", "order", "budget", "row"):
        docs = docs.withColumn(name, F.lit(name))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{GIVEN}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for count in (docs.count(), 0):
        rows = docs.limit(count)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, rows, str(tmp_path))
            assert kept.columns == docs.columns
            found = kept.collect()
            assert not Counter(found) - Counter(rows.collect())
            rows = spark.createDataFrame(found, docs.schema)
        written = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
        assert written.count() == rows.count()


def test_shapes_are_hashed_whole():
    assert quality.shape("Hello,") == "Aa,"
    long = "a1" * 40
    assert quality.shape(long + "X") != quality.shape(long + "y9")


def test_repeated_ids_are_one_training_row(spark):
    rows = [(n, f"good words {n} here", 1) if n % 2 else (n, f"bad stuff {n} there", 0) for n in range(60)]
    labels = spark.createDataFrame([(n, q) for n, _, q in rows], "doc_id long, quality int")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    repeated = docs.unionByName(docs.filter("doc_id = 4")).unionByName(spark.createDataFrame([(4, "bad z")] * 50, docs.schema))
    one, two = (quality.fit(frame, labels) for frame in (docs, repeated))
    assert np.array_equal(one.weights, two.weights) and one.intercept == two.intercept
