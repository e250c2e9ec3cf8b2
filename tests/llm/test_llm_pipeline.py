"""The pipeline stage by stage against brute force, on a small corpus with planted cases."""

import collections
import random

import pytest
from pyspark.sql import functions

import corpus_pipeline
from fieldaudit.llm import packing, tokens
from fieldaudit.session import ship
from test_llm_operators import brute_components, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    ship(spark)
    rng = random.Random(8)
    item = " ".join(f"item{rng.randrange(9999)}" for _ in range(30))
    rows, labels, leaks = [], [], set()
    for i in range(600):
        kind = rng.random()
        w = words(rng, rng.randrange(30, 90), 900).split(" ")
        good, toxic = int(kind > 0.2), int(0.2 < kind < 0.35)
        if not good:
            w = [x.upper() + "!!" for x in w]
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["grumbel", "snark", "flop", "wretchy"])
        if kind > 0.9:
            w[4:4] = item.split(" ")
            leaks.add(i)
        rows.append((i, " ".join(w), good, toxic))
    for i in range(600, 660):  # exact and near copies of clean documents
        old = rng.choice([r for r in rows if r[2] and not r[3] and r[0] not in leaks])
        rows.append((i, old[1] + (" tail" if i % 2 else ""), 1, 0))
    labels = [(r[0], r[2], r[3]) for r in rows if r[0] % 4]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, None, "s", len(t)) for i, t, _, _ in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, leaks


def test_stages(spark, corpus):
    folder, rows, leaks = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_copies", "decontamination", "packing"]
    kept = set(text)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        now = {r["doc_id"] for r in docs.collect()}
        if name == "quality":
            want = {r[0] for r in rows if r[2]}
            assert len(now ^ want) <= 3
        elif name == "toxicity":
            want = {r[0] for r in rows if r[0] in kept and not r[3]}
            assert len(now ^ want) <= 20 and not want - now
        elif name == "near_copies":
            parts = brute_components([(i, text[i]) for i in sorted(kept)], 5, 80, 100)
            assert now == {i for i, (_, c) in parts.items() if c == i}
            assert len(kept) - len(now) > 20
        else:
            assert now == kept - leaks
        kept = now
    # the last stage packs exactly the documents that are left
    path = tokens.vocabulary("byte_bpe_50k.json")
    packed = packing.pack(docs, path).collect()
    sizes = collections.Counter()
    for r in packed:
        sizes[r["doc_id"]] += r["length"]
    enc = tokens.WordEncoder(path)
    assert sizes == {i: len(enc._plain([text[i]])[0]) // 4 + 1 for i in kept}


def test_run_equals_the_stages(spark, corpus):
    folder, rows, leaks = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in got}
    assert ids and not ids & leaks
    assert len(ids & {r[0] for r in rows if not r[2]}) <= 3
    assert all(r["offset"] + r["length"] <= 1024 for r in got)


def test_stages_on_nulls_repeats_and_odd_columns(spark, corpus):
    folder, rows, leaks = corpus
    leak, clean = next(r for r in rows if r[0] in leaks), next(r for r in rows if r[2] and not r[3] and r[0] not in leaks)
    odd = [(None, leak[1], 1.0), (5, leak[1], 2.0), (5, clean[1], 3.0), (5, clean[1], 3.0), (None, clean[1], 4.0), (6, None, 5.0), (None, None, 6.0), (7, "", 7.0)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, _score double").withColumn("a.b", functions.lit("x"))
    docs = docs.withColumn("_text", functions.lit(1)).withColumn("_GONE", functions.lit(2))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        left[name] = sorted(r["_score"] for r in out.collect())
        assert stage(spark, docs.limit(0), folder).collect() == []
    assert left["decontamination"] == [3.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    assert set(left["near_copies"]) >= {1.0, 4.0, 5.0, 6.0, 7.0}
