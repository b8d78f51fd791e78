import math
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstrata.catalog import views
from quillstrata.functions.text import word_ngrams
from quillstrata.operators.classifier import TextLabelModel
from quillstrata.operators.features import tfidf_weights, vocabulary_topk
from quillstrata.plans.jobs import leakage_experiment, prepare_corpus, train_and_evaluate
from quillstrata.schema import RECORD_SCHEMA
from quillstrata.sources.records import read_sft_jsonl
from quillstrata.streaming.rowwise import stream_chat, stream_records

TOPICS = {"order": ["parcel", "track", "shipping", "late"], "refund": ["money", "back", "charge", "bill"]}


def corpus(spark, n=60):
    rows = []
    for i in range(n):
        category = ["order", "refund"][i % 2]
        words = TOPICS[category]
        intent = f"{category}_{i % 4 // 2}"
        text = f"{words[i % 4]} {words[(i + 1) % 4]} {intent[-1] * 3} number{i} item{i * 7} today{i * 3}"
        rows.append((i, "B", text, category, intent, f"Answer {i} for mail{i}@test.org"))
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def test_prepare_corpus_writes_everything(spark, tmp_path):
    out = str(tmp_path)
    audit = prepare_corpus(corpus(spark), out, eval_rows=3, validate=True, sanitize=True, normalize=True).first()
    assert audit.train_rows + audit.val_rows + audit.test_rows == 60 and audit.is_leakage_free
    assert (audit.train_rows, audit.val_rows) == (48, 6)
    splits = spark.read.parquet(f"{out}/splits")
    assert splits.count() == 60 and splits.where("response like '%@%'").count() == 0
    assert read_sft_jsonl(spark, f"{out}/sft").count() == 60
    assert spark.read.parquet(f"{out}/test_eval_3").count() == 3
    assert read_sft_jsonl(spark, f"{out}/test_eval_3_sft").count() == 3
    assert Path(f"{out}/quarantine").exists()
    again = prepare_corpus(corpus(spark).repartition(5)).first()
    assert again == prepare_corpus(corpus(spark)).first()


def test_weights_match_a_plain_computation(spark):
    texts = {1: "red fox red", 2: "red hen", 3: "blue hen hen fox", 4: "x"}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    vocabulary = [r.term for r in vocabulary_topk(df, word_ngrams("t"), 5).collect()]
    grams = {}
    for i, t in texts.items():
        words = [w for w in t.split() if len(w) > 1]
        grams[i] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    total = sum(grams.values(), Counter())
    assert vocabulary == sorted(total, key=lambda w: (-total[w], w))[:5]
    idf = {w: math.log(5 / (1 + sum(w in g for g in grams.values()))) + 1 for w in vocabulary}
    got = {(r.id, r.term): r.weight for r in tfidf_weights(df, word_ngrams("t"), "id", 5).collect()}
    for i, g in grams.items():
        raw = {w: g[w] * idf[w] for w in vocabulary if g[w]}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for w, v in raw.items():
            assert abs(got.pop((i, w)) - v / norm) < 1e-12
    assert got == {}


def test_classifier_learns_saves_and_loads(spark, tmp_path):
    df = corpus(spark, 40).withColumn("split", F.when(F.col("record_id") < 32, "train").otherwise("test"))
    path = str(tmp_path / "m")
    model, scores = train_and_evaluate(df, path, max_word_features=100, max_char_features=300, max_iter=30)
    by_target = {r.target: r for r in scores.collect()}
    assert by_target["category"].accuracy == 1.0 and by_target["intent"].samples == 8
    test = df.where("split = 'test'")
    columns = ["record_id", "predicted_category", "predicted_intent"]
    before = sorted(model.predict(test).select(columns).collect())
    assert before == sorted(TextLabelModel.load(path).predict(test).select(columns).collect())
    with pytest.raises(ValueError):
        TextLabelModel().predict(test)
    with pytest.raises(ValueError):
        TextLabelModel().save(path)


def test_sources_are_intents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    intents = {(r.record_id, r.intent) for r in views.corpus(spark, sf_dir).collect()}
    assert intents == {(r.doc_id, r.source) for r in documents.select("doc_id", "source").collect()}


def test_leakage_experiment_compares_two_splits(spark):
    df = corpus(spark, 24).withColumn("split", F.when(F.col("record_id") < 16, "train").otherwise("test"))
    options = dict(max_word_features=50, max_char_features=50, max_iter=5)
    rows = leakage_experiment(df, df, **options).collect()
    assert {(r.kind, r.target) for r in rows} == {(k, t) for k in ("grouped", "naive") for t in ("intent", "category")}


def test_stream_of_records(spark, tmp_path):
    source = str(tmp_path / "in")
    bad = spark.createDataFrame([(99, "B", "hi there", "C", "i", "x")], RECORD_SCHEMA)
    corpus(spark, 10).union(bad.withColumn("category", F.lit("CC")).withColumn("intent", F.lit("ii"))).write.parquet(source)
    query = stream_chat(stream_records(spark, source), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    chats = read_sft_jsonl(spark, str(tmp_path / "out"))
    assert chats.count() == 10
    assert chats.where("messages[2].content like '%@%'").count() == 0
    quarantined = spark.read.json(str(tmp_path / "bad"))
    assert [r.row_index for r in quarantined.collect()] == [99]
