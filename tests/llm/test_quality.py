import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from frames import clashing, frame, hard_rows, words
from pyspark.sql import functions as F

from opswell.llm import quality


def test_chunks_cover_every_byte_and_every_place():
    texts = ["", None, "a", "b" * quality.CHUNK, "c" * (quality.CHUNK + 1), words(1, 5000), "é" * 4000]
    some, counts = quality.chunks(pa.array(texts, pa.string()))
    at = 0
    for t, n in zip(texts, counts):
        raw = (t or "").encode()
        seen = set()
        for i in range(n):
            own = raw[i * quality.STEP : i * quality.STEP + quality.CHUNK]
            assert some[at + i].tobytes() == own.ljust(quality.CHUNK, b"\0")
            seen |= set(range(i * quality.STEP, i * quality.STEP + quality.CHUNK - quality.WIDTH + 1, quality.STRIDE))
        assert seen >= set(range(0, max(1, len(raw) - quality.WIDTH + 1), quality.STRIDE))
        at += n
    assert at == len(some)


def test_a_very_long_text_takes_little_memory_besides():
    text = pa.array([words(1, 1000) * 9000])
    assert text.nbytes > 45 << 20
    net = quality.Network.fresh()
    tracemalloc.start()
    score = net.score(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20 and 0 < score[0] < 1


def plain_score(net, text):
    """Byte by byte, filter by filter."""
    raw, best = text.encode(), []
    for begin in range(0, max(1, len(raw) - quality.CHUNK + quality.STEP), quality.STEP) if len(raw) > quality.CHUNK else [0]:
        own = raw[begin : begin + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        answers = []
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            seen = np.concatenate([net.embed[b] for b in own[at : at + quality.WIDTH]]).astype(np.float64)
            answers.append(seen @ net.filters + net.bias)
        best.append(np.maximum(np.max(answers, axis=0), 0))
    features = np.concatenate([np.mean(best, axis=0), np.max(best, axis=0)])
    hidden = np.tanh(features @ net.inner + net.inner_bias)
    return 1 / (1 + np.exp(-(hidden @ net.outer + net.outer_bias[0])))


def test_score_equals_a_plain_network():
    net = quality.Network.fresh(3)
    texts = ["", "short", words(1, 60), words(2, 100), words(3, 700), "é" * quality.CHUNK]
    assert np.allclose(net.score(pa.array(texts), most=3), [plain_score(net, t) for t in texts], atol=1e-4)


def texts_and_labels(n, seed):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        bad = r.random() < 0.3
        own = words(seed * 1000 + i, int(r.integers(3, 200)))
        out.append((" ".join(w + "$$" for w in own.split()) if bad else own, 0 if bad else 1))
    return out


def test_held_out_accuracy():
    train, test = texts_and_labels(300, 1), texts_and_labels(150, 2)
    some, counts = quality.chunks(pa.array([t for t, _ in train]))
    net = quality.fit(some, counts, np.array([y for _, y in train], np.float32), steps=120)
    score = net.score(pa.array([t for t, _ in test]))
    assert ((score >= quality.ACCEPT) == [y == 1 for _, y in test]).mean() > 0.95


def test_gradient_points_down():
    """One step of learning lowers the loss of what it learned from."""
    train = texts_and_labels(64, 3)
    some, counts = quality.chunks(pa.array([t for t, _ in train]))
    y = np.array([y for _, y in train], np.float32)
    loss = lambda steps: -np.log(np.where(y == 1, p := quality.fit(some, counts, y, steps=steps).score(pa.array([t for t, _ in train])), 1 - p) + 1e-9).mean()
    assert loss(30) < loss(1)


def test_one_label_or_none():
    some, counts = quality.chunks(pa.array(["a", "b"]))
    assert (quality.fit(some, counts, np.ones(2, np.float32)).score(pa.array(["x", ""])) > 0.9).all()
    assert (quality.fit(some, counts, np.zeros(2, np.float32)).score(pa.array(["x", None], pa.string())) < 0.1).all()
    assert (quality.fit(some[:0], counts[:0], np.zeros(0, np.float32)).score(pa.array(["x"])) == 0.5).all()


def test_scores_do_not_depend_on_the_batch():
    train = texts_and_labels(80, 4)
    some, counts = quality.chunks(pa.array([t for t, _ in train]))
    net = quality.fit(some, counts, np.array([y for _, y in train], np.float32), steps=20)
    texts = pa.array([r[1] for r in hard_rows()], pa.string())
    assert np.allclose(net.score(texts), np.concatenate([net.score(texts.slice(i, 1)) for i in range(len(texts))]), atol=1e-5)


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 20)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(12)] + [(None, 1, "x"), (3, None, "x"), (2, 1, "x")], "doc_id long, label int, score string")
    docs = clashing(frame(spark, hard_rows()))
    got = quality.classify(docs, labels, ["doc_id"]).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and all(r["score"] == "own score" for r in kept.collect())
    assert quality.classify(frame(spark, []), labels, ["doc_id"]).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0), ["doc_id"]).collect()} == {0.5}


def test_held_out_rows(spark):
    got = spark.range(200).select("id", quality.held_out("id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(quality.held_out("id")).first()[0] is False


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_accuracy_on_the_given_table(spark, folder):
    from opswell.llm.queries import QUERIES

    got = QUERIES["op9_quality_cnn"](spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = got.filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", "quality").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.4
    assert got.filter(F.col("score").isNull()).count() == 0
