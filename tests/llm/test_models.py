import zlib

import numpy as np
import pytest

from ledgerloom.llm import langid, quality

from .fixtures import documents, texts

SF = "/root/testdata/sf0.01"


def test_language_id_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    predicted = langid.predict(docs, langid.train(docs, langid.learnable()))
    rows = predicted.select("doc_id", "lang_pred", "score", langid.held_out().alias("held")).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_of_awkward_texts(spark):
    rows = texts() + [(800 + k, "der die das und über größe straße " * 5 + str(k), "de") for k in range(20)] + [(900, "123 ... \u20ac", "en"), (901, "я", "en")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs, langid.learnable())).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202, 900)] == ["und"] * 4 and got[900].score == 0
    assert got[901].lang_pred in ("de", "en")
    assert got[805].lang_pred == "de" and got[10].lang_pred == "en"
    nothing = langid.train(docs.limit(0), langid.learnable())
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), nothing).count() == 0


def test_ftrl_drops_features_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    vectors = [(np.sort(np.array([10 + k, *rng.choice(np.arange(100, 4000), 5, replace=False)])), np.full(6, 6**-0.5)) for k in y]
    w, b = langid.ftrl(vectors, y, 2)
    assert (w[10].argmax(), w[11].argmax()) == (0, 1)
    assert (w == 0).mean() > 0.9
    logits = np.array([[4.0, 0.0]] * 100)
    labels = np.array([0] * 75 + [1] * 25)
    p = langid.softmax(logits / langid.fit_temperature(logits, labels))[0, 0]
    assert abs(p - 0.75) < 0.02


@pytest.fixture(scope="module")
def classified(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    return quality.classify(docs, labels).join(labels, "doc_id").collect()


def test_quality_is_right_on_held_out_documents(classified):
    held = [r for r in classified if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in classified)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in classified)


def test_quality_of_awkward_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (4, 7, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.count() == len(texts())
    assert got.where("score is null").count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_pooling_tells_repetition_from_variety():
    text = b"Go go NOW now | ||" + b"x"
    ids, first = quality.tokens(np.array([0, 5, 18, 19, 19]), np.frombuffer(text, np.uint8))
    assert first.tolist() == [0, 2, 6, 7, 7]
    assert ids[0] == ids[1] and ids[2] == ids[3] != ids[4] != ids[5]
    vectors = np.random.default_rng(0).normal(0, 1, (quality.BUCKETS, quality.DIM)).astype(np.float32)
    pooled = quality.pool(np.array([0, 5, 18, 19, 19]), np.frombuffer(text, np.uint8), vectors)
    assert pooled.shape == (4, 2 * quality.DIM)
    assert np.allclose(pooled[0], np.concatenate([vectors[ids[0]], vectors[ids[0]] ** 2]), atol=1e-6)
    assert np.allclose(pooled[2], np.concatenate([vectors[ids[6]], np.zeros(quality.DIM)])) and not pooled[3].any()
    near = np.mean([vectors[a] * vectors[b] for a, b in zip(ids[2:5], ids[3:6], strict=True)], axis=0)
    assert np.allclose(pooled[1, quality.DIM :], near, atol=1e-5)


def test_samples_hold_one_row_an_id_and_every_language(spark, monkeypatch):
    """Ids of many rows don't fill the driver, and a language with a single document is learnt."""
    monkeypatch.setattr(langid, "MOST", 40)
    rows = texts() + [(2, f"the hand and the land number {k}", "en") for k in range(200)] + [(5000, "xyzzy plugh quux " * 20, "xx")]
    docs = documents(spark, rows)
    model = langid.train(docs, langid.learnable() | (langid.F.col("doc_id") == 5000))
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert got[5000] == "xx" and "xx" in model.languages and model.weights[:, model.languages.index("xx")].any()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    sizes = []
    monkeypatch.setattr(quality.Network, "fit", classmethod(lambda cls, x, y: sizes.append(len(y)) or cls(np.zeros(quality.POOLED), np.ones(quality.POOLED), np.zeros((quality.POOLED, quality.HIDDEN)), np.zeros(quality.HIDDEN), np.zeros(quality.HIDDEN), 0.0)))
    quality.train(docs, labels, quality.learnable("doc_id", 4, 2), sample=10)
    assert sizes == [10]


def test_pooling_a_block_takes_little_memory():
    """A block of short tokens, the worst case: six workers share an executor with the JVM."""
    import tracemalloc

    data = np.frombuffer(b"a " * (quality.BLOCK_BYTES // 2), np.uint8)
    vectors = np.ones((quality.BUCKETS, quality.DIM), np.float32)
    at = np.array([0, len(data)])
    quality.pool(at, data, vectors)  # tables of powers are made once
    tracemalloc.start()
    quality.pool(at, data, vectors)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
