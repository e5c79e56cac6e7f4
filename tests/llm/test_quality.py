import numpy as np

from tests.llm.util import AWKWARD
from tideline.llm import quality as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label int"


def corpus(spark, seed, n=700, labelled=0.4):
    """Clean prose, and junk that comes more often from one source; few labels."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(300)]
    docs, labels, truth = [], [], {}
    for i in range(n):
        bad = rng.random() < 0.3
        own = rng.choice(words, rng.integers(10, 60))
        text = " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in own) if bad else " ".join(own) + "."
        docs.append((i, text, "en", "junk" if bad and rng.random() < 0.8 else f"s{i % 5}", len(text), "x", 1))
        truth[i] = 0 if bad else 1
        if rng.random() < labelled:
            labels.append((i, truth[i], 0))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_accuracy_on_rows_without_labels(spark):
    docs, labels, truth = corpus(spark, 1)
    seen = {r.doc_id for r in labels.collect()}
    got = {r.doc_id: r for r in Q.score_documents(docs, labels).collect()}
    own = [i for i in truth if i not in seen]
    assert len(got) == len(truth) and np.mean([got[i].kept == bool(truth[i]) for i in own]) >= 0.95
    assert np.mean([got[i].kept for i in own if truth[i]]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_views_teach_each_other():
    """The pool joins the training rows; scores stay calibrated on the held-out rows."""
    rng = np.random.default_rng(2)
    y = (rng.random(1500) < 0.5).astype(float)
    text = (rng.normal(size=(1500, 20)) + np.outer(y - 0.5, np.ones(20)) * 0.9).astype(np.float32)
    meta = (rng.normal(size=(1500, 10)) + np.outer(y - 0.5, np.ones(10)) * 0.9).astype(np.float32)
    label = np.where(np.arange(1500) < 60, y, np.nan)
    model = Q.co_train(text, meta, label)
    p = model.scores(text[60:], meta[60:])
    assert np.mean((p >= 0.5) == (y[60:] > 0.5)) >= 0.93


def test_too_few_labels(spark):
    docs, labels, _ = corpus(spark, 3, 40)
    few = labels.limit(3).withColumn("quality", Q.F.lit(1))
    assert {r.score for r in Q.score_documents(docs, few).collect()} == {1.0}
    assert {r.score for r in Q.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_awkward_rows(spark):
    docs, labels, _ = corpus(spark, 4, 300)
    odd = spark.createDataFrame([(5000 + k if i is not None else None, t, None, None, None, None, None) for k, (i, t) in enumerate(AWKWARD)], DOCS)
    extra = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = Q.score_documents(docs.union(odd), labels.union(extra)).collect()
    assert len(got) == 300 + len(AWKWARD) and all(0 <= r.score <= 1 for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert Q.score_documents(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_few_labels_in_a_large_table_are_all_learned_from(spark, monkeypatch):
    """The bound is one of labelled rows, and the pool covers the table in shards."""
    monkeypatch.setattr(Q, "POOL_ROWS", 150)
    docs, labels, truth = corpus(spark, 5, 700, 0.12)
    model = Q.train(docs, labels, sample_rows=100)
    assert model.combine is not None
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(truth[i]) for i in truth]) >= 0.95


def test_features_are_made_once(spark):
    docs, labels, _ = corpus(spark, 6, 300)
    got = Q.score_documents(docs, labels)
    read = got.inputFiles()
    assert read and all("/features/" in name for name in read)
    apart = {r.doc_id: r.score for r in Q.score(docs, Q.train(docs, labels)).collect()}
    assert {r.doc_id: r.score for r in got.collect()} == apart
