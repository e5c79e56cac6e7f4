import zlib

import numpy as np

from tests.llm.util import AWKWARD, documents, empty  # noqa: F401
from tideline.llm import langid as L

WORDS = {
    "en": "the of and that with from this have were their which would there about people through".split(),
    "de": "der die und nicht werden eine schon zwischen über können mögen straße außerdem wieder".split(),
    "es": "que para los las ción también después mañana señor niño está más porque cuando".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n)) + "."


def corpus(seed, n=240):
    rng = np.random.default_rng(seed)
    langs = list(WORDS)
    return [(i, text(rng, langs[i % 3], int(rng.integers(5, 60))), langs[i % 3]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in rows], "doc_id long, text string, lang string, score string, languages int")


def test_held_out_accuracy(spark):
    rows = corpus(1)
    got = {r.doc_id: r for r in L.identify_documents(frame(spark, rows)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    own = [(got[i], g) for i, _, g in rows if got[i].held_out]
    assert len(own) > 30 and np.mean([r.lang_pred == g for r, g in own]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_have_no_influence(spark):
    rows = corpus(2)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in L.identify_documents(frame(spark, x)).collect()} for x in (rows, other))
    assert a == b


def test_mixtures(spark):
    rng = np.random.default_rng(4)
    model = L.train(frame(spark, corpus(3)))
    mixed = [(1, text(rng, "en", 90) + " " + text(rng, "de", 30), None), (2, text(rng, "es", 80), None)]
    got = {r.doc_id: r for r in L.identify(frame(spark, mixed), model).collect()}
    assert got[1].lang_pred == "en" and set(got[1].languages) == {"en", "de"} and 0.65 < got[1].score < 0.85
    assert got[2].languages == ["es"] and got[2].score == 1.0


def test_awkward_rows(spark):
    rows = [(i, t, "en" if k % 2 else None) for k, (i, t) in enumerate([*AWKWARD, (70, "12 34 !!"), (71, "漢字"), (72, "a")])]
    rows = [*rows, *[(1000 + i, t, g) for i, t, g in corpus(5, 60)]]
    got = L.identify_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    und = {(repr(i), t) for i, t, _ in rows if not t or not any(map(str.isalpha, t))}
    assert sorted(repr(r.doc_id) for r in got if r.lang_pred == "und") == sorted(i for i, _ in und)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_nothing_to_learn_from(spark, empty):  # noqa: F811
    got = L.identify_documents(frame(spark, [(1, "text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert L.identify_documents(empty).count() == 0


def test_accept_keeps_rows_as_they_are(spark):
    docs = documents(spark, [*AWKWARD, (50, "1 2 3")])
    got = L.accept(docs, L.train(docs), 0.4)
    assert got.columns == docs.columns
    want = [(repr(i), repr(t)) for i, t in AWKWARD if t and any(map(str.isalpha, t))]
    assert sorted((repr(r.doc_id), repr(r.text)) for r in got.collect()) == sorted(want)
