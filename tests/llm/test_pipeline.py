"""The pipeline against its stages done by hand."""

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_ngram_join import brute
from tests.llm.test_pii import ROWS
from tideline.llm import pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rows():
    base = "the quick brown fox jumps over the lazy dog and then it runs far away from all of the other animals in the wood today"
    out = [(1, base), (2, base.upper()), (3, base + " again"), (4, None), (5, ""), (6, "12 34 !!"), (7, "a wholly different text of its own"), (8, base)]
    return out + [(i, t) for i, t in ROWS] + [(300, "long " + " ".join(f"word{k}" for k in range(3000)))]


def test_against_the_stages_by_hand(spark, tmp_path):
    own = rows()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in own], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [(i, t) for i, t in own if t and any(map(str.isalpha, t))]
    newest = {}
    for i, t in left:
        newest[norm(t)] = max(i, newest.get(norm(t), -1))
    left = [(i, t) for i, t in left if newest[norm(t)] == i]
    keep = {c for _, _, c in brute(left, 5, 80)}
    left = [(i, t) for i, t in left if i in keep]
    clean = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in left], DOCS)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in pii.replace_entities(clean, "no secret").collect()}
    sums = {}
    for r in got:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == want
    assert len({r.sequence_id for r in got}) == -(-sum(want.values()) // 2048)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows()], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unknown_languages_are_rejected(spark, tmp_path):
    """What no learned language explains goes, also where only one is learned; short texts in a learned language stay."""
    clean = [(i, "the house is small and the garden of the house is green", "en") for i in range(20)] + [(20, "the garden is small", "en")]
    odd = [(30, "今天天气很好我们一起去公园散步", None), (31, "xqzj vwkkq zzxq qwpfj hgkkx vbnnq jjqz", None)]
    docs = spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in clean + odd], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()) == list(range(21))
