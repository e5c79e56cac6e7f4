import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.util import AWKWARD, documents, empty  # noqa: F401
from tideline.llm.token_store import Shard, digest_documents, read_store, round_trip, write_shard, write_store
from tideline.llm.tokens import UnitEncoder, encoder
from tideline.llm.worker import BUDGET, Recent

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40), min_size=1, max_size=12), st.sampled_from([1, 3, 4, 8, 13]))
def test_any_token_without_decoding(docs, width):
    ids = np.array([x for d in docs for x in d], np.uint32)
    firsts = np.cumsum([0, *map(len, docs)])[:-1]
    shard = Shard(write_shard(list(range(len(docs))), ids, firsts.tolist(), width))
    assert shard.all().tolist() == ids.tolist()
    assert [shard.token(i) for i in range(len(ids))] == ids.tolist()
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d
    with pytest.raises(IndexError):
        shard.token(len(ids))


def test_rank_directory_over_many_blocks():
    ids = np.random.default_rng(1).integers(0, 70000, 5000).astype(np.uint32)
    shard = Shard(write_shard([1], ids, [0]))
    assert [shard.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()


def test_not_a_file():
    with pytest.raises(ValueError):
        Shard(b"x" * 64)


def test_documents(spark, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in AWKWARD if i not in (7, None)] + [(-5, "negative id"), (10**12, "A large one's text")]
    write_store(documents(spark, rows), str(tmp_path / "store"), PATH, 2, docs_per_shard=3)
    got = read_store(spark, str(tmp_path / "store"))
    at = 0
    found = {r.doc_id: r for r in got.collect()}
    crc = {r.doc_id: r.ids_crc32 for r in digest_documents(got).collect()}
    for i, t in sorted(rows):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert found[i].start == at and found[i].n_tokens == len(ids) and bytes(found[i].ids) == ids.tobytes()
        assert crc[i] == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert len(found) == len(rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, "b"), (1, "a"), (None, "c"), (1, "a")]
    got = sorted((r.start, r.doc_id is None) for r in round_trip(documents(spark, rows), PATH, 2).collect())
    assert got == [(0, True), (2, False), (4, False), (6, False)]


def test_one_id_of_many_rows_is_cut(spark, tmp_path):
    rows = [(7, f"text {i % 50}") for i in range(400)] + [(None, "x")] * 30 + [(-(2**63), "least")]
    write_store(documents(spark, rows), str(tmp_path / "store"), PATH, 2, docs_per_shard=16, parts=5)
    assert spark.read.parquet(str(tmp_path / "store")).groupBy("part").count().count() == 5
    got = sorted(read_store(spark, str(tmp_path / "store")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 30 + [-(2**63)] + [7] * 400
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    plain = Tokenizer.from_file(PATH)
    want = Counter(tuple(plain.encode(t, add_special_tokens=False).ids + [2]) for _, t in rows)
    assert Counter(tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got) == want


def test_empty(empty):  # noqa: F811
    assert round_trip(empty, PATH, 2).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("abAB  .,'\n\t\r!1é́漢\x0b\x1c\x85\xa0 　İΣ<|>")) | st.characters(codec="utf-8"), max_size=30), max_size=6))
def test_unit_encoder_is_the_tokenizer(name, texts):
    path = P.path(name)
    plain = Tokenizer.from_file(path)
    own = UnitEncoder(path, budget=20_000)
    for at in range(0, len(texts) + 1, 3):
        some = texts[at : at + 3]
        ids, firsts = own.encode(pa.array([*some, None], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(firsts, firsts[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in [*some, ""]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_strings_are_what_the_library_makes_of_them(name):
    path = P.path(name)
    plain, own = Tokenizer.from_file(path), UnitEncoder(path)
    texts = ["a<|endoftext|>b", "<|startoftext|> hello", "plain", "x <|endoftext|>", "<|endoftext|", "\x00 <|endoftext|>\x00"]
    ids, firsts = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(firsts, firsts[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_wider_table_keeps_units_that_a_narrow_one_drops():
    texts = [[f"word{k}x{turn}" for k in range(400)] for turn in (1, 2, 1)]
    learned = {}
    for budget in (1 << 17, 1 << 19):
        e = UnitEncoder(PATH, budget)
        learned[budget], learn = 0, e._learn

        def count(new, learn=learn, budget=budget):
            learned[budget] += len(new)
            return learn(new)

        e._learn = count
        tokenizer = Tokenizer.from_file(PATH)
        for words in texts:
            text = " ".join(words)
            assert e.encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert learned[1 << 17] > learned[1 << 19] == 800
    assert encoder(PATH, 2 * BUDGET).units.budget == 2 * encoder(PATH).units.budget


def test_values_come_from_both_generations_and_from_new_ones_in_order():
    table = Recent(1000)
    table.put(["a", "b"], [b"1", b""])
    table.old, table.now = table.now, {}
    table.put(["c"], [b"3"])
    asked = []
    assert table.look_up(["x", "b", "c", "a", "y"], lambda new: asked.extend(new) or [u.encode() for u in new]) == [b"x", b"", b"3", b"1", b"y"]
    assert asked == ["x", "y"] and set(table.now) == set("abcxy")
