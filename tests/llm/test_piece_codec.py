import struct

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import AWKWARD, documents, empty  # noqa: F401
from tideline.llm import piece_codec as C

PATH = P.path("piece_bpe_32k.model")
CODEC = C.PieceCodec(C.Model.load(PATH))
DECODER = C.Decoder(CODEC.model)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(codec, text):
    data = codec.encode(text)
    return list(struct.unpack(f"<{len(data) // 4}I", data))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aaeeiotnsrl  .,'\n\t1029é漢😀▁")) | st.characters(codec="utf-8"), max_size=50))
def test_same_as_the_library(text):
    assert ids(CODEC, text) == LIBRARY.encode(text)
    assert DECODER.decode(CODEC.encode(text)) == text.replace("▁", " ")


@pytest.mark.parametrize("text", ["", " ", "   a  b ", "The  quick brown\n\nfox", "A" * 400, "internationalization's", "    return x", "<s>"])
def test_texts(text):
    assert ids(CODEC, text) == LIBRARY.encode(text)


def brute_viterbi(text, scores, least):
    """Best sum over all cuts of a short text."""
    if not text:
        return 0.0
    best = float("-inf")
    for k in range(1, len(text) + 1):
        head = text[:k]
        s = scores.get(head, least if k == 1 else None)
        if s is not None:
            best = max(best, s + brute_viterbi(text[k:], scores, least))
    return best


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab▁x", max_size=9), st.integers(0, 5))
def test_unigram_is_the_best_cut(text, seed):
    import random

    rng = random.Random(seed)
    names = ["a", "b", "▁", "ab", "ba", "▁a", "aab", "bab", "▁ab", "abba"]
    pieces = [("<unk>", 0.0, C.UNKNOWN)] + [(n, -rng.random() * 5 - 1, C.NORMAL) for n in names]
    codec = C.PieceCodec(C.Model(pieces, C.UNIGRAM, dummy_prefix=False, byte_fallback=False))
    cut = codec.cut(text)
    assert "".join(cut) == text
    least = codec.least
    assert sum(codec.score.get(p, least) for p in cut) == pytest.approx(brute_viterbi(text, codec.score, least))


def test_documents(spark):
    rows = [*AWKWARD, (60, "a ▁ b")]
    made = C.encode_documents(documents(spark, rows), PATH)
    back = C.decode_documents(made, PATH).collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(i), (t or "").replace("▁", " ")) for i, t in rows)
    by = {repr(r.doc_id): r for r in back}
    assert list(struct.unpack(f"<{by['6'].n_pieces}I", bytes(by["6"].ids))) == LIBRARY.encode(AWKWARD[5][1])


def test_empty(empty):  # noqa: F811
    assert C.decode_documents(C.encode_documents(empty, PATH), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aeit  .\n\x00é漢▁")), max_size=30), max_size=8))
def test_columns_are_the_texts_and_tables_stay_small(texts):
    codec = C.PieceCodec(C.Model.load(PATH)) if SMALL[0] is None else SMALL[0]
    SMALL[0] = codec
    codec.known.budget = 2_000
    got, firsts = codec.encode_column(pa.array([*texts, None], pa.string()))
    assert [got[a:b].tolist() for a, b in zip(firsts, firsts[1:])] == [LIBRARY.encode(t) for t in [*texts, ""]]
    assert len(codec.known.now) + len(codec.known.old) < 60


SMALL = [None]


def test_decoded_in_the_same_pass(spark):
    rows = [*AWKWARD, (60, "a ▁ b")]
    got = C.encode_documents(documents(spark, rows), PATH, decode=True).collect()
    assert all(r.same for r in got)
    assert sorted((repr(r.doc_id), r.decoded) for r in got) == sorted((repr(i), (t or "").replace("▁", " ")) for i, t in rows)
