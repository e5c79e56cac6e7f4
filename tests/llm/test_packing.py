import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.util import AWKWARD, documents, empty  # noqa: F401
from tideline.llm.packing import pack_documents, plan, sequences

PATH = P.path("byte_bpe_50k.json")


def layout(lengths, capacity):
    """bin -> intervals, from the runs."""
    runs, bins = plan(dict(Counter(lengths)), capacity)
    placed = {}
    for r in runs:
        for k in range(r.count):
            placed.setdefault(r.bin0 + k // r.per, []).append((r.offset + k % r.per * r.length, r.length))
    assert len(placed) == bins
    return placed


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=200))
def test_every_item_fits_without_gaps(lengths):
    placed = layout(lengths, 60)
    assert Counter(n for own in placed.values() for _, n in own) == Counter(lengths)
    for own in placed.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 60
        assert sum(3 * n > 60 for _, n in own) <= 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(21, 60), min_size=1, max_size=40))
def test_large_items_are_matched_as_well_as_possible(lengths):
    ordered, used, pairs = sorted(lengths), 0, 0
    lo, hi = 0, len(ordered) - 1
    while lo < hi:  # the largest matching, by two pointers
        if ordered[lo] + ordered[hi] <= 60:
            lo, pairs = lo + 1, pairs + 1
        hi -= 1
    assert len(layout(lengths, 60)) == len(lengths) - pairs + used


def test_close_to_the_lower_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.lognormal(5.5, 1.0, 20000).astype(int) + 1).tolist()
    assert len(layout(lengths, 2048)) <= -(-sum(lengths) // 2048) + 2


def test_documents(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in AWKWARD if i != 7] + [(20, "  two  spaces \n\n and\ttabs "), (21, "a<|endoftext|>b")]
    got = pack_documents(documents(spark, rows), PATH, with_ids=True)
    pieces = got.collect()
    whole = {}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        whole.setdefault(i, []).append(ids)
    for i, texts in whole.items():
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: (r.piece, r.length))
        if len(texts) == 1:
            assert [r.piece for r in own] == list(range(len(own)))
            assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == texts[0]
            assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
            assert all(r.length == 2048 for r in own[1:])
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in own)
    assert len(pieces) == sum(-(-len(ids) // 2048) for own in whole.values() for ids in own)
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    made = {r.sequence_id: r for r in sequences(got).collect()}
    assert set(made) == set(by) and all(len(r.ids) == 4 * r.n_tokens for r in made.values())


def test_empty(empty):  # noqa: F811
    assert pack_documents(empty, PATH).count() == 0


def test_bad_plan_input():
    assert plan({}, 10) == ([], 0)
    with pytest.raises(ZeroDivisionError):
        plan({0: 1}, 10)
