import random

import numpy as np
import pytest

from tests.llm.util import AWKWARD, documents, empty  # noqa: F401
from tideline.llm import ngram_join as J


def shingles(t, n):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def copies(seed, n=160):
    """Documents, near copies at many distances, chains of copies, and one passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = []
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.35 or not texts:
            own = [word() for _ in range(rng.choice([1, 2, 3, 5, 9, 12, 20, 40, 90, 200]))]
        elif kind < 0.9:
            own = rng.choice(texts)[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                own.insert(rng.randrange(len(own) + 1), word()) if rng.random() < 0.5 else own.pop(rng.randrange(len(own))) if len(own) > 1 else None
        else:
            own = [word() for _ in range(rng.randint(1, 30))] + passage
        texts.append(own)
    return [(100 - k if k % 3 else 1000 + k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed, words, percent", [(1, 3, 90), (2, 5, 80), (3, 3, 85), (4, 1, 95)])
def test_against_brute_force(spark, seed, words, percent):
    rows = copies(seed)
    got = J.link_documents(documents(spark, rows), words, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, words, percent)


def test_small_blocks_of_a_page(spark, monkeypatch):
    monkeypatch.setattr(J, "PAGE", 3)
    rows = copies(9, 120)
    got = J.link_documents(documents(spark, rows), 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 90)


def test_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[0] is not None and r != AWKWARD[7]]
    got = J.link_documents(documents(spark, rows), 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 90)


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g"
    rows = [(1, text), (1, text), (None, text), (2, text), (None, None)]
    got = J.link_documents(documents(spark, rows), 3, 90).collect()
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in got) == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None"), ("None", "None")]


def test_rows_that_repeat_an_id_with_other_texts(spark):
    base = [f"w{k}" for k in range(40)]
    a, b = " ".join(base), " ".join(base[::-1])
    rows = [(1, a), (1, b), (0, "zz " + b), (5, b + " x"), (1, b.upper()), (7, a)]
    got = J.link_documents(documents(spark, rows), 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 90)
    rng = random.Random(11)
    more = [(rng.randint(0, 60), t) for _, t in copies(11)]
    got = J.link_documents(documents(spark, more), 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(more, 3, 90)
    kept = J.keep_one(documents(spark, rows), 3, 90).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(0, "zz " + b), (1, a)]


def test_counts_cover_all_documents(spark):
    rows = [(i, f"x{i} y{i} z{i} common words here") for i in range(50)]
    found = J.frequent_shingles(documents(spark, rows).repartition(3), 3)
    assert found.tolist() == sorted(J.Shingler(3)("common words here").tolist())
    many, n = np.arange(1000, dtype=np.uint64), np.arange(1000)
    kept, low = J._thinned(many, n, 10)
    assert kept.tolist() == list(range(990, 1000)) and low.tolist() == list(range(1, 11))


def test_keep_one(spark):
    rows = copies(5, 60)
    docs = documents(spark, rows)
    got = J.keep_one(docs, 5, 80)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})


def test_sql(spark):
    import duckdb

    from tideline.llm.queries import OP2_SQL

    rows = copies(12, 90)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*rows, (5000, None), (5001, " \n"), (5002, "Two WORDS"), (5003, "two words")])
    want = brute([*rows, (5000, None), (5001, " \n"), (5002, "Two WORDS"), (5003, "two words")], 3, 90)
    assert sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({OP2_SQL})").fetchall()) == want


def test_empty(empty):  # noqa: F811
    assert J.link_documents(empty).count() == 0 and J.keep_one(empty).count() == 0


def test_tree_join_finds_all_pairs_of_the_bound():
    rng = np.random.default_rng(2)
    base = rng.poisson(2, (40, J.DIMS))
    points = np.abs(base[rng.integers(0, 40, 300)] + rng.integers(-1, 2, (300, J.DIMS)) * (rng.random((300, J.DIMS)) < 0.05)).astype(np.int32)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = J.RTree(points, sizes)
    got = {(min(x, y), max(x, y)) for a, b in J.tree_join(tree, tree, 90) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y}
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    on = (bound >= J.least_overlap(sizes[:, None], sizes[None], 90)) & (100 * np.minimum.outer(sizes, sizes) >= 90 * np.maximum.outer(sizes, sizes))
    assert {(i, j) for i, j in zip(*np.nonzero(on), strict=True) if i < j} <= got


def test_count_vectors_of_large_sets_stay_above_the_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 40, 3000, 700_000)]
    sets.append(np.unique(np.concatenate([sets[3][:500_000], sets[2]])))
    found = J.points([J.counts(s) for s in sets])
    for s, row in zip(sets, found, strict=True):
        exact = np.bincount((s & np.uint64(J.DIMS - 1)).astype(np.int64), minlength=J.DIMS)
        assert (row >= exact).all() and (row <= exact * 1.01 + max(1, exact.max() // 255 + 1)).all()
        assert exact.max() > 255 or (row == exact).all()
    for a in range(len(sets)):
        for b in range(len(sets)):
            assert np.minimum(found[a], found[b]).sum() >= len(np.intersect1d(sets[a], sets[b]))


def test_long_unrelated_sets_are_no_candidates():
    rng = np.random.default_rng(11)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (20_000, 20_000, 19_000)]
    near = np.concatenate([sets[0][:18_500], rng.integers(0, 1 << 63, 1_200, dtype=np.uint64)])
    vectors = [J.counts(s) for s in [*sets, near]]
    need = J.least_overlap(np.array([20_000] * 3), np.array([20_000, 19_000, 19_700]), 80)
    coarse = J.points(vectors)
    assert (np.minimum(coarse[0], coarse[1:3]).sum(axis=1) >= need[:2]).all()
    assert J.fine_enough([vectors[0]] * 3, vectors[1:], need).tolist() == [False, False, True]


@pytest.mark.parametrize("block", [1, 60, 400])
def test_small_blocks_of_a_cluster(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = copies(13, 120)
    got = J.link_documents(documents(spark, rows), 5, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 5, 80)


def test_pages_and_clusters_yield_no_more_than_joins_them(spark):
    """All 300 sets are candidates of each other, and none links with another; before, each pair was a row."""
    n = 300
    raw = J.counts(np.arange(512, dtype=np.uint64))
    rows = [(7, k, k, 512, raw) for k in range(n)]
    pages = spark.createDataFrame(rows, "key long, rep long, component long, n_shingles long, point binary")
    got = [(r.a, r.b) for r in J._page_pairs(pages, 80).collect()]
    assert len(got) == n - 1
    common = np.arange(300, dtype=np.uint64)
    sets = [np.concatenate([common, np.arange(1000 * k, 1000 * k + 100, dtype=np.uint64)]) for k in range(1, n + 1)]
    assert J.spanning_links(sets, np.arange(n), None, 80) == []
    assert len(J.spanning_links([common] * n, np.arange(n), None, 80)) == n - 1


def test_spanning_links_against_every_pair():
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 2**63, k).astype(np.uint64) for k in (1, 3, 20, 80)]
    sets = []
    for _ in range(120):
        own = base[rng.integers(4)]
        own = own[rng.random(len(own)) < 0.95]
        sets.append(np.unique(np.append(own, rng.integers(0, 2**63, 1 + rng.integers(3)).astype(np.uint64))))
    for side in (None, rng.integers(0, 2, len(sets))):
        parts, wanted = list(range(len(sets))), list(range(len(sets)))

        def join(of, x, y):
            x, y = of[x], of[y]
            of[:] = [x if k == y else k for k in of]

        for x, y in J.spanning_links(sets, np.arange(len(sets)), side, 80):
            assert parts[x] != parts[y]
            join(parts, x, y)
        for x in range(len(sets)):
            for y in range(x):
                both = len(np.intersect1d(sets[x], sets[y]))
                if (side is None or side[x] != side[y]) and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    join(wanted, x, y)
        assert len(set(zip(parts, wanted, strict=True))) == len(set(parts)) == len(set(wanted)) < len(sets)


def test_pages_are_cut_by_size(spark):
    rows = [(1, k, n) for k, n in enumerate([100, 125, 156, 196, 250, 251, 500])] + [(2, 9, 5), (2, 10, 7)]
    got = J._by_size(spark.createDataFrame(rows, "key long, rep long, n_shingles long"), 80).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.key, []).append(r.rep)
    assert sorted(map(sorted, parts.values())) == [[0, 1, 2], [4, 5]]


def test_texts_that_no_cluster_names_stay(spark):
    """Before, every text was shuffled to the clusters."""
    docs = documents(spark, [(i, f"text {i}") for i in range(3000)] + [(None, "x"), (5, None), (5, "another")])
    named = docs.filter("doc_id IN (5, 70, 2999)").selectExpr("doc_id", "xxhash64(text) AS t")
    got = sorted((r.doc_id, r.text or "") for r in J._named_texts(docs, named.union(named)).collect())
    assert [x for x in got if x[0] in (5, 70, 2999)] == [(5, ""), (5, "another"), (5, "text 5"), (70, "text 70"), (2999, "text 2999")]
    assert len(got) < 20
    assert J._named_texts(docs, named.limit(0)).count() == 0


def test_vectors_travel_packed(spark):
    rng = np.random.default_rng(3)
    for n, most in ((1, 250), (300, 250), (20_000, 2600)):
        v = J.counts(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert J.unpacked(J.packed(v)) == v and len(J.packed(v)) < most
    raw = J.counts(np.arange(512, dtype=np.uint64))
    pages = spark.createDataFrame([(7, k, k, 512) for k in range(40)], "key long, rep long, component long, n_shingles long")
    vectors = spark.createDataFrame([(k, bytearray(J.packed(raw))) for k in range(40)], "rep long, point binary")
    assert J._page_pairs(pages, 80, vectors).count() == 39
