import math

import numpy as np
import pytest

from tideline.llm.vector_dedup import CoverTree, Links, near_duplicates, traverse

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, v int"


def brute(rows, cosine=0.93):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if usable(a, la) and usable(b, lb) and la == lb and len(a) == len(b):
                a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    parent[root(i)] = root(j)
    least = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return sorted((r[0], links[k], least[root(k)]) for k, r in enumerate(rows))


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = near_duplicates(df, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in got)


def vectors(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8 + 1, dim))
    x = base[rng.integers(0, len(base), n)] + rng.choice([0, 0.05, 0.3], n)[:, None] * rng.normal(size=(n, dim))
    return [(int(1000 - k if k % 2 else k), [float(v) for v in x[k]], int(k % 3 == 0)) for k in range(n)]


@pytest.mark.parametrize("block", [8192, 25])
def test_against_brute_force(spark, block):
    rows = vectors(4, 240)
    assert found(spark, rows, block=block) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1),
        (2, [2.0, 0.0], 1),
        (3, [1.0, 0.0], 2),
        (4, [1.0, 0.0], None),
        (5, None, 1),
        (6, [], 1),
        (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1),
        (9, [inf, 1.0], 1),
        (10, [1.0, None], 1),
        (11, [1.0, 0.0, 0.0], 1),
        (12, [1.0, 0.0], 1),
        (13, [-1.0, 0.0], 1),
        (14, [1e30, 1e25], 1),
        (15, [1e-30, 0.0], 1),
    ]
    want = [r for r in brute(rows) if r[0] not in (14, 15)]
    got = found(spark, [r for r in rows if r[0] not in (14, 15)])
    assert [r for r in got] == [r for r in brute([r for r in rows if r[0] not in (14, 15)])]
    assert want and {r[0]: r[1] for r in found(spark, rows)}[14] == 4


def test_repeated_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)]
    assert found(spark, rows) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 60, 400])
@pytest.mark.parametrize("spread", [0.0005, 0.05, 0.4])
def test_trees(n, spread):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(max(1, n // 20), 8))
    x = base[rng.integers(0, len(base), n)] + spread * rng.normal(size=(n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.integers(1, 4, n)
    tree = CoverTree(x)
    radius = 1.0
    for centres, cover, starts, ends in tree.levels[1:-1]:
        assert cover.max() <= radius + 1e-9 and (ends > starts).all()
        radius /= 2
    links = Links((w[tree.order], w[tree.order]))
    traverse(tree, tree, links, 0.93)
    left, right, edges = links.result()
    want = ((x @ x.T) >= 0.93) @ w
    assert (left == want[tree.order]).all() and (right == left).all()
