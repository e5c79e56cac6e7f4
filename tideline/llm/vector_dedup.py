"""Embedding near-duplicates: all pairs at or above a cosine, found by traversing two cover trees at once.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). A block of vectors gets a cover tree: nested levels of
centres whose radii halve from level to level, every vector within the radius of a centre of each level, and with each centre the real distance
to the farthest vector below it. Two trees (or a tree and itself) are descended together. A pair of nodes is dropped when
its centres are farther apart than both covering radii and the threshold; when even the farthest vectors below lie
within the threshold the whole pair is counted at once; at the bottom the cosine itself decides, in double precision.

Vectors meet only within a label (and a dimension). Equal vectors are one class with a multiplicity. A label is
dealt into blocks of about `block` classes by a hash, and every two blocks of it meet in a task of their own, so a label of
any size is spread. A task returns link counts and the edges of a spanning forest of its links, never the pairs.

Defined cases: a null label, a null, empty or all-zero vector, and one with null or non-finite components links with nothing; ties at the
threshold link; rows that repeat vec_id and vector count as two vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, ship

BLOCK = 8192
_SLACK = 1e-7
_FRONTIER = 1 << 20


class CoverTree:
    """Levels of centres over unit vectors x; vectors are reordered so that what lies below a node is a range."""

    def __init__(self, x: np.ndarray, floor: float = 1 / 64):
        n = len(x)
        levels = [np.array([0])]
        parents: list[np.ndarray] = []
        home = np.zeros(n, np.int64)  # each vector's centre in the last level
        radius = 1.0
        while len(levels[-1]) < n and radius >= floor:
            centres, home = self._net(x, levels[-1], home, radius)
            parents.append(self._up(centres, levels[-1], parents, home_of_parent=self._last_home))
            levels.append(centres)
            radius /= 2
        parents.append(home)
        levels.append(np.arange(n))
        paths = [parents[-1]]
        for up in reversed(parents[:-1]):
            paths.append(up[paths[-1]])
        self.order = np.lexsort([np.arange(n), *paths]) if n else np.zeros(0, np.int64)
        self.x = x[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k, centres in enumerate(levels):
            own = (paths[len(levels) - 2 - k] if k < len(levels) - 1 else np.arange(n))[self.order]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            node = own[starts]
            far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.x, x[centres[own]])))
            cover = np.maximum.reduceat(far, starts)
            if k == len(levels) - 1:
                cover[:] = 0
            self.levels.append((x[centres[node]], cover, starts, np.append(starts[1:], n)))

    def _net(self, x: np.ndarray, old: np.ndarray, old_home: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Centres of the next level: the old ones, and every vector that no centre below the same old one covers yet."""
        self._last_home = old_home
        least = 1 - radius * radius / 2  # the cosine at that distance
        centres, home = list(old), np.full(len(x), -1, np.int64)
        of = {c: k for k, c in enumerate(old)}
        order = np.argsort(old_home, kind="stable")
        cuts = np.flatnonzero(np.diff(old_home[order], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[a:b]
            mine = [int(old[old_home[own[0]]])]
            for lo in range(0, len(own), 512):
                part = own[lo : lo + 512]
                near = x[part] @ x[mine].T
                best = near.argmax(axis=1)
                value = near[np.arange(len(part)), best]
                at = np.array([of[c] for c in mine])[best]
                open_ = np.flatnonzero(value < least)
                if len(open_):
                    inner = x[part[open_]] @ x[part[open_]].T
                    top, where = value[open_].copy(), at[open_].copy()
                    for i in range(len(open_)):
                        if top[i] < least:
                            c = int(part[open_[i]])
                            of[c] = len(centres)
                            centres.append(c), mine.append(c)
                            closer = inner[i] > top
                            closer[:i] &= top[:i] < least
                            top = np.where(closer, inner[i], top)
                            where = np.where(closer, of[c], where)
                            top[i], where[i] = 1.0, of[c]
                    at[open_] = where
                home[part] = at
        return np.array(centres), home

    def _up(self, centres: np.ndarray, old: np.ndarray, parents: list, home_of_parent: np.ndarray) -> np.ndarray:
        return home_of_parent[centres]


def _pairs_of_children(tree: CoverTree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child in the next level and one past the last, of nodes of this level."""
    _, _, starts, ends = tree.levels[level]
    below = tree.levels[level + 1][2]
    return np.searchsorted(below, starts[nodes]), np.searchsorted(below, ends[nodes])


class Links:
    """Link counts, weighted by multiplicity, and a union of linked vectors."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray]):
        self.weights = weights
        self.sums = [np.concatenate([[0], np.cumsum(w)]) for w in weights]
        self.bulk = [np.zeros(len(w) + 1, np.int64) for w in weights]
        self.counts = [np.zeros(len(w), np.int64) for w in weights]
        self.shift = len(weights[0])
        self.edges: list[np.ndarray] = []

    def whole(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """Every vector of the range a links with every one of b."""
        for side, own, other in ((0, a, b), (1, b, a)):
            total = self.sums[1 - side][other[1]] - self.sums[1 - side][other[0]]
            self.bulk[side][own[0]] += total
            self.bulk[side][own[1]] -= total
        first_a, first_b = a[0], b[0] + self.shift
        left = np.arange(b[0], b[1]) + self.shift
        right = np.arange(a[0], a[1])
        self.edges.append(np.stack([np.full(len(left), first_a), left], 1))
        self.edges.append(np.stack([right, np.full(len(right), first_b)], 1))
        self._fold()

    def each(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.counts[0], a, self.weights[1][b])
        np.add.at(self.counts[1], b, self.weights[0][a])
        self.edges.append(np.stack([a, b + self.shift], 1))
        self._fold()

    def _fold(self, force: bool = False) -> None:
        """Replace the edges kept so far by a spanning star of each component."""
        if not force and sum(map(len, self.edges)) < 4 * (len(self.weights[0]) + len(self.weights[1])) + 1024:
            return
        got = np.concatenate(self.edges) if self.edges else np.zeros((0, 2), np.int64)
        label = np.arange(len(self.weights[0]) + len(self.weights[1]))
        while True:
            u, v = label[got[:, 0]], label[got[:, 1]]
            low = np.minimum(u, v)
            if (u == v).all():
                break
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
            while (label[label] != label).any():
                label = label[label]
        at = np.flatnonzero(label != np.arange(len(label)))
        self.edges = [np.stack([label[at], at], 1)]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._fold(True)
        left, right = (c + np.cumsum(b)[:-1] for c, b in zip(self.counts, self.bulk, strict=True))
        return left, right, self.edges[0]


def traverse(left: CoverTree, right: CoverTree, links: Links, cosine: float) -> None:
    """Find all pairs of left and right at or above cosine. Depth first, so the frontier stays small."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))
    top = max(len(left.levels), len(right.levels)) - 1

    def at(tree: CoverTree, k: int) -> int:
        return min(k, len(tree.levels) - 1)

    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(left.x) and len(right.x) else []
    while stack:
        k, a, b = stack.pop()
        if len(a) > _FRONTIER:
            half = len(a) // 2
            stack += [(k, a[half:], b[half:]), (k, a[:half], b[:half])]
            continue
        (ca, ra, sa, ea), (cb, rb, sb, eb) = left.levels[at(left, k)], right.levels[at(right, k)]
        dot = np.empty(len(a))
        for lo in range(0, len(a), 65536):
            dot[lo : lo + 65536] = np.einsum("ij,ij->i", ca[a[lo : lo + 65536]], cb[b[lo : lo + 65536]])
        if k == top:
            hit = dot >= cosine
            links.each(sa[a[hit]], sb[b[hit]])
            continue
        d = np.sqrt(np.maximum(0, 2 - 2 * dot))
        inside = d + ra[a] + rb[b] <= reach - _SLACK
        inside &= (ea[a] - sa[a]) * (eb[b] - sb[b]) >= 256  # small ranges go down together with the others
        for i in np.flatnonzero(inside):
            links.whole((int(sa[a[i]]), int(ea[a[i]])), (int(sb[b[i]]), int(eb[b[i]])))
        near = ~inside & (d - ra[a] - rb[b] <= reach + _SLACK)
        a, b = a[near], b[near]
        if not len(a):
            continue
        lo_a, hi_a = _pairs_of_children(left, k, a) if k < len(left.levels) - 1 else (a, a + 1)
        lo_b, hi_b = _pairs_of_children(right, k, b) if k < len(right.levels) - 1 else (b, b + 1)
        wide_a, wide_b = hi_a - lo_a, hi_b - lo_b
        dense = np.flatnonzero(wide_a * wide_b > 4096)
        for i in dense:  # many children on both sides: distances by one product, in slices
            _dense(left, right, at(left, k + 1), at(right, k + 1), (lo_a[i], hi_a[i]), (lo_b[i], hi_b[i]), reach, k + 1, stack)
        few = np.flatnonzero(wide_a * wide_b <= 4096)
        for lo in range(0, len(few), 4096):
            own = few[lo : lo + 4096]
            n = wide_a[own] * wide_b[own]
            which = np.repeat(own, n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            stack.append((k + 1, lo_a[which] + nth // wide_b[which], lo_b[which] + nth % wide_b[which]))


def _dense(left, right, la, lb, own, other, reach, k, stack) -> None:
    ca, ra, *_ = left.levels[la]
    cb, rb, *_ = right.levels[lb]
    b = slice(*other)
    step = max(1, (1 << 22) // max(1, other[1] - other[0]))
    for lo in range(own[0], own[1], step):
        a = slice(lo, min(lo + step, own[1]))
        d = np.sqrt(np.maximum(0, 2 - 2 * (ca[a] @ cb[b].T)))
        i, j = np.nonzero(d <= ra[a, None] + rb[None, b] + reach + _SLACK)
        if len(i):
            stack.append((k, i + lo, j + other[0]))



def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vector-dedup")
    v = F.col("embedding").cast("array<double>")
    sound = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    )
    rows = vectors.select(F.col("vec_id").cast("long"), "label", v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    classes = rows.filter("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = scratch.table("classes", classes.withColumn("dim", F.size("v")))
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        F.xxhash64("label", "dim").alias("home"),
        "label",
        "dim",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "rep",
        "n",
        "v",
    )

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []

        def flush() -> pa.RecordBatch:
            block, rep, n = (np.array([h[k] for h in held], np.int64) for k in range(3))
            x = np.array([h[3] for h in held], np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            at = [np.flatnonzero(block == k) for k in own[-2:]]
            same = own[-1] == own[-2]
            trees = [CoverTree(x[at[0]])]
            trees.append(trees[0] if same else CoverTree(x[at[1]]))
            ids = [at[k][t.order] for k, t in enumerate(trees)]
            links = Links((n[ids[0]], n[ids[1]]))
            traverse(trees[0], trees[1], links, cosine)
            left, right, edges = links.result()
            both = np.concatenate([rep[ids[0]], rep[ids[1]]])
            out_rep, out_n = (rep[ids[0]], left) if same else (both, np.concatenate([left, right]))
            keep = out_n > 0
            u, w = both[edges[:, 0]], both[edges[:, 1]]
            out = [
                np.concatenate([out_rep[keep], u]),
                np.concatenate([out_n[keep], np.zeros(len(u), np.int64)]),
                np.concatenate([out_rep[keep], w]),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["rep", "links", "with"])

        for batch in batches:
            for _, label, dim, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, dim, i, j) != own and held:
                    yield flush()
                    held = []
                own = label, dim, i, j
                held.append(row)
        if held:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    found = scratch.table(
        "found",
        spread.repartition(n, "home", "i", "j")
        .sortWithinPartitions("home", "label", "dim", "i", "j")
        .mapInArrow(join, "rep long, links long, with long"),
    )
    edges = found.filter("rep <> with").select(F.col("rep").alias("u"), F.col("with").alias("v"))
    parts = components(edges, scratch)
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    done = classes.select("label", "v", "rep").join(counted, "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("label").alias("_label"), F.col("v").alias("_v"), "links", F.coalesce("component", "rep").alias("component")
    )
    on = F.col("sound") & (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))
    return (
        rows.join(done, on, "left")
        .select("vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
