"""Jaccard self-join of documents on word shingles, exact, over count vectors.

A document is its set of distinct shingles, each a 64-bit hash. Documents with equal sets form a class; only one of a class
goes on. The join hashes shingles into groups in two ways:

* Directory, for thresholds of 85 % and over. With threshold t two sets that link differ in at most d = smaller * (1 - t) / t
  shingles. Hashed into more than d groups, they agree in whole groups, so documents are looked up by the content of each group. A
  band of sizes fixes d and the number of groups; a document is entered in the bands of all sizes it could link with. Empty groups are
  entered only for the few documents whose filled groups do not outnumber d, which keeps the lookup complete and free of one hot entry.
  Below 85 % groups would hold two or three shingles only and there would be very many. There the entries are the first
  n - ceil(t * n) + 1 shingles of a set in one order of all shingles; sets that link have one of these in common. The order puts
  frequent shingles last, by counts over all documents; any order gives the same links.
* Count vectors. The numbers of shingles in DIMS groups make a point; the overlap of two sets is at most the sum of
  the smaller coordinates. Pages of the directory are joined by an R-tree over these points: node boxes carry the
  largest coordinates and the smallest size, and node pairs whose bound is too low are pruned.
  Unrelated sets of n shingles stay below a threshold of 80 % only if there are more than about n / 25 groups, so sets of more than FINE_FROM shingles
  carry a second vector of FINE groups, and pairs of these have to pass its bound too.

A page is cut where the next larger size is out of reach of a link, before anything else is done with it.
Pairs that the bounds allow are never listed: they join documents to clusters, and as every link is such a pair, no link leaves a cluster. First every entry is
compared with the smallest document of its page, which joins near copies without pairing them all. Only pages that still hold several clusters go on to the
tree join, in blocks of bounded size, and a task there keeps only pairs that join two clusters. Then the sets of each cluster meet in one task, once, in blocks
of about BLOCK shingles: overlaps are counted on the sets, and a task yields only links that join two components. Clusters of several blocks are first
linked within their blocks and with the cluster's smallest document; every two blocks meet only if the cluster is then still in several components.
Components need no more than that.

What moves between tasks is kept small: count vectors travel packed, pages are dealt into blocks before vectors join them, and before texts are shuffled
a bitmap of fixed size leaves out most documents that no cluster names; the join behind it decides.

Sets are held as hashes: shingles of 64 bits, and a class is told by its size and two sums of 64 bits over mixed shingles. Classes have numbers of their
own, so rows that repeat a doc_id with other texts are documents of their own; only the result names components by doc_id.

Defined cases: null text, and text without words, has no shingles and links with nothing; with fewer words than a shingle the whole
sequence is the one shingle; rows that share a doc_id but not the shingles link only by their sets; a row without doc_id links with nothing;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, ship
from .worker import BUDGET, Recent, held

DIMS = 512
FINE, FINE_FROM = 4096, 4096
PAGE = 1024
#: Shingles of a block of a cluster; a task holds two blocks of sets.
BLOCK = 1 << 21
#: Bits of the map of the documents that clusters name; with more of them it lets more others pass.
NAMED = 1 << 24
NODE = 16
BAND = 1.5
#: Counters a task keeps while it counts shingles.
COUNTERS = 1 << 17
GROUPS_FROM = 85
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_KEY_BITS = np.uint64(14)  # entries keep 50 bits; a chance collision costs one comparison


def _mix(x: np.ndarray, by: np.uint64 = _A) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of hashed shingles; remembers the hashes of words it has met lately."""

    def __init__(self, words: int):
        self.words = words
        self.known = Recent(BUDGET // 2)

    def __call__(self, text: str | None) -> np.ndarray:
        units = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not units:
            return np.zeros(0, np.uint64)
        self.known.turn()
        new = self.known.missing(set(units))
        self.known.put(new, list(map(xxhash.xxh3_64_intdigest, new)))
        h = np.fromiter(map(self.known.now.__getitem__, units), np.uint64, len(units))
        k = min(self.words, len(h))
        rolled = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            rolled = _mix(rolled * _C + h[i : len(h) - k + 1 + i], _D)
        return np.unique(rolled)


def shingler(words: int) -> Shingler:
    """This worker's shingler."""
    return held(("shingles", words), lambda: Shingler(words))


def bands(limit: int = 1 << 40) -> list[int]:
    """The smallest size of each band."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


_BANDS = np.array(bands())


def entries(s: np.ndarray, percent: int) -> np.ndarray:
    """The directory keys of a set, for links at percent / 100 and over."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    own = int(np.searchsorted(_BANDS, n, side="right")) - 1
    least = -(-n * percent // 100)  # the smallest partner
    first = int(np.searchsorted(_BANDS, max(1, least), side="right")) - 1
    out = []
    for band in range(first, own + 1):
        high = int(_BANDS[band + 1]) - 1
        d = high * (100 - percent) // percent
        if d == 0:
            continue  # such sets link only when they are equal
        groups = d + 2
        g = ((s >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(g, kind="stable")
        at = np.flatnonzero(np.diff(g[order], prepend=-1))
        filled = g[order][at]
        content = np.add.reduceat(_mix(s, _C)[order], at)
        content += np.diff(np.append(at, n)).astype(np.uint64) * _D
        if len(filled) <= d:
            empty = np.setdiff1d(np.arange(groups), filled)
            filled = np.concatenate([filled, empty])
            content = np.concatenate([content, np.zeros(len(empty), np.uint64)])
        out.append(_mix(content + _mix(filled.astype(np.uint64) * _A + np.uint64(band + 1)), _D) >> _KEY_BITS)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def first_entries(s: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The directory keys of a set by the order of shingles: frequent ones last."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    length = n + (-n * percent) // 100 + 1
    late = np.zeros(n, bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    return (s[np.lexsort((s, late))][:length] >> _KEY_BITS).astype(np.int64)


def _thinned(found: np.ndarray, n: np.ndarray, most: int = COUNTERS) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` counters: all are lowered by the count that the next one has, and those at zero go. A count is never too high."""
    if len(n) <= most:
        return found, n
    n = n - np.partition(n, len(n) - most - 1)[len(n) - most - 1]
    return found[n > 0], n[n > 0]


def frequent_shingles(docs: DataFrame, words: int, most: int = 200_000) -> np.ndarray:
    """Sorted shingles that many documents hold, of all documents.

    A task counts with at most COUNTERS counters (the heavy-hitter summary of Misra and Gries), so a shingle that a share of more than 1 / COUNTERS
    of its shingles are is never missed. The `most` shingles with the largest sums come to the driver.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = shingler(words)
        found, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            sets, size = [], 0
            texts = batch.column(0)
            for k in range(len(texts) + 1):
                if k < len(texts):
                    sets.append(shingle(texts[k].as_py()))
                    size += len(sets[-1])
                if sets and (size > 1 << 20 or k == len(texts)):
                    own, m = np.unique(np.concatenate(sets), return_counts=True)
                    both, at = np.unique(np.concatenate([found, own]), return_inverse=True)
                    found, n = _thinned(both, np.bincount(at, np.concatenate([n, m]), len(both)).astype(np.int64))
                    sets, size = [], 0
        more = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(found[more].astype(np.int64)), pa.array(n[more])], names=["s", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter("n >= 3")
    got = counted.orderBy(F.desc("n"), "s").limit(most).toPandas()
    return np.sort(got["s"].to_numpy(np.int64).astype(np.uint64))


def counts(s: np.ndarray) -> bytes:
    """The count vector of a set: a scale, and a byte for each group. A count is at most byte * scale, so bounds on overlaps hold. A large set's fine vector follows."""
    return b"".join(_counted(s, dims) for dims in ((DIMS, FINE) if len(s) > FINE_FROM else (DIMS,)))


def packed(vector: bytes) -> bytes:
    """A count vector as it travels. Counts are small numbers without order, so they are Huffman-coded only."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return z.compress(vector) + z.flush()


def unpacked(sent: bytes) -> bytes:
    return zlib.decompress(sent, -15)


def _counted(s: np.ndarray, dims: int) -> bytes:
    n = np.bincount((s & np.uint64(dims - 1)).astype(np.int64), minlength=dims)
    scale = max(1, -(-int(n.max()) // 255))
    return scale.to_bytes(4, "little") + (-(-n // scale)).astype(np.uint8).tobytes()


def _numbers(raw: bytes, dims: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 4 + dims)
    return rows[:, 4:] * np.ascontiguousarray(rows[:, :4]).view("<u4").astype(np.int32)


def points(vectors: list[bytes]) -> np.ndarray:
    """Count vectors as rows of numbers."""
    return _numbers(b"".join([v[: 4 + DIMS] for v in vectors]), DIMS)


def fine_enough(left: list[bytes], right: list[bytes], need: np.ndarray) -> np.ndarray:
    """Which pairs (left, right) may overlap by need after their fine vectors; True where one of them has none."""
    out = np.ones(len(left), bool)
    both = [k for k, (x, y) in enumerate(zip(left, right, strict=True)) if len(x) > 4 + DIMS and len(y) > 4 + DIMS]
    for at in range(0, len(both), 128):
        own = both[at : at + 128]
        x, y = (_numbers(b"".join([side[k][4 + DIMS :] for k in own]), FINE) for side in (left, right))
        out[own] = np.minimum(x, y).sum(axis=1) >= need[own]
    return out


def describe(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A row number, doc_id and a hash of the text, n_shingles, two hashes of the set, its directory keys and its packed count vector."""
    frequent = None
    if percent < GROUPS_FROM:
        frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))

    def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = shingler(words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [shingle(t) for t in part.column(1).to_pylist()]
                keys = [entries(s, percent) if frequent is None else first_entries(s, percent, frequent.value) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                sums = [[np.uint64(0), np.uint64(0)] if not len(s) else [_mix(s, _A).sum(), _mix(s, _B).sum()] for s in sets]
                sums = np.array(sums, np.uint64).astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sums[:, 0]),
                        pa.array(sums[:, 1]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                        pa.array([packed(counts(s)) for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "t", "n_shingles", "h1", "h2", "keys", "point"],
                )

    out = "doc_id long, t long, n_shingles long, h1 long, h2 long, keys array<long>, point binary"
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))).mapInArrow(one, out)
    return made.withColumn("row", F.monotonically_increasing_id())


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap of sets of these sizes that makes 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class RTree:
    """Count vectors in nodes of NODE neighbours: points sorted by size, boxes of largest coordinates and smallest sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], points[:, 1], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        at = np.arange(0, len(sizes), NODE)
        self.high = np.maximum.reduceat(self.points, at, axis=0)
        self.small, self.large = np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at)

    def members(self, node: int) -> slice:
        return slice(node * NODE, (node + 1) * NODE)


def tree_join(left: RTree, right: RTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of all pairs whose bound reaches the threshold."""
    for i in range(len(left.high)):
        bound = np.minimum(left.high[i], right.high).sum(axis=1)
        need = least_overlap(left.small[i], right.small, percent)
        near = (100 * left.large[i] >= percent * right.small) & (100 * right.large >= percent * left.small[i])
        own = left.members(i)
        for j in np.flatnonzero((bound >= need) & near):
            other = right.members(j)
            shared = np.minimum(left.points[own, None], right.points[None, other]).sum(axis=2)
            sizes = left.sizes[own, None], right.sizes[None, other]
            a, b = np.nonzero(shared >= least_overlap(*sizes, percent))
            if len(a):
                yield left.order[a + own.start], right.order[b + other.start]


def spanning_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Places of linked sets, as many links as join the labels that links reach. With side, only sets of different sides are compared.

    A set is compared with all sets behind it at once: its shingles are marked, and the marks under the others are summed.
    """
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n, label = n[order], label[order].copy()
    side = None if side is None else side[order]
    _, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    shared_by = np.bincount(ids)[ids] > 1
    ends = np.append(0, np.cumsum(shared_by))[np.append(0, np.cumsum(n))]
    ids = ids[shared_by]
    marks = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    last = np.searchsorted(n, n * 100 // percent, side="right")  # a larger set cannot link
    out = []
    for k in range(len(n) - 1):
        live = label[k + 1 : last[k]] != label[k]
        if side is not None:
            live &= side[k + 1 : last[k]] != side[k]
        at = np.flatnonzero(live) + k + 1
        if not len(at):
            continue
        own = ids[ends[k] : ends[k + 1]]
        marks[own] = True
        lo, hi = at[0], at[-1] + 1
        sums = np.append(0, np.cumsum(marks[ids[ends[lo] : ends[hi]]]))
        marks[own] = False
        shared = sums[ends[at + 1] - ends[lo]] - sums[ends[at] - ends[lo]]
        at = at[(100 * shared >= percent * (n[k] + n[at] - shared)) & (shared > 0)]
        while len(at):
            out.append((int(order[k]), int(order[at[0]])))
            label[label == label[at[0]]] = label[k]
            at = at[label[at] != label[k]]
    return out


def _named_texts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, t and text of all documents whose doc_id and t are in named, and of a few others."""
    place = F.pmod(F.xxhash64("doc_id", "t"), F.lit(NAMED)) + 1  # the functions for bitmaps count from 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    bits = np.zeros(NAMED // 8, np.uint8)
    for r in named.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect():
        at = (r.bucket - 1) * len(r.bits)
        bits[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(3).to_numpy()
            on = sent.value[p >> 3] >> (p & 7).astype(np.uint8) & 1
            yield batch.select([0, 1, 2]).filter(pa.array(on.astype(bool)))

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return texts.withColumn("place", place - 1).mapInArrow(keep, "doc_id long, t long, text string")


def _cluster_links(dealt: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links u, v that join the components within (cluster, i, j); rows of dealt have rep, doc_id, t, cluster, i, j, block and component."""

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = shingler(words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [shingle(t).tobytes() for t in part.column(6).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(sets, pa.binary())], names=["cluster", "i", "j", "rep", "block", "component", "s"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reps, blocks, comps, sets = None, [], [], [], []

        def flush() -> pa.RecordBatch:
            side = None if own[1] == own[2] else np.array(blocks, np.int64)
            found = spanning_links(sets, np.array(comps, np.int64), side, percent)
            out = np.array([(reps[x], reps[y]) for x, y in found], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])

        for batch in batches:
            for k, (*at, rep, block, comp) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True)):
                if at != own:
                    if len(reps) > 1:
                        yield flush()
                    own, reps, blocks, comps, sets = at, [], [], [], []
                if reps and reps[-1] == rep:
                    continue  # a class's text may occur in several rows with its doc_id
                reps.append(rep), blocks.append(block), comps.append(comp)
                sets.append(np.frombuffer(batch.column(6)[k].as_py(), np.uint64))
        if len(reps) > 1:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # The one place where texts are shuffled.
    found = _named_texts(docs, dealt).join(dealt, ["doc_id", "t"]).select("cluster", "i", "j", "rep", "block", "component", "text")
    loaded = found.mapInArrow(load, "cluster long, i long, j long, rep long, block long, component long, s binary")
    sorted_ = loaded.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep")
    return sorted_.mapInArrow(join, "u long, v long")


def _verified(near: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """Links u, v that join all that links join, out of clusters (node, component) that no link leaves."""
    own = reps.select("rep", "doc_id", "t", "n_shingles").join(near.toDF("rep", "cluster"), "rep")
    sizes = own.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / BLOCK).alias("blocks"), F.min("rep").alias("pivot"))
    placed = own.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("n_shingles")
    placed = scratch.table("placed", placed)
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    # Each block by itself, with the smallest member of the cluster.
    alone = F.when(F.col("rep") == F.col("pivot"), every).otherwise(F.array("block"))
    first = placed.withColumn("i", F.explode(alone)).withColumn("j", F.col("i")).withColumn("component", F.col("rep"))
    columns = ["rep", "doc_id", "t", "cluster", "i", "j", "block", "component"]
    links = scratch.table("links-1", _cluster_links(first.select(*columns), docs, words, percent))
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return links
    # Then every two blocks of the clusters that are still in several parts.
    labelled = large.join(components(links, scratch, "blocks").withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    labelled = scratch.table("labelled", labelled)
    parted = labelled.groupBy("cluster").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("cluster")
    pairs = labelled.join(parted, "cluster").withColumn("other", F.explode(every)).filter("other <> block")
    pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return links.union(scratch.table("links-2", _cluster_links(pairs.select(*columns), docs, words, percent)))


def _bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that size and summed coordinate minima allow."""
    p = reps.select("rep", "n_shingles", "point")
    both = pairs.join(p.toDF("a", "na", "pa"), "a").join(p.toDF("b", "nb", "pb"), "b").filter(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    )

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                left, right = ([unpacked(v) for v in part.column(k).to_pylist()] for k in (3, 5))
                a, b, na, nb = (part.column(k).to_numpy() for k in (0, 1, 2, 4))
                need = least_overlap(na, nb, percent)
                on = np.flatnonzero(np.minimum(points(left), points(right)).sum(axis=1) >= need)
                on = on[fine_enough([left[k] for k in on], [right[k] for k in on], need[on])]
                yield pa.RecordBatch.from_arrays([pa.array(a[on]), pa.array(b[on])], names=["a", "b"])

    return both.select("a", "b", "na", "pa", "nb", "pb").mapInArrow(keep, "a long, b long")


def _by_size(shared: DataFrame, percent: int) -> DataFrame:
    """Pages cut where the next larger size is out of reach of a link; parts of one document go."""
    page = Window.partitionBy("key").orderBy("n_shingles", "rep")
    cut = (100 * F.lag("n_shingles").over(page) < percent * F.col("n_shingles")).cast("int")
    parts = shared.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("part", F.sum("cut").over(page))
    parts = parts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "part"))).filter("n > 1")
    return parts.select(F.xxhash64("key", "part").alias("key"), "rep", "n_shingles")


def _page_pairs(members: DataFrame, percent: int, vectors: DataFrame | None = None) -> DataFrame:
    """Candidate pairs that join components within pages, by tree joins of blocks of at most about PAGE entries.

    vectors: rep and packed count vector, if members have no vectors of their own.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PAGE).alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # Block i meets every block j >= i, in a task of its own.
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "rep",
        "component",
        "n_shingles",
        *(["point"] if vectors is None else []),
    )
    if vectors is not None:
        spread = spread.join(vectors.toDF("rep", "point"), "rep").select("key", "i", "j", "block", "rep", "component", "n_shingles", "point")
    load = bytes if vectors is None else unpacked

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []

        def flush() -> pa.RecordBatch:
            _, i, j = own
            block, rep, comp, size = (np.array([r[k] for r in rows], np.int64) for k in range(4))
            raw = [load(r[4]) for r in rows]
            at = points(raw)
            a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
            label, found = comp.copy(), []
            if len(a) and len(b):
                left = RTree(at[a], size[a])
                right = left if i == j else RTree(at[b], size[b])
                for x, y in tree_join(left, right, percent):
                    x, y = a[x], b[y]
                    on = np.flatnonzero(label[x] != label[y])
                    on = on[fine_enough([raw[k] for k in x[on]], [raw[k] for k in y[on]], least_overlap(size[x[on]], size[y[on]], percent))]
                    x, y = x[on], y[on]
                    while len(x):
                        found.append((rep[x[0]], rep[y[0]]))
                        label[label == label[y[0]]] = label[x[0]]
                        on = label[x] != label[y]
                        x, y = x[on], y[on]
            out = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != own and rows:
                    yield flush()
                    rows = []
                own = key, i, j
                rows.append(row)
        if rows:
            yield flush()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return spread.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(join, "a long, b long").distinct()


def link_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id (smallest doc_id reachable by links)."""
    plain, named = _linked(docs, words, percent)
    return plain.join(named, _SAME, "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("least", "doc_id").alias("class_id"),
        F.coalesce("lowest", "doc_id").alias("component_id"),
    )


_SAME = ["n_shingles", "h1", "h2"]


def _linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, t (a hash of the text) and set of every row (no set without doc_id); and of every set least, its smallest doc_id, its component, and lowest, that one's smallest doc_id."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ngram-join")
    rows = scratch.table("rows", describe(docs, words, percent))
    same = _SAME
    # A class goes by the number of its first row; least is its smallest doc_id.
    classes = scratch.table(
        "classes",
        rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")),
    )
    # Pages are made of rows; of a class only one goes on from there.
    members = rows.filter("doc_id IS NOT NULL").select(F.explode("keys").alias("key"), "row")
    pages = members.groupBy("key").agg(F.min("row").alias("x"), F.max("row").alias("y")).filter("x <> y").select("key")
    shared = scratch.table("entries", members.join(pages, "key"))
    plain = scratch.table("plain", rows.drop("keys", "point"))
    own = plain.filter("doc_id IS NOT NULL").join(classes, same).select("row", "rep", "n_shingles")
    shared = scratch.table("shared", _by_size(shared.join(own, "row").select("key", "rep", "n_shingles").distinct(), percent))
    live = shared.select(F.col("rep").alias("row")).distinct()
    reps = scratch.table("reps", rows.join(live, "row", "left_semi").select(F.col("row").alias("rep"), "doc_id", "t", "n_shingles", "point"))
    scratch.drop("rows", "entries")
    pivots = shared.groupBy("key").agg(F.min(F.struct("rep", "n_shingles")).alias("pivot"))
    star = shared.join(pivots, "key").filter(
        (F.col("rep") != F.col("pivot.rep"))
        & (100 * F.least("n_shingles", "pivot.n_shingles") >= percent * F.greatest("n_shingles", "pivot.n_shingles"))
    )
    star = star.select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b")).distinct()
    star = scratch.table("star", _bounded(star, reps, percent))
    near = scratch.table("near", components(star.toDF("u", "v"), scratch, "near"))
    labelled = (
        shared.join(near.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
        .distinct()
    )
    mixed = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
        .filter("x <> y AND n > 2")
        .select("key")
    )
    left = scratch.table("left", labelled.join(mixed, "key"))
    rest = scratch.table("rest", _page_pairs(left, percent, reps.select("rep", "point")))
    scratch.drop("left", "shared")
    if not rest.isEmpty():
        near = scratch.table("clusters", components(star.union(rest).toDF("u", "v"), scratch, "clusters"))
    links = _verified(near, reps, docs, scratch, words, percent)
    first = scratch.table("first", components(links, scratch, "first"))
    placed = classes.join(first.withColumnRenamed("node", "rep"), "rep", "left").select(
        *same, "least", F.coalesce("component", "rep").alias("component")
    )
    lowest = placed.groupBy("component").agg(F.min("least").alias("lowest"))
    named = scratch.table("named", placed.join(lowest, "component").select(*same, "least", "component", "lowest"))
    for name in ("classes", "reps", "star", "near", "clusters", "placed", "blocks", "labelled", "first", "rest", "links-1", "links-2"):
        scratch.drop(name)
    without = F.when(F.col("doc_id").isNotNull(), F.col("h1"))  # such rows meet no set
    return plain.select("doc_id", "t", "n_shingles", without.alias("h1"), "h2"), named


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document, one of the smallest doc_id, of each component; columns as they are. Rows equal in both doc_id and text stay together."""
    plain, named = _linked(docs, words, percent)
    own = plain.filter("doc_id IS NOT NULL").join(named, _SAME, "left")
    alone = own.filter("component IS NULL").select("doc_id", "t")
    first = own.filter("doc_id = lowest").groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("of")).select("of.*")
    found = alone.union(first).distinct().select(F.col("doc_id").alias("_keep"), F.col("t").alias("_t"))
    kept = docs.join(
        found, (F.col("doc_id").cast("long") == F.col("_keep")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_t")), "left_semi"
    )
    return kept.unionByName(docs.filter("doc_id IS NULL"))
