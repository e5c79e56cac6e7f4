"""Best-fit packing of documents into sequences of a fixed number of tokens.

Items are documents, or the pieces of a document that is longer than a sequence (all of them full but
the first). At most two items above a third of the capacity share a sequence, so these are matched first:
from the longest down, each takes the longest partner that still fits. Smaller items then go, from the
longest down, into the smallest gap that takes them; a new sequence opens when none does.

The matching needs only how many items there are of each length, at most `capacity` numbers. It runs
on the driver over runs of equal sequences and yields runs (length, ranks, sequences, offset). An item
finds its run by its length and its rank among the items of that length, so nothing but lengths and ids
is shuffled, and no key gathers in one task: ranks are counted in blocks of each length.

Defined cases: null and empty texts give one end token; equal documents are packed like any others; rows
that repeat a doc_id are separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, ship
from .tokens import encoder
from .worker import blocks

CAPACITY = 2048
#: Bytes of texts that are encoded together; the arrays over them are what a worker peaks with.
BLOCK = 1 << 21


@dataclass(frozen=True)
class Run:
    """Items of one length, by rank from rank0 on, go `per` to a sequence into sequences from bin0 on, from offset on."""

    length: int
    rank0: int
    count: int
    bin0: int
    per: int
    offset: int


class _Gaps:
    """Runs of equal sequences by the room they have left; finds the smallest room that is enough."""

    def __init__(self, capacity: int):
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.bits = np.zeros(capacity + 1, dtype=bool)

    def put(self, gap: int, bin0: int, count: int) -> None:
        if gap and count:
            self.by.setdefault(gap, []).append((bin0, count))
            self.bits[gap] = True

    def take(self, least: int) -> tuple[int, int, int] | None:
        at = int(np.argmax(self.bits[least:])) + least
        if not self.bits[at]:
            return None
        bin0, count = self.by[at].pop()
        if not self.by[at]:
            self.bits[at] = False
        return at, bin0, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """The runs that place histogram[length] items of each length, and the number of sequences."""
    left = {n: c for n, c in histogram.items() if c}
    rank = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps, bins = _Gaps(capacity), 0

    def place(length: int, count: int, bin0: int, per: int, offset: int) -> None:
        runs.append(Run(length, rank[length], count, bin0, per, offset))
        rank[length] += count
        left[length] -= count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m]), None)
            if mate is None:
                count = left[n]
                place(n, count, bins, 1, 0)
            elif mate == n:
                count = left[n] // 2
                if not count:  # a single one is left; it may still match a shorter item
                    mate = next((m for m in large if m < n and m <= capacity - n and left[m]), None)
                    count = 1
                    place(n, 1, bins, 1, 0)
                    if mate:
                        place(mate, 1, bins, 1, n)
                        gaps.put(capacity - n - mate, bins, 1)
                    else:
                        gaps.put(capacity - n, bins, 1)
                    bins += 1
                    continue
                place(n, 2 * count, bins, 2, 0)
                gaps.put(capacity - 2 * n, bins, count)
                bins += count
                continue
            else:
                count = min(left[n], left[mate])
                place(n, count, bins, 1, 0)
                place(mate, count, bins, 1, n)
                gaps.put(capacity - n - mate, bins, count)
                bins += count
                continue
            gaps.put(capacity - n, bins, count)
            bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            found = gaps.take(n)
            if found is None:
                per = capacity // n
                found = capacity, bins, -(-left[n] // per)
                bins += found[2]
            gap, bin0, count = found
            per = gap // n
            full = min(count, left[n] // per)
            offset = capacity - gap
            if full:
                place(n, full * per, bin0, per, offset)
                gaps.put(gap - per * n, bin0, full)
            if full < count and left[n]:  # the last sequence takes what is left
                rest = left[n]
                place(n, rest, bin0 + full, rest, offset)
                gaps.put(gap - rest * n, bin0 + full, 1)
                full += 1
            gaps.put(gap, bin0 + full, count - full)
    return runs, bins


def token_pieces(
    docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with with_ids the ids as 4-byte words."""
    ship(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK):
                ids, firsts = encode(batch.column(1).slice(lo, hi - lo))
                rows: list[tuple] = []
                for doc, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                    n = b - a + 1
                    first = n if n <= capacity else n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = ids[a + x : min(a + y, b)].tobytes() + (end if y == n else b"")
                        rows.append((doc, k, x, y - x, zlib.crc32(own), own if with_ids else None))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, _KINDS[: 5 + with_ids], strict=False)],
                    names=_NAMES[: 5 + with_ids],
                )

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, out)


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def place_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items, which has `length` (1 to capacity), with sequence_id and offset."""
    spark = items.sparkSession
    blocks = max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    key = F.xxhash64(*[F.col(c) for c in items.columns if c in ("doc_id", "piece", "start", "ids_crc32")] or [F.col("length")])
    own = Window.partitionBy("length", "_block").orderBy("_key")
    scratch = Scratch(spark, "packing")
    ranked = scratch.table(
        "ranked",
        items.withColumn("_key", key)
        .withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(blocks)))
        .withColumn("_nth", F.row_number().over(own) - 1),
    )
    counts = ranked.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    total = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(total, capacity)
    table = spark.sparkContext.broadcast(_lookup(runs))
    ship(spark)
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    width = len(items.columns)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rank0, bin0, per, offset = table.value
        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            length = named["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            rank = named["_rank"].to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(base, (length << 48) + rank, side="right") - 1
            nth = rank - rank0[at]
            seq, off = bin0[at] + nth // per[at], offset[at] + nth % per[at] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(seq), pa.array(off)],
                names=[*batch.schema.names[:width], "sequence_id", "offset"],
            )

    return (
        ranked.join(starts, ["length", "_block"])
        .select(*items.columns, (F.col("_nth") + F.col("_before")).cast("long").alias("_rank"))
        .mapInArrow(find, schema)
    )


def _lookup(runs: list[Run]) -> tuple[np.ndarray, ...]:
    """Sorted arrays. There are at most 2 * capacity groups of equal sequences with at most 63 lengths in each."""
    got = np.array(
        [((r.length << 48) + r.rank0, r.rank0, r.bin0, r.per, r.offset) for r in runs] or [(0, 0, 0, 1, 0)], dtype=np.int64
    )
    return tuple(got[np.argsort(got[:, 0], kind="stable")].T.copy())


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Every piece of every document with the sequence that holds it and its place there."""
    pieces = Scratch(docs.sparkSession, "pieces").table("pieces", token_pieces(docs, path, end_id, capacity, with_ids))
    return place_items(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack_documents(with_ids=True): sequence_id, n_tokens, ids as 4-byte words."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select(
        "sequence_id", "n_tokens", F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
