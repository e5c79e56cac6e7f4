"""Token ids in files of directly addressable codes.

An id is cut into chunks of `width` bits, lowest first. Level k holds the k-th chunk of the ids that
have one, packed bit by bit, and a bitmap with a bit for each of them that says whether another chunk
follows. A rank directory counts the set bits before every 512th position of a bitmap, so the place of an id in the next
level is one directory entry and the bits of at most one block: any token is read without
decoding a block of tokens.

A file (one shard) is, in little-endian order: the magic bytes, the version, the number of documents, tokens, levels
and the width, and of documents without doc_id, which come first; per document its doc_id and its first token within the shard; per level the
number of chunks, the packed chunks, the bitmap and the directory. The store is a Parquet table of shards (part, shard, start, n_docs, n_tokens, data),
since Parquet is the one container that Spark writes to and reads from any file system; `data` is the file.

Documents are dealt by ranges of (doc_id, hash of the text), so one doc_id that many rows share is cut like any other run of rows. Parts
follow one another in doc_id order, and each is cut into shards as it is written; `start` counts from the beginning of the part.

Defined cases: null and empty texts hold the end id alone; documents with equal doc_id keep one order, by a hash of their texts;
a null doc_id sorts first; an empty table has no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, ship
from .tokens import encoder
from .worker import BUDGET, blocks

MAGIC = b"TLDAC2\0\0"
WIDTH = 8
BLOCK = 512
SHARD_TOKENS = 1 << 20
_HEAD = struct.Struct("<8sIQQIIQ")
BROADCAST_BYTES = 32 << 20


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    if width == 8:
        return values.astype(np.uint8).tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if width == 8:
        return data[:n].astype(np.uint32)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_shard(doc_ids: list[int | None], ids: np.ndarray, firsts: list[int], width: int = WIDTH) -> bytes:
    """The file of these documents, those without doc_id first: ids of all of them in order, firsts the place of each one's first id."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = (rest >> np.uint32(width)) > 0
        bitmap = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(more)])[::BLOCK].astype("<u8")
        levels.append((len(rest), _pack_bits(rest & np.uint32((1 << width) - 1), width), bitmap.tobytes(), ranks.tobytes()))
        rest = rest[more] >> np.uint32(width)
        if not len(rest):
            break
    nameless = sum(i is None for i in doc_ids)
    out = [_HEAD.pack(MAGIC, 2, len(doc_ids), len(ids), len(levels), width, nameless)]
    out += [np.asarray([0] * nameless + list(doc_ids[nameless:]), "<i8").tobytes(), np.asarray(firsts, "<u8").tobytes()]
    for n, chunks, bitmap, ranks in levels:
        out += [struct.pack("<QQQQ", n, len(chunks), len(bitmap), len(ranks)), chunks, bitmap, ranks]
    return b"".join(out)


class Shard:
    """A file opened for reading."""

    def __init__(self, data: bytes):
        magic, version, docs, self.n_tokens, levels, self.width, self.nameless = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 2:
            raise ValueError("not a token file of this format")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.firsts = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        at += 16 * docs
        self.levels = []
        for _ in range(levels):
            n, a, b, c = struct.unpack_from("<QQQQ", data, at)
            at += 32
            chunks = np.frombuffer(data, np.uint8, a, at)
            bitmap = np.frombuffer(data, np.uint8, b, at + a)
            ranks = np.frombuffer(data, "<u8", c // 8, at + a + b)
            self.levels.append((n, chunks, bitmap, ranks))
            at += a + b + c

    def token(self, i: int) -> int:
        """The id at place i, without decoding its neighbours."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bitmap, ranks) in enumerate(self.levels):
            bit = i * self.width
            word = int.from_bytes(chunks[bit // 8 : (bit + self.width + 7) // 8].tobytes(), "little") >> bit % 8
            value |= (word & ((1 << self.width) - 1)) << (k * self.width)
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            lo = i // BLOCK * BLOCK
            i = int(ranks[i // BLOCK]) + int(np.unpackbits(bitmap[lo // 8 : i // 8 + 1], bitorder="little")[: i - lo].sum())
        return value

    def all(self) -> np.ndarray:
        """Every id of the shard, level by level."""
        out = np.zeros(self.n_tokens, np.uint32)
        where = np.arange(self.n_tokens)
        for k, (n, chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= _unpack_bits(chunks, n, self.width) << np.uint32(k * self.width)
            where = where[np.unpackbits(bitmap, count=n, bitorder="little").astype(bool)]
        return out

    def document(self, k: int, ids: np.ndarray | None = None) -> np.ndarray:
        """The ids of the k-th document."""
        a = int(self.firsts[k])
        b = int(self.firsts[k + 1]) if k + 1 < len(self.firsts) else self.n_tokens
        return ids[a:b] if ids is not None else np.array([self.token(i) for i in range(a, b)], np.uint32)


def write_store(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, docs_per_shard: int = 1024, width: int = WIDTH, parts: int | None = None
) -> None:
    """Encode every text, add end_id, and write the shards in ascending doc_id order; a shard ends at docs_per_shard documents or SHARD_TOKENS tokens."""
    spark = docs.sparkSession
    ship(spark)

    def built(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, 2 * BUDGET).encode
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, start
            size = np.concatenate(sizes)
            ids = np.concatenate(parts)
            row = [part, shard, start, len(doc_ids), len(ids), write_shard(doc_ids, ids, np.cumsum(size) - size, width)]
            shard, start = shard + 1, start + len(ids)
            doc_ids.clear(), parts.clear(), sizes.clear()
            kinds = [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=_STORE_NAMES)

        for batch in batches:
            for lo, hi in blocks(batch.column(1)):
                ids, firsts = encode(batch.column(1).slice(lo, hi - lo))
                ids = np.insert(ids, firsts[1:], end_id)
                firsts = firsts + np.arange(len(firsts))
                names = batch.column(0).slice(lo, hi - lo).to_pylist()
                at = 0
                while at < len(names):
                    room = max(0, SHARD_TOKENS - sum(map(len, parts)))
                    upto = int(np.searchsorted(firsts, firsts[at] + room, side="right")) - 1
                    upto = max(at + (not doc_ids), min(upto, at + docs_per_shard - len(doc_ids), len(names)))
                    if upto > at:
                        doc_ids += names[at:upto]
                        parts.append(ids[firsts[at] : firsts[upto]])
                        sizes.append(np.diff(firsts[at : upto + 1]))
                    at = upto
                    if at < len(names) or len(doc_ids) == docs_per_shard:
                        yield flush()
        if doc_ids:
            yield flush()

    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    text = F.col("text").cast("string")
    key = ["doc_id", "h", "m"]  # rows that are equal in all else are told apart by their place
    files = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("m"))
        .repartitionByRange(parts, *key)
        .sortWithinPartitions(*key)
        .select("doc_id", "text")
        .mapInArrow(built, "part long, shard long, start long, n_docs long, n_tokens long, data binary")
    )
    files.write.mode("overwrite").option("compression", "none").parquet(path)


_STORE_NAMES = ["part", "shard", "start", "n_docs", "n_tokens", "data"]


def part_starts(store: DataFrame) -> DataFrame:
    """of, base: each part's first token in the whole store. One row a part goes through one task."""
    sizes = store.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("base"))


def read_store(spark, path: str) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids as 4-byte words."""
    store = spark.read.parquet(path)

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_buffer())
                n = len(shard.doc_ids)
                ends = np.append(shard.firsts, shard.n_tokens)
                words = pa.py_buffer(shard.all().astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64(), mask=np.arange(n) < shard.nameless),
                        pa.array(start + shard.firsts, pa.int64()),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * ends).astype("<i4").tobytes()), words]),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    ship(spark)
    starts = part_starts(store)
    if store.select("part").distinct().count() * 16 <= BROADCAST_BYTES:  # beyond it the join shuffles both sides
        starts = F.broadcast(starts)
    return store.join(starts, store.part == starts.of).select((F.col("base") + F.col("start")).alias("start"), "data").mapInArrow(
        decoded, "doc_id long, start long, n_tokens long, ids binary"
    )


def digest_documents(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids' bytes."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write docs as token files in the shared folder and read the files back."""
    scratch = Scratch(docs.sparkSession, "token-store")
    write_store(docs, scratch.at("store"), vocabulary, end_id)
    return read_store(docs.sparkSession, scratch.at("store"))


__all__ = ["Shard", "digest_documents", "read_store", "round_trip", "write_shard", "write_store"]
