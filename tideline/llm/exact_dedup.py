"""Exact duplicate removal with streaming state (DataFrame functions only).

Texts are equal when they are identical after lower-casing A-Z. A stateful stream keeps, for each
digest, the identifier and the content locator of the row that stays and the number of rows seen. The
state lives in RocksDB, has no watermark and therefore never expires. Rows that hit an existing digest are
compared byte by byte with the kept row, which is read at its locator (the file it came from); rows whose bytes differ (a digest collision) are
grouped by their full text instead. The stream runs in a session of its own, so its settings touch nothing else. Large groups are compared in
parts of about PART rows, each with a copy of the kept text.

Defined cases: null text counts as empty; of equal texts the largest doc_id stays; a null doc_id is
smaller than any other; rows that repeat both doc_id and text count in the group size and one of them
stays; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

PART = 1024
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Without these every state partition reserves megabytes of disk whatever it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() is exact, and faster, where a text is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _state(digests: DataFrame, scratch: Scratch, files_per_batch: int) -> DataFrame:
    """Run the stateful stream over the digest table to its end; one row per digest."""
    spark = scratch.spark.newSession()
    for k, v in scratch.spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    for k, v in _STREAM_CONF.items():  # the state store's own settings don't count as modifiable, but can be set
        spark.conf.set(k, v)
    stream = (
        spark.readStream.schema(digests.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(scratch.at("digests"))
        .groupBy("digest", "n_bytes")
        .agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    )

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(scratch.at(f"state/batch={batch_id}"))

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(emit)
        .option("checkpointLocation", scratch.at("stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = scratch.spark
    # A digest that several batches touched has several rows; both values only ever grow.
    emitted = (
        spark.read.schema(stream.schema).parquet(scratch.at("state/batch=*"))
        if query.lastProgress
        else spark.createDataFrame([], stream.schema)
    )
    return emitted.groupBy("digest", "n_bytes").agg(
        F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size")
    )


def duplicate_groups(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 1000,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    digest is the fingerprint of the normalised text that keys the state. Any function is right, since
    bytes are compared on hits; a weak one only costs more comparisons.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = normalised(F.col("text"))
    scratch.table(
        "digests",
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            digest(text).alias("digest"),
            F.octet_length(text).alias("n_bytes"),
            F.input_file_name().alias("locator"),
            sha256(text).alias("text_sha256"),
        ),
    )
    seen = scratch.read("digests", _digest_schema(docs, digest))
    state = scratch.table("groups", _state(seen, scratch, files_per_batch))
    rows = scratch.table(
        "rows",
        seen.join(state, ["digest", "n_bytes"]).select(
            "doc_id",
            "text_sha256",
            F.col("keeper.doc_id").alias("keep_id"),
            F.col("keeper.locator").alias("keep_at"),
            "group_size",
            F.monotonically_increasing_id().alias("row"),
        ),
    )
    scratch.drop("digests", "groups", "state", "stream")
    parts = F.ceil(F.col("group_size") / PART).cast("int").alias("parts")
    shared = rows.filter("group_size > 1").select(F.col("doc_id").alias("of"), F.col("text_sha256").alias("sha"), "keep_id", "keep_at", parts).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("content"), F.input_file_name().alias("locator"))
    texts = scratch.table(
        "texts",
        own.withColumn("text_sha256", sha256(F.col("content")))
        .join(shared, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_sha256") == F.col("sha")))
        .select("doc_id", "keep_id", "keep_at", "locator", "parts", "text_sha256", "content"),
    )
    # Several texts can share a weak digest, and then the kept doc_id too; the largest of the texts there decides.
    at_keeper = texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("locator").eqNullSafe(F.col("keep_at")))
    group = ["keep_id", "parts"] if digest is not sha256 else ["keep_id", "text_sha256", "parts"]
    kept_texts = at_keeper.groupBy(*group).agg(F.max("content").alias("kept_content"))
    kept_texts = kept_texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*[F.col(c).alias("_" + c) for c in group], "part", "kept_content")
    hits = texts.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")) | F.lit(digest is not sha256))
    hits = hits.withColumn("own_part", F.pmod(F.xxhash64("doc_id", "locator"), F.col("parts")).cast("int"))
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in group] + [F.col("own_part") == F.col("part")]
    differ = hits.join(kept_texts, same).filter("content <> kept_content")
    if differ.select("keep_id").isEmpty():
        scratch.drop("texts")
    else:
        # Full bytes tell these rows apart, so full bytes are their key.
        split = differ.select("keep_id").distinct()
        again = texts.join(split, "keep_id", "left_semi")
        by_text = again.groupBy("keep_id", "content", "text_sha256").agg(F.max("doc_id").alias("new_id"))
        sizes = rows.join(split, "keep_id", "left_semi").groupBy("keep_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
        renewed = by_text.join(sizes, ["keep_id", "text_sha256"]).select("keep_id", "text_sha256", "new_id", "n")
        rows = (
            rows.join(renewed, ["keep_id", "text_sha256"], "left")
            .withColumn("group_size", F.coalesce("n", "group_size"))
            .withColumn("keep_id", F.when(F.col("n").isNotNull(), F.col("new_id")).otherwise(F.col("keep_id")))
        )
    return _mark_kept(rows)


def _digest_schema(docs: DataFrame, digest: Callable[[Column], Column]):
    text = normalised(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(text).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.input_file_name().alias("locator"),
        sha256(text).alias("text_sha256"),
    ).schema


def _mark_kept(rows: DataFrame) -> DataFrame:
    """kept is true for one row of each group, also where a row repeats."""
    first = (
        rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("doc_id", "text_sha256")
        .agg(F.min("row").alias("row"))
        .select("row", F.lit(True).alias("first"))
    )
    return rows.join(first, "row", "left").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce("first", F.lit(False)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without its exact duplicates; columns as they are."""
    from pyspark.sql import Window

    kept = duplicate_groups(docs).filter("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    joined = docs.withColumn("_own", sha256(normalised(F.col("text")))).join(
        kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")) & (F.col("_own") == F.col("_sha"))
    )
    nth = F.row_number().over(Window.partitionBy("_keep", "_sha").orderBy(F.lit(1)))
    return joined.withColumn("_nth", nth).filter("_nth = 1").select(*docs.columns)
