"""Files on any file system that Spark reads, and decoding of timestamps."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000

#: The layouts that text timestamps may have.
LAYOUTS = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def day_of(ts: Column) -> Column:
    return F.floor(ts / DAY).cast("int")


def millis_of(raw: Column) -> Column:
    """Milliseconds from a number, a text of one, or a text in one of the known layouts (UTC); null if it is none."""
    text = raw.cast("string")
    number = text.try_cast("double").cast("long")
    found = [number]
    for layout in LAYOUTS:
        found.append(F.unix_millis(F.try_to_timestamp(text, F.lit(layout))))
    return F.coalesce(*found)
