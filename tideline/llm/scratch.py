"""Intermediate tables in the folder the cluster shares, and the code the workers need.

Every operator that has to cut lineage writes a table here, so a lost executor costs a re-read and
not a recomputation, and nothing depends on a machine-local folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_shipped: set[str] = set()
_made: list["Scratch"] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A temporary folder stands in only in one-process local mode."""
    found = spark.conf.get(_KEY, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{_KEY} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for clusters that don't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tideline-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tideline_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


class Scratch:
    """One operator run's folder of tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tideline/{name}-{uuid.uuid4().hex}"
        _made.append(self)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write df and read it back; the result has no lineage but the files."""
        df.write.mode("overwrite").parquet(self.at(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(conf).delete(path, True)


def made() -> list[Scratch]:
    """The runs so far whose tables are still there, oldest first."""
    return list(_made)


def release(runs: list[Scratch]) -> None:
    """Remove the tables of these runs; for callers that have written whatever they need of the results."""
    for scratch in runs:
        scratch.drop("")
        if scratch in _made:
            _made.remove(scratch)


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
