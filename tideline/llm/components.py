"""Connected components of a graph that stays distributed.

Alternates two steps: every node hands its larger neighbours the smallest node it knows of, then every node
links itself and its smaller neighbours to the smallest of them. Each step is an aggregation and an
equi-join; each round is written to the shared folder. The edges end as stars around each component's smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_ROUNDS = 60
#: Edges of a file. Rounds never add edges, so one round's number tells how many files the next one needs.
FILE_EDGES = 1 << 17


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("w"))
    moved = edges.join(least, "u").filter("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return moved.union(least.select("u", F.col("w").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, component (its smallest node) of every node that has an edge (columns u, v, of any direction)."""
    ends = F.when(F.col("u") > F.col("v"), F.struct("u", "v")).otherwise(F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    now = scratch.table(f"{name}-0", edges.filter("u <> v").select(ends.alias("e")).select("e.u", "e.v").distinct())
    state, n = None, now.count()
    for k in range(1, MAX_ROUNDS + 1):
        now = scratch.table(f"{name}-{k}", _small_star(_large_star(now)).coalesce(-(-n // FILE_EDGES) or 1))
        row = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        scratch.drop(f"{name}-{k - 1}")
        if tuple(row) == state:
            break
        state, n = tuple(row), row[0]
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
