"""Connected components of an edge table by alternating large-star and small-star steps.

Each step maps an edge list to a smaller or equal one with the same components, until every
component is a star around its smallest node. Minima are pre-aggregated before each shuffle,
edges and labels stay distributed and every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize


#: Edges that a file may hold at least.
EDGES_A_FILE = 200_000


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    # a hub's edges are dealt out
    return join_groups(both.where("v > u"), low, ["u"], "c", 2 * n, "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    other = edges.join(low.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return other.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge that is no loop.

    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    edges = edges.where(f"{src} is not null and {dst} is not null and {src} != {dst}").select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    edges = materialize(edges, "edges")
    state = _state(edges)
    while state["n"]:
        # few edges in many small files would cost more to open than to read
        edges = materialize(_small(_large(edges, state["n"])).coalesce(max(4, state["n"] // EDGES_A_FILE)), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
