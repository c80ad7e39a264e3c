"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a pre-aggregated minimum and a join; each round's edges are written to the shared folder, so neither the
lineage nor the driver grows with the graph. The minimum of a node with very many neighbours is broadcast (at most
``HUBS`` nodes can have that many), so that no task gets all edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import Scratch

#: A node with more than 1 in so many of all rows, and more than ``HUB_ROWS``, is a hub.
HUBS, HUB_ROWS = 10_000, 200


def _with_least(rows: DataFrame, many: int) -> DataFrame:
    """Rows (u, v) with ``m``, the smallest v of their u."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(HUB_ROWS, many // HUBS)
    hubs = F.broadcast(least.filter(hub).select("u", "m"))
    rest = least.filter(~hub).select("u", "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(rest, "u"))


def _large_star(down: DataFrame, many: int) -> DataFrame:
    """Edges -> from each node's larger neighbours to the smallest of its neighbours and itself."""
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * many).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(down: DataFrame, many: int) -> DataFrame:
    """Edges that point down -> each node and its lower neighbours to the smallest of them."""
    least = _with_least(down, many)
    moved = least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 200) -> DataFrame:
    """``edges`` (a, b) of long ids -> (node, component): the smallest id reachable; only nodes with an edge.

    Rounds go on to the fixed point, about the logarithm of the longest path; more than ``rounds`` raise an error.
    Null ends and loops link nothing. Repeated edges count once; no edges give no rows.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before = None
    for k in range(rounds):
        sign = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if sign == before or not sign[0]:
            break
        before = sign
        large = scratch.keep(_large_star(now, sign[0]), f"{name}-large-{k}")
        after = scratch.keep(_small_star(large, sign[0]), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}", f"{name}-large-{k}")
        now = after
    else:
        raise RuntimeError(f"the classes were still changing after {rounds} rounds")
    # at the fixed point every edge is (node, root)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
