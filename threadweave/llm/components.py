"""Connected components over link tables too large for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.session import cut_lineage


def _shape(links: DataFrame) -> tuple:
    return tuple(links.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "low")), F.sum(F.xxhash64("low", "node").cast("decimal(38,0)"))
    ).first())


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` of every linked node: ``component`` is the smallest node reachable.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest
    one, then its smaller neighbours and itself to the smallest. Links turn into stars in a number
    of rounds that grows with the logarithm of the nodes, and never grow in number. A hub's links are
    minimised before the shuffle and joined on equality, so AQE can split them. Each round is written
    to the shared folder. Nodes must be numbers; null nodes link with nothing.
    """
    node, low = F.greatest(left, right).alias("node"), F.least(left, right).alias("low")
    links = cut_lineage(links.filter(F.col(left) != F.col(right)).select(node, low).distinct())
    shape = _shape(links)
    while shape[0]:
        both = links.unionByName(links.select(F.col("low").alias("node"), F.col("node").alias("low")))
        lowest = both.groupBy("node").agg(F.min("low").alias("to")).select("node", F.least("node", "to").alias("to"))
        large = (
            both.join(lowest, "node").filter("low > node")
            .select(F.col("low").alias("node"), F.col("to").alias("low")).filter("node > low").distinct()
        )
        floor = large.groupBy("node").agg(F.min("low").alias("to"))
        small = (
            large.join(floor, "node").select(
                F.inline(F.array(
                    F.struct(F.col("low").alias("node"), F.col("to").alias("low")),
                    F.struct(F.col("node").alias("node"), F.col("to").alias("low")),
                ))
            ).filter("node > low").distinct()
        )
        links = cut_lineage(small)
        now = _shape(links)
        if now == shape:
            break
        shape = now
    stars = links.select("node", F.col("low").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of places ``a[k]`` and ``b[k]`` in a parent array whose roots are their sets' lowest places."""
    while len(a):
        while True:  # point every place at its root
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
