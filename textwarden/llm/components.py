"""Connected components of a link table, by alternating large-star and small-star steps.

Both steps move links towards the smallest node that is known of a component; a few rounds leave a star for each
component. Minima are combined before they are shuffled, and links of a node with very many neighbours are split by the
skew-join rule, as they are only joined with one row per node. Each round is a table in the shared folder. Nothing but
counts comes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.sources.scratch import materialise


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the given ones, one per node but the smallest of each component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        for side in (left, right):
            np.minimum.at(label, label[side], low)
        while (label != (jumped := label[label])).any():
            label = jumped
        if (label == before).all():
            break
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _minima(links: DataFrame, both: DataFrame) -> DataFrame:
    found = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(found, "u")


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` but the roots; the root is the smallest node of its component."""
    links = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = None
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest of its neighbourhood.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minima(both, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a node, and itself, are linked to the smallest of them.
        small = _minima(large, large)
        links = materialise(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "links",
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
