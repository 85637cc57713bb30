"""Connected components of a table of links, in rounds of joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import split_join, staged


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links between (u, v) as stars: (node, least node of its component), without the least nodes themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def connected(links: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (u, v) that is not the least of its component, that least node.

    Large-star and small-star rounds: each node's larger neighbours, then its smaller ones, are linked to the least node
    around. A node with very many links is dealt over several tasks. Each round's links are a table in the shared folder.
    """
    links = staged(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, least, ["u"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(
            F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.u", "l.v").filter("u <> v").distinct()
        links = staged(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
