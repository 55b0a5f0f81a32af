"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, stored


def connected_components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Label each node of ``links`` with the smallest node id it can reach.

    Returns (node, component). Each node has a parent of its component, at first its
    smallest neighbour. A round gives the smallest grandparent among a node's
    neighbours to the node and to its parent (so whole trees are hooked, not single
    nodes), and each node its own grandparent; on a chain of n nodes with random ids
    that takes about log n rounds. When nothing moves, parents are the smallest ids:
    they agree along every link. Every round is two partial aggregations and three
    equi-joins; a hub with many links is only ever a join key, which adaptive
    execution splits. Null ends, loops and repeated links are ignored; no links give
    an empty table.
    """
    return _components(links, src, dst)[0]


def _components(links: DataFrame, src: str = "a", dst: str = "b") -> tuple[DataFrame, int]:
    """The labels, and the number of rounds."""
    pairs = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    # Both directions from one pass over the links.
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = stored(pairs.select(F.explode(ways).alias("w")).select("w.u", "w.v").distinct(), "cc-links")
    first = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("f"))
    labels = stored(first, "cc-labels")
    rounds = 0
    while True:
        rounds += 1
        up = labels.join(labels.select(F.col("node").alias("f"), F.col("f").alias("g")), "f")
        near = both.join(up.select(F.col("node").alias("v"), "g"), "v").groupBy(F.col("u").alias("node")).agg(F.min("g").alias("m"))
        known = up.join(near, "node")
        offers = F.array(F.struct("node", F.least("f", "g", "m").alias("f"), F.col("f").alias("old")), F.struct(F.col("f").alias("node"), F.col("m").alias("f"), F.lit(None).cast(labels.schema["f"].dataType).alias("old")))
        new = stored(known.select(F.explode(offers).alias("o")).select("o.*").groupBy("node").agg(F.min("f").alias("f"), F.max("old").alias("old")), "cc-labels")
        moved = new.where("f <> old").limit(1).count()
        forget(labels)
        labels = new
        if not moved:
            forget(both)
            out = labels.select("node", F.col("f").alias("component"))
            out._tessera_path = labels._tessera_path
            return out, rounds
