"""Trees and lineage graphs: closures by joins, never on the driver.

Each round joins only the frontier, cuts lineage by a table in the shared folder
when it is long, and stops by itself when the frontier is empty; nodes seen before
leave it, so cycles end too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import stored

#: After so many rounds what was seen becomes one table again.
ROUNDS = 16


def _rounds(max_depth: int | None):
    return count() if max_depth is None else range(max_depth)


def ancestors(edges: DataFrame, roots: DataFrame, *, child: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): each start (column ``child`` of ``roots``) with itself at depth 0 and all its ancestors.

    A node that is its own parent ends its lineage; so does a repeated node, and ``max_depth`` if given.
    """
    up = edges.select(F.col(child).alias("__c"), F.col(parent).alias("__p")).where("__p IS NOT NULL AND __c <> __p").distinct()
    frontier = stored(roots.select(F.col(child).alias("start"), F.col(child).alias("node"), F.lit(0).alias("depth")).distinct(), "lineage")
    seen = frontier
    for k in _rounds(max_depth):
        step = frontier.join(up, F.col("node") == F.col("__c")).select("start", F.col("__p").alias("node"), (F.col("depth") + 1).alias("depth"))
        frontier = stored(step.dropDuplicates(["start", "node"]).join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", "depth"), "lineage")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % ROUNDS == ROUNDS - 1:
            seen = stored(seen, "lineage")
    return seen


def descendants(edges: DataFrame, roots: DataFrame, *, child: str, parent: str, max_depth: int | None = None, without: DataFrame | None = None) -> DataFrame:
    """(node, depth) of the roots (column ``child``) and all below, down to ``max_depth`` if given; subtrees under ``without`` (column ``child``) are left out."""
    down = edges.select(F.col(parent).alias("__p"), F.col(child).alias("__c")).where("__p IS NOT NULL AND __c <> __p").distinct()
    start = roots.select(F.col(child).alias("node")).distinct()
    if without is not None:
        cut = without.select(F.col(child).alias("node")).distinct()
        start, down = start.join(cut, "node", "left_anti"), down.join(cut, F.col("__c") == F.col("node"), "left_anti")
    frontier = stored(start.withColumn("depth", F.lit(0)), "closure")
    seen = frontier
    for k in _rounds(max_depth):
        step = frontier.join(down, F.col("node") == F.col("__p")).select(F.col("__c").alias("node"), (F.col("depth") + 1).alias("depth"))
        frontier = stored(step.dropDuplicates(["node"]).join(seen.select("node"), "node", "left_anti").select("node", "depth"), "closure")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % ROUNDS == ROUNDS - 1:
            seen = stored(seen, "closure")
    return seen


def climb_until(features: DataFrame, initial: DataFrame, *, until: str = "gene", max_depth: int = 100) -> DataFrame:
    """Rows of ``features`` (id, parent, type) reached by climbing from ids until a row of type ``until`` or one without a parent.

    All starts climb together: the climb ends once the frontier holds the type.
    """
    nodes = features.where("id IS NOT NULL").select("id", "parent", "type").distinct()
    frontier = stored(nodes.join(initial.select("id").distinct(), "id", "left_semi"), "climb")
    seen = frontier
    for _ in range(max_depth):
        if frontier.isEmpty() or not frontier.where(F.col("type") == until).isEmpty():
            break
        above = frontier.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
        frontier = stored(nodes.join(above, "id", "left_semi").join(seen.select("id"), "id", "left_anti"), "climb")
        seen = seen.unionByName(frontier)
    ends = seen.where((F.col("type") == until) | F.col("parent").isNull()).select("id").distinct()
    return features.join(ends, "id", "left_semi")


def children(features: DataFrame, initial: DataFrame, *, recursive: bool = False) -> DataFrame:
    """Rows of ``features`` whose parent is among the ids, or below with ``recursive``."""
    if not recursive:
        return features.join(initial.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    below = descendants(features, initial, child="id", parent="parent").where("depth > 0").select(F.col("node").alias("id"))
    return features.join(below, "id", "left_semi")


def cascade(levels: Sequence[tuple[str, DataFrame, str, str | None]], events: DataFrame) -> DataFrame:
    """Effective retirements down an ownership chain of fixed depth.

    ``levels``: (type, table, id column, parent id column), parents first.
    ``events`` (object_type, object_id, event_id) are direct ones. Returns
    (object_type, object_id, root_type, root_id, event_id): each entity with every
    retired entity at or above it, as distinct rows.
    """
    out, above = [], None
    for kind, table, key, parent in levels:
        own = events.where(F.col("object_type") == kind).join(table.select(F.col(key).alias("object_id")), "object_id", "left_semi")
        here = own.select(F.lit(kind).alias("object_type"), "object_id", F.lit(kind).alias("root_type"), F.col("object_id").alias("root_id"), "event_id")
        if above is not None and parent:
            inherited = above.join(table.select(F.col(key).alias("__id"), F.col(parent).alias("object_id")), "object_id").select(F.lit(kind).alias("object_type"), F.col("__id").alias("object_id"), "root_type", "root_id", "event_id")
            here = here.unionByName(inherited)
        above = here.distinct()
        out.append(above)
    return reduce(DataFrame.unionByName, out)


def prune(parents: DataFrame, kids: DataFrame, key: str, parent: str) -> DataFrame:
    """Children whose parent is still there."""
    return kids.join(parents.select(F.col(key).alias(parent)), parent, "left_semi")


def resolve_identifier(spark: SparkSession, entities: DataFrame, accessions: DataFrame, identifier: str) -> DataFrame:
    """(internal_type, internal_id) of an internal id, ``NAMESPACE:ACCESSION`` or a bare accession; more than one match is an error on reading."""
    space, found, rest = identifier.partition(":")
    test = (F.col("accession") == identifier) | ((F.col("namespace") == space) & (F.col("accession") == rest) if found else F.lit(False))
    hits = entities.where(F.col("internal_id") == identifier).select("internal_type", "internal_id").unionByName(accessions.where(test).select("internal_type", "internal_id")).distinct()
    every = hits.agg(F.count(F.lit(1)).alias("__n"))
    joined = hits.crossJoin(F.broadcast(every))
    return joined.select(F.when(F.col("__n") > 1, F.raise_error(F.lit(f"ambiguous: {identifier}")).cast("string")).otherwise(F.col("internal_type")).alias("internal_type"), "internal_id")
