"""The ownership tree: owners of any entity, nested listings, impact of a change, graphs around one entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of the tree, parents first: type, id column, parent's id column.
LEVELS = (("organism", "organism_id", None), ("sample", "sample_id", "organism_id"), ("run", "run_id", "sample_id"), ("assembly", "assembly_id", "sample_id"), ("annotation", "annotation_id", "assembly_id"))
PARENT = {"sample": "organism", "run": "sample", "assembly": "sample", "annotation": "assembly"}


def owners(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(entity_type, entity_id, organism_id) of every entity, by one join per level."""
    maps: dict[str, DataFrame] = {}
    for kind, key, parent in LEVELS:
        t = tables[kind]
        if parent is None:
            maps[kind] = t.select(F.col(key).alias("entity_id"), F.col(key).alias("organism_id"))
        else:
            up = maps[PARENT[kind]].select(F.col("entity_id").alias("__p"), "organism_id")
            maps[kind] = t.select(F.col(key).alias("entity_id"), F.col(parent).alias("__p")).join(up, "__p").select("entity_id", "organism_id")
    return reduce(DataFrame.unionByName, [m.select(F.lit(k).alias("entity_type"), "entity_id", "organism_id") for k, m in maps.items()])


def member_taxa(members: DataFrame, owner_map: DataFrame, organisms: DataFrame) -> DataFrame:
    """Members with their organism's columns."""
    return members.join(owner_map, ["entity_type", "entity_id"], "left").join(organisms, "organism_id", "left")


def nested(parents: DataFrame, kids: DataFrame, key: str, columns: Sequence[str], name: str) -> DataFrame:
    """Parents with an array of their children's columns, ordered by them; none gives an empty array."""
    lists = kids.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def impact(subtree: DataFrame, dependents: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n): rows of each table that belong to the entities of a subtree."""
    keys = ["entity_type", "entity_id"]
    ids = subtree.select(*keys).distinct()
    return reduce(DataFrame.unionByName, [df.join(ids, keys, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in dependents.items()])


def graph(tables: Mapping[str, DataFrame], organism: str, excluded: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows of each level under one organism; entities in ``excluded`` (entity_type, entity_id) go with all below them."""
    out: dict[str, DataFrame] = {}
    for kind, key, parent in LEVELS:
        t = tables[kind].where(F.col(key) == organism) if parent is None else tables[kind].join(out[PARENT[kind]].select(parent), parent, "left_semi")
        if excluded is not None:
            t = t.join(excluded.where(F.col("entity_type") == kind).select(F.col("entity_id").alias(key)), key, "left_anti")
        out[kind] = t
    return out


def matched(parts: Mapping[str, DataFrame], kind: str, ident: str) -> dict[str, DataFrame]:
    """A graph cut down to one entity's lineage: its ancestors, itself and all below."""
    keys = {k: (key, parent) for k, key, parent in LEVELS}
    out = dict(parts)
    out[kind] = parts[kind].where(F.col(keys[kind][0]) == ident)
    at = kind
    while at in PARENT:
        up = PARENT[at]
        out[up] = parts[up].join(out[at].select(keys[at][1]).distinct(), keys[up][0], "left_semi")
        at = up
    for k, _, parent in LEVELS:
        if k not in PARENT or k == kind:
            continue
        above = {kind}
        p = PARENT[k]
        while True:
            if p in above:
                out[k] = parts[k].join(out[PARENT[k]].select(parent), parent, "left_semi")
                break
            if p not in PARENT:
                if k not in _lineage(kind):
                    out[k] = parts[k].limit(0)
                break
            p = PARENT[p]
    return out


def _lineage(kind: str) -> list[str]:
    out = [kind]
    while out[-1] in PARENT:
        out.append(PARENT[out[-1]])
    return out


def with_locations(files: DataFrame, locations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per (file, location); files without one have empty texts."""
    out = files.join(locations.select("file_id", *columns), "file_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})
