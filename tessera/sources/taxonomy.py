"""Taxonomies from JSON lines and from name, node, merge and deletion dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(column: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(column, p) for p in paths])


def nodes_from_json(text: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(nodes, aliases) of one taxonomy object per line, under ``taxonomy`` or at the top; facts go by several names.

    The first parent counts; a root is its own parent; ranks are lower case with
    underscores; secondary ids are aliases of the node.
    """
    r = text.where(F.trim(column) != "").select(F.coalesce(F.get_json_object(column, "$.taxonomy"), F.col(column)).alias("j"))
    j = F.col("j")
    taxid = _first(j, "$.taxId", "$.tax_id", "$.taxid").try_cast("long")
    parent = F.coalesce(_first(j, "$.parents[0]", "$.parentTaxId", "$.parent_tax_id").try_cast("long"), F.when(taxid == 1, 1))
    rank = F.regexp_replace(F.lower(F.trim(F.coalesce(_first(j, "$.rank"), F.lit("no rank")))), r"[\s-]+", "_")
    name = _first(j, "$.currentScientificName.name", "$.scientific_name", "$.organism_name")
    nodes = r.select(taxid.alias("taxid"), parent.alias("parent_taxid"), rank.alias("rank"), name.alias("scientific_name"), _first(j, "$.extinct").try_cast("boolean").cast("int").alias("is_extinct"))
    others = F.from_json(_first(j, "$.secondaryTaxIds"), "array<string>")
    aliases = r.select(F.explode(others).alias("a"), taxid.alias("current_taxid")).select(F.col("a").try_cast("long").alias("alias_taxid"), "current_taxid", F.lit("MERGED").alias("status"))
    return nodes, aliases


def dump_rows(lines: DataFrame, width: int) -> DataFrame:
    """Fields f0.. of ``\\t|\\t`` separated dump lines."""
    f = F.split(F.regexp_replace("line", r"\t?\|\s*$", ""), r"\t?\|\t?")
    return lines.where(F.trim("line") != "").select(*[F.trim(F.get(f, F.lit(k))).alias(f"f{k}") for k in range(width)])


def nodes_from_dump(names: DataFrame, nodes: DataFrame, merged: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, aliases) of the four dumps; a node without scientific name is an error on reading."""
    label = dump_rows(names, 4).where("f3 = 'scientific name'").select(F.col("f0").cast("long").alias("taxid"), F.col("f1").alias("scientific_name")).dropDuplicates(["taxid"])
    n = dump_rows(nodes, 3).select(F.col("f0").cast("long").alias("taxid"), F.col("f1").cast("long").alias("parent_taxid"), F.regexp_replace(F.lower("f2"), r"[\s-]+", "_").alias("rank"))
    both = n.join(label, "taxid", "left")
    named = F.when(F.col("scientific_name").isNull(), F.raise_error(F.concat(F.lit("no scientific name: "), F.col("taxid").cast("string"))).cast("string")).otherwise(F.col("scientific_name"))
    out = both.select("taxid", "parent_taxid", "rank", named.alias("scientific_name"), F.lit(None).cast("int").alias("is_extinct"))
    m = dump_rows(merged, 2).select(F.col("f0").cast("long").alias("alias_taxid"), F.col("f1").cast("long").alias("current_taxid"), F.lit("MERGED").alias("status"))
    d = dump_rows(deleted, 1).select(F.col("f0").cast("long").alias("alias_taxid"), F.lit(None).cast("long").alias("current_taxid"), F.lit("DELETED").alias("status"))
    return out, m.unionByName(d)


def unnamed(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes without a name."""
    return nodes.join(names, "taxid", "left_anti")


def snapshot_problems(nodes: DataFrame) -> DataFrame:
    """(taxid, problem) of a node table: repeated ids, unknown parents, no root."""
    again = nodes.groupBy("taxid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("taxid", F.lit("repeated").alias("problem"))
    orphan = nodes.join(nodes.select(F.col("taxid").alias("parent_taxid")).distinct(), "parent_taxid", "left_anti").select("taxid", F.lit("unknown parent").alias("problem"))
    roots = nodes.where("taxid = parent_taxid").agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("long").alias("taxid"), F.lit("no root").alias("problem"))
    return again.unionByName(orphan).unionByName(roots)
