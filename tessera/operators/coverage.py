"""Taxonomic coverage: denominators, resolution of identifiers, exclusion reasons, coverage by rank."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import percent_exact
from tessera.operators.hierarchy import ancestors, descendants


def resolve_ids(ids: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(taxid, current, status): exact beats alias; a deleted alias has no current id; the rest are unknown."""
    exact = nodes.select(F.col("taxid"), F.lit(True).alias("__exact")).distinct()
    alias = aliases.select(F.col("alias_taxid").alias("taxid"), F.col("current_taxid").alias("__to"), F.lit(True).alias("__alias")).dropDuplicates(["taxid"])
    out = ids.select("taxid").distinct().join(exact, "taxid", "left").join(alias, "taxid", "left")
    status = F.when(F.col("__exact"), "EXACT").when(F.col("__alias") & F.col("__to").isNull(), "DELETED_TAXID").when(F.col("__alias"), "MERGED").otherwise("UNKNOWN_TAXID")
    return out.select("taxid", F.when(F.col("__exact"), F.col("taxid")).otherwise(F.col("__to")).alias("current"), status.alias("status"))


def lineages(nodes: DataFrame, taxids: DataFrame) -> DataFrame:
    """(taxid, lineage): array of (depth, taxid, rank, name, extinct) from the node up, over at most 100 levels."""
    up = ancestors(nodes.select("taxid", "parent_taxid"), taxids.select("taxid"), child="taxid", parent="parent_taxid", max_depth=100)
    joined = up.join(nodes.select(F.col("taxid").alias("node"), "rank", "scientific_name", "is_extinct"), "node")
    item = F.struct("depth", F.col("node").alias("taxid"), "rank", F.col("scientific_name").alias("name"), F.col("is_extinct").alias("extinct"))
    return joined.groupBy(F.col("start").alias("taxid")).agg(F.sort_array(F.collect_list(item)).alias("lineage"))


def targets(nodes: DataFrame, roots: Sequence[int], *, ranks: Sequence[str], without: Sequence[int] = (), exclude_extinct: bool = True, exclude_names: Sequence[str] = ()) -> DataFrame:
    """Denominator: nodes of the ranks below the roots, without excluded and extinct subtrees; name patterns test the node's own name."""
    start = nodes.where(F.col("taxid").isin(*roots)).select("taxid")
    cut = nodes.where(F.col("taxid").isin(*without) if without else F.lit(False)).select("taxid")
    if exclude_extinct:
        cut = cut.unionByName(nodes.where("is_extinct = 1").select("taxid"))
    below = descendants(nodes, start, child="taxid", parent="parent_taxid", without=cut).select(F.col("node").alias("taxid"))
    out = nodes.join(below, "taxid", "left_semi").where(F.col("rank").isin(*ranks))
    for pattern in exclude_names:
        out = out.where(~F.col("scientific_name").rlike(pattern))
    return out.select("rank", "taxid", "scientific_name")


def first_of_rank(lineage: Column, rank: str) -> Column:
    """Nearest taxid of a rank in a lineage, or null."""
    return F.get(F.filter(lineage, lambda x: x["rank"] == rank), F.lit(0))["taxid"]


def _named(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x["name"].rlike(pattern)


def observations(observed: DataFrame, nodes: DataFrame, aliases: DataFrame, wanted: DataFrame, *, ranks: Sequence[str], without: Sequence[int] = (), exclude_extinct: bool = True, exclude_names: Sequence[str] = (), source: str = "NCBI") -> DataFrame:
    """Resolve observations (organism_id, taxonomy_source, taxon_id text) and give each one reason of exclusion, the first that applies; accepted ones have none.

    Adds resolved_taxid, mapping_status, <rank>_taxid and reason.
    """
    number = F.when(F.col("taxon_id").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim("taxon_id").try_cast("long"))
    o = observed.withColumn("__t", number)
    resolved = resolve_ids(o.where("__t IS NOT NULL").select(F.col("__t").alias("taxid")), nodes, aliases)
    lines = lineages(nodes, resolved.where("current IS NOT NULL").select(F.col("current").alias("taxid")).distinct())
    o = o.join(resolved.toDF("__t", "resolved_taxid", "mapping_status"), "__t", "left").join(lines.withColumnRenamed("taxid", "resolved_taxid"), "resolved_taxid", "left")
    for rank in ranks:
        o = o.withColumn(f"{rank}_taxid", first_of_rank(F.col("lineage"), rank))
        hit = wanted.where(F.col("rank") == rank).select(F.col("taxid").alias(f"{rank}_taxid"), F.lit(True).alias(f"__in_{rank}")).distinct()
        o = o.join(hit, f"{rank}_taxid", "left")
    any_rank = [F.col(f"{r}_taxid").isNotNull() for r in ranks]
    any_hit = [F.coalesce(F.col(f"__in_{r}"), F.lit(False)) for r in ranks]
    either = lambda tests: F.array_contains(F.array(*tests), True)
    ladder = F.when(F.coalesce(F.col("taxonomy_source"), F.lit("")) != source, "UNSUPPORTED_TAXONOMY_SOURCE").when(F.coalesce(F.col("taxon_id"), F.lit("")) == "", "MISSING_TAXID").when(F.col("__t").isNull(), "INVALID_TAXID")
    ladder = ladder.when(F.col("resolved_taxid").isNull(), F.col("mapping_status")).when(F.col("lineage").isNull(), "UNKNOWN_RESOLVED_TAXID")
    if exclude_extinct:
        ladder = ladder.when(F.exists("lineage", lambda x: F.coalesce(x["extinct"] == 1, F.lit(False))), "EXCLUDED_EXTINCT")
    for pattern in exclude_names:
        ladder = ladder.when(F.exists("lineage", _named(pattern)), "EXCLUDED_NAME_PATTERN")
    if without:
        ladder = ladder.when(F.exists("lineage", lambda x: x["taxid"].isin(*without)), "EXCLUDED_SUBTREE")
    ladder = ladder.when(~either(any_rank), "MISSING_TARGET_RANK").when(~either(any_hit), "OUTSIDE_REFERENCE_SCOPE")
    return o.withColumn("reason", ladder).drop("__t", "lineage", *[f"__in_{r}" for r in ranks])


def covered(wanted: DataFrame, accepted: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """All targets, with how many organisms cover each, COVERED or MISSING."""
    out = None
    for rank in ranks:
        seen = accepted.where(F.col(f"{rank}_taxid").isNotNull()).groupBy(F.col(f"{rank}_taxid").alias("taxid")).agg(F.count_distinct("organism_id").alias("organism_count"))
        part = wanted.where(F.col("rank") == rank).join(seen, "taxid", "left").withColumn("organism_count", F.coalesce("organism_count", F.lit(0)))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("status", F.when(F.col("organism_count") > 0, "COVERED").otherwise("MISSING"))


def coverage_by_rank(targets_covered: DataFrame, thresholds: Mapping[str, float], *, rank: str = "rank", is_covered: Column | None = None) -> DataFrame:
    """Numerator, denominator, percentage (exact, half up to four places) and whether the rank's threshold is met."""
    test = F.col("status") == "COVERED" if is_covered is None else is_covered
    out = targets_covered.groupBy(rank).agg(F.count_if(test).alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    out = out.withColumn("percentage", percent_exact(F.col("numerator"), F.col("denominator")))
    least = F.lit(None).cast("double")
    for name, value in thresholds.items():
        least = F.when(F.col(rank) == name, float(value)).otherwise(least)
    return out.withColumn("passed", F.coalesce(F.col("percentage") >= least, F.lit(True)))
