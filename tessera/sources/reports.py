"""Assembly reports: reading of several layouts, flat records, merging by shared accessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import merged, partial_date
from tessera.storage import stored

#: Name -> JSON paths, the first that is there counts.
FIELDS: Mapping[str, Sequence[str]] = {
    "accession": ("$.accession", "$.current_accession", "$.assembly_accession"), "paired_accession": ("$.paired_accession", "$.assembly_info.paired_assembly.accession"), "organism_name": ("$.organism.organism_name", "$.organism_name"),
    "taxon_id": ("$.organism.tax_id", "$.tax_id", "$.taxid"), "assembly_name": ("$.assembly_info.assembly_name", "$.assembly_name"), "assembly_level": ("$.assembly_info.assembly_level", "$.assembly_level"), "submitter": ("$.assembly_info.submitter", "$.submitter"),
    "release_date": ("$.assembly_info.release_date", "$.release_date"), "biosample": ("$.assembly_info.biosample.accession", "$.biosample"), "bioproject": ("$.assembly_info.bioproject_accession", "$.bioproject"), "strain": ("$.organism.infraspecific_names.strain", "$.strain"),
}


def report_objects(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, n, report): one JSON text per report of each file: an array, an object with reports, assemblies or data, one object, or one per line."""
    t = F.trim(text)
    array = "array<string>"
    whole = F.when(t.startswith("["), F.from_json(t, array))
    inner = [F.from_json(F.get_json_object(t, f"$.{k}"), array) for k in ("reports", "assemblies", "data")]
    lines = F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    many = (F.size(lines) > 1) & F.forall(lines, lambda x: F.get_json_object(x, "$").isNotNull() & F.trim(x).startswith("{"))
    items = F.coalesce(whole, F.when(~many, F.coalesce(*inner)), F.when(many, lines), F.array(t))
    return texts.where(t != "").select(F.col(path).alias("path"), F.posexplode(items).alias("n", "report"))


def flat_records(reports: DataFrame) -> DataFrame:
    out = reports.select("path", "n", *[F.coalesce(*[F.get_json_object("report", p) for p in paths]).alias(name) for name, paths in FIELDS.items()])
    return out.withColumn("release_date", partial_date(F.col("release_date")))


def merge_aliases(records: DataFrame, ident: str, aliases: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """One record per group of records that share an alias, directly or by way of others; later non-empty fields win.

    Groups are connected components: labels spread over aliases until none changes.
    """
    link = records.select(ident, F.explode(F.array_compact(F.array(*[F.nullif(F.col(a), F.lit("")) for a in aliases]))).alias("alias"))
    labels = stored(records.select(ident, F.col(ident).alias("label")), "alias-labels")
    while True:
        least = link.join(labels, ident).groupBy("alias").agg(F.min("label").alias("least"))
        near = link.join(least, "alias").groupBy(ident).agg(F.min("least").alias("least"))
        new = stored(labels.join(near, ident, "left").select(ident, F.least("label", F.coalesce("least", "label")).alias("label"), F.col("label").alias("old")), "alias-labels")
        labels = new.select(ident, "label")
        if new.where("label <> old").isEmpty():
            break
    grouped = records.join(labels, ident)
    last = [F.max_by(F.col(f), F.when(F.nullif(F.col(f), F.lit("")).isNotNull(), F.col(order))).alias(f) for f in fields]
    return grouped.groupBy("label").agg(*last, F.count(F.lit(1)).alias("merged"))


def merge_fields(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Old rows with the new ones' non-empty fields."""
    n = new.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = old.join(n, F.col(key) == F.col("__k"), "left")
    return both.select(*[merged(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns])


def sample_attributes(reports: DataFrame, column: str) -> DataFrame:
    """Map of a sample's name and value list: names lower case with underscores, the first value of a name."""
    items = F.from_json(column, "array<struct<name:string,value:string>>")
    named = F.transform(items, lambda x: F.struct(F.regexp_replace(F.lower(F.trim(x["name"])), r"[^a-z0-9]+", "_").alias("key"), x["value"].alias("value")))
    named = F.filter(named, lambda x: x["key"].isNotNull() & x["value"].isNotNull())
    first = F.filter(named, lambda x, i: ~F.exists(F.slice(named, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return reports.withColumn("attributes", F.map_from_entries(first))
