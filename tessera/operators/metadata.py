"""Metadata contracts: typed normalisation of texts, and row errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import null_tokens


@dataclass(frozen=True)
class Field:
    """A column of a contract. ``kind``: id, string, integer, float, boolean, date or datetime."""

    kind: str = "string"
    required: bool = False
    pattern: str | None = None
    allowed: Sequence[str] = ()
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Contract:
    fields: Mapping[str, Field]
    primary_key: str
    unique: Sequence[Sequence[str]] = field(default_factory=list)


def _bound(test: Column, value: Column, f: Field) -> Column:
    if f.low is not None:
        test |= value < f.low
    if f.high is not None:
        test |= value > f.high
    return test


def normalise(value: Column, f: Field) -> tuple[Column, Column]:
    """(normal value, whether the text is wrong) of a field's text."""
    text = null_tokens(value)
    if f.allowed:
        table = F.create_map(*[F.lit(x) for a in f.allowed for x in (a.lower(), a)])
        canon = F.try_element_at(table, F.lower(text))
        if any(a.lower() in ("na", "n/a", "null", "none") for a in f.allowed):
            text = F.nullif(F.trim(value), F.lit(""))
            canon = F.try_element_at(table, F.lower(text))
        return canon, text.isNotNull() & canon.isNull()
    if f.kind == "id":
        out = F.upper(text)
        return out, text.isNotNull() & ~out.rlike(f"^(?:{f.pattern or '.*'})$")
    if f.kind == "integer":
        plain = text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
        out = F.when(plain, F.replace(text, F.lit("_"), F.lit("")).try_cast("long"))
        return out, F.coalesce(_bound(text.isNotNull() & out.isNull(), out, f), text.isNotNull() & out.isNull())
    if f.kind == "float":
        out = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
        return out, F.coalesce(_bound(text.isNotNull() & out.isNull(), out, f), text.isNotNull() & out.isNull())
    if f.kind == "boolean":
        return F.when(F.lower(text).isin("false", "no", "0"), 0).when(text.isNotNull(), 1), F.lit(False)
    if f.kind == "date":
        out = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date").cast("string"))
        return out, text.isNotNull() & out.isNull()
    if f.kind == "datetime":
        parts = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
        pick = lambda k: F.regexp_extract(text, parts, k)
        iso = F.concat(pick(1), F.lit("T"), F.when(pick(2) == "", "00:00").otherwise(pick(2)), F.when(pick(3) == "", ":00").otherwise(pick(3)), F.when(pick(4) == "Z", "+00:00").otherwise(pick(4)))
        out = F.when(text.rlike(parts) & F.try_to_timestamp(F.substring(iso, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), iso)
        return out, text.isNotNull() & out.isNull()
    return text, text.isNotNull() & ~text.rlike(f"^(?:{f.pattern})$") if f.pattern else F.lit(False)


def validate(rows: DataFrame, contract: Contract) -> DataFrame:
    """Normal rows with ``errors``: array of ``column: problem`` texts, empty if the row is sound. Unknown columns are an error at once."""
    unknown = [c for c in rows.columns if c not in contract.fields]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    out, errors = {}, []
    for name, f in contract.fields.items():
        raw = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        value, wrong = normalise(raw, f)
        out[name] = value
        errors.append(F.when(F.coalesce(wrong, F.lit(False)), F.lit(f"{name}: invalid")))
        if f.required:
            errors.append(F.when(value.isNull() & ~F.coalesce(wrong, F.lit(False)), F.lit(f"{name}: missing")))
    got = rows.select(*[v.alias(c) for c, v in out.items()], F.array_compact(F.array(*errors)).alias("errors"))
    for keys in [[contract.primary_key], *contract.unique]:
        whole = ~F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNotNull()
        again = (F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1) & whole
        got = got.withColumn("errors", F.when(again, F.array_append("errors", F.lit(f"{'+'.join(keys)}: repeated"))).otherwise(F.col("errors")))
    return got
