"""Filters: feature selections, attribute filters, and a three-valued condition language."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import like, number

ORDERED = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


def overlaps(start: Column, end: Column, low: int | None = None, high: int | None = None) -> Column:
    """Whether a closed interval meets [low, high]; either side may be open."""
    tests = ([end >= low] if low is not None else []) + ([start <= high] if high is not None else [])
    return reduce(and_, tests, F.lit(True))


def in_lists(df: DataFrame, lists: Mapping[str, Sequence | None]) -> DataFrame:
    """Keep rows whose columns are in the lists given; None and an empty list set no condition. The tests reach the scan."""
    tests = [F.col(c).isin(*values) for c, values in lists.items() if values]
    return df.where(reduce(and_, tests)) if tests else df


def parse_attribute_filter(token: str) -> tuple[str, str, bool]:
    """``KEY~=PATTERN`` or ``KEY=VALUE`` -> (key, value, is a pattern); the former wins."""
    for sign, regex in (("~=", True), ("=", False)):
        key, found, value = token.partition(sign)
        if found and key:
            return key, value, regex
    raise ValueError(f"not KEY=VALUE or KEY~=PATTERN: {token}")


def attribute_filter(dialect: str, key: str, value: str, *, regex: bool = False) -> Column:
    """Test of a feature attribute.

    id, parent (not in GTF), gene_id and transcript_id, in any case, test the decoded
    columns; other keys, case-sensitive, test the raw attribute text, of which a
    pattern has to match the whole value.
    """
    decoded = ("gene_id", "transcript_id") if dialect == "gtf" else ("id", "parent", "gene_id", "transcript_id")
    if key.lower() in decoded:
        column = F.col(key.lower())
        return column.rlike(value) if regex else column == value
    body = value if regex else re.sub(r"([^\w])", r"\\\1", value)
    k = re.sub(r"([^\w])", r"\\\1", key)
    value_is = f'\\s+"(?:{body})"' if dialect == "gtf" else f"\\s*=\\s*(?:{body})"
    return F.col("attributes").rlike(f"(?:^|;)\\s*{k}{value_is}\\s*(?:;|$)")


def filter_features(
    features: DataFrame, *, types: Sequence[str] | None = None, seqids: Sequence[str] | None = None, sources: Sequence[str] | None = None, strands: Sequence[str] | None = None, gene_ids: Sequence[str] | None = None,
    transcript_ids: Sequence[str] | None = None, parents: Sequence[str] | None = None, start: int | None = None, end: int | None = None, attributes: Sequence[Column] = (),
) -> DataFrame:
    """All lists must hold, the interval must overlap [start, end], and one of ``attributes`` if there are any."""
    out = in_lists(features, {"type": types, "seqid": seqids, "source": sources, "strand": strands, "gene_id": gene_ids, "transcript_id": transcript_ids, "parent": parents})
    out = out.where(overlaps(F.col("start"), F.col("end"), start, end))
    return out.where(reduce(or_, attributes)) if attributes else out


def compare(observed: Column, operator: str, expected: object, *, strict: bool = True) -> Column:
    """Comparison of a text with a literal; null if the text is null.

    == and != compare numbers if both are, else texts. Ordering needs numbers; with
    ``strict`` a text that isn't one is an error, otherwise unknown.
    """
    value = observed.cast("string")
    wanted = ("true" if expected else "false") if isinstance(expected, bool) else str(expected)
    try:
        numeric: float | None = float(wanted)
    except ValueError:
        numeric = None
    if operator in ("==", "!="):
        equal = value == wanted
        if numeric is not None:
            equal = F.when(number(value).isNotNull(), number(value) == numeric).otherwise(equal)
        return equal if operator == "==" else ~equal
    if operator not in ORDERED:
        raise ValueError(f"unknown operator {operator}")
    if numeric is None:
        raise ValueError(f"{operator} needs a number, not {expected!r}")
    test = ORDERED[operator](number(value), F.lit(numeric))
    if strict:
        bad = value.isNotNull() & number(value).isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit("not a number: "), value)).cast("boolean")).otherwise(test)
    return test


def condition(rule: Mapping, fields: Mapping[str, Column] | None = None) -> Column:
    """Compile a condition to a three-valued Column.

    ``{any: [...]}`` is two-valued: conditions that don't hold count as false, so its
    negation holds for missing fields. ``{not: c}`` keeps unknown. A field condition
    on a missing value is unknown, whatever its operator.
    """
    if "any" in rule:
        return reduce(or_, [holds(c, fields) for c in rule["any"]], F.lit(False))
    if "not" in rule:
        return ~condition(rule["not"], fields)
    name, operator = rule["field"], rule.get("operator", "==")
    value = (fields or {}).get(name, F.lit(None).cast("string") if fields is not None else F.col(name))
    if operator == "exists":
        return F.when(value.isNotNull(), F.lit(True))
    if operator in ("in", "not_in"):
        # Membership is of texts: "1.0" isn't in [1].
        wanted = [str(v) for v in rule.get("values", [])]
        inside = value.cast("string").isin(*wanted) if wanted else F.lit(False)
        test = inside if operator == "in" else ~inside
        return F.when(value.isNotNull(), test)
    if operator == "between":
        return compare(value, ">=", rule["min"]) & compare(value, "<=", rule["max"])
    if operator == "like":
        return like(value.cast("string"), str(rule["value"]))
    return compare(value, operator, rule["value"])


def holds(rule: Mapping, fields: Mapping[str, Column] | None = None) -> Column:
    """The condition, unknown counting as false."""
    return F.coalesce(condition(rule, fields), F.lit(False))


def all_hold(rules: Sequence[Mapping], fields: Mapping[str, Column] | None = None) -> Column:
    return reduce(and_, [holds(r, fields) for r in rules], F.lit(True))


def role_matches(role: Column, wanted: str) -> Column:
    """A role equals the wanted one or stands below it (``p`` or ``p:...``)."""
    return (role == wanted) | role.startswith(f"{wanted}:")


def subject_matches(subject: Column, extra_json: Column, pattern: str) -> Column:
    """LIKE on the subject or on the extra field short_name."""
    return F.coalesce(like(subject, pattern), F.lit(False)) | F.coalesce(like(F.get_json_object(extra_json, "$.short_name"), pattern), F.lit(False))


def in_time(column: Column, start: str | None = None, stop: str | None = None) -> Column:
    """Half-open time window [start, stop); texts with offsets compare as instants."""
    at = F.to_timestamp(column)
    tests = ([at >= F.to_timestamp(F.lit(start))] if start else []) + ([at < F.to_timestamp(F.lit(stop))] if stop else [])
    return reduce(and_, tests, F.lit(True))


def page(df: DataFrame, order: Sequence[Column], *, limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of the ordered rows; limit 0 is none. Limits compile to a top-k, not a full sort."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out
