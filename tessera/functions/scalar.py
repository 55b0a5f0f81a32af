"""Scalar column functions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(numerator: Column, denominator: Column) -> Column:
    """100 * n / d, 0.0 where d is 0 or null."""
    return F.coalesce(F.try_divide(numerator.cast("double") * 100, denominator.cast("double")), F.lit(0.0))


def percent_exact(numerator: Column, denominator: Column, places: int = 4) -> Column:
    """Percentage rounded half up on decimals, then double; a zero denominator is an error."""
    exact = numerator.cast("decimal(28,0)") * F.lit(100).cast("decimal(3,0)") / denominator.cast("decimal(28,0)")
    return F.when(denominator == 0, F.raise_error(F.lit("denominator is zero"))).otherwise(F.round(exact, places).cast("double"))


def like(value: Column, pattern: str) -> Column:
    """Case-insensitive LIKE with % and _ and no escape character."""
    return F.ilike(value, F.lit(pattern.replace("\\", "\\\\")))


def first_token(value: Column) -> Column:
    """First white-space separated token; an empty text has an empty one."""
    return F.element_at(F.split(F.regexp_replace(value, r"^(?U)\s+", ""), r"(?U)\s+"), 1)


def percent_decode(value: Column) -> Column:
    """Percent-decoding in which + is literal and malformed escapes stay as they are."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def number(value: Column) -> Column:
    """The text as a double, or null."""
    return value.try_cast("double")


def null_tokens(value: Column) -> Column:
    """Trimmed text, null where it is empty or one of the missing tokens."""
    trimmed = F.regexp_replace(value, r"^(?U)\s+|(?U)\s+$", "")
    return F.when(F.lower(trimmed).isin("", "na", "n/a", "null", "none"), None).otherwise(trimmed)


def escape_formula(value: Column) -> Column:
    """Quote text that a spreadsheet would take for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def wrap(sequence: Column, width: int = 60) -> Column:
    """Line breaks after every ``width`` characters but the last."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")


def count_of(text: Column, characters: str) -> Column:
    """Occurrences of any of the characters, case-sensitive, without regular expressions."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def circular(header: Column) -> Column:
    """Whether a sequence header has a token circular, topology=circular or topology:circular."""
    tokens = F.transform(F.split(F.lower(header), r"(?U)\s+"), lambda t: F.regexp_replace(t, r"^[,;|\[\](){}]+|[,;|\[\](){}]+$", ""))
    return F.exists(tokens, lambda t: t.isin("circular", "topology=circular", "topology:circular"))


def metric_value(value: Column, kind: str) -> Column:
    """Struct of a metric's text and number: booleans as 1 and 0, numbers both ways, other text without number."""
    if kind == "boolean":
        text, num = F.when(value, "1").when(~value, "0"), value.cast("int").cast("double")
    elif kind == "string":
        text, num = value, F.lit(None).cast("double")
    else:
        text, num = value.cast("string"), value.cast("double")
    return F.struct(text.alias("metric_value"), num.alias("metric_numeric"))


def is_false(numeric: Column, text: Column) -> Column:
    """Whether a metric says no: number 0, or text 0, false or no."""
    return F.coalesce(numeric == 0, F.lower(F.trim(text)).isin("0", "false", "no"), F.lit(False))


def iso_date(value: Column) -> Column:
    """ISO date as canonical text, null if it isn't one."""
    return F.date_format(F.to_date(F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))), "yyyy-MM-dd")


def partial_date(value: Column) -> Column:
    """Leading yyyy, yyyy-mm or yyyy-mm-dd of a text, or null."""
    found = F.regexp_extract(value, r"^\s*(\d{4}(?:-\d{2}(?:-\d{2})?)?)", 1)
    return F.when(found != "", found)


def excel_date(serial: Column, base_1904: bool = False) -> Column:
    """Date of an Excel serial number."""
    return F.date_add(F.lit("1904-01-01" if base_1904 else "1899-12-30").cast("date"), F.floor(serial).cast("int"))


def latitude_longitude(value: Column) -> Column:
    """Struct of signed degrees from text such as ``12.5 N 99.1 W``; null parts if there are none."""
    part = lambda letters, back: F.regexp_extract(value, rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*([{letters}])", back)

    def signed(letters: str, negative: str) -> Column:
        return F.when(part(letters, 1) != "", part(letters, 1).try_cast("double") * F.when(F.upper(part(letters, 2)) == negative, -1).otherwise(1))

    return F.struct(signed("NS", "S").alias("latitude"), signed("EW", "W").alias("longitude"))


def merged(new: Column, old: Column) -> Column:
    """The new text unless it is null or empty, else the old."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def set_hash(items: Column) -> Column:
    """sha256 of a collection of texts, whatever their order."""
    return F.sha2(F.array_join(F.sort_array(items), "\n"), 256)


def canonical_hash(**fields: Column) -> Column:
    """sha256 of the compact JSON object of the fields, keys sorted, nulls kept."""
    value = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)
