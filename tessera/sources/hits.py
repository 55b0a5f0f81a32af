"""Hit tables of search tools, metric reports and hit payloads."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.lines import carried, cuts

# Usual column names of alignment fields, and their types.
ALIGNMENT_FIELDS = {
    "qstart": (("qstart", "query_start"), "long"), "qend": (("qend", "query_end"), "long"), "sstart": (("sstart", "subject_start"), "long"), "send": (("send", "subject_end"), "long"),
    "evalue": (("evalue",), "double"), "bitscore": (("bitscore",), "double"), "pident": (("pident",), "double"),
}


def _number(text: Column, kind: str) -> Column:
    value = F.trim(text).try_cast("double")
    return F.when(value == F.floor(value), value.try_cast("long")) if kind == "long" else value


def _ranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")))


def tabular_alignments(lines: DataFrame, columns: Sequence[str], *, query: str | None = None, subject: str | None = None, fields: Mapping[str, str] | None = None) -> DataFrame:
    """Alignments of a tab-separated table with the given columns, ranked by arrival per query.

    Comments, blank lines, rows of another width and rows without query or subject
    are skipped. Columns that are no alignment field go into the map ``extra``.
    """
    query, subject = query or columns[0], subject or columns[1]
    f = F.split("line", "\t")
    cell = {c: F.trim(F.get(f, F.lit(k))) for k, c in enumerate(columns)}
    rows = lines.where((F.trim("line") != "") & ~F.ltrim("line").startswith("#") & (F.size(f) == len(columns))).where((cell[query] != "") & (cell[subject] != ""))
    found = {}
    for name, (usual, kind) in ALIGNMENT_FIELDS.items():
        own = (fields or {}).get(name)
        found[name] = (own if own in columns else next((c for c in usual if c in columns), None), kind)
    used = {c for c, _ in found.values() if c} | {query, subject}
    rest = [x for c in columns if c not in used for x in (F.lit(c), cell[c])]
    extra = F.create_map(*rest) if rest else F.create_map().cast("map<string,string>")
    out = rows.select("path", "line_no", cell[query].alias("query_id"), cell[subject].alias("subject_id"), *[(_number(cell[c], kind) if c else F.lit(None).cast(kind)).alias(n) for n, (c, kind) in found.items()], extra.alias("extra"), *[cell[c].alias(f"__{c}") for c in columns])
    return _ranked(out, ["path", "query_id"])


def long_hits(alignments: DataFrame, metrics: Mapping[str, str], *, numeric: Sequence[str] | None = None, most: int = 5) -> DataFrame:
    """Long rows (query_id, subject_id, metric_name, metric_value, metric_numeric, rank) of the first ``most`` hits of each query; ``metrics``: name -> column of its text."""
    items = F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).cast("string").alias("v")) for n, c in metrics.items()])
    rows = alignments.where(F.col("rank") <= most).select("path", "query_id", "subject_id", "rank", F.explode(items).alias("m")).where("m.v IS NOT NULL AND m.v <> ''")
    number = F.col("m.v").try_cast("double")
    if numeric is not None:
        number = F.when(F.col("m.n").isin(*numeric), number)
    return rows.select("path", "query_id", "subject_id", F.col("m.n").alias("metric_name"), F.col("m.v").alias("metric_value"), number.alias("metric_numeric"), "rank")


def blast(lines: DataFrame, columns: Sequence[str], *, metrics: Sequence[str] | None = None, numeric: Sequence[str] | None = None, most: int = 5, **kind) -> tuple[DataFrame, DataFrame]:
    """(long hits, alignments) of a configurable tabular report."""
    a = tabular_alignments(lines, columns, **kind)
    names = [c for c in (metrics or columns[2:]) if c in columns]
    hits = long_hits(a, {c: f"__{c}" for c in names}, numeric=numeric, most=most)
    return hits, a.drop(*[f"__{c}" for c in columns])


def swaps(lines: DataFrame) -> DataFrame:
    """(path, swap): whether the report's header names hmmsearch, whose targets are the queries of interest."""
    head = lines.where(F.col("line").rlike(r"(?i)^#.*program:|^#\s*prog"))
    return head.groupBy("path").agg(F.bool_or(F.col("line").rlike(r"(?i)hmmsearch")).alias("swap"))


def _hmmer(lines: DataFrame, width: int, query_at: int, swap: bool | None) -> DataFrame:
    f = F.split(F.trim("line"), r"\s+", width + 1 if width == 22 else -1)
    rows = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("f", f).where(F.size("f") >= width)
    if swap is None:
        rows = rows.join(swaps(lines), "path", "left").withColumn("swap", F.coalesce("swap", F.lit(False)))
    else:
        rows = rows.withColumn("swap", F.lit(swap))
    target, query = F.get("f", F.lit(0)), F.get("f", F.lit(query_at))
    rows = rows.withColumn("query_id", F.when(F.col("swap"), target).otherwise(query)).withColumn("subject_id", F.when(F.col("swap"), query).otherwise(target))
    return _ranked(rows, ["path", "query_id"])


def hmmer_table(lines: DataFrame, *, swap: bool | None = None, most: int = 5) -> DataFrame:
    """Long hits (evalue, score) of a per-sequence table."""
    rows = _hmmer(lines, 6, 2, swap).withColumn("e", F.get("f", F.lit(4))).withColumn("s", F.get("f", F.lit(5)))
    return long_hits(rows, {"evalue": "e", "score": "s"}, most=most)


def hmmer_domains(lines: DataFrame, *, swap: bool | None = None, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(long hits, alignments) of a per-domain table: 22 fixed columns and free text."""
    rows = _hmmer(lines, 22, 3, swap)
    at = lambda k: F.get("f", F.lit(k))
    rows = rows.withColumn("e", at(12)).withColumn("s", at(13))
    extra = F.create_map(*[x for n, k in (("hmm_from", 15), ("hmm_to", 16), ("env_from", 19), ("env_to", 20)) for x in (F.lit(n), at(k))])
    alignments = rows.select("path", "line_no", "query_id", "subject_id", "rank", _number(at(17), "long").alias("qstart"), _number(at(18), "long").alias("qend"), F.col("e").try_cast("double").alias("evalue"), F.col("s").try_cast("double").alias("bitscore"), extra.alias("extra"))
    return long_hits(rows, {"evalue": "e", "score": "s"}, most=most), alignments


def domain_blocks(lines: DataFrame, *, most: int = 5, places: Sequence[tuple[str, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(long hits, alignments) of block reports: SESSION, QUERY and DOMAINS ... ENDDOMAINS, up to ENDDATA.

    Malformed records, domains before a query and repeated queries of a session are
    errors on reading. Rank is by arrival per (session, query). Reports are read in
    spans between ``places``, by default :func:`~tessera.sources.lines.cuts`.
    """
    rows = lines.select("path", "line_no", "line")
    is_query, is_session, is_end = F.col("line").startswith("QUERY\t"), F.col("line").startswith("SESSION"), F.col("line") == "ENDDATA"
    mark = F.when(F.col("line") == "DOMAINS", True).when(F.col("line").isin("SITES", "MOTIFS") | is_query | is_session | F.col("line").startswith("END"), False)
    rows = carried(rows, cuts(rows) if places is None else places, [is_session, is_query, mark.isNotNull(), is_end])
    rows = rows.where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    w = Window.partitionBy("span", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    q = F.split("line", "\t", 5)
    # Fields are split on the lines that set a state only.
    latest = {"inside": mark, "session": F.when(is_session, F.trim(F.coalesce(F.get(F.split("line", "\t"), F.lit(1)), F.lit("")))), "rps_query": F.when(is_query, F.trim(F.get(q, F.lit(1)))), "definition": F.when(is_query, F.coalesce(F.get(q, F.lit(4)), F.lit("\u0000")))}
    rows = rows.select("path", "line_no", "line", "copy", is_query.alias("is_query"), F.bool_or(is_end).over(w).alias("ended"), *[F.last(c, True).over(w).alias(n) for n, c in latest.items()])
    rows = rows.where("NOT ended AND NOT copy AND (is_query OR inside AND line <> 'DOMAINS')")
    rows = rows.select("path", "line_no", "line", "is_query", F.coalesce("session", F.lit("")).alias("session"), "rps_query", "definition")
    # One order for both, so that rows are sorted once.
    w = Window.partitionBy("rps_query", "session", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    again = F.count(F.when(F.col("is_query"), 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > 1
    rank = F.count(F.when(~F.col("is_query"), 1)).over(w).cast("int")
    rows = rows.withColumns({"again": again, "rank": rank}).where("NOT is_query").withColumn("f", F.split("line", "\t"))
    bad = F.when(F.size("f") < 12, "malformed domain record").when(F.col("rps_query").isNull(), "domain before a query").when(F.col("definition") == "\u0000", "malformed query record").when(F.col("again"), "repeated query")
    where = F.concat(bad, F.lit(" at "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"))
    at = lambda k: F.trim(F.get("f", F.lit(k)))
    rows = rows.withColumn("query_id", F.when(bad.isNotNull(), F.raise_error(where).cast("string")).otherwise(F.col("definition"))).withColumn("subject_id", at(8)).withColumn("e", at(6)).withColumn("s", at(7))
    extra = F.create_map(*[x for n, k in (("hit_type", 2), ("pssm_id", 3), ("short_name", 9), ("incomplete", 10), ("superfamily_pssm", 11), ("rps_query_id", 1)) for x in (F.lit(n), at(k))], F.lit("session"), F.col("session"))
    alignments = rows.select("path", "line_no", "query_id", "subject_id", "rank", _number(at(4), "long").alias("qstart"), _number(at(5), "long").alias("qend"), F.col("e").try_cast("double").alias("evalue"), F.col("s").try_cast("double").alias("bitscore"), extra.alias("extra"))
    return long_hits(rows, {"evalue": "e", "bitscore": "s"}, most=most), alignments


def report_metrics(reports: DataFrame, text: str, paths: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Long (path, metric_name, metric_value, metric_numeric) of JSON reports: for each metric the first JSON path that is there; a missing required one is an error on reading."""
    items = []
    for name, options in paths.items():
        value = F.coalesce(*[F.get_json_object(text, p) for p in options])
        if name in required:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"missing {name}")).cast("string")).otherwise(value)
        items.append(F.struct(F.lit(name).alias("metric_name"), value.alias("metric_value")))
    rows = reports.select("path", F.explode(F.array(*items)).alias("m")).select("path", "m.*").where("metric_value IS NOT NULL")
    return rows.withColumn("metric_numeric", F.col("metric_value").try_cast("double"))


PARSERS: dict[str, Callable] = {"blast_tabular": blast, "hmmer_tblout": hmmer_table, "hmmer_domtblout": hmmer_domains, "rpsbproc_tabular": domain_blocks}


def parse_hits(name: str, lines: DataFrame, *args, **kind):
    """Parser by name; external ones (``plugin:...``) have results of their own and give none here."""
    if name.startswith("plugin:"):
        return None
    return PARSERS[name](lines, *args, **kind)


def hit_problems(results: DataFrame, keys: Sequence[str], subject: str = "subject_id") -> DataFrame:
    """(keys, problem): repeated keys, and ranks with more than one subject."""
    same = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(subject).alias("subjects"))
    return same.where("n > 1 OR subjects > 1").select(*keys, F.when(F.col("subjects") > 1, "inconsistent subject").otherwise("repeated").alias("problem"))
