"""Sinks: TSV with formula escaping, FASTA, BED, row renderings, bundles with checksums."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import escape_formula, wrap


def cell(value: Column, *, formulas: bool = True) -> Column:
    """TSV cell of a value: null is empty, formulas are escaped, cells with tabs, quotes or line ends are quoted."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = escape_formula(text) if formulas else text
    return F.when(text.rlike("[\t\n\r\"]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def tsv_lines(df: DataFrame, columns: Sequence[str], *, formulas: bool = True) -> DataFrame:
    """One column ``value`` with the TSV line of each row."""
    return df.select(F.concat_ws("\t", *[cell(F.col(c), formulas=formulas) for c in columns]).alias("value"))


def write_tsv(df: DataFrame, path: str, columns: Sequence[str], *, formulas: bool = True) -> None:
    """Part files of TSV lines; each has the header."""
    quoted = df.select(*[cell(F.col(c), formulas=formulas).alias(c) for c in columns])
    quoted.write.mode("overwrite").csv(path, sep="\t", header=True, quote="\u0000", escape="\u0000", emptyValue="")


def fasta_lines(records: DataFrame, width: int = 60) -> DataFrame:
    """One column ``value``: header and wrapped sequence of each record."""
    head = F.concat(F.lit(">"), F.coalesce("header", "seqid"))
    return records.select(F.when(F.length("sequence") > 0, F.concat_ws("\n", head, wrap(F.col("sequence"), width))).otherwise(head).alias("value"))


def write_fasta(records: DataFrame, path: str, width: int = 60) -> None:
    fasta_lines(records, width).write.mode("overwrite").text(path)


def bed_lines(rows: DataFrame) -> DataFrame:
    """BED text; no escaping, whole scores without a decimal point."""
    score = F.when(F.col("score") == F.floor("score"), F.col("score").cast("long").cast("string")).otherwise(F.col("score").cast("string"))
    return rows.select(F.concat_ws("\t", "chrom", F.col("chrom_start").cast("string"), F.col("chrom_end").cast("string"), "name", score, "strand").alias("value"))


def six_places(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles as texts with six decimals."""
    return df.withColumns({c: F.format_string("%.6f", F.col(c).cast("double")) for c in columns})


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def table_digest(df: DataFrame) -> DataFrame:
    """One row: row count and a checksum that doesn't depend on the order of rows."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("checksum"))


def write_bundle(tables: Mapping[str, DataFrame], path: str) -> dict[str, tuple[int, int]]:
    """Each table as TSV parts ordered by all its columns; returns row count and checksum by table."""
    out = {}
    for name, df in tables.items():
        write_tsv(df.orderBy(*[F.col(c).asc_nulls_first() for c in df.columns]), f"{path}/{name}", df.columns)
        got = table_digest(df).first()
        out[name] = (got["row_count"], got["checksum"])
    return out


def file_check(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, status) of manifest rows against contents (path, content): verified, failed or missing."""
    have = contents.select(F.col("path").alias("relative_path"), F.sha2("content", 256).alias("__sha"))
    out = files.join(have, "relative_path", "left")
    return out.select("file_id", F.when(F.col("__sha").isNull(), "MISSING").when(F.col("__sha") == F.col("sha256"), "CHECKSUM_VERIFIED").otherwise("CHECKSUM_FAILED").alias("status"))


def write_alignment(rows: DataFrame, columns: DataFrame, summary: DataFrame, path: str) -> None:
    """Alignment quality as two TSV tables and one JSON summary, shares with six decimals."""
    for name, df, shares in (("sequence_qc", rows, ["coverage", "gap_fraction"]), ("column_qc", columns, ["occupancy", "consensus_fraction"])):
        write_tsv(six_places(df, shares), f"{path}/{name}", df.columns)
    json_rows(summary).write.mode("overwrite").text(f"{path}/alignment_qc")


def template_header(names: list[str]) -> str:
    """Header line of an import template."""
    return "\t".join(names) + "\n"


def workbook(sheets: Mapping[str, Sequence[Sequence]]) -> bytes:
    """A workbook with the sheets given as rows of texts, the first of them the header; for templates and other small tables."""
    part = lambda kind, n: f'<Override PartName="/xl/{n}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{kind}+xml"/>'
    head, main = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def row(values: Sequence) -> str:
        return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in values) + "</row>"

    names = list(sheets)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = part("sheet.main", "workbook.xml") + "".join(part("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(map(row, sheets[n]))}</sheetData></worksheet>')
    return held.getvalue()


def table_template(columns: Sequence[tuple[str, str, bool]], examples: Sequence[Sequence] = ()) -> bytes:
    """Import template as a workbook: a data sheet with the header and examples, and a schema sheet with each column's type and whether it is required."""
    return workbook({"data": [[c for c, _, _ in columns], *examples], "schema": [("column", "type", "required"), *[(c, kind, "yes" if must else "no") for c, kind, must in columns]]})


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, written where Spark's readers find it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(data))
    stream.close()
