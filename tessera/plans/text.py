"""Sequence, alignment and metadata queries over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import escape_formula, like, set_hash, wrap
from tessera.operators import alignment as al
from tessera.operators import composition as co
from tessera.operators import metadata as md
from tessera.operators import selection as se
from tessera.plans.tables import read
from tessera.sinks.files import cell, fasta_lines, tsv_lines
from tessera.sources import sequences as sq
from tessera.sources.hits import tabular_alignments

Q, S = {}, {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read(spark, sf_dir, "documents")
    return docs.select("source", F.concat_ws(" ", F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, "circular").otherwise(F.col("lang"))).alias("header"), (F.col("doc_id") % 700).cast("string").alias("seqid"), F.translate("text", " \nß", "-").alias("sequence"))


Q["composition_pct"] = lambda s, d: co.assembly_stats(records(s, d), ["source"]).select("source", "sequence_count", "total_length", "gc_percent", "n_percent", "ambiguous_base_percent", "invalid_base_count", "gap_count", "gap_percent", "duplicate_sequence_id_count", "duplicate_header_count", "circular_sequence_count", "contig_n50", "contig_l50", "median_sequence_length")
S["composition_pct"] = """WITH r AS (SELECT source, doc_id || ' ' || CASE WHEN doc_id % 9 = 0 THEN 'circular' ELSE lang END AS h, doc_id % 700 AS i, replace(replace(replace(text, chr(10), ''), 'ß', ''), ' ', '-') AS s FROM documents), c AS (SELECT *, upper(s) AS u, length(s) AS n FROM r),
 k AS (SELECT *, length(u) - length(translate(u, 'GC', '')) AS gc, length(u) - length(translate(u, 'AT', '')) AS ta, length(u) - length(translate(u, 'N', '')) AS nn, length(u) - length(translate(u, 'RYSWKMBDHV', '')) AS amb, length(u) - length(translate(u, '-', '')) AS gap, len(regexp_extract_all(s, '-+')) AS gaps FROM c),
 w AS (SELECT source, n, sum(n) OVER o AS cum, row_number() OVER o AS rk, sum(n) OVER (PARTITION BY source) AS t FROM k WINDOW o AS (PARTITION BY source ORDER BY n DESC ROWS UNBOUNDED PRECEDING)), x AS (SELECT source, max(n) FILTER (cum >= t * 0.5) AS contig_n50, min(rk) FILTER (cum >= t * 0.5) AS contig_l50 FROM w GROUP BY 1),
 y AS (SELECT source, count(*) AS sequence_count, CAST(sum(n) AS BIGINT) AS total_length, 100.0 * sum(gc) / sum(gc + ta) AS gc_percent, 100.0 * sum(nn) / sum(n) AS n_percent, 100.0 * sum(amb) / sum(n) AS ambiguous_base_percent, CAST(sum(n - gc - ta - nn - amb - gap) AS BIGINT) AS invalid_base_count, CAST(sum(gaps) AS BIGINT) AS gap_count, 100.0 * sum(gap) / sum(n) AS gap_percent,
 count(i) - count(DISTINCT i) AS duplicate_sequence_id_count, count(h) - count(DISTINCT h) AS duplicate_header_count, count(*) FILTER (h LIKE '% circular') AS circular_sequence_count, median(n) AS median_sequence_length FROM k GROUP BY 1) SELECT y.*, contig_n50, contig_l50 FROM y JOIN x USING (source)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read(spark, sf_dir, "documents")
    seq = F.translate("text", " \n", "")
    return docs.select(F.col("doc_id").alias("record_no"), seq.alias("sequence"), F.rpad(F.lit(""), 0, "").alias("q0"), F.substring(F.repeat(F.concat(F.lit("!5?I"), F.chr(F.col("doc_id") % 40 + 40)), F.ceil(F.length(seq) / 5).cast("int")), F.lit(1), F.length(seq)).alias("quality")).drop("q0")


Q["read_stats"] = lambda s, d: co.read_stats(reads(s, d))
S["read_stats"] = """WITH r AS (SELECT doc_id, replace(replace(text, ' ', ''), chr(10), '') AS s FROM documents), q AS (SELECT *, substr(repeat('!5?I' || chr(CAST(doc_id % 40 + 40 AS INT)), CAST(ceil(length(s) / 5.0) AS BIGINT)), 1, length(s)) AS q, length(s) AS n, upper(s) AS u FROM r), w AS (SELECT n, sum(n) OVER o AS c, row_number() OVER o AS k, sum(n) OVER () AS t FROM q WINDOW o AS (ORDER BY n DESC ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT s, count(*) AS k FROM q WHERE doc_id < 1000000 GROUP BY 1), g AS (SELECT CAST(sum(k) AS BIGINT) AS sampled, count(*) AS kinds FROM f)
SELECT count(*) AS read_count, CAST(sum(n) AS BIGINT) AS total_bases, min(n) AS read_length_min, max(n) AS read_length_max, avg(n) AS read_length_mean, 100.0 * sum(len(regexp_extract_all(q, '[5-~]'))) / sum(n) AS q20_percent, 100.0 * sum(len(regexp_extract_all(q, '[?-~]'))) / sum(n) AS q30_percent,
 100.0 * sum(length(u) - length(translate(u, 'GC', ''))) / sum(length(u) - length(translate(u, 'ACGT', ''))) AS gc_percent, 'sanger_phred33' AS quality_encoding, (SELECT max(n) FILTER (c >= t * 0.5) FROM w) AS read_length_n50, (SELECT min(k) FILTER (c >= t * 0.5) FROM w) AS read_length_l50, (SELECT sampled FROM g) AS duplicate_sampled_read_count,
 (SELECT 100.0 * (sampled - kinds) / sampled FROM g) AS duplicate_percent, (SELECT count(*) FROM f, g WHERE k > sampled * CAST(0.01 AS DOUBLE)) AS overrepresented_sequence_count, count(*) > (SELECT sampled FROM g) AS duplicate_is_sampled, 'first_n' AS duplicate_sampling_strategy FROM q"""

Q["protein_stats"] = lambda s, d: co.protein_stats(read(s, d, "documents")[0].select("lang", F.col("doc_id").alias("seqid"), F.translate("text", " .\n", "X*").alias("sequence")), ["lang"])
S["protein_stats"] = """WITH p AS (SELECT lang, doc_id, upper(replace(replace(replace(text, ' ', 'X'), '.', '*'), chr(10), '')) AS u FROM documents), q AS (SELECT *, length(u) - length(replace(u, '*', '')) - CASE WHEN u LIKE '%*' THEN 1 ELSE 0 END AS stops FROM p)
SELECT lang, count(*) AS protein_count, count(doc_id) - count(DISTINCT doc_id) AS protein_duplicate_id_count, count(*) FILTER (u = '') AS protein_empty_count, 100.0 * sum(length(u) - length(replace(u, 'X', ''))) / sum(length(u)) AS protein_x_percent, CAST(sum(stops) AS BIGINT) AS protein_internal_stop_count, count(*) FILTER (u <> '' AND u NOT LIKE 'M%') AS protein_missing_start_count, count(*) FILTER (u <> '' AND u NOT LIKE '%*') AS protein_missing_stop_count FROM q GROUP BY lang"""


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an alignment by priority: status, month, price in fixed width; - and blanks are gaps."""
    (orders,) = read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderpriority").alias("lang"), F.col("o_orderkey").alias("record_no"), F.col("o_orderkey").cast("string").alias("seqid"), F.concat("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.floor("o_totalprice").cast("string"), 9, ".")).alias("sequence"))


Q["residue_columns"] = lambda s, d: al.alignment_columns(msa(s, d), ["lang"])
S["residue_columns"] = """WITH m AS (SELECT o_orderpriority AS lang, o_orderkey AS doc_id, o_orderstatus || strftime(o_orderdate, '%Y-%m-%d') || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), 9, '.') AS s FROM orders), c AS (SELECT lang, doc_id, p, substr(s, p, 1) AS r FROM m, range(1, 21) t(p)), n AS (SELECT lang, count(*) AS k FROM m GROUP BY 1), g AS (SELECT lang, p, r, count(*) AS n, min(doc_id) AS f FROM c WHERE r NOT IN ('-', '.', '') GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY n DESC, f) AS k FROM g),
 a AS (SELECT lang, p, sum(n) AS t, count(*) AS d, max(r) FILTER (k = 1) AS top, max(n) FILTER (k = 1) AS tn FROM b GROUP BY ALL) SELECT lang, p AS column_1based, coalesce(t, 0) / n.k AS occupancy, coalesce(d, 0) AS distinct_residues, coalesce(top, '-') AS consensus, coalesce(tn / t, 0.0) AS consensus_fraction FROM n CROSS JOIN range(1, 21) r(p) LEFT JOIN a USING (lang, p)"""

Q["alignment_rows"] = lambda s, d: al.alignment_rows(msa(s, d), ["lang"])
S["alignment_rows"] = """WITH m AS (SELECT o_orderpriority AS lang, o_orderkey AS doc_id, o_orderstatus || strftime(o_orderdate, '%Y-%m-%d') || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), 9, '.') AS s FROM orders) SELECT lang, doc_id AS record_no, CAST(doc_id AS VARCHAR) AS seqid, length(s) AS alignment_length, length(translate(s, '-.', '')) AS non_gap_sites, length(translate(s, '-.', '')) / length(s) AS coverage, 1 - length(translate(s, '-.', '')) / length(s) AS gap_fraction FROM m"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = msa(spark, sf_dir)
    return al.alignment_summary(al.alignment_rows(m, ["lang"]), al.alignment_columns(m, ["lang"]), ["lang"]).withColumn("mean_coverage", F.round("mean_coverage", 6))


Q["alignment_summary"] = summary
S["alignment_summary"] = f"""WITH r AS (SELECT lang, alignment_length, round(coverage, 6) AS c FROM ({S['alignment_rows']})), c AS ({S['residue_columns']}), a AS (SELECT lang, count(*) AS sequences, max(alignment_length) AS alignment_length, round(avg(c), 6) AS mean_coverage, list_sort(list(c))[CAST(len(list(c)) // 2 + 1 AS INT)] AS median_coverage FROM r GROUP BY 1)
SELECT a.*, (SELECT count(*) FROM c WHERE c.lang = a.lang AND round(occupancy, 6) >= 0.9) AS columns_occupancy_ge_0_9, (SELECT count(*) FROM c WHERE c.lang = a.lang AND round(occupancy, 6) >= 0.7) AS columns_occupancy_ge_0_7 FROM a"""


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as wrapped FASTA, split into lines and read again."""
    (docs,) = read(spark, sf_dir, "documents")
    rec = docs.select(F.concat_ws(" ", F.col("doc_id").cast("string"), "lang").alias("header"), F.lit("").alias("seqid"), F.regexp_replace("text", "[^A-Za-z]", "").alias("sequence"), F.col("doc_id").cast("string").alias("path"))
    text = fasta_lines(rec.select("header", "seqid", "sequence")).withColumn("path", F.regexp_extract("value", "^>([0-9]+)", 1))
    lines = text.select("path", F.posexplode(F.split("value", "\n")).alias("n", "line")).select("path", (F.col("n") + 1).cast("long").alias("line_no"), "line")
    return sq.fasta_records(lines).select("header", "seqid", "sequence")


Q["fasta_round_trip"] = fasta_round_trip
S["fasta_round_trip"] = "SELECT doc_id || ' ' || lang AS header, CAST(doc_id AS VARCHAR) AS seqid, regexp_replace(text, '[^A-Za-z]', '', 'g') AS sequence FROM documents"


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    four = F.array(F.concat(F.lit("@r"), F.col("record_no").cast("string"), F.lit(" x")), F.col("sequence"), F.lit("+"), F.col("quality"))
    lines = r.select(F.lit("f").alias("path"), "record_no", F.posexplode(four).alias("k", "line")).select("path", (F.col("record_no") * 4 + F.col("k") + 1).alias("line_no"), "line")
    return sq.fastq_records(lines).select("record_no", "seqid", "sequence", F.length("quality").cast("long").alias("n"))


Q["fastq_round_trip"] = fastq_round_trip
S["fastq_round_trip"] = "SELECT doc_id AS record_no, 'r' || doc_id AS seqid, replace(replace(text, ' ', ''), chr(10), '') AS sequence, length(replace(replace(text, ' ', ''), chr(10), '')) AS n FROM documents"

Q["sequence_lengths"] = lambda s, d: co.sequence_lengths(records(s, d))
S["sequence_lengths"] = "SELECT CAST(doc_id % 700 AS VARCHAR) AS seqid, CAST(sum(length(replace(replace(text, chr(10), ''), 'ß', ''))) AS BIGINT) AS length FROM documents GROUP BY 1"

Q["ilike_no_escape"] = lambda s, d: read(s, d, "part")[0].where(like(F.col("p_name"), "%A_E%") | like(F.col("p_name"), "%\\%")).select("p_partkey", "p_name")
S["ilike_no_escape"] = "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A_E%'"

Q["tsv_cells"] = lambda s, d: read(s, d, "documents")[0].select("doc_id", cell(F.col("text")).alias("c"), escape_formula(F.concat(F.lit("="), "lang")).alias("e"))
S["tsv_cells"] = """WITH t AS (SELECT doc_id, lang, text AS s FROM documents), f AS (SELECT *, CASE WHEN regexp_matches(s, '^[=+\\-@\\t\\r]') THEN '''' || s ELSE s END AS v FROM t) SELECT doc_id, CASE WHEN regexp_matches(v, '[\\t\\n\\r"]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS c, '''=' || lang AS e FROM f"""

Q["tsv_lines"] = lambda s, d: tsv_lines(read(s, d, "nation")[0], ["n_nationkey", "n_name", "n_regionkey"])
S["tsv_lines"] = "SELECT n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS value FROM nation"

Q["fasta_wrap"] = lambda s, d: read(s, d, "documents")[0].select("doc_id", wrap(F.regexp_replace("text", "[^A-Za-z]", "")).alias("w"))
S["fasta_wrap"] = "WITH t AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents) SELECT doc_id, array_to_string([substr(s, k * 60 + 1, 60) FOR k IN range(0, greatest(1, CAST(ceil(length(s) / 60.0) AS BIGINT)))], chr(10)) AS w FROM t"

Q["input_set_hash"] = lambda s, d: read(s, d, "events")[0].groupBy("user_id").agg(set_hash(F.collect_list("event_type")).alias("identity"))
S["input_set_hash"] = "SELECT user_id, sha256(string_agg(event_type, chr(10) ORDER BY event_type)) AS identity FROM events GROUP BY 1"


def hit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's place is its three keys, compared one after the other: packed into one number, large keys would run into each other."""
    (li,) = read(spark, sf_dir, "lineitem")
    line = F.concat_ws("\t", F.concat(F.lit("q"), F.col("l_orderkey").cast("string")), F.concat(F.lit("s"), F.col("l_partkey").cast("string")), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"), F.lit("1e-5"), F.col("l_returnflag"))
    lines = li.select(F.lit("f").alias("path"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line_no"), line.alias("line"))
    got = tabular_alignments(lines, ["query", "subject", "qstart", "qend", "evalue", "note"])
    return got.select("query_id", "subject_id", F.col("rank").cast("long").alias("rank"), "qstart", "qend", "evalue", F.element_at("extra", "note").alias("note"))


Q["hit_table"] = hit_table
S["hit_table"] = "SELECT 'q' || l_orderkey AS query_id, 's' || l_partkey AS subject_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, CAST(l_linenumber AS BIGINT) AS qstart, CAST(l_suppkey AS BIGINT) AS qend, CAST(1e-5 AS DOUBLE) AS evalue, l_returnflag AS note FROM lineitem"

CONTRACT = md.Contract({"id": md.Field("id", required=True, pattern=r"ORG_\d{6}"), "size": md.Field("integer", low=3, high=45), "price": md.Field("float"), "brand": md.Field(allowed=["Brand#1", "Brand#2", "Brand#3"]), "live": md.Field("boolean")}, "id")


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    raw = p.select(F.when(k % 9 == 0, F.lit(" na ")).when(k % 7 == 0, "BAD").otherwise(F.concat(F.lit(" org_"), F.lpad((k - F.when(k % 40 == 3, 1).otherwise(0)).cast("string"), 6, "0"))).alias("id"), F.when(k % 5 == 0, "1.0").otherwise(F.col("p_size").cast("string")).alias("size"), F.when(k % 6 == 0, "n/a").otherwise("2_0.5").alias("price"), F.concat(F.lit("bRAND#"), (k % 4).cast("string")).alias("brand"), F.when(k % 2 == 0, "No").otherwise("x").alias("live"))
    return md.validate(raw, CONTRACT).select("id", "size", "price", "brand", "live", F.array_join("errors", ";").alias("errors"))


Q["schema_validation"] = validated
S["schema_validation"] = """WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'BAD' ELSE 'ORG_' || lpad(CAST(p_partkey - CASE WHEN p_partkey % 40 = 3 THEN 1 ELSE 0 END AS VARCHAR), 6, '0') END AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS size FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM r)
SELECT id, size, CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(20.5 AS DOUBLE) END AS price, CASE WHEN k % 4 = 0 THEN NULL ELSE 'Brand#' || (k % 4) END AS brand, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS live,
 array_to_string(list_filter([CASE WHEN id = 'BAD' THEN 'id: invalid' END, CASE WHEN id IS NULL THEN 'id: missing' END, CASE WHEN size IS NULL OR size < 3 OR size > 45 THEN 'size: invalid' END, CASE WHEN k % 4 = 0 THEN 'brand: invalid' END, CASE WHEN c > 1 AND id IS NOT NULL THEN 'id: repeated' END], lambda x: x IS NOT NULL), ';') AS errors FROM n"""

Q["fanout_units"] = lambda s, d: se.fanout(read(s, d, "documents")[0].select(F.col("source").alias("unit"), F.col("doc_id").alias("seqid")), read(s, d, "documents")[0].select(F.col("doc_id").alias("seqid"), F.col("text").alias("sequence"))).select("unit", "n", "fasta_hash")
S["fanout_units"] = "SELECT source AS unit, count(*) AS n, sha256(string_agg(sha256(doc_id || chr(10) || text), '' ORDER BY doc_id)) AS fasta_hash FROM documents GROUP BY 1"
