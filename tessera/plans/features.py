"""Feature and interval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features as fe
from tessera.operators import intervals as iv
from tessera.operators import nstats
from tessera.operators.predicates import attribute_filter, filter_features, in_lists, overlaps, page
from tessera.plans.tables import INTERVALS, intervals, read
from tessera.sources.features import parse_features

Q, S = {}, {}


def feature_stats_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filter_features(intervals(spark, sf_dir), types=["A", "R"], start=20, end=1500)
    got = f.groupBy("seqid").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("min_start"), F.max("end").alias("max_end"))
    return page(got, [F.desc("n"), F.asc("seqid")], limit=20)


Q["feature_stats_top"] = feature_stats_top
S["feature_stats_top"] = f"""SELECT seqid, count(*) AS n, min("start") AS min_start, max("end") AS max_end FROM {INTERVALS} WHERE type IN ('A','R') AND "end" >= 20 AND "start" <= 1500 GROUP BY seqid ORDER BY n DESC, seqid LIMIT 20"""

Q["region_filter"] = lambda s, d: filter_features(intervals(s, d), types=["A"], sources=["F"], strands=["+"], seqids=[], start=30, end=800).select("seqid", "start", "end", "id")
S["region_filter"] = f"""SELECT seqid, "start", "end", id FROM {INTERVALS} WHERE type = 'A' AND source = 'F' AND strand = '+' AND "end" >= 30 AND "start" <= 800"""

Q["attribute_filters"] = lambda s, d: filter_features(intervals(s, d), attributes=[attribute_filter("gff3", "Flag", "R"), attribute_filter("gff3", "Line", "[67]", regex=True), attribute_filter("gff3", "parent", "1")]).select("id", "type")
S["attribute_filters"] = rf"SELECT id, type FROM {INTERVALS} WHERE type = 'R' OR regexp_matches(attributes, '(^|;)\s*Line\s*=\s*[67]\s*(;|$)') OR parent = '1'"

for part in ("type", "source", "seqid"):
    Q[f"feature_stats_{part}"] = lambda s, d, p=part: fe.feature_stats(intervals(s, d))[p]
S["feature_stats_type"] = f"SELECT type, count(*) AS n FROM {INTERVALS} GROUP BY type"
S["feature_stats_source"] = f"SELECT source, count(*) AS n FROM {INTERVALS} GROUP BY source"
S["feature_stats_seqid"] = f'SELECT seqid, count(*) AS n, min("start") AS min_start, max("end") AS max_end FROM {INTERVALS} GROUP BY seqid'

Q["feature_bins"] = lambda s, d: iv.bins(intervals(s, d), ["seqid"], "start", "end", 50)
S["feature_bins"] = f"""SELECT seqid, CAST(floor(("start" - 1) / 50.0) AS BIGINT) AS bin, count(*) AS n, min("start") AS min_start, max("end") AS max_end, count(*) / 50.0 AS density FROM {INTERVALS} GROUP BY ALL"""

# Order keys and line numbers repeat; such rows come as they stand in the files, so that reruns agree.
Q["feature_rows_first"] = lambda s, d: fe.feature_rows(intervals(s, d), limit=100, ties=[F.col("_metadata.file_name"), F.col("_metadata.row_index")]).select("seqid", "type", "start", "end", "id")
S["feature_rows_first"] = f'SELECT seqid, type, "start", "end", id FROM {INTERVALS} ORDER BY line_number LIMIT 100'

Q["bed_rows"] = lambda s, d: fe.bed_rows(intervals(s, d))
S["bed_rows"] = f"""SELECT seqid AS chrom, "start" - 1 AS chrom_start, "end" AS chrom_end, id AS name, coalesce(score, 0.0) AS score, coalesce(strand, '.') AS strand FROM {INTERVALS}"""

Q["structure_stats"] = lambda s, d: fe.structure_stats(intervals(s, d).withColumn("type", F.when(F.col("type") == "A", "CDS").when(F.col("type") == "N", "gene").otherwise("exon")), ["source"])
S["structure_stats"] = f"""WITH f AS (SELECT *, CASE type WHEN 'A' THEN 'CDS' WHEN 'N' THEN 'gene' ELSE 'exon' END AS t FROM {INTERVALS})
SELECT source, count(*) AS feature_count, count(*) FILTER (t = 'gene') AS gene_count, CAST(0 AS BIGINT) AS mrna_count, count(*) FILTER (t = 'CDS') AS cds_count, count(*) FILTER (t = 'exon') AS exon_count, count(DISTINCT t) AS feature_type_count, count(DISTINCT seqid) AS seqid_count,
 CAST(0 AS BIGINT) AS seqid_mismatch_count, CAST(0 AS BIGINT) AS end_beyond_sequence_count, count(*) FILTER ("start" < 1 OR "end" < "start") AS coordinate_error_count, CAST(0 AS BIGINT) AS missing_id_count, count(id) - count(DISTINCT id) AS duplicate_id_count,
 100.0 * count(*) FILTER (t = 'CDS' AND ("end" - "start" + 1) % 3 = 0) / count(*) FILTER (t = 'CDS') AS cds_length_multiple3_percent, 100.0 * count(*) FILTER (t = 'CDS' AND phase = '0') / count(*) FILTER (t = 'CDS') AS cds_phase0_percent,
 count(*) FILTER (t = 'CDS' AND ("end" - "start" + 1) % 3 <> 0) AS cds_not_multiple3_count, count(*) AS missing_parent_count FROM f GROUP BY source"""

Q["depth_sweep"] = lambda s, d: iv.depth_segments(intervals(s, d), ["seqid"], "start", "end")
S["depth_sweep"] = f"""WITH e AS (SELECT seqid, "start" AS pos, 1 AS d FROM {INTERVALS} WHERE "start" < "end" UNION ALL SELECT seqid, "end", -1 FROM {INTERVALS} WHERE "start" < "end"), g AS (SELECT seqid, pos, sum(d) AS d FROM e GROUP BY ALL),
 w AS (SELECT seqid, pos AS seg_start, lead(pos) OVER p AS seg_end, CAST(sum(d) OVER p AS BIGINT) AS depth FROM g WINDOW p AS (PARTITION BY seqid ORDER BY pos)) SELECT * FROM w WHERE depth > 0"""

Q["depth_breadth"] = lambda s, d: iv.breadth(iv.depth_segments(intervals(s, d), ["seqid"], "start", "end"), ["seqid"])
S["depth_breadth"] = f"""WITH x AS ({S['depth_sweep']}) SELECT seqid, CAST(coalesce(sum(seg_end - seg_start) FILTER (depth >= 1), 0) AS BIGINT) AS bases_ge_1, CAST(coalesce(sum(seg_end - seg_start) FILTER (depth >= 10), 0) AS BIGINT) AS bases_ge_10,
 CAST(coalesce(sum(seg_end - seg_start) FILTER (depth >= 30), 0) AS BIGINT) AS bases_ge_30, CAST(sum((seg_end - seg_start) * depth) AS BIGINT) AS aligned_bases FROM x GROUP BY seqid"""

Q["merged_intervals"] = lambda s, d: iv.merge_intervals(intervals(s, d).select("seqid", "start", "end"), ["seqid"], "start", "end")
S["merged_intervals"] = f"""WITH a AS (SELECT seqid, "start" AS s, "end" AS e, max("end") OVER (PARTITION BY seqid ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {INTERVALS}),
 b AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT seqid, min(s) AS "start", max(e) AS "end" FROM b GROUP BY seqid, k"""


def beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    (sup,) = read(spark, sf_dir, "supplier")
    return iv.beyond_length(intervals(spark, sf_dir), sup.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").cast("string").alias("seqid"), (F.abs("s_acctbal") / 5).cast("long").alias("length")))


Q["end_beyond_length"] = beyond
S["end_beyond_length"] = f"""WITH l AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, CAST(trunc(abs(s_acctbal) / 5) AS BIGINT) AS n FROM supplier WHERE s_suppkey % 5 <> 0) SELECT count(*) FILTER (k IS NULL) AS seqid_mismatch_count, count(*) FILTER ("end" > n) AS end_beyond_sequence_count FROM {INTERVALS} f LEFT JOIN l ON f.seqid = l.k"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, = read(spark, sf_dir, "documents")
    seqs = docs.select(F.col("doc_id").alias("seqid"), F.col("text").alias("sequence"))
    regions = docs.select(F.col("doc_id").alias("seqid"), (F.col("doc_id") % 400 - 3).alias("start"), (F.col("doc_id") % 400 + F.col("doc_id") % 23).alias("end"))
    return iv.extract_regions(regions, seqs, flank=5, min_length=6).select("seqid", "status", "w_start", "w_end", "w_text")


Q["extract_window"] = windows
S["extract_window"] = """WITH r AS (SELECT doc_id AS seqid, text, doc_id % 400 - 3 AS s, doc_id % 400 + doc_id % 23 AS e, length(text) AS n FROM documents), t AS (SELECT *, CASE WHEN s < 1 OR e < s OR s > n THEN 'INVALID_COORDINATES' WHEN e - s + 1 < 6 THEN 'TOO_SHORT' ELSE 'SELECTED' END AS status FROM r)
SELECT seqid, status, CASE WHEN status = 'SELECTED' THEN greatest(1, s - 5) END AS w_start, CASE WHEN status = 'SELECTED' THEN least(n, e + 5) END AS w_end, CASE WHEN status = 'SELECTED' THEN substr(text, greatest(1, s - 5), least(n, e + 5) - greatest(1, s - 5) + 1) END AS w_text FROM t"""


def longest_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, li = read(spark, sf_dir, "orders", "lineitem")
    best = fe.heaviest_child(orders.select("o_orderkey", "o_custkey"), li, child="o_orderkey", group="o_custkey", part_parent="l_orderkey", weight=F.col("l_quantity").cast("long"))
    return best.select("o_custkey", "o_orderkey", "weight")


Q["longest_child"] = longest_child
S["longest_child"] = """WITH q AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM lineitem GROUP BY 1), r AS (SELECT o_custkey, o_orderkey, coalesce(weight, 0) AS weight, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(weight, 0) DESC, o_orderkey) AS k FROM orders LEFT JOIN q ON o_orderkey = l_orderkey) SELECT o_custkey, o_orderkey, weight FROM r WHERE k = 1"""


def longest_bed(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    """Genes are customers, transcripts their orders, CDS rows the order's lines."""
    cust, orders, li = read(spark, sf_dir, "customer", "orders", "lineitem")
    nul = lambda t: F.lit(None).cast(t)
    row = lambda df, t, s, e, i, p, n: df.select(F.lit("chr").alias("seqid"), F.lit(t).alias("type"), s.cast("long").alias("start"), e.cast("long").alias("end"), nul("double").alias("score"), nul("string").alias("strand"), i.alias("id"), p.alias("parent"), nul("string").alias("gene_id"), nul("string").alias("transcript_id"), n.cast("long").alias("line_number"))
    text = lambda p, c: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 9, "0"))
    genes = row(cust, "gene", F.col("c_custkey"), F.col("c_custkey") + 100, text("g", "c_custkey"), nul("string"), F.col("c_custkey"))
    tx = row(orders, "mRNA", F.col("o_orderkey") % 50 + 1, F.col("o_orderkey") % 97 + 60, text("t", "o_orderkey"), text("g", "o_custkey"), F.col("o_orderkey"))
    cds = row(li, "CDS", F.col("l_partkey"), F.col("l_partkey") + F.col("l_quantity"), F.lit("c"), text("t", "l_orderkey"), F.col("l_linenumber"))
    return fe.longest_transcripts(genes.unionByName(tx).unionByName(cds), "gff3", measure=measure)


Q["longest_transcript_cds"] = lambda s, d: longest_bed(s, d, "CDS")
Q["longest_transcript_span"] = lambda s, d: longest_bed(s, d, "span")
_BED = """SELECT 'chr' AS chrom, CAST(c_custkey - 1 AS BIGINT) AS chrom_start, CAST(c_custkey + 100 AS BIGINT) AS chrom_end, 't' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS name, CAST(0.0 AS DOUBLE) AS score, '.' AS strand FROM r JOIN customer ON c_custkey = o_custkey WHERE k = 1"""
S["longest_transcript_cds"] = f"""WITH q AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT) + 1) AS w FROM lineitem GROUP BY 1), r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(w, 0) DESC, o_orderkey) AS k FROM orders LEFT JOIN q ON o_orderkey = l_orderkey) {_BED}"""
S["longest_transcript_span"] = f"""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 97 + 60) - (o_orderkey % 50 + 1) DESC, o_orderkey) AS k FROM orders) {_BED}"""


def gff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as GFF3 lines and parsed again."""
    f = intervals(spark, sf_dir)
    text = F.concat_ws("\t", "seqid", "source", "type", (F.col("start") + 1).cast("string"), (F.col("end") + 1).cast("string"), F.lit("."), "strand", "phase", F.concat(F.lit("ID="), "id", F.lit(";Parent="), "parent", F.lit(";Note=a%20b%2Bc+d")))
    lines = f.select(F.lit("x").alias("path"), F.col("line_number").alias("line_no"), text.alias("line"))
    return parse_features(lines).select("seqid", "source", "type", "start", "end", "score", "strand", "phase", "id", "parent", "line_number")


Q["gff_round_trip"] = gff_round_trip
S["gff_round_trip"] = f'SELECT seqid, source, type, "start" + 1 AS "start", "end" + 1 AS "end", CAST(NULL AS DOUBLE) AS score, strand, phase, id, parent, line_number FROM {INTERVALS}'

Q["n50_by_group"] = lambda s, d: nstats.nx(read(s, d, "documents")[0], ["lang"], "n_chars", {"50": 0.5, "90": 0.9})
S["n50_by_group"] = """WITH w AS (SELECT lang, n_chars AS n, sum(n_chars) OVER p AS c, row_number() OVER p AS k, sum(n_chars) OVER (PARTITION BY lang) AS t FROM documents WINDOW p AS (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, max(n) FILTER (c >= t * 0.5) AS n50, min(k) FILTER (c >= t * 0.5) AS l50, max(n) FILTER (c >= t * CAST(0.9 AS DOUBLE)) AS n90, min(k) FILTER (c >= t * CAST(0.9 AS DOUBLE)) AS l90 FROM w GROUP BY lang"""

Q["nx_histogram"] = lambda s, d: nstats.nx(nstats.histogram(read(s, d, "lineitem")[0].withColumn("q", F.col("l_quantity").cast("long")), ["l_returnflag"], "q"), ["l_returnflag"], "q", {"50": 0.5}, counts="n")
S["nx_histogram"] = """WITH x AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q FROM lineitem), w AS (SELECT l_returnflag, q, sum(q) OVER p AS c, row_number() OVER p AS k, sum(q) OVER (PARTITION BY l_returnflag) AS t FROM x WINDOW p AS (PARTITION BY l_returnflag ORDER BY q DESC ROWS UNBOUNDED PRECEDING))
SELECT l_returnflag, max(q) FILTER (c >= t * 0.5) AS n50, min(k) FILTER (c >= t * 0.5) AS l50 FROM w GROUP BY 1"""

Q["length_summary"] = lambda s, d: nstats.length_summary(read(s, d, "documents")[0], ["source"], "n_chars")
S["length_summary"] = "SELECT source, count(n_chars) AS records, CAST(sum(n_chars) AS BIGINT) AS total_length, min(n_chars) AS min_length, max(n_chars) AS max_length, avg(n_chars) AS mean_length, median(n_chars) AS median_length FROM documents GROUP BY source"

Q["histogram_median"] = lambda s, d: nstats.histogram(read(s, d, "lineitem")[0], ["l_shipdate"], "l_quantity").groupBy(F.year("l_shipdate").alias("y")).agg(nstats.median_of_counts(F.col("l_quantity"), F.col("n")).alias("median_quantity"))
S["histogram_median"] = "SELECT CAST(year(l_shipdate) AS INT) AS y, median(l_quantity) AS median_quantity FROM lineitem GROUP BY 1"

Q["upper_median"] = lambda s, d: nstats.upper_median(read(s, d, "documents")[0].select("lang", "n_chars"), ["lang"], "n_chars")
S["upper_median"] = "SELECT lang, list_sort(list(n_chars))[CAST(len(list(n_chars)) // 2 + 1 AS INT)] AS n_chars FROM documents GROUP BY lang"

Q["two_sided_overlap"] = lambda s, d: in_lists(intervals(s, d), {"type": ["N"]}).where(overlaps(F.col("start"), F.col("end"), 100, None)).groupBy("strand").agg(F.count(F.lit(1)).alias("n"))
S["two_sided_overlap"] = f"""SELECT strand, count(*) AS n FROM {INTERVALS} WHERE type = 'N' AND "end" >= 100 GROUP BY strand"""
