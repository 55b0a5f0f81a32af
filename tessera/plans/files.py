"""Parsers, sources, sinks and streams: the tables are written as lines or files of each format and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import is_false
from tessera.operators import alignment as al
from tessera.operators import measure as me
from tessera.operators import reads as rd
from tessera.operators.predicates import filter_features, page
from tessera.operators.selection import region_order
from tessera.plans.tables import INTERVALS, intervals, read
from tessera.sinks import files as out
from tessera.sources import alignments as aln
from tessera.sources import events as ev
from tessera.sources import features as fs
from tessera.sources import hits, lines, reports, sequences, tables, taxonomy
from tessera.storage import shared_folder
from tessera.streaming import events as st

Q, S = {}, {}


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tessera-files/{name}-{uuid.uuid4().hex}"


def text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
_PART = "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part"


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "tsv")
    out.write_tsv(read(spark, sf_dir, "part")[0], path, PART)
    return tables.tsv(lines.numbered_lines(spark, path), PART, ["p_partkey"]).select(*PART)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "csv")
    read(spark, sf_dir, "part")[0].select(*PART).write.csv(path, header=True)
    return tables.read_table(spark, path, PART)


Q["tsv_round_trip"], Q["csv_round_trip"] = tsv_round_trip, csv_round_trip
S["tsv_round_trip"] = S["csv_round_trip"] = _PART


def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, which are few, as a workbook's data sheet."""
    rows = [(str(r["n_nationkey"]), r["n_name"], str(r["n_regionkey"])) for r in read(spark, sf_dir, "nation")[0].collect()]
    path = place(spark, "book") + ".xlsx"
    out.write_bytes(spark, path, out.workbook({"data": [("n_nationkey", "n_name", "n_regionkey"), *rows], "schema": [("column", "type"), ("n_nationkey", "integer")]}))
    return tables.read_table(spark, path, ["n_nationkey", "n_name", "n_regionkey"])


Q["workbook_round_trip"] = workbook_round_trip
S["workbook_round_trip"] = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "json")
    read(spark, sf_dir, "orders")[0].select(F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("role"), F.col("o_totalprice").alias("size")).write.json(path)
    return page(tables.json_lines(spark, path, "file_id long, role string, size double"), [F.desc("size"), F.asc("file_id")])


Q["manifest_rows"] = manifest_rows
S["manifest_rows"] = "SELECT o_orderkey AS file_id, o_orderpriority AS role, o_totalprice AS size FROM orders"


def features_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built once for an identity, found again, and pruned by its file and ranges."""
    path, rows = place(spark, "index"), intervals(spark, sf_dir).withColumn("file_id", F.lit("f1"))
    fs.ensure_index(spark, path, "one", lambda: rows)
    again = fs.ensure_index(spark, path, "one", lambda: rows.limit(0))
    return filter_features(again.where("file_id = 'f1'"), types=["A"], seqids=[], start=40, end=900).select("seqid", "start", "end", "id", "line_number")


Q["features_index"] = features_index
S["features_index"] = f"""SELECT seqid, "start", "end", id, line_number FROM {INTERVALS} WHERE type = 'A' AND "end" >= 40 AND "start" <= 900"""

Q["region_order"] = lambda s, d: page(intervals(s, d).select("seqid", "start", "end", F.when(F.col("type") == "R", None).otherwise(F.col("id")).alias("subject_id")), region_order(), limit=300)
S["region_order"] = f"""SELECT seqid, "start", "end", CASE WHEN type <> 'R' THEN id END AS subject_id FROM {INTERVALS} ORDER BY seqid, "start", "end", coalesce(CASE WHEN type <> 'R' THEN id END, '') LIMIT 300"""


def gtf_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute columns of both dialects, as maps and as the names wanted."""
    (p,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    p = p.select("p_partkey", "p_brand", text("ID=x%20", k, "+;Note=a;Note=", F.col("p_brand"), ";bad;=y").alias("g3"), text('gene_id "g', k, '"; transcript_id "t%20"; note "two words"; tag=z').alias("gtf"))
    m, t = fs.attribute_map(F.col("g3")), fs.attribute_map(F.col("gtf"), "gtf")
    w = fs.attributes(F.col("gtf"), ["gene_id", "none"], "gtf")
    return p.select("p_partkey", F.element_at(m, "ID").alias("id"), F.element_at(m, "Note").alias("note"), F.size(m).cast("long").alias("n"), F.element_at(t, "transcript_id").alias("transcript"), F.element_at(t, "note").alias("words"), F.element_at(t, "tag").alias("tag"), w["gene_id"].alias("gene"), w["none"].alias("none"))


Q["gtf_attributes"] = gtf_attributes
S["gtf_attributes"] = "SELECT p_partkey, 'x ' || p_partkey || '+' AS id, p_brand AS note, CAST(3 AS BIGINT) AS n, 't%20' AS transcript, 'two words' AS words, 'z' AS tag, 'g' || p_partkey AS gene, CAST(NULL AS VARCHAR) AS none FROM part"

#: A line's place: by order, then by line, part and supplier.
_AT = "CAST(l_orderkey AS BIGINT) * 1000000000000 + (l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey"


def _line() -> Column:
    return F.col("l_orderkey") * 1_000_000_000_000 + (F.col("l_linenumber") * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")


def _item(c: str) -> Column:
    return F.col(c).cast("string")


def _hmmer_lines(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """One report for each line status; that of O is of hmmsearch, whose targets are the queries."""
    (li,) = read(spark, sf_dir, "lineitem")
    body = li.select(F.col("l_linestatus").alias("path"), _line().alias("line_no"), line.alias("line"))
    head = spark.createDataFrame([("O", -2, "# Program:         hmmsearch"), ("F", -2, "# Program:         hmmscan"), ("F", -1, ""), ("O", -1, "#---")], "path string, line_no long, line string")
    return body.unionByName(head)


def hmmer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("  ", text("t", _item("l_partkey")), F.lit("-"), text("q", _item("l_orderkey")), F.lit("-"), text(_item("l_linenumber"), "e-5"), _item("l_suppkey"), F.lit("0.1 x y"))
    return hits.parse_hits("hmmer_tblout", _hmmer_lines(spark, sf_dir, line)).select("path", "query_id", "subject_id", "metric_name", "metric_value", "metric_numeric", F.col("rank").cast("long").alias("rank"))


Q["hmmer_table"] = hmmer_table
S["hmmer_table"] = f"""WITH r AS (SELECT l_linestatus AS path, CASE l_linestatus WHEN 'O' THEN 't' || l_partkey ELSE 'q' || l_orderkey END AS query_id, CASE l_linestatus WHEN 'O' THEN 'q' || l_orderkey ELSE 't' || l_partkey END AS subject_id, l_linenumber || 'e-5' AS e, CAST(l_suppkey AS VARCHAR) AS s, {_AT} AS pos FROM lineitem),
 k AS (SELECT *, row_number() OVER (PARTITION BY path, query_id ORDER BY pos) AS rank FROM r) SELECT path, query_id, subject_id, m AS metric_name, CASE m WHEN 'evalue' THEN e ELSE s END AS metric_value, CAST(CASE m WHEN 'evalue' THEN e ELSE s END AS DOUBLE) AS metric_numeric, rank FROM k, (VALUES ('evalue'), ('score')) v(m) WHERE rank <= 5"""


def hmmer_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = [text("t", _item("l_partkey")), F.lit("-"), F.lit("90"), text("q", _item("l_orderkey")), *[F.lit("0")] * 8, text(_item("l_linenumber"), "e-3"), _item("l_suppkey"), F.lit("0"), F.lit("3"), F.lit("7"), _item("l_partkey"), (F.col("l_partkey") + 9).cast("string"), F.lit("1"), F.lit("8"), F.lit("0.9"), F.lit("free text")]
    _, a = hits.parse_hits("hmmer_domtblout", _hmmer_lines(spark, sf_dir, F.concat_ws(" ", *part)), swap=False)
    return a.select("path", "query_id", "subject_id", F.col("rank").cast("long").alias("rank"), "qstart", "qend", "evalue", "bitscore", F.element_at("extra", "hmm_to").alias("hmm_to"), F.element_at("extra", "env_from").alias("env_from"))


Q["hmmer_domains"] = hmmer_domains
S["hmmer_domains"] = f"""SELECT l_linestatus AS path, 'q' || l_orderkey AS query_id, 't' || l_partkey AS subject_id, row_number() OVER (PARTITION BY l_linestatus, l_orderkey ORDER BY {_AT}) AS rank, CAST(l_partkey AS BIGINT) AS qstart, CAST(l_partkey + 9 AS BIGINT) AS qend, CAST(l_linenumber || 'e-3' AS DOUBLE) AS evalue, CAST(l_suppkey AS DOUBLE) AS bitscore, '7' AS hmm_to, '1' AS env_from FROM lineitem"""


def domain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each order: session, query, its lines as domains, sites that are skipped; what follows ENDDATA is not read."""
    orders, li = read(spark, sf_dir, "orders", "lineitem")
    base, last = F.col("o_orderkey") * 1_000_000_000_000, (F.col("o_orderkey") + 1) * 1_000_000_000_000
    k = _item("o_orderkey")
    block = orders.select(F.explode(F.array(*[F.struct(at.alias("line_no"), line.alias("line")) for at, line in (
        (base + 1, text("QUERY\tQ#", k, "\tPeptide\t90\torder_", k, " of it")), (base + 2, F.lit("DOMAINS")), (last - 4, F.lit("ENDDOMAINS")), (last - 3, F.lit("SITES")), (last - 2, F.lit("not\ta\tdomain")), (last - 1, F.lit("ENDSITES")),
    )])).alias("b")).select("b.*")
    item = F.concat_ws("\t", F.lit("1"), text("Q#", _item("l_orderkey")), F.lit("specific"), text("p", _item("l_suppkey")), _item("l_partkey"), (F.col("l_partkey") + 9).cast("string"), text(_item("l_linenumber"), "e-2"), _item("l_suppkey"), text("acc", _item("l_partkey")), F.col("l_returnflag"), F.lit("-"), F.lit("sf"))
    # The report's end takes the largest numbers there are, after the blocks of all orders.
    ends = spark.createDataFrame([(-2, "#comment"), (-1, "SESSION\t1\tprog"), ((1 << 63) - 2, "ENDDATA"), ((1 << 63) - 1, "garbage")], "line_no long, line string")
    rows = block.unionByName(li.select(_line().alias("line_no"), item.alias("line"))).unionByName(ends).select(F.lit("f").alias("path"), "line_no", "line")
    _, a = hits.parse_hits("rpsbproc_tabular", rows)
    return a.select("query_id", "subject_id", F.col("rank").cast("long").alias("rank"), "qstart", "qend", "evalue", "bitscore", F.element_at("extra", "short_name").alias("short_name"), F.element_at("extra", "rps_query_id").alias("rps"), F.element_at("extra", "session").alias("session"))


Q["domain_blocks"] = domain_blocks
S["domain_blocks"] = f"""SELECT 'order_' || l_orderkey || ' of it' AS query_id, 'acc' || l_partkey AS subject_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_AT}) AS rank, CAST(l_partkey AS BIGINT) AS qstart, CAST(l_partkey + 9 AS BIGINT) AS qend, CAST(l_linenumber || 'e-2' AS DOUBLE) AS evalue, CAST(l_suppkey AS DOUBLE) AS bitscore, l_returnflag AS short_name, 'Q#' || l_orderkey AS rps, '1' AS session FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""

Q["report_metrics"] = lambda s, d: hits.report_metrics(read(s, d, "events")[0].select(F.col("event_id").cast("string").alias("path"), "props"), "props", {"k": ["$.results.k", "$.k"], "none": ["$.none"]}, ["k"])
S["report_metrics"] = "SELECT CAST(event_id AS VARCHAR) AS path, 'k' AS metric_name, json_extract_string(props, '$.k') AS metric_value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS metric_numeric FROM events"

Q["hit_problems"] = lambda s, d: hits.hit_problems(read(s, d, "lineitem")[0].select("l_orderkey", F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("subject_id")), ["l_orderkey", "rank"])
S["hit_problems"] = "SELECT l_orderkey, l_linenumber AS rank, CASE WHEN count(DISTINCT l_partkey) > 1 THEN 'inconsistent subject' ELSE 'repeated' END AS problem FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


def taxonomy_json(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers under nations under regions, in the two layouts of a taxonomy object."""
    region, nation, cust = read(spark, sf_dir, "region", "nation", "customer")
    j = lambda **f: F.to_json(F.struct(*[v.alias(k) for k, v in f.items()]))
    n = lambda c: F.col(c).cast("long")
    rows = [
        spark.range(1).select(F.lit('{"taxId": 1, "rank": null, "scientific_name": "root"}').alias("value")),
        region.select(j(taxonomy=F.struct((n("r_regionkey") + 10).alias("tax_id"), F.array(F.lit(1), F.lit(7)).alias("parents"), F.lit("Sub Family").alias("rank"), F.struct(F.col("r_name").alias("name")).alias("currentScientificName"), (F.col("r_regionkey") == 4).alias("extinct"))).alias("value")),
        nation.select(j(taxId=n("n_nationkey") + 100, parent_tax_id=n("n_regionkey") + 10, rank=F.lit("GENUS"), organism_name=F.col("n_name")).alias("value")),
        cust.select(j(taxid=n("c_custkey") + 1000, parentTaxId=n("c_nationkey") + 100, rank=F.lit("species"), scientific_name=F.col("c_name"), secondaryTaxIds=F.array((n("c_custkey") + 10_000_000).cast("string"))).alias("value")),
    ]
    return taxonomy.nodes_from_json(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]))


Q["taxonomy_nodes"], Q["taxonomy_aliases"] = (lambda s, d: taxonomy_json(s, d)[0]), (lambda s, d: taxonomy_json(s, d)[1])
S["taxonomy_nodes"] = "SELECT 1 AS taxid, 1 AS parent_taxid, 'no_rank' AS rank, 'root' AS scientific_name, CAST(NULL AS INT) AS is_extinct UNION ALL SELECT r_regionkey + 10, 1, 'sub_family', r_name, CAST(r_regionkey = 4 AS INT) FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'genus', n_name, NULL FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, 'species', c_name, NULL FROM customer"
S["taxonomy_aliases"] = "SELECT c_custkey + 10000000 AS alias_taxid, c_custkey + 1000 AS current_taxid, 'MERGED' AS status FROM customer"


def taxonomy_dump(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    region, nation, cust = read(spark, sf_dir, "region", "nation", "customer")
    row = lambda *f: F.concat(F.concat_ws("\t|\t", *[c.cast("string") if isinstance(c, Column) else F.lit(c) for c in f]), F.lit("\t|"))
    one = lambda df, *f: df.select(row(*f).alias("line"))
    names = one(region, F.col("r_regionkey") + 10, F.col("r_name"), "", "scientific name").unionByName(one(region, F.col("r_regionkey") + 10, "other", "", "synonym")).unionByName(one(nation, F.col("n_nationkey") + 100, F.col("n_name"), "u", "scientific name")).unionByName(one(cust, F.col("c_custkey") + 1000, F.col("c_name"), "", "scientific name"))
    nodes = one(region, F.col("r_regionkey") + 10, F.col("r_regionkey") + 10, "no rank", "").unionByName(one(nation, F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, "Genus", "")).unionByName(one(cust, F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, "species", ""))
    return taxonomy.nodes_from_dump(names, nodes, one(cust, F.col("c_custkey") + 5_000_000, F.col("c_custkey") + 1000), one(nation, F.col("n_nationkey") + 9_000_000))


Q["taxonomy_dump"] = lambda s, d: taxonomy_dump(s, d)[0].select("taxid", "parent_taxid", "rank", "scientific_name")
S["taxonomy_dump"] = "SELECT r_regionkey + 10 AS taxid, r_regionkey + 10 AS parent_taxid, 'no_rank' AS rank, r_name AS scientific_name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'genus', n_name FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, 'species', c_name FROM customer"
Q["taxonomy_dump_aliases"] = lambda s, d: taxonomy_dump(s, d)[1]
S["taxonomy_dump_aliases"] = "SELECT c_custkey + 5000000 AS alias_taxid, c_custkey + 1000 AS current_taxid, 'MERGED' AS status FROM customer UNION ALL SELECT n_nationkey + 9000000, NULL, 'DELETED' FROM nation"
Q["unnamed_nodes"] = lambda s, d: taxonomy.unnamed(read(s, d, "part")[0].select(F.col("p_partkey").alias("taxid"), "p_brand"), read(s, d, "lineitem")[0].where("l_quantity >= 45 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("taxid")))
S["unnamed_nodes"] = "SELECT p_partkey AS taxid, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R')"
Q["snapshot_problems"] = lambda s, d: taxonomy.snapshot_problems(read(s, d, "orders")[0].select((F.col("o_orderkey") % 1000).alias("taxid"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 5000).otherwise(0)).alias("parent_taxid")))
S["snapshot_problems"] = "WITH n AS (SELECT o_orderkey % 1000 AS taxid, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 5000 ELSE 0 END AS p FROM orders) SELECT taxid, 'repeated' AS problem FROM n GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT taxid, 'unknown parent' FROM n WHERE p NOT IN (SELECT taxid FROM n) UNION ALL SELECT NULL, 'no root' WHERE NOT EXISTS (SELECT 1 FROM n WHERE taxid = p)"


def assembly_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each nation: an object with reports, an array, or a report per line."""
    (cust,) = read(spark, sf_dir, "customer")
    one = F.to_json(F.struct(text("GCA_", _item("c_custkey"), ".1").alias("accession"), F.struct(F.col("c_name").alias("organism_name"), F.col("c_custkey").alias("tax_id")).alias("organism"), F.struct(F.lit("2020-05-01T00:00").alias("release_date"), F.col("c_mktsegment").alias("assembly_level")).alias("assembly_info")))
    each = cust.select("c_nationkey", "c_custkey", one.alias("j")).groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "j"))), lambda x: x["j"]).alias("js"))
    body = F.when(F.col("c_nationkey") % 3 == 0, text('{"reports": [', F.array_join("js", ","), "]}")).when(F.col("c_nationkey") % 3 == 1, text("[", F.array_join("js", ", "), "]")).otherwise(F.array_join("js", "\r\n"))
    got = reports.flat_records(reports.report_objects(each.select(_item("c_nationkey").alias("path"), body.alias("text"))))
    return got.select("path", F.col("n").cast("long").alias("n"), "accession", "organism_name", "taxon_id", "assembly_level", "release_date")


Q["assembly_reports"] = assembly_reports
S["assembly_reports"] = "SELECT CAST(c_nationkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, 'GCA_' || c_custkey || '.1' AS accession, c_name AS organism_name, CAST(c_custkey AS VARCHAR) AS taxon_id, c_mktsegment AS assembly_level, '2020-05-01' AS release_date FROM customer"

Q["merged_reports"] = lambda s, d: reports.merge_aliases(read(s, d, "orders")[0].select("o_orderkey", text("c", _item("o_custkey")).alias("a"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(text("c", _item("o_custkey"))).alias("b"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("level")), "o_orderkey", ["a", "b"], "o_orderkey", ["level"])
S["merged_reports"] = "SELECT min(o_orderkey) AS label, max_by(CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) AS level, count(*) AS merged FROM orders GROUP BY o_custkey"
Q["merge_nonempty"] = lambda s, d: reports.merge_fields(read(s, d, "customer")[0].select("c_custkey", "c_name", "c_mktsegment"), read(s, d, "supplier")[0].select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name")).alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment")), "c_custkey", ["c_name", "c_mktsegment"])
S["merge_nonempty"] = "SELECT c_custkey, CASE WHEN s_suppkey % 2 <> 0 THEN s_name ELSE c_name END AS c_name, c_mktsegment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"
Q["sample_attributes"] = lambda s, d: reports.sample_attributes(read(s, d, "events")[0].select("event_id", F.to_json(F.array(F.struct(F.lit(" Geo  Loc-Name").alias("name"), F.col("event_type").alias("value")), F.struct(F.lit("geo loc name").alias("name"), F.lit("later").alias("value")), F.struct(F.lit("K").alias("name"), F.col("props").alias("value")))).alias("j")), "j").select("event_id", F.element_at("attributes", "geo_loc_name").alias("geo"), F.element_at("attributes", "k").alias("k"), F.size("attributes").cast("long").alias("n"))
S["sample_attributes"] = "SELECT event_id, event_type AS geo, props AS k, CAST(2 AS BIGINT) AS n FROM events"


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    line = text('{"event_id":"', _item("event_id"), '","type":"', F.col("event_type"), '","metric":"m', _item("user_id"), '"}')
    return ev.events(e.select(F.lit("f").alias("path"), F.col("event_id").alias("line_no"), line.alias("line")))


Q["event_payloads"] = event_payloads
S["event_payloads"] = """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS type, 'm' || user_id AS payload, sha256('{"event_id":"' || event_id || '","type":"' || event_type || '","metric":"m' || user_id || '"}') AS content FROM events"""
Q["unowned_metrics"] = lambda s, d: ev.owned_metrics(read(s, d, "events")[0].select(F.lit("customer").alias("entity_type"), F.col("user_id").alias("entity_id"), "event_id"), read(s, d, "orders")[0].where("o_orderpriority = '1-URGENT'").select(F.lit("customer").alias("entity_type"), F.col("o_custkey").alias("entity_id")))[1]
S["unowned_metrics"] = "SELECT 'customer' AS entity_type, user_id AS entity_id, event_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"
Q["unit_assignments"] = lambda s, d: tables.assignments(read(s, d, "lineitem")[0].select(text(" ", F.col("l_returnflag")).alias("unit"), text(" s", _item("l_partkey"), " note").alias("seqid"))).select("unit", F.array_join("seqids", ",").alias("seqids"), "repeated")
S["unit_assignments"] = "SELECT l_returnflag AS unit, string_agg(DISTINCT 's' || l_partkey, ',' ORDER BY 's' || l_partkey) AS seqids, count(*) - count(DISTINCT l_partkey) AS repeated FROM lineitem GROUP BY 1"


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of two tables: the counts it reports, beside those of its files."""
    region, part = read(spark, sf_dir, "region", "part")
    path = place(spark, "bundle")
    said = out.write_bundle({"region": region, "part": part.select(*PART)}, path)
    found = [tables.tsv(lines.numbered_lines(spark, f"{path}/{n}"), [k]).agg(F.count(k).alias("rows"), F.min(k).alias("least")).select(F.lit(n).alias("name"), "rows", F.lit(said[n][0]).cast("long").alias("row_count"), "least") for n, k in (("region", "r_name"), ("part", "p_name"))]
    return found[0].unionByName(found[1])


Q["bundle"] = bundle
S["bundle"] = "SELECT 'region' AS name, count(*) AS rows, count(*) AS row_count, min(r_name) AS least FROM region UNION ALL SELECT 'part', count(*), count(*), min(p_name) FROM part"


def alignment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column table of an alignment of returned items' dates, as written."""
    (li,) = read(spark, sf_dir, "lineitem")
    m = li.select(_line().alias("record_no"), _item("l_orderkey").alias("seqid"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("sequence"))
    rows, columns = al.alignment_rows(m), al.alignment_columns(m)
    path = place(spark, "alignment")
    out.write_alignment(rows, columns, al.alignment_summary(rows, columns), path)
    names = ["column_1based", "occupancy", "distinct_residues", "consensus_fraction"]
    return tables.tsv(lines.numbered_lines(spark, f"{path}/column_qc"), names).select(*names)


Q["alignment_files"] = alignment_files
S["alignment_files"] = """WITH c AS (SELECT p, substr(strftime(l_shipdate, '%Y-%m-%d'), p, 1) AS r FROM lineitem, range(1, 11) t(p)), g AS (SELECT p, r, count(*) AS n FROM c WHERE r <> '-' GROUP BY ALL), a AS (SELECT p, sum(n) AS t, count(*) AS d, max(n) AS m FROM g GROUP BY 1)
SELECT CAST(r.p AS VARCHAR) AS column_1based, printf('%.6f', coalesce(t, 0) / (SELECT count(*) FROM lineitem)) AS occupancy, CAST(coalesce(d, 0) AS VARCHAR) AS distinct_residues, printf('%.6f', coalesce(m / t, 0.0)) AS consensus_fraction FROM range(1, 11) r(p) LEFT JOIN a ON a.p = r.p"""

Q["report_rows"] = lambda s, d: out.json_rows(out.six_places(read(s, d, "orders")[0].select("o_orderkey", F.round(F.col("o_totalprice") / 4, 1).alias("share"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("level")), ["share"]))
S["report_rows"] = """SELECT '{"o_orderkey":' || o_orderkey || ',"share":"' || printf('%.6f', round(o_totalprice / 4, 1)) || '","level":' || CASE WHEN o_orderstatus = 'F' THEN '"' || o_orderpriority || '"' ELSE 'null' END || '}' AS value FROM orders"""

Q["verify_files"] = lambda s, d: out.file_check(read(s, d, "documents")[0].select(F.col("doc_id").alias("file_id"), _item("doc_id").alias("relative_path"), F.sha2(text(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")), 256).alias("sha256")), read(s, d, "documents")[0].where("source <> 'src1'").select(_item("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content")))
S["verify_files"] = "SELECT doc_id AS file_id, CASE WHEN source IS NULL OR source = 'src1' THEN 'MISSING' WHEN doc_id % 5 = 0 THEN 'CHECKSUM_FAILED' ELSE 'CHECKSUM_VERIFIED' END AS status FROM documents"


def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as FASTA text of their language, in numbered lines."""
    (docs,) = read(spark, sf_dir, "documents")
    body = F.array(text(">", _item("doc_id"), " ", F.col("source")), F.regexp_replace("text", "[^A-Za-z]", ""))
    at = docs.select(F.col("lang").alias("path"), "doc_id", F.posexplode(body).alias("k", "line"))
    return at.select("path", (F.col("doc_id") * 2 + F.col("k") + 1).alias("line_no"), "line")


Q["measured_files"] = lambda s, d: me.measure(fasta_files(s, d), "fasta").where("metric_name IN ('sequence_count', 'total_length', 'gc_percent', 'parseable', 'max_sequence_length')").select("path", "qc_stage", "metric_name", F.round("metric_numeric", 6).alias("metric_numeric"), "metric_unit")
_FA = "(SELECT lang, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS u FROM documents)"
S["measured_files"] = f"""WITH a AS (SELECT lang, count(*) AS c, sum(n) AS t, max(n) AS m, 100.0 * sum(length(u) - length(translate(u, 'GC', ''))) / sum(length(u) - length(translate(u, 'ACGT', ''))) AS gc FROM {_FA} GROUP BY 1)
SELECT lang AS path, 'assembly' AS qc_stage, v.m AS metric_name, CAST(round(CASE v.m WHEN 'sequence_count' THEN c WHEN 'total_length' THEN t WHEN 'gc_percent' THEN gc WHEN 'parseable' THEN 1 ELSE a.m END, 6) AS DOUBLE) AS metric_numeric, v.u AS metric_unit FROM a, (VALUES ('sequence_count', 'count'), ('total_length', 'bp'), ('gc_percent', 'percent'), ('parseable', 'count'), ('max_sequence_length', 'bp')) v(m, u)"""

PROFILE = {"required": [{"metric": "parseable", "operator": "==", "value": 1}, {"metric": "sequence_count", "operator": ">=", "value": 40}], "warnings": [{"metric": "total_length", "operator": "<", "value": 60000}]}
Q["measured_and_judged"] = lambda s, d: me.run(fasta_files(s, d), "fasta", PROFILE, ["parseable", "sequence_count", "total_length"]).select("path", "decision", F.array_join("reason_codes", ",").alias("reasons"))
S["measured_and_judged"] = f"""SELECT lang AS path, CASE WHEN count(*) < 40 THEN 'FAIL' WHEN sum(n) < 60000 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS decision, array_to_string(list_filter([CASE WHEN count(*) < 40 THEN 'SEQUENCE_COUNT_FAILED' END, CASE WHEN sum(n) < 60000 THEN 'TOTAL_LENGTH_WARNING' END], lambda x: x IS NOT NULL), ',') AS reasons FROM {_FA} GROUP BY 1"""
Q["record_counts"] = lambda s, d: sequences.record_count(sequences.fasta_records(fasta_files(s, d)))
S["record_counts"] = "SELECT lang AS path, count(*) AS records FROM documents GROUP BY 1"

Q["failed_metrics"] = lambda s, d: read(s, d, "events")[0].select("event_id", is_false(F.when(F.col("value") > 100, F.col("value") - F.col("value")), F.when(F.col("event_type") == "view", " No ").when(F.col("event_type") == "click", "false").otherwise("1")).alias("failed"))
S["failed_metrics"] = "SELECT event_id, coalesce(value > 100, false) OR event_type IN ('view', 'click') AS failed FROM events"


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, each of them once, into a table of the shared folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    twice = stream.select(F.explode(F.array(F.struct("*"), F.struct("*"))).alias("e")).select("e.*")
    path = place(spark, "stream")
    return st.run_to(st.once(twice, delay="3650 days"), f"{path}/rows", f"{path}/state").select("event_id", "user_id", "event_type")


Q["stream_once"] = stream_once
S["stream_once"] = "SELECT event_id, user_id, event_type FROM events"


def bam_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, which are few, as the reads of a BAM file."""
    rows = [{"qname": r["n_name"], "flag": 99 if r["n_nationkey"] % 2 else 4, "rname": None if r["n_nationkey"] % 2 == 0 else f"r{r['n_regionkey']}", "pos": 10 * r["n_nationkey"], "mapq": r["n_nationkey"], "cigar": "5S10M2D3M" if r["n_nationkey"] % 2 else "*", "mate": f"r{r['n_regionkey']}", "tlen": -r["n_nationkey"], "seq": "ACGTNACGTACGTACGTA", "nm": r["n_nationkey"] if r["n_nationkey"] % 3 else None} for r in read(spark, sf_dir, "nation")[0].orderBy("n_nationkey").collect()]
    path = place(spark, "reads") + ".bam"
    out.write_bytes(spark, path, aln.encode({f"r{k}": 1000 for k in range(5)}, rows))
    return aln.bam(spark, path).drop("path")


Q["bam_reads"] = bam_reads
S["bam_reads"] = """SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS record_no, n_name AS qname, CASE n_nationkey % 2 WHEN 1 THEN 99 ELSE 4 END AS flag, CASE n_nationkey % 2 WHEN 1 THEN 'r' || n_regionkey END AS rname, 10 * n_nationkey AS pos, n_nationkey AS mapq, CASE n_nationkey % 2 WHEN 1 THEN '5S10M2D3M' ELSE '*' END AS cigar, 'r' || n_regionkey AS mate, -n_nationkey AS tlen, 'ACGTNACGTACGTACGTA' AS seq, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END AS nm FROM nation"""


def sam_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as SAM text, their flags from the line number, measured."""
    (li,) = read(spark, sf_dir, "lineitem")
    line = F.concat_ws("\t", text("q", _item("l_orderkey")), F.when(F.col("l_linenumber") == 1, "4").when(F.col("l_linenumber") == 2, "1024").when(F.col("l_linenumber") == 3, "256").otherwise("16"), text("s", _item("l_suppkey")), (F.col("l_partkey") + 1).cast("string"), (F.col("l_quantity").cast("int") % 61).cast("string"), F.lit("2S8M"), F.lit("="), F.lit("0"), F.lit("0"), F.lit("ACGTACGTAC"), F.lit("*"), F.lit("XX:Z:t"), text("NM:i:", _item("l_linenumber")))
    rows = li.select(F.lit("f").alias("path"), _line().alias("line_no"), line.alias("line")).unionByName(spark.createDataFrame([("f", -1, "@HD\tVN:1.6")], "path string, line_no long, line string"))
    return rd.read_metrics(aln.sam(rows)).select("alignment_count", "mapped_count", "primary_mapped_count", "duplicate_count", "secondary_count", "mapq_ge30_count", "aligned_query_bases", "soft_clipped_bases", F.round("mapped_percent", 6).alias("mapped_percent"))


Q["sam_metrics"] = sam_metrics
S["sam_metrics"] = """SELECT count(*) AS alignment_count, count(*) FILTER (l_linenumber <> 1) AS mapped_count, count(*) FILTER (l_linenumber NOT IN (1, 3)) AS primary_mapped_count, count(*) FILTER (l_linenumber = 2) AS duplicate_count, count(*) FILTER (l_linenumber = 3) AS secondary_count, count(*) FILTER (l_linenumber NOT IN (1, 3) AND CAST(l_quantity AS INT) % 61 >= 30) AS mapq_ge30_count, 8 * count(*) FILTER (l_linenumber <> 1) AS aligned_query_bases, 2 * count(*) FILTER (l_linenumber <> 1) AS soft_clipped_bases, round(100.0 * count(*) FILTER (l_linenumber <> 1) / count(*), 6) AS mapped_percent FROM lineitem"""


def followed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log's files, followed as a stream."""
    path = place(spark, "log")
    read(spark, sf_dir, "events")[0].select(text(_item("event_id"), " ", F.col("event_type"))).write.text(f"{path}/log")
    return st.run_to(st.follow(spark, f"{path}/log"), f"{path}/rows", f"{path}/state")


Q["followed_log"] = followed_log
S["followed_log"] = "SELECT event_id || ' ' || event_type AS value FROM events"
