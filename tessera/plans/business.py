"""Queries of the data model: ownership, states, selections, imports, sweeps, dated trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import canonical_hash
from tessera.operators import composition as co
from tessera.operators import coverage as cov
from tessera.operators import diff as di
from tessera.operators import entities as en
from tessera.operators import features as fe
from tessera.operators import hierarchy as hi
from tessera.operators import latest as la
from tessera.operators import measure as me
from tessera.operators import rules as ru
from tessera.operators import selection as se
from tessera.operators import timetree as tt
from tessera.operators.predicates import page
from tessera.plans.records import RULES, taxonomy
from tessera.plans.tables import INTERVALS, intervals, read

Q, S = {}, {}


def text(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def tree(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nations as organisms, customers as samples, finished orders as runs, others as assemblies, their lines as annotations."""
    nation, cust, orders, li = read(spark, sf_dir, "nation", "customer", "orders", "lineitem")
    run, assembly = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'")
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return {
        "organism": nation.select(text("O", "n_nationkey").alias("organism_id"), "n_name"), "sample": cust.select(text("S", "c_custkey").alias("sample_id"), text("O", "c_nationkey").alias("organism_id")),
        "run": run.select(text("R", "o_orderkey").alias("run_id"), text("S", "o_custkey").alias("sample_id")), "assembly": assembly.select(text("A", "o_orderkey").alias("assembly_id"), text("S", "o_custkey").alias("sample_id")),
        "annotation": lines.select(F.concat_ws("_", text("N", "l_orderkey"), F.col("l_linenumber").cast("string")).alias("annotation_id"), text("A", "l_orderkey").alias("assembly_id")),
    }


_TREE = """x AS (SELECT 'organism' AS entity_type, 'O' || n_nationkey AS entity_id, 'O' || n_nationkey AS organism_id, NULL AS up FROM nation
 UNION ALL SELECT 'sample', 'S' || c_custkey, 'O' || c_nationkey, 'O' || c_nationkey FROM customer
 UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 'run' ELSE 'assembly' END, CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'A' END || o_orderkey, 'O' || c_nationkey, 'S' || o_custkey FROM orders JOIN customer ON c_custkey = o_custkey
 UNION ALL SELECT DISTINCT 'annotation', 'N' || l_orderkey || '_' || l_linenumber, 'O' || c_nationkey, 'A' || l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'F' JOIN customer ON c_custkey = o_custkey)"""

Q["entity_owners"] = lambda s, d: en.owners(tree(s, d))
S["entity_owners"] = f"WITH {_TREE} SELECT entity_type, entity_id, organism_id FROM x"


def entity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What belongs to one organism, without the samples that are excluded and all below them."""
    t = tree(spark, sf_dir)
    gone = t["sample"].where("sample_id LIKE 'S%7'").select(F.lit("sample").alias("entity_type"), F.col("sample_id").alias("entity_id"))
    g = en.graph(t, "O3", gone)
    return reduce(DataFrame.unionByName, [g[k].select(F.lit(k).alias("entity_type"), F.col(f"{k}_id").alias("entity_id")) for k in g])


Q["entity_graph"] = entity_graph
S["entity_graph"] = f"""WITH {_TREE}, s AS (SELECT entity_id FROM x WHERE entity_type = 'sample' AND organism_id = 'O3' AND entity_id NOT LIKE 'S%7'), m AS (SELECT entity_type, entity_id FROM x WHERE entity_type IN ('run', 'assembly') AND up IN (SELECT entity_id FROM s))
SELECT 'organism' AS entity_type, 'O3' AS entity_id UNION ALL SELECT 'sample', entity_id FROM s UNION ALL SELECT * FROM m UNION ALL SELECT entity_type, entity_id FROM x WHERE entity_type = 'annotation' AND up IN (SELECT entity_id FROM m)"""


def entity_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of an organism, cut down to the lineage of one sample."""
    t = tree(spark, sf_dir)
    organism = t["sample"].where("sample_id = 'S0'").first()["organism_id"]
    g = en.matched(en.graph(t, organism), "sample", "S0")
    kept = reduce(DataFrame.unionByName, [g[k].select(F.lit(k).alias("entity_type")) for k in g])
    return kept.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


Q["entity_lineage"] = entity_lineage
S["entity_lineage"] = f"""WITH {_TREE}, s AS (SELECT * FROM x WHERE entity_type = 'sample' AND entity_id = 'S0'), m AS (SELECT * FROM x WHERE entity_type IN ('run', 'assembly') AND up IN (SELECT entity_id FROM s)), a AS (SELECT 'organism' AS entity_type FROM s UNION ALL SELECT entity_type FROM s UNION ALL SELECT entity_type FROM m UNION ALL SELECT entity_type FROM x WHERE entity_type = 'annotation' AND up IN (SELECT entity_id FROM m))
SELECT entity_type, count(*) AS n FROM a GROUP BY 1"""

Q["entity_tree"] = lambda s, d: en.nested(tree(s, d)["organism"], tree(s, d)["sample"], "organism_id", ["sample_id"], "samples").select("organism_id", "n_name", F.array_join("samples.sample_id", ",").alias("samples"), F.size("samples").cast("long").alias("n"))
S["entity_tree"] = "SELECT 'O' || n_nationkey AS organism_id, n_name, coalesce(string_agg('S' || c_custkey, ',' ORDER BY 'S' || c_custkey), '') AS samples, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL"


def member_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    files = t["run"].select(F.lit("run").alias("entity_type"), F.col("run_id").alias("entity_id")).unionByName(t["assembly"].select(F.lit("assembly"), F.concat(F.lit("?"), "assembly_id")).toDF("entity_type", "entity_id"))
    return en.member_taxa(files, en.owners(t), t["organism"]).select("entity_id", "organism_id", "n_name")


Q["member_taxa"] = member_taxa
S["member_taxa"] = "SELECT CASE o_orderstatus WHEN 'F' THEN 'R' ELSE '?A' END || o_orderkey AS entity_id, CASE o_orderstatus WHEN 'F' THEN 'O' || n_nationkey END AS organism_id, CASE o_orderstatus WHEN 'F' THEN n_name END AS n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"


def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows hang on the customers of one segment."""
    cust, orders, events = read(spark, sf_dir, "customer", "orders", "events")
    key = lambda c: [F.lit("customer").alias("entity_type"), F.col(c).alias("entity_id")]
    return en.impact(cust.where("c_mktsegment = 'BUILDING'").select(*key("c_custkey")), {"orders": orders.select(*key("o_custkey")), "events": events.select(*key("user_id"))})


Q["lifecycle_impact"] = impact
S["lifecycle_impact"] = "SELECT 'orders' AS table_name, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'events', count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"

Q["file_locations"] = lambda s, d: en.with_locations(read(s, d, "part")[0].select(F.col("p_partkey").alias("file_id")), read(s, d, "lineitem")[0].where("l_quantity >= 40").select(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("remote"), F.col("l_returnflag").alias("state")), ["remote", "state"])
S["file_locations"] = "SELECT p_partkey AS file_id, coalesce(CAST(l_suppkey AS VARCHAR), '') AS remote, coalesce(l_returnflag, '') AS state FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 40"


def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An internal id, a qualified accession and a bare one."""
    cust, sup = read(spark, sf_dir, "customer", "supplier")
    ents = cust.select(F.lit("customer").alias("internal_type"), text("C", "c_custkey").alias("internal_id"))
    acc = sup.select(F.lit("supplier").alias("internal_type"), text("U", "s_suppkey").alias("internal_id"), F.lit("NS").alias("namespace"), F.col("s_name").alias("accession"))
    asked = ["C7", "NS:Supplier#000000003", "Supplier#000000004"]
    return reduce(DataFrame.unionByName, [hi.resolve_identifier(spark, ents, acc, x).select("internal_type", "internal_id", F.lit(x).alias("asked")) for x in asked])


Q["resolve_identifier"] = resolve
S["resolve_identifier"] = "SELECT 'customer' AS internal_type, 'C' || c_custkey AS internal_id, 'C7' AS asked FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'supplier', 'U' || s_suppkey, CASE s_suppkey WHEN 3 THEN 'NS:' ELSE '' END || s_name FROM supplier WHERE s_name IN ('Supplier#000000003', 'Supplier#000000004')"


def dated_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clade of each pair of nations in the tree of regions; regions and nations are few."""
    region, nation = read(spark, sf_dir, "region", "nation")
    kids: dict[int, list[str]] = {}
    for r in nation.orderBy("n_nationkey").collect():
        kids.setdefault(r["n_regionkey"], []).append(r["n_name"])
    clades = ",".join(f"({','.join(kids[r['r_regionkey']])})'{r['r_name']}':1" for r in region.orderBy("r_regionkey").collect() if r["r_regionkey"] in kids)
    t = tt.edges(spark, f"({clades})root;")
    # A stated set of pairs: each nation with the one before and the one seven before it.
    n = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    pairs = n.select("a", F.explode(F.array((F.col("k") + 24) % 25, (F.col("k") + 18) % 25)).alias("j")).join(n.select(F.col("k").alias("j"), F.col("a").alias("b")), "j").select("a", "b")
    return tt.clades(t, pairs).join(t.select(F.col("node").alias("mrca"), "label"), "mrca", "left").select("a", "b", F.col("label").alias("clade"))


Q["dated_tree"] = dated_tree
S["dated_tree"] = "SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN r_name ELSE 'root' END AS clade FROM nation a JOIN nation b ON b.n_nationkey IN ((a.n_nationkey + 24) % 25, (a.n_nationkey + 18) % 25) JOIN region ON r_regionkey = a.n_regionkey"


def bound_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose greatest age lies below the least age of one of their nations."""
    region, nation = read(spark, sf_dir, "region", "nation")
    t = region.select((F.col("r_regionkey") + 100).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("label")).unionByName(nation.select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_regionkey") + 100).cast("long").alias("parent"), F.col("n_name").alias("label")))
    bounds = t.select("node", (F.when(F.col("node") >= 100, 0).otherwise(F.col("node") % 7)).cast("double").alias("low"), (F.when(F.col("node") >= 100, (F.col("node") - 98) * 1.0).otherwise(9.0)).alias("high"))
    return tt.bound_conflicts(t, bounds)


Q["bound_conflicts"] = bound_conflicts
S["bound_conflicts"] = "SELECT n_regionkey + 100 AS ancestor, n_nationkey AS descendant FROM nation WHERE n_regionkey + 2 < n_nationkey % 7"

Q["files_by_state"] = lambda s, d: se.select_files(read(s, d, "orders")[0].select(F.lit("customer").alias("entity_type"), F.col("o_custkey").alias("entity_id"), "o_orderkey", "o_orderpriority"), [F.col("o_orderpriority") != "5-LOW"], states=read(s, d, "customer")[0].select(F.lit("customer").alias("entity_type"), F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("state")), state="BUILDING", decisions=read(s, d, "customer")[0].select(F.lit("customer").alias("entity_type"), F.col("c_custkey").alias("entity_id"), F.when(F.col("c_acctbal") > 1000, "PASS").otherwise("FAIL").alias("decision"), F.when(F.col("c_custkey") % 4 == 0, "PASS").alias("curated_decision")), decision="PASS").select("o_orderkey")
S["files_by_state"] = "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '5-LOW' AND c_mktsegment = 'BUILDING' AND (c_custkey % 4 = 0 OR c_acctbal > 1000)"


def warned_release(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of which some were accepted with a warning by a curator."""
    (docs,) = read(spark, sf_dir, "documents")
    key = [F.lit("doc").alias("entity_type"), F.col("doc_id").alias("entity_id")]
    decided = docs.select(*key, F.when(F.col("doc_id") % 3 == 0, "PASS").otherwise("FAIL").alias("decision"), F.when(F.col("doc_id") % 5 == 0, "ACCEPT_WITH_WARNING").when(F.col("doc_id") % 7 == 0, "EXCLUDED").alias("curated_decision"))
    return docs.select(*key, "n_chars"), decided, docs.where("lang = 'fr'").select(*key)


Q["warned_release"] = lambda s, d: (lambda f, dec, gone: se.release_files(f, dec, gone, gone.limit(0)))(*warned_release(s, d)).select("entity_id", "n_chars")
S["warned_release"] = "SELECT doc_id AS entity_id, n_chars FROM documents WHERE (doc_id % 5 = 0 OR (doc_id % 7 <> 0 AND doc_id % 3 = 0)) AND lang IS DISTINCT FROM 'fr'"
Q["warned_exclusions"] = lambda s, d: (lambda f, dec, gone: se.release_exclusions(dec, gone.withColumn("root_type", F.lit("lang")).withColumn("root_id", F.lit("fr"))))(*warned_release(s, d)).select("entity_id", "reason", "detail")
S["warned_exclusions"] = "WITH x AS (SELECT doc_id, lang = 'fr' AS gone, CASE WHEN doc_id % 5 = 0 THEN 'ACCEPT_WITH_WARNING' WHEN doc_id % 7 = 0 THEN 'EXCLUDED' WHEN doc_id % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS d FROM documents) SELECT doc_id AS entity_id, CASE WHEN gone THEN 'RETIRED' ELSE 'DECISION' END AS reason, CASE WHEN gone THEN 'lang:fr' ELSE d END AS detail FROM x WHERE coalesce(gone, false) OR d NOT IN ('PASS', 'PASS_WITH_WARNINGS', 'ACCEPT_WITH_WARNING')"

Q["stale_jobs"] = lambda s, d: se.sweep_stale(read(s, d, "orders")[0].select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("analysis_name"), F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("completed").alias("status"), F.lit(None).cast("string").alias("finished_at"), F.lit(None).cast("string").alias("error")), "1-URGENT", F.lit("2024-01-01")).select("job_id", "status", "finished_at", "error")
S["stale_jobs"] = "WITH x AS (SELECT o_orderkey, o_orderstatus = 'O' AS r, o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AS s FROM orders) SELECT o_orderkey AS job_id, CASE WHEN s THEN 'interrupted' WHEN r THEN 'RUNNING' ELSE 'completed' END AS status, CASE WHEN s THEN '2024-01-01' END AS finished_at, CASE WHEN s THEN 'swept at startup: previous run terminated abnormally' END AS error FROM x"

MOVES = {"REGISTERED": ["QC_RUNNING", "ACCEPTED"], "QC_RUNNING": ["ACCEPTED", "REJECTED"]}
Q["state_moves"] = lambda s, d: read(s, d, "orders")[0].select("o_orderkey", ru.transition(F.when(F.col("o_orderstatus") == "F", "REGISTERED").otherwise("QC_RUNNING"), F.when(F.col("o_orderstatus") == "O", "REJECTED").otherwise("ACCEPTED"), MOVES).alias("state"), ru.transition(F.lit("REJECTED"), F.lit("REGISTERED"), MOVES, force=True).alias("forced"), ru.decided_state(F.when(F.col("o_orderpriority") == "5-LOW", "FAIL").otherwise("REVIEW"), F.when(F.col("o_orderstatus") == "P", "RELEASED").otherwise("QC_COMPLETE")).alias("decided"))
S["state_moves"] = "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'REJECTED' ELSE 'ACCEPTED' END AS state, 'REGISTERED' AS forced, CASE WHEN o_orderstatus = 'P' THEN 'RELEASED' WHEN o_orderpriority = '5-LOW' THEN 'REJECTED' ELSE 'REVIEW' END AS decided FROM orders"

_CUST = ["c_custkey", "c_name", "c_mktsegment"]
Q["adopted_rows"] = lambda s, d: la.insert_or_ignore(read(s, d, "customer")[0].where("c_mktsegment = 'BUILDING'").select(*_CUST), read(s, d, "customer")[0].select("c_custkey", F.lower("c_name").alias("c_name"), "c_mktsegment"), ["c_custkey"])
S["adopted_rows"] = "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_name ELSE lower(c_name) END AS c_name, c_mktsegment FROM customer"
Q["import_skipped"] = lambda s, d: di.apply_import(read(s, d, "customer")[0].select(*_CUST), read(s, d, "supplier")[0].select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("new").alias("c_mktsegment")), "c_custkey", _CUST[1:], "skip")
S["import_skipped"] = "SELECT c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT s_suppkey * 20, s_name, 'new' FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)"
Q["profile_hashes"] = lambda s, d: la.insert_or_ignore(read(s, d, "part")[0].limit(0).select(F.lit("").alias("sha"), F.lit("").alias("p_brand")), read(s, d, "part")[0].select(canonical_hash(brand=F.col("p_brand"), size=F.lit(None).cast("int")).alias("sha"), "p_brand"), ["sha"])
S["profile_hashes"] = """SELECT DISTINCT sha256('{"brand":"' || p_brand || '","size":null}') AS sha, p_brand FROM part"""
Q["sequence_sync"] = lambda s, d: la.upsert(read(s, d, "part")[0].select(F.col("p_partkey").cast("string").alias("seqid"), F.lit(0).cast("long").alias("length")), co.sequence_lengths(read(s, d, "documents")[0].select((F.col("doc_id") % 150).cast("string").alias("seqid"), F.coalesce("text", F.lit("")).alias("sequence"))), ["seqid"])
S["sequence_sync"] = "WITH l AS (SELECT CAST(doc_id % 150 AS VARCHAR) AS seqid, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS length FROM documents GROUP BY 1) SELECT * FROM l UNION ALL SELECT CAST(p_partkey AS VARCHAR), 0 FROM part WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT seqid FROM l)"
Q["decision_log"] = lambda s, d: page(la.current(read(s, d, "events")[0].select("user_id", F.col("event_id").alias("seq"), "event_type"), ["user_id"], "seq"), [F.desc("seq")]).select("user_id", "seq", "event_type")
S["decision_log"] = "SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = read(spark, sf_dir, "orders")
    files = orders.where("o_orderstatus IN ('F', 'O')").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("records"))
    files = files.select(F.lit("customer").alias("entity_type"), F.col("o_custkey").alias("entity_id"), F.concat_ws("_", F.col("o_custkey").cast("string"), "o_orderstatus").alias("file_id"), F.when(F.col("o_orderstatus") == "F", "reads_1").otherwise("reads_2").alias("file_role"), "records")
    return me.paired_counts(files.drop("records"), files.select("file_id", "records")).select("entity_id", "paired_read_count_match")


Q["paired_read_counts"] = paired
S["paired_read_counts"] = "WITH x AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1) SELECT o_custkey AS entity_id, CAST(f = o AS INT) AS paired_read_count_match FROM x WHERE f > 0 AND o > 0"
Q["protein_matches"] = lambda s, d: co.protein_stats(read(s, d, "documents")[0].select("lang", F.col("doc_id").alias("seqid"), F.coalesce("text", F.lit("")).alias("sequence")), ["lang"], F.lit(40).cast("long")).select("lang", "protein_count", "cds_protein_count_match")
S["protein_matches"] = "SELECT lang, count(*) AS protein_count, CAST(count(*) = 40 AS INT) AS cds_protein_count_match FROM documents GROUP BY 1"
Q["heaviest_child"] = lambda s, d: fe.heaviest_child(read(s, d, "orders")[0].select("o_orderkey", "o_custkey"), read(s, d, "lineitem")[0], child="o_orderkey", group="o_custkey", weight=F.col("l_quantity").cast("long"), part_parent="l_orderkey").select("o_custkey", "o_orderkey", F.col("weight").cast("long").alias("weight"))
S["heaviest_child"] = "WITH w AS (SELECT o_custkey, o_orderkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS weight FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_custkey, o_orderkey, weight FROM w QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, o_orderkey) = 1"


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure statistics of features that have every fault: ids missing and repeated, wrong order, unknown sequences, ends beyond them."""
    line, k = F.col("line_number") % 10, F.col("start")
    f = intervals(spark, sf_dir).withColumn("type", F.when(F.col("type") == "A", "CDS").when(F.col("type") == "N", "mRNA").otherwise("gene")).withColumn("id", F.when(line == 1, None).otherwise(F.col("id"))).withColumn("end", F.when(line == 2, k - 1).otherwise(F.col("end")))
    lengths = read(spark, sf_dir, "supplier")[0].where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").cast("string").alias("seqid"), F.lit(1500).cast("long").alias("length"))
    return fe.structure_stats(f, ["source"], lengths).select("source", "feature_count", "gene_count", "mrna_count", "cds_count", "coordinate_error_count", "missing_id_count", "duplicate_id_count", "seqid_mismatch_count", "end_beyond_sequence_count")


Q["structure_faults"] = structure
S["structure_faults"] = f"""WITH f AS (SELECT source, type, seqid, "start" AS s, CASE WHEN line_number % 10 = 2 THEN "start" - 1 ELSE "end" END AS e, CASE WHEN line_number % 10 <> 1 THEN id END AS id, seqid IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 9 <> 0) AS known FROM {INTERVALS})
SELECT source, count(*) AS feature_count, count(*) FILTER (type = 'R') AS gene_count, count(*) FILTER (type = 'N') AS mrna_count, count(*) FILTER (type = 'A') AS cds_count, count(*) FILTER (s < 1 OR e < s) + count(*) FILTER (known AND e > 1500) AS coordinate_error_count, count(*) FILTER (id IS NULL) AS missing_id_count, count(id) - count(DISTINCT id) AS duplicate_id_count, count(*) FILTER (NOT known) AS seqid_mismatch_count, count(*) FILTER (known AND e > 1500) AS end_beyond_sequence_count FROM f GROUP BY source"""


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks and names that a coverage report counts."""
    return cov.targets(taxonomy(spark, sf_dir), [10, 11, 12, 13, 14], **RULES).select("taxid", "rank")


Q["coverage_scope"] = scope
S["coverage_scope"] = "SELECT r_regionkey + 10 AS taxid, 'family' AS rank FROM region WHERE r_regionkey < 4 AND NOT regexp_matches(r_name, '^NATION_1?4$|EGYPT') UNION ALL SELECT n_nationkey + 100, 'genus' FROM nation WHERE n_regionkey < 4 AND n_nationkey <> 3 AND NOT regexp_matches(n_name, '^NATION_1?4$|EGYPT')"
