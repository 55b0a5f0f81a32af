"""Joins, selections, differences and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import diff as di
from tessera.operators import latest as la
from tessera.operators import reads as rd
from tessera.operators import selection as se
from tessera.operators.predicates import role_matches
from tessera.plans.tables import metrics, read

Q, S = {}, {}


def universe(spark: SparkSession, sf_dir: str, complement: bool) -> DataFrame:
    cust, orders = read(spark, sf_dir, "customer", "orders")
    hits = se.evidence(orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("analysis_name"), F.col("o_totalprice").alias("evalue")), evalue_max=30000)
    return se.select_sequences(cust.select("c_custkey"), hits, "c_custkey", complement=complement)


Q["select_sequences"] = lambda s, d: universe(s, d, False)
Q["select_complement"] = lambda s, d: universe(s, d, True)
_UNI = "SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS analyses, min(o_totalprice) AS best, count(o_orderkey) AS n_hits, (count(o_orderkey) > 0) <> {} AS selected FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice <= 30000 GROUP BY c_custkey"
S["select_sequences"], S["select_complement"] = _UNI.format("false"), _UNI.format("true")

Q["anti_universe"] = lambda s, d: se.without(read(s, d, "customer")[0].select("c_custkey", "c_name"), read(s, d, "orders")[0].where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), keys=["c_custkey"])
S["anti_universe"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, li = read(spark, sf_dir, "orders", "lineitem")
    files = orders.select(F.lit("order").alias("entity_type"), F.col("o_orderkey").alias("entity_id"), F.concat(F.lit("report"), F.when(F.col("o_orderkey") % 2 == 0, ":full").otherwise("s")).alias("file_role"), F.col("o_orderstatus").alias("format"))
    gone = orders.where("o_orderkey % 7 = 0").select(F.lit("order").alias("entity_type"), F.col("o_orderkey").alias("entity_id"))
    old = li.where("l_quantity > 49").select(F.lit("order").alias("entity_type"), F.col("l_orderkey").alias("entity_id"))
    return se.candidate_files(files, role="report", formats=["F", "O"], retired=gone, superseded=old).select("entity_id", "file_role")


Q["candidate_files"] = active
S["candidate_files"] = "SELECT o_orderkey AS entity_id, 'report:full' AS file_role FROM orders o WHERE o_orderkey % 2 = 0 AND o_orderstatus IN ('F', 'O') AND o_orderkey % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49 AND l_orderkey = o.o_orderkey)"


def release(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, labels = read(spark, sf_dir, "documents", "labels")
    key = [F.lit("doc").alias("entity_type"), F.col("doc_id").alias("entity_id")]
    files = docs.select(*key, "n_chars", "source")
    decisions = labels.select(*key, F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("decision"), F.when(F.col("toxic") == 1, "EXCLUDED").alias("curated_decision"))
    retired = docs.where("source = 'src3'").select(*key, F.lit("source").alias("root_type"), F.col("source").alias("root_id"))
    return files, decisions, retired


def release_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, decisions, retired = release(spark, sf_dir)
    return se.release_files(files, decisions, retired.select("entity_type", "entity_id"), files.where("n_chars < 100").select("entity_type", "entity_id")).select("entity_id", "n_chars")


Q["release_files"] = release_files
S["release_files"] = "SELECT doc_id AS entity_id, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic <> 1 AND source <> 'src3' AND n_chars >= 100"
Q["release_preview"] = lambda s, d: se.preview(release_files(s, d), "n_chars")
S["release_preview"] = f"SELECT count(*) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM ({S['release_files']})"


def release_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, decisions, retired = release(spark, sf_dir)
    return se.release_exclusions(decisions, retired).select("entity_id", "reason", "detail")


Q["release_exclusions"] = release_out
S["release_exclusions"] = """WITH x AS (SELECT doc_id, source, CASE WHEN toxic = 1 THEN 'EXCLUDED' WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS d FROM labels LEFT JOIN documents USING (doc_id))
SELECT doc_id AS entity_id, CASE WHEN source = 'src3' THEN 'RETIRED' ELSE 'DECISION' END AS reason, CASE WHEN source = 'src3' THEN 'source:src3' ELSE d END AS detail FROM x WHERE source = 'src3' OR d <> 'PASS'"""


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, orders, events = read(spark, sf_dir, "customer", "orders", "events")
    key = lambda c: [F.lit("user").alias("entity_type"), F.col(c).alias("entity_id")]
    decided = orders.where("o_orderpriority = '1-URGENT'").groupBy(*key("o_custkey")).agg(F.max("o_orderkey").alias("change_id"))
    return se.not_evaluated(cust.select(*key("c_custkey")), decided, events.select(*key("user_id"), F.col("event_id").alias("change_id"))).select("entity_id", "status")


Q["missing_or_stale"] = stale
S["missing_or_stale"] = """WITH d AS (SELECT o_custkey, max(o_orderkey) AS c FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), e AS (SELECT user_id, max(event_id) AS l FROM events GROUP BY 1), x AS (SELECT c_custkey AS entity_id, CASE WHEN d.o_custkey IS NULL THEN 'MISSING' WHEN coalesce(l, 0) > coalesce(c, 0) THEN 'STALE' END AS status FROM customer LEFT JOIN d ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey) SELECT * FROM x WHERE status IS NOT NULL"""


def either(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup, cust = read(spark, sf_dir, "supplier", "customer")
    left = sup.select("s_suppkey", F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 3).alias("b"))
    return se.either_join(left, cust.select("c_custkey", "c_mktsegment"), [("a", "c_custkey"), ("b", "c_custkey")]).select("s_suppkey", "c_custkey", "c_mktsegment")


Q["either_join"] = either
S["either_join"] = "SELECT DISTINCT s_suppkey, c_custkey, c_mktsegment FROM supplier JOIN customer ON c_custkey = s_suppkey OR c_custkey = s_suppkey * 3"


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = read(spark, sf_dir, "part")
    new = part.where("p_partkey % 10 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("p_brand"), (F.col("p_size") + (F.col("p_partkey") % 3 == 0).cast("int")).alias("p_size"))
    more = part.where("p_partkey % 50 = 1").select((F.col("p_partkey") + 10000000).alias("p_partkey"), "p_brand", "p_size")
    return di.import_preview(part, new.unionByName(more), "p_partkey", ["p_brand", "p_size"])


Q["insert_update_unchanged"] = diffs
S["insert_update_unchanged"] = """WITH n AS (SELECT p_partkey, p_partkey % 4 = 0 AND p_brand IS NOT NULL AS b, p_partkey % 3 = 0 AS s FROM part WHERE p_partkey % 10 <> 0) SELECT p_partkey, CASE WHEN b OR s THEN 'update' ELSE 'unchanged' END AS action, CASE WHEN b AND s THEN 'p_brand,p_size' WHEN b THEN 'p_brand' WHEN s THEN 'p_size' ELSE '' END AS changed FROM n
UNION ALL SELECT p_partkey + 10000000, 'insert', '' FROM part WHERE p_partkey % 50 = 1"""


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = read(spark, sf_dir, "part")
    old = part.select("p_partkey", "p_brand", "p_size")
    new = part.where("p_partkey % 3 = 0").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(20000000)).alias("p_partkey"), F.lit(99).cast("int").alias("p_size"))
    return di.apply_import(old, new, "p_partkey", ["p_size"], on_conflict="update")


Q["import_applied"] = applied
S["import_applied"] = "SELECT p_partkey, p_brand, CASE WHEN p_partkey % 6 = 0 THEN 99 ELSE p_size END AS p_size FROM part UNION ALL SELECT p_partkey + 20000000, NULL, 99 FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 1"


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = read(spark, sf_dir, "lineitem")
    pick = lambda c: li.where(c).select("l_returnflag", "l_linestatus", "l_linenumber")
    return di.row_differences(pick("l_suppkey % 2 = 0"), pick("l_suppkey % 2 = 1"))


Q["row_differences"] = differences
S["row_differences"] = "SELECT l_returnflag, l_linestatus, l_linenumber, CAST(sum(CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS difference FROM lineitem GROUP BY ALL HAVING difference <> 0"

Q["conflicting_keys"] = lambda s, d: di.conflicts(read(s, d, "events")[0].withColumn("v", F.floor("value")), ["user_id", "event_type"], ["v"])
S["conflicting_keys"] = "SELECT user_id, event_type, count(DISTINCT floor(value)) AS contents FROM events GROUP BY ALL HAVING contents > 1"


def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("event_type").alias("content"))
    return di.append_once(rows.where("event_id % 3 = 0"), rows.unionByName(rows.where("event_id % 5 = 0")), "event_id", "content")


Q["append_once"] = append
S["append_once"] = "SELECT event_id, event_type AS content FROM events WHERE event_id % 3 <> 0"


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, docs, events = read(spark, sf_dir, "orders", "documents", "events")
    item = lambda df, i, v: df.select(F.col(i).cast("long").alias("item"), F.col(v).cast("double").alias("weight"))
    got = se.attention({"order": item(orders.where("o_totalprice > 200000"), "o_orderkey", "o_totalprice"), "document": item(docs.where("n_chars < 300"), "doc_id", "n_chars"), "event": item(events.where("event_type = 'error'"), "event_id", "value")}, [F.desc("weight"), F.asc("item")], limit=7)
    return got.select("kind", "item", "weight", F.col("rank").cast("long").alias("rank"), "total")


Q["attention_union"] = attention
S["attention_union"] = """WITH u AS (SELECT 'order' AS kind, o_orderkey AS item, o_totalprice AS weight FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'document', doc_id, n_chars FROM documents WHERE n_chars < 300 UNION ALL SELECT 'event', event_id, value FROM events WHERE event_type = 'error')
SELECT kind, CAST(item AS BIGINT) AS item, CAST(weight AS DOUBLE) AS weight, row_number() OVER (PARTITION BY kind ORDER BY weight DESC, item) AS rank, count(*) OVER (PARTITION BY kind) AS total FROM u QUALIFY rank <= 7"""

Q["group_concat"] = lambda s, d: se.listed(read(s, d, "events")[0], ["user_id"], F.col("event_type"), "types")
S["group_concat"] = "SELECT user_id, string_agg(event_type, ', ' ORDER BY event_type) AS types FROM events GROUP BY user_id"

Q["label_summary"] = lambda s, d: read(s, d, "labels")[0].join(read(s, d, "documents")[0], "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources")).orderBy(F.desc("n")).limit(500)
S["label_summary"] = "SELECT quality, toxic, count(*) AS n, count(DISTINCT source) AS sources FROM labels JOIN documents USING (doc_id) GROUP BY ALL"

Q["hit_summary"] = lambda s, d: se.hit_summary(read(s, d, "lineitem")[0].select("l_shipdate", "l_returnflag", F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("subject_id"), F.col("l_linenumber").alias("hit_rank"), F.col("l_tax").alias("evalue")), ["l_returnflag"])
S["hit_summary"] = "SELECT l_returnflag, count(DISTINCT l_orderkey) AS queries, count(DISTINCT l_orderkey) FILTER (l_linenumber = 1) AS queries_with_best, count(DISTINCT (l_orderkey, l_partkey)) AS pairs, min(l_tax) AS min_evalue FROM lineitem GROUP BY 1"

Q["unordered_pairs"] = lambda s, d: se.unordered_pairs(read(s, d, "lineitem")[0], "l_suppkey", "l_partkey")
S["unordered_pairs"] = "SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey AND l_suppkey > 0 AND l_partkey > 0"

Q["resolve_sequences"] = lambda s, d: se.resolve_sequences(read(s, d, "part")[0].select(F.col("p_partkey").alias("seqid")), read(s, d, "lineitem")[0].where("l_quantity < 3").select(F.col("l_partkey").alias("seqid"), F.col("l_suppkey").alias("file_id")))
S["resolve_sequences"] = """SELECT p_partkey AS seqid, CASE WHEN count(l_suppkey) = 0 THEN 'MISSING' WHEN count(DISTINCT l_suppkey) > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS status, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS file_id FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity < 3 GROUP BY 1"""

Q["list_files"] = lambda s, d: se.search(read(s, d, "part")[0], "GeT", ["p_name", "p_type"]).select("p_partkey", "p_name")
S["list_files"] = "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'get') OR contains(lower(p_type), 'get')"

Q["profile_uses"] = lambda s, d: se.uses(read(s, d, "customer")[0].select("c_custkey"), read(s, d, "orders")[0].select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
S["profile_uses"] = "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS uses FROM customer"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    wanted = e.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])).alias("event_type"))
    lack = se.missing_kinds(wanted, e.select("user_id", "event_type").distinct(), "user_id", "event_type")
    return lack.groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


Q["missing_signatures"] = kinds
S["missing_signatures"] = """WITH u AS (SELECT DISTINCT user_id FROM events), m AS (SELECT u.user_id, coalesce(string_agg(t, ',' ORDER BY t) FILTER (NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t)), '') AS missing FROM u, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(t) GROUP BY 1) SELECT missing, count(*) AS n FROM m GROUP BY 1"""


def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = read(spark, sf_dir, "part")
    return se.supersessions(part, ["p_brand", "p_size"], ["p_retailprice"], "p_type", "p_partkey")


Q["supersessions"] = superseded
S["supersessions"] = """WITH w AS (SELECT p_partkey, p_type, first(p_partkey) OVER o AS best, first(p_type) OVER o AS t FROM part WINDOW o AS (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey)) SELECT p_partkey AS old, best AS "new" FROM w WHERE p_partkey <> best AND p_type IS NOT DISTINCT FROM t"""

Q["latest_job_rows"] = lambda s, d: se.latest_job_rows(read(s, d, "lineitem")[0].select(F.col("l_orderkey").alias("job_id"), "l_linenumber"), read(s, d, "orders")[0].select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("file_id"), F.lower("o_orderpriority").alias("analysis_name"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status")))
S["latest_job_rows"] = "SELECT l_orderkey AS job_id, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderpriority)"

Q["ignored_jobs"] = lambda s, d: se.ignored_jobs(read(s, d, "orders")[0].select(F.col("o_custkey").alias("analysis_name"), F.when(F.col("o_orderstatus") == "F", "completed").alias("status")))
S["ignored_jobs"] = "SELECT count(*) - count(DISTINCT o_custkey) AS ignored FROM orders WHERE o_orderstatus = 'F'"

Q["flag_counts"] = lambda s, d: rd.flag_counts(read(s, d, "lineitem")[0].withColumn("flag", (F.col("l_partkey") % 4096).cast("int")), ["l_returnflag"], "flag", ["paired", "proper", "unmapped", "reverse", "secondary", "duplicate", "supplementary"])
S["flag_counts"] = "SELECT l_returnflag, count(*) AS alignment_count, " + ", ".join(f"count(*) FILTER ((l_partkey % 4096) & {rd.BITS[n]} <> 0) AS {n}_count" for n in ("paired", "proper", "unmapped", "reverse", "secondary", "duplicate", "supplementary")) + " FROM lineitem GROUP BY 1"

Q["role_prefix"] = lambda s, d: read(s, d, "documents")[0].where(role_matches(F.concat(F.col("source"), F.when(F.col("lang") == "en", ":x").otherwise("")), "src1")).select("doc_id")
S["role_prefix"] = "SELECT doc_id FROM documents WHERE source = 'src1'"

Q["max_change"] = lambda s, d: la.max_change(metrics(s, d), ["user_id", "metric"], "seq")
S["max_change"] = "SELECT user_id, event_type AS metric, max(event_id) AS seq FROM events GROUP BY ALL"

Q["next_number"] = lambda s, d: read(s, d, "customer")[0].select(F.concat(F.lit("ORG_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("i")).agg(la.next_number(F.col("i"), "ORG_").alias("largest"))
S["next_number"] = "SELECT max(c_custkey) AS largest FROM customer"


def adhoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, cust = read(spark, sf_dir, "orders", "customer")
    catalog.register(spark, {"q_orders": orders, "q_customer": cust})
    return catalog.query(spark, "WITH x AS (SELECT c_mktsegment, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM q_orders JOIN q_customer ON o_custkey = c_custkey GROUP BY c_mktsegment) SELECT c_mktsegment, n, CAST(total AS DOUBLE) AS total FROM x")


Q["adhoc_query"] = adhoc
S["adhoc_query"] = "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["region", "nation", "customer", "orders", "lineitem", "documents"]
    out = None
    for name, df in zip(names, read(spark, sf_dir, *names), strict=True):
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


Q["project_summary"] = summary
S["project_summary"] = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "orders", "lineitem", "documents"))
