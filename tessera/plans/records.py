"""Queries of metric stores, decisions, rules, classification and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import percent
from tessera.operators import coverage as cov
from tessera.operators import hierarchy as hi
from tessera.operators import latest as la
from tessera.operators import rules as ru
from tessera.operators.predicates import condition, holds, in_time, page
from tessera.plans.tables import METRICS, metrics, read

Q, S = {}, {}


def newest() -> list[Column]:
    return [F.col("moment").desc_nulls_last(), F.col("seq").desc()]


def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    got = la.latest_metrics(m, entity=["user_id"], identity="identity", metric="metric", at="moment", sequence="seq", text="text", numeric="num", integrity=("error",))
    return got.select("user_id", "metric", "num", "seq")


Q["latest_metrics"] = latest_metrics
S["latest_metrics"] = f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, identity, metric ORDER BY moment DESC NULLS LAST, seq DESC) AS k FROM {METRICS}), b AS (SELECT *, min(num) OVER (PARTITION BY user_id, metric) AS worst, row_number() OVER (PARTITION BY user_id, metric ORDER BY moment DESC NULLS LAST, seq DESC) AS j FROM a WHERE k = 1)
SELECT user_id, metric, CASE WHEN metric = 'error' THEN worst ELSE num END AS num, seq FROM b WHERE j = 1"""

Q["latest_row"] = lambda s, d: la.latest(metrics(s, d), ["user_id", "metric"], newest()).select("user_id", "metric", "seq", "num")
S["latest_row"] = f"SELECT user_id, metric, seq, num FROM {METRICS} QUALIFY row_number() OVER (PARTITION BY user_id, metric ORDER BY moment DESC NULLS LAST, seq DESC) = 1"

Q["current_row"] = lambda s, d: la.current(metrics(s, d), ["user_id"], "seq").select("user_id", "metric", "num", "seq")
S["current_row"] = f"SELECT user_id, metric, num, seq FROM {METRICS} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1"

TYPES = ["signup", "view", "error", "click", "purchase"]
Q["qc_wide"] = lambda s, d: la.wide(la.latest(metrics(s, d), ["user_id", "metric"], newest()), ["user_id"], "metric", "num", TYPES)
S["qc_wide"] = f"""WITH x AS ({S['latest_row']}) SELECT user_id, {', '.join(f"max(num) FILTER (metric = '{t}') AS {t}" for t in TYPES)} FROM x GROUP BY user_id"""

Q["top_hits"] = lambda s, d: la.top_k(metrics(s, d), ["metric"], [F.desc("num"), F.asc("seq")], 5).select("metric", "seq", F.col("rank").cast("long").alias("rank"))
S["top_hits"] = f"SELECT metric, seq, row_number() OVER (PARTITION BY metric ORDER BY num DESC, seq) AS rank FROM {METRICS} QUALIFY rank <= 5"

Q["file_state"] = lambda s, d: la.file_state(metrics(s, d), ["user_id"], "metric", newest(), (F.col("metric") == "error") & (F.col("num") < 20))
S["file_state"] = f"""WITH x AS ({S['latest_row']}) SELECT user_id, CASE WHEN bool_or(metric = 'error' AND num < 20) THEN 'FAILED' ELSE 'COMPLETE' END AS state FROM x GROUP BY user_id"""

Q["entity_state"] = lambda s, d: la.entity_state(read(s, d, "orders")[0].withColumn("st", F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("COMPLETE")), ["o_custkey"], "st")
S["entity_state"] = "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'FAILED' WHEN bool_or(o_orderstatus = 'P') THEN 'RUNNING' ELSE 'COMPLETE' END AS state FROM orders GROUP BY o_custkey"


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    old, new = e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0")
    pick = lambda x: x.select("user_id", "event_type", "event_id", "value")
    keys = ["user_id", "event_type"]
    return la.upsert(la.latest(pick(old), keys, [F.desc("event_id")]), pick(new), keys, [F.desc("event_id")])


Q["metric_upsert"] = upsert
S["metric_upsert"] = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 = 0 DESC, event_id DESC) = 1"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "labels")
    automatic = docs.select("doc_id", F.when(F.col("n_chars") < 200, "FAIL").otherwise("PASS").alias("decision"), F.lit(1).alias("seq"))
    override = labels.select("doc_id", F.when(F.col("toxic") == 1, "EXCLUDED").when(F.col("quality") == 0, "REVIEW").alias("curated_decision"), F.lit(1).alias("seq"))
    return ru.curate(automatic, ["doc_id"], "seq", override).select("doc_id", "decision", "effective_decision")


Q["effective_decision"] = decisions
S["effective_decision"] = "SELECT d.doc_id, CASE WHEN n_chars < 200 THEN 'FAIL' ELSE 'PASS' END AS decision, coalesce(CASE WHEN toxic = 1 THEN 'EXCLUDED' WHEN quality = 0 THEN 'REVIEW' END, CASE WHEN n_chars < 200 THEN 'FAIL' ELSE 'PASS' END) AS effective_decision FROM documents d LEFT JOIN labels USING (doc_id)"

PROFILE = {
    "kind": "qc",
    "version": 1,
    "required": [
        {"metric": "purchase", "operator": ">=", "value": 5},
        {"metric": "view", "operator": "<", "value_by": {"metric": "segment", "values": {"BUILDING": 400, "MACHINERY": 90, "FURNITURE": 60}, "unknown": "warning"}},
    ],
    "warnings": [{"metric": "error", "operator": ">", "value": 80, "code": "MANY_ERRORS"}, {"metric": "click", "operator": "between", "min": 10, "max": 20}],
}


def rule_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    (cust,) = read(spark, sf_dir, "customer")
    wide = Q["qc_wide"](spark, sf_dir).join(cust.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")), "user_id", "left")
    got = ru.evaluate(wide, PROFILE, {t: F.col(t) for t in [*TYPES, "segment"]})
    return got.select("user_id", "decision", F.array_join("reason_codes", ",").alias("reasons"), ru.decided_state(F.col("decision"), F.lit("QC_COMPLETE")).alias("state"))


Q["rule_decision"] = rule_decision
S["rule_decision"] = f"""WITH w AS ({S['qc_wide']}), m AS (SELECT w.*, c_mktsegment AS segment FROM w LEFT JOIN customer ON c_custkey = user_id), o AS (SELECT user_id,
 CASE WHEN purchase IS NULL THEN 'm:MISSING_METRIC:purchase' WHEN NOT purchase >= 5 THEN 'f:PURCHASE_FAILED' END AS a,
 CASE WHEN "view" IS NULL THEN 'm:MISSING_METRIC:view' WHEN segment IS NULL OR segment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'w:SEGMENT_UNKNOWN' WHEN NOT "view" < CASE segment WHEN 'BUILDING' THEN 400 WHEN 'MACHINERY' THEN 90 ELSE 60 END THEN 'f:VIEW_FAILED' END AS b,
 CASE WHEN error > 80 THEN 'w:MANY_ERRORS' END AS c, CASE WHEN click BETWEEN 10 AND 20 THEN 'w:CLICK_WARNING' END AS d FROM m), l AS (SELECT user_id, list_filter([a, b, c, d], lambda x: x IS NOT NULL) AS r FROM o), z AS (SELECT user_id, r, list_transform(r, lambda x: x[1]) AS k FROM l), y AS (SELECT user_id, r,
 CASE WHEN list_contains(k, 'f') THEN 'FAIL' WHEN list_contains(k, 'm') THEN 'NOT_EVALUATED' WHEN list_contains(k, 'w') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS decision FROM z)
SELECT user_id, decision, array_to_string(list_transform(r, lambda x: x[3:]), ',') AS reasons, CASE decision WHEN 'FAIL' THEN 'REJECTED' WHEN 'NOT_EVALUATED' THEN 'QC_COMPLETE' ELSE 'ACCEPTED' END AS state FROM y"""


def best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = read(spark, sf_dir, "lineitem")
    source = {"filter": [{"field": "l_tax", "operator": "<=", "value": 0.04}], "best_by": [{"field": "l_discount"}, {"field": "l_returnflag", "rank": {"R": 1, "A": 2}, "default": 9}, {"field": "l_extendedprice", "direction": "desc"}]}
    return ru.best_hits(li, ["l_orderkey"], source, tie="l_linenumber").select("l_orderkey", "l_linenumber")


Q["best_hit"] = best_hit
S["best_hit"] = """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax <= 0.04 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount NULLS LAST, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 9 END, l_extendedprice DESC NULLS LAST, l_linenumber) = 1"""


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "labels")
    rules = [
        {"label": "toxic", "source": "label", "when": [{"field": "toxic", "operator": "==", "value": 1}]},
        {"label": "poor", "source": "label", "when": [{"any": [{"field": "quality", "operator": "==", "value": 0}, {"field": "missing", "operator": "exists"}]}]},
        {"label": "unlabelled", "source": "label", "absent": True},
        {"label": "other", "default": True},
    ]
    return ru.classify(docs.select("doc_id"), ["doc_id"], {"label": labels}, rules).select("doc_id", "label", "rule")


Q["classify_first_match"] = classify
S["classify_first_match"] = "SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'other' END AS label, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN l.doc_id IS NULL THEN 2 ELSE 3 END AS rule FROM documents d LEFT JOIN labels l USING (doc_id)"


def label_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "labels")
    old = labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
    new = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("n_chars") > 500, "good").otherwise("poor").alias("label"))
    return ru.label_changes(old, new, ["doc_id"])


Q["label_changes"] = label_diff
S["label_changes"] = """WITH o AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS a FROM labels), n AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 'good' ELSE 'poor' END AS b FROM documents WHERE doc_id % 4 <> 0)
SELECT doc_id, CASE WHEN b IS NULL THEN 'removed' WHEN a IS NOT DISTINCT FROM b THEN 'unchanged' ELSE 'written' END AS change FROM o FULL JOIN n USING (doc_id)"""


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    fields = {"k": F.get_json_object("props", "$.k"), "type": F.col("event_type"), "none": F.get_json_object("props", "$.absent")}
    c = {
        "a": {"field": "k", "operator": ">=", "value": 50}, "b": {"any": [{"field": "none", "operator": "exists"}, {"field": "type", "operator": "in", "values": ["view", "click"]}]}, "c": {"not": {"any": [{"field": "none", "operator": "==", "value": 1}]}},
        "d": {"not": {"field": "none", "operator": "==", "value": 1}}, "e": {"field": "type", "operator": "like", "value": "%I_W"}, "f": {"field": "none", "operator": "not_in", "values": [1]}, "g": {"field": "k", "operator": "between", "min": 10, "max": 30},
    }
    return e.select("event_id", *[holds(x, fields).alias(f"holds_{n}") for n, x in c.items()], condition(c["d"], fields).isNull().alias("unknown_d"))


Q["condition_any_not"] = conditions
S["condition_any_not"] = """WITH x AS (SELECT event_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_id, coalesce(k >= 50, false) AS holds_a, t IN ('view', 'click') AS holds_b, true AS holds_c, false AS holds_d, t ILIKE '%I_W' AS holds_e, false AS holds_f, coalesce(k BETWEEN 10 AND 30, false) AS holds_g, true AS unknown_d FROM x"""

Q["run_log_page"] = lambda s, d: page(read(s, d, "orders")[0].where(in_time(F.col("o_orderdate"), "1994-01-01", "1996-01-01")).select("o_orderkey", "o_custkey"), [F.desc("o_orderkey")], limit=50, offset=20)
S["run_log_page"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderkey DESC LIMIT 50 OFFSET 20"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as one edge list."""
    region, nation, cust, orders = read(spark, sf_dir, "region", "nation", "customer", "orders")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = region.select(text("r", "r_regionkey").alias("c"), text("r", "r_regionkey").alias("p"))
    e = e.unionByName(nation.select(text("n", "n_nationkey").alias("c"), text("r", "n_regionkey").alias("p"))).unionByName(cust.select(text("c", "c_custkey").alias("c"), text("n", "c_nationkey").alias("p")))
    return e.unionByName(orders.select(text("o", "o_orderkey").alias("c"), text("c", "o_custkey").alias("p")))


EDGES = "(SELECT 'r' || r_regionkey AS c, 'r' || r_regionkey AS p FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return hi.ancestors(e, e.where(F.col("c").startswith("o")).select("c"), child="c", parent="p")


Q["ancestors"] = ancestors
S["ancestors"] = f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES}), a(start, node, depth) AS (SELECT c, c, 0 FROM e WHERE c LIKE 'o%' UNION ALL SELECT start, p, depth + 1 FROM a JOIN e ON e.c = a.node WHERE e.c <> e.p) SELECT * FROM a"


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return hi.descendants(e, e.where("c LIKE 'r%'").select("c"), child="c", parent="p", without=e.where("c IN ('n3', 'n6')").select("c"))


Q["descendants_without"] = descendants
S["descendants_without"] = f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES} WHERE c NOT IN ('n3', 'n6')), a(node, depth) AS (SELECT c, 0 FROM e WHERE c LIKE 'r%' UNION ALL SELECT e.c, depth + 1 FROM a JOIN e ON e.p = a.node WHERE e.c <> e.p) SELECT * FROM a"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "conversations")
    node = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    f = c.select(node(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent"), "role")
    return hi.children(f, f.where(F.col("parent").isNull()).select("id"), recursive=True).select("id", "parent", "role")


Q["children_recursive"] = turns
S["children_recursive"] = "WITH RECURSIVE f AS MATERIALIZED (SELECT DISTINCT conv_id || ':' || turn AS id, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent FROM conversations), a(id) AS (SELECT id FROM f WHERE parent IS NULL UNION SELECT f.id FROM a JOIN f ON f.parent = a.id) SELECT c.conv_id || ':' || c.turn AS id, CASE WHEN c.turn > 0 THEN c.conv_id || ':' || (c.turn - 1) END AS parent, c.role FROM conversations c JOIN a ON a.id = c.conv_id || ':' || c.turn WHERE c.turn > 0"


def climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    f = e.select(F.col("c").alias("id"), F.when(F.col("c") != F.col("p"), F.col("p")).alias("parent"), F.substring("c", 1, 1).alias("type"))
    return hi.climb_until(f, f.where(F.col("id").startswith("o")).select("id"), until="n").select("id", "parent")


Q["climb_to_type"] = climb
S["climb_to_type"] = "SELECT DISTINCT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, cust, orders = read(spark, sf_dir, "region", "nation", "customer", "orders")
    events = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(t).alias("object_type"), F.lit(i).cast("long").alias("object_id"), F.lit(e).cast("long").alias("event_id")) for t, i, e in (("region", 2, 1), ("nation", 8, 2), ("nation", 3, 3), ("customer", 7, 4))])).alias("e")).select("e.*")
    key = lambda df, *cs: df.select(*[F.col(c).cast("long").alias(c) for c in cs])
    levels = [("region", key(region, "r_regionkey"), "r_regionkey", None), ("nation", key(nation, "n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey"), ("customer", key(cust, "c_custkey", "c_nationkey"), "c_custkey", "c_nationkey"), ("orders", key(orders, "o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")]
    return hi.cascade(levels, events)


Q["retire_cascade"] = cascade
S["retire_cascade"] = """WITH ev(t, i, e) AS (VALUES ('region', 2, 1), ('nation', 8, 2), ('nation', 3, 3), ('customer', 7, 4)), o AS (SELECT 'region' AS t, r_regionkey AS id, 'region' AS rt, r_regionkey AS ri FROM region UNION ALL SELECT 'nation', n_nationkey, 'region', n_regionkey FROM nation UNION ALL SELECT 'nation', n_nationkey, 'nation', n_nationkey FROM nation
 UNION ALL SELECT 'customer', c_custkey, x, y FROM customer JOIN nation ON n_nationkey = c_nationkey, LATERAL (VALUES ('region', n_regionkey), ('nation', n_nationkey), ('customer', c_custkey)) v(x, y)
 UNION ALL SELECT 'orders', o_orderkey, x, y FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey, LATERAL (VALUES ('region', n_regionkey), ('nation', n_nationkey), ('customer', c_custkey), ('orders', o_orderkey)) v(x, y))
SELECT o.t AS object_type, CAST(id AS BIGINT) AS object_id, rt AS root_type, CAST(ri AS BIGINT) AS root_id, CAST(e AS BIGINT) AS event_id FROM o JOIN ev ON ev.t = rt AND ev.i = ri"""


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root 1, regions as families, nations as genera, customers as species."""
    region, nation, cust = read(spark, sf_dir, "region", "nation", "customer")
    row = lambda df, t, p, r, n, x: df.select(t.cast("long").alias("taxid"), p.cast("long").alias("parent_taxid"), F.lit(r).alias("rank"), n.alias("scientific_name"), x.cast("int").alias("is_extinct"))
    out = row(spark.range(1), F.lit(1), F.lit(1), "no_rank", F.lit("root"), F.lit(0))
    out = out.unionByName(row(region, F.col("r_regionkey") + 10, F.lit(1), "family", F.col("r_name"), F.col("r_regionkey") == 4))
    out = out.unionByName(row(nation, F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, "genus", F.col("n_name"), F.lit(0)))
    return out.unionByName(row(cust, F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, "species", F.col("c_name"), F.lit(0)))


def observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cust, orders = read(spark, sf_dir, "customer", "orders")
    nodes = taxonomy(spark, sf_dir)
    aliases = spark.range(1).select(F.explode(F.array(F.struct(F.lit(5).cast("long").alias("alias_taxid"), F.lit(1007).cast("long").alias("current_taxid")), F.struct(F.lit(6).cast("long").alias("alias_taxid"), F.lit(None).cast("long").alias("current_taxid")))).alias("a")).select("a.*")
    k = F.col("c_custkey")
    taxon = F.when(k % 11 == 0, None).when(k % 13 == 0, "x1").when(k % 17 == 0, "5").when(k % 19 == 0, "6").when(k % 23 == 0, "99999999").when(k % 29 == 0, "1").otherwise((k + 1000).cast("string"))
    seen = cust.join(orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    return seen.select(F.concat(F.lit("ORG_"), k.cast("string")).alias("organism_id"), F.when(k % 31 == 0, "OTHER").otherwise("NCBI").alias("taxonomy_source"), taxon.alias("taxon_id")), nodes, aliases


RULES = {"ranks": ["family", "genus"], "without": [103], "exclude_names": ["^NATION_1?4$", "EGYPT"]}


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, nodes, aliases = observed(spark, sf_dir)
    wanted = cov.targets(nodes, [10, 11, 12, 14], **RULES)
    got = cov.observations(o, nodes, aliases, wanted, **RULES)
    return got.select("organism_id", F.coalesce("reason", F.lit("ACCEPTED")).alias("reason"), "family_taxid", "genus_taxid")


Q["exclusion_ladder"] = exclusions
_OBS = """tx AS (SELECT n_nationkey, n_regionkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey),
 k AS (SELECT c_custkey AS k, c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'x1' WHEN c_custkey % 17 = 0 THEN '5' WHEN c_custkey % 19 = 0 THEN '6' WHEN c_custkey % 23 = 0 THEN '99999999' WHEN c_custkey % 29 = 0 THEN '1' ELSE CAST(c_custkey + 1000 AS VARCHAR) END AS t FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
 l AS (SELECT k.*, CASE WHEN t = '5' THEN 7 WHEN t IN ('6', '99999999', 'x1') OR t IS NULL THEN NULL WHEN t = '1' THEN NULL ELSE k END AS c FROM k),
 m AS (SELECT l.*, x.n_nationkey AS n, x.n_regionkey AS r, x.n_name, x.r_name FROM l LEFT JOIN customer u ON u.c_custkey = l.c LEFT JOIN tx x ON x.n_nationkey = u.c_nationkey),
 z AS (SELECT 'ORG_' || k AS organism_id, r + 10 AS family_taxid, n + 100 AS genus_taxid, CASE WHEN k % 31 = 0 THEN 'UNSUPPORTED_TAXONOMY_SOURCE' WHEN t IS NULL THEN 'MISSING_TAXID' WHEN t = 'x1' THEN 'INVALID_TAXID' WHEN t = '6' THEN 'DELETED_TAXID' WHEN t = '99999999' THEN 'UNKNOWN_TAXID'
  WHEN r = 4 THEN 'EXCLUDED_EXTINCT' WHEN regexp_matches(n_name, '^NATION_1?4$|EGYPT') OR regexp_matches(r_name, '^NATION_1?4$|EGYPT') THEN 'EXCLUDED_NAME_PATTERN' WHEN n = 3 THEN 'EXCLUDED_SUBTREE' WHEN t = '1' THEN 'MISSING_TARGET_RANK' WHEN r NOT IN (0, 1, 2) THEN 'OUTSIDE_REFERENCE_SCOPE' ELSE 'ACCEPTED' END AS reason FROM m)"""
S["exclusion_ladder"] = f"WITH {_OBS} SELECT organism_id, reason, CAST(family_taxid AS BIGINT) AS family_taxid, CAST(genus_taxid AS BIGINT) AS genus_taxid FROM z"


def by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, nodes, aliases = observed(spark, sf_dir)
    wanted = cov.targets(nodes, [10, 11, 12, 14], **RULES)
    accepted = cov.observations(o, nodes, aliases, wanted, **RULES).where("reason IS NULL")
    return cov.coverage_by_rank(cov.covered(wanted, accepted, RULES["ranks"]), {"family": 50, "genus": 99})


Q["coverage_by_rank"] = by_rank
S["coverage_by_rank"] = f"""WITH {_OBS}, w AS (SELECT 'family' AS rank, r_regionkey + 10 AS x FROM region WHERE r_regionkey < 3 AND NOT regexp_matches(r_name, '^NATION_1?4$|EGYPT') UNION ALL SELECT 'genus', n_nationkey + 100 FROM nation WHERE n_regionkey < 3 AND n_nationkey <> 3 AND NOT regexp_matches(n_name, '^NATION_1?4$|EGYPT')),
 g AS (SELECT DISTINCT rank, x FROM w JOIN z ON reason = 'ACCEPTED' AND x = CASE rank WHEN 'family' THEN family_taxid ELSE genus_taxid END), c AS (SELECT rank, (SELECT count(*) FROM g WHERE g.rank = w.rank) AS numerator, count(*) AS denominator FROM w GROUP BY rank)
SELECT rank, numerator, denominator, CAST(round(CAST(numerator AS DECIMAL(28, 8)) * 100 / denominator, 4) AS DOUBLE) AS percentage, round(numerator * 100.0 / denominator, 4) >= CASE rank WHEN 'family' THEN 50 ELSE 99 END AS passed FROM c"""

Q["percent_of_zero"] = lambda s, d: read(s, d, "events")[0].groupBy("user_id").agg(percent(F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "view")).alias("errors_per_view"))
S["percent_of_zero"] = "SELECT user_id, coalesce(100.0 * count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type = 'view'), 0), 0.0) AS errors_per_view FROM events GROUP BY user_id"
