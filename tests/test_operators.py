"""Operators on hand-made rows: cases that the tables don't have."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as sc
from tessera.operators import alignment as al
from tessera.operators import coverage as cov
from tessera.operators import diff as di
from tessera.operators import hierarchy as hi
from tessera.operators import latest as la
from tessera.operators import nstats
from tessera.operators import rules as ru
from tessera.operators import selection as se
from tessera.operators.predicates import attribute_filter, compare, holds, in_lists, page, parse_attribute_filter, subject_matches


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_compare(spark):
    t = lambda x: F.lit(x).cast("string")
    assert one(spark, compare(t("1e-5"), "==", 0.00001)) is True and one(spark, compare(t("a"), "==", "a")) is True and one(spark, compare(t("2"), "!=", "2.0")) is False
    assert one(spark, compare(t(None), "<", 5)) is None and one(spark, compare(t("x"), "<", 5, strict=False)) is None
    with pytest.raises(Exception, match="not a number"):
        one(spark, compare(t("x"), "<", 5))
    with pytest.raises(ValueError, match="needs a number"):
        compare(t("1"), "<", "x")
    for operator, extra in (("exists", {}), ("not_in", {"values": [1]}), ("!=", {"value": 1}), ("like", {"value": "%"})):
        assert one(spark, holds({"field": "gone", "operator": operator, **extra}, {})) is False
    assert one(spark, holds({"field": "f", "operator": "like", "value": "bhlh_%"}, {"f": t("bHLH-myc_n\n")})) is True


def test_attribute_filters(spark):
    assert parse_attribute_filter("a~=b=c") == ("a", "b=c", True) and parse_attribute_filter("a=b") == ("a", "b", False)
    df = spark.createDataFrame([("ID=x;Dbxref=a.b", "x", None), ("Note=a.b c;Dbxref=aXb", None, "g")], "attributes string, id string, gene_id string")
    assert df.where(attribute_filter("gff3", "Dbxref", "a.b")).count() == 1 and df.where(attribute_filter("gff3", "Dbxref", "a.b", regex=True)).count() == 2
    assert df.where(attribute_filter("gff3", "iD", "x")).count() == 1 and df.where(attribute_filter("gtf", "GENE_ID", "g")).count() == 1
    gtf = spark.createDataFrame([('gene_id "A"; note "p q"',)], "attributes string")
    assert gtf.where(attribute_filter("gtf", "note", "p q")).count() == 1
    assert gtf.where(attribute_filter("gtf", "note", "q", regex=True)).count() == 0 and gtf.where(attribute_filter("gtf", "note", "p.q|x", regex=True)).count() == 1
    lines = spark.createDataFrame([("Line=16",), ("Line = 6 ;x=1",), ("a=1; Line=7",), ("Line=76",), ("XLine=6",)], "attributes string")
    assert [r[0] for r in lines.where(attribute_filter("gff3", "Line", "[67]", regex=True)).collect()] == ["Line = 6 ;x=1", "a=1; Line=7"]
    assert lines.where(attribute_filter("gff3", "Line", "6")).count() == 1
    for value, values, inside in (("1.0", [1], False), ("1", [1], True), ("x", [], False)):
        assert one(spark, holds({"field": "f", "operator": "in", "values": values}, {"f": F.lit(value)})) is inside and one(spark, holds({"field": "f", "operator": "not_in", "values": values}, {"f": F.lit(value)})) is not inside
    assert in_lists(lines, {"attributes": []}).count() == 5 and in_lists(lines, {"attributes": ["XLine=6"]}).count() == 1
    assert one(spark, subject_matches(F.lit("cd1"), F.lit('{"short_name":"bHLH"}'), "%hlh")) is True and one(spark, subject_matches(F.lit(None).cast("string"), F.lit("bad"), "x")) is False


def test_scalars(spark):
    v = lambda f, x: one(spark, f(F.lit(x).cast("string")))
    assert v(sc.percent_decode, "a%20b+%zz") == "a%20b+%zz" and v(sc.percent_decode, "a%20b+") == "a b+"
    assert [v(sc.null_tokens, x) for x in (" N/A ", "none", " x ", "")] == [None, None, "x", None]
    assert [v(sc.escape_formula, x) for x in ("=1", "@a", "a=", "\tq")] == ["'=1", "'@a", "a=", "'\tq"]
    assert [v(sc.circular, x) for x in ("c1 [topology=circular]", "c1 circularis", "x (Circular),")] == [True, False, True]
    assert [v(sc.partial_date, x) for x in ("2020-05-01T1", "2020-05", "x")] == ["2020-05-01", "2020-05", None]
    assert [v(sc.iso_date, x) for x in ("2020-02-29", "2020-02-30")] == ["2020-02-29", None]
    assert one(spark, sc.latitude_longitude(F.lit("12.5 S 99.25 E"))).asDict() == {"latitude": -12.5, "longitude": 99.25}
    assert str(one(spark, sc.excel_date(F.lit(43831.5)))) == "2020-01-01" and one(spark, sc.percent(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, sc.percent_exact(F.lit(1), F.lit(3))) == 33.3333 and one(spark, sc.percent_exact(F.lit(2), F.lit(3))) == 66.6667
    with pytest.raises(Exception, match="denominator"):
        one(spark, sc.percent_exact(F.lit(1), F.lit(0)))
    assert one(spark, sc.metric_value(F.lit(True), "boolean")).asDict() == {"metric_value": "1", "metric_numeric": 1.0} and one(spark, sc.metric_value(F.lit("x"), "string"))["metric_numeric"] is None
    assert one(spark, sc.canonical_hash(b=F.lit(1), a=F.lit("x"))) == __import__("hashlib").sha256(b'{"a":"x","b":1}').hexdigest()
    assert v(sc.first_token, "  ab c") == "ab" and one(spark, sc.is_false(F.lit(None).cast("double"), F.lit(" No "))) is True and one(spark, sc.merged(F.lit(""), F.lit("old"))) == "old"


def test_n_statistics(spark):
    df = spark.createDataFrame([("a", 6000), ("a", 5000), ("a", 4000), ("a", 3000), ("a", 2000), ("z", 0), ("n", None)], "g string, len long")
    got = {r["g"]: (r["n50"], r["l50"]) for r in nstats.nx(df, ["g"], "len", {"50": 0.5}).collect()}
    assert got == {"a": (5000, 2), "z": (0, 1)}
    assert nstats.nx(spark.createDataFrame([("a", 10, 7), ("a", 3, 1)], "g string, len long, n long"), ["g"], "len", {"50": 0.5}, counts="n").first()["l50"] == 4


def test_alignment(spark):
    r = spark.createDataFrame([(0, "s1", "AC-T"), (1, "s2", "GC-."), (2, "s3", "AG--")], "record_no long, seqid string, sequence string")
    c = [tuple(x) for x in al.alignment_columns(r).orderBy("column_1based").collect()]
    assert c == [(1, 1.0, 2, "A", 2 / 3), (2, 1.0, 2, "C", 2 / 3), (3, 0.0, 0, "-", 0.0), (4, 1 / 3, 1, "T", 1.0)]
    s = al.alignment_summary(al.alignment_rows(r), al.alignment_columns(r)).first().asDict()
    assert (s["sequences"], s["alignment_length"], s["median_coverage"], s["columns_occupancy_ge_0_9"]) == (3, 4, 0.5, 2)
    with pytest.raises(Exception, match="unequal"):
        al.check_equal(r.unionByName(spark.createDataFrame([(3, "x", "A")], r.schema))).collect()


def test_hierarchy(spark):
    e = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (9, 8), (8, 9)], "c long, p long")
    got = sorted(tuple(r) for r in hi.ancestors(e, e.where("c IN (4, 9)").select("c"), child="c", parent="p").collect())
    assert got == [(4, 1, 3), (4, 2, 2), (4, 3, 1), (4, 4, 0), (9, 8, 1), (9, 9, 0)]
    assert sorted(r["node"] for r in hi.descendants(e, e.where("c = 1").select("c"), child="c", parent="p", without=e.where("c = 3").select("c")).collect()) == [1, 2]
    ents = spark.createDataFrame([("organism", "ORG_1"), ("sample", "S")], "internal_type string, internal_id string")
    acc = spark.createDataFrame([("organism", "ORG_1", "NCBI", "X1"), ("sample", "S", "NCBI", "DUP"), ("organism", "ORG_1", "ENA", "DUP")], "internal_type string, internal_id string, namespace string, accession string")
    find = lambda x: [r["internal_id"] for r in hi.resolve_identifier(spark, ents, acc, x).collect()]
    assert find("ORG_1") == find("X1") == find("ENA:DUP") == ["ORG_1"] and find("none") == []
    with pytest.raises(Exception, match="ambiguous"):
        find("DUP")


def test_rules(spark):
    df = spark.createDataFrame([(1, "5", None, "x"), (2, None, "1", None), (3, "1", "1", "y"), (4, "9", "0", "q")], "i int, n50 string, flag string, kind string")
    by = lambda policy: {"metric": "n50", "operator": ">=", "value_by": {"metric": "kind", "values": {"x": 4, "y": 4}, **({"unknown": policy} if policy else {})}}
    m = {c: F.col(c) for c in ("n50", "flag", "kind")}
    run = lambda p: {r["i"]: (r["decision"], r["reason_codes"]) for r in ru.evaluate(df, p, m).collect()}
    got = run({"required": [by("ignore")], "warnings": [{"metric": "flag", "operator": "==", "value": 1}]})
    assert got == {1: ("PASS", []), 2: ("NOT_EVALUATED", ["MISSING_METRIC:n50", "FLAG_WARNING"]), 3: ("FAIL", ["N50_FAILED", "FLAG_WARNING"]), 4: ("PASS", ["KIND_IGNORED"])}
    assert run({"required": [by(None)]})[4] == ("NOT_EVALUATED", ["KIND_UNKNOWN"]) and run({"required": [by("fail")]})[4] == ("FAIL", ["KIND_UNKNOWN"])
    assert run({"warnings": [by(None)]})[4] == ("PASS", []) and run({"required": [{"metric": "kind", "operator": "in", "values": ["x", "y"]}]})[4][0] == "FAIL"
    staged = ru.evaluate(df, {"required": [{"metric": "n50", "operator": ">", "value": 3, "source": {"qc_stage": "s"}}]}, {"s/n50": F.col("n50")})
    assert [r["decision"] for r in staged.orderBy("i").collect()] == ["PASS", "NOT_EVALUATED", "FAIL", "PASS"]
    assert one(spark, ru.decided_state(F.lit("FAIL"), F.lit("RELEASED"))) == "RELEASED" and one(spark, ru.transition(F.lit("A"), F.lit("B"), {"A": ["B"]})) == "B"
    with pytest.raises(Exception, match="not allowed"):
        one(spark, ru.transition(F.lit("B"), F.lit("A"), {"A": ["B"]}))
    for bad in ({}, {"kind": "sequence_classification"}, {"kind": "sequence_classification", "rules": [{"label": "x", "source": "no"}]}, {"kind": "sequence_classification", "rules": [{"label": "x", "default": True}, {"label": "y", "default": True}]}):
        with pytest.raises(ValueError):
            ru.validate_profile(bad)


def tree(spark):
    rows = [(1, 1, "no_rank", "root", 0), (33, 1, "clade", "plants", 0), (10, 33, "family", "Alpha", 0), (20, 33, "family", "Beta", 1), (40, 33, "family", "Gamma", 0), (60, 33, "family", "Cut", 0), (11, 10, "genus", "Aa", 0), (31, 10, "genus", "environmental samples", 0), (21, 20, "genus", "Bb", 0), (41, 40, "genus", "Cc", 0), (50, 40, "genus", "unclassified Alpha", 0), (61, 60, "genus", "Dd", 0), (12, 11, "species", "Aa a", 0)]
    return spark.createDataFrame(rows, "taxid long, parent_taxid long, rank string, scientific_name string, is_extinct int")


def test_coverage(spark):
    nodes, kind = tree(spark), {"ranks": ["family", "genus"], "without": [60], "exclude_names": ["^environmental", "unclassified"]}
    wanted = cov.targets(nodes, [33], **kind)
    assert sorted((r["rank"], r["taxid"]) for r in wanted.collect()) == [("family", 10), ("family", 40), ("genus", 11), ("genus", 41)]
    aliases = spark.createDataFrame([(1200, 12, "MERGED"), (9999, None, "DELETED")], "alias_taxid long, current_taxid long, status string")
    rows = [("o1", "NCBI", "1200"), ("o2", "NCBI", "9999"), ("o3", "NCBI", "21"), ("o4", "NCBI", "31"), ("o5", "NCBI", "61"), ("o6", "NCBI", "33"), ("o7", "GBIF", "12"), ("o8", "NCBI", ""), ("o9", "NCBI", "x"), ("p1", "NCBI", "77")]
    got = cov.observations(spark.createDataFrame(rows, "organism_id string, taxonomy_source string, taxon_id string"), nodes, aliases, wanted, **kind)
    assert {r["organism_id"]: r["reason"] for r in got.collect()} == {"o1": None, "o2": "DELETED_TAXID", "o3": "EXCLUDED_EXTINCT", "o4": "EXCLUDED_NAME_PATTERN", "o5": "EXCLUDED_SUBTREE", "o6": "MISSING_TARGET_RANK", "o7": "UNSUPPORTED_TAXONOMY_SOURCE", "o8": "MISSING_TAXID", "o9": "INVALID_TAXID", "p1": "UNKNOWN_TAXID"}
    c = cov.coverage_by_rank(cov.covered(wanted, got.where("reason IS NULL"), ["family", "genus"]), {"family": 50, "genus": 60})
    assert {r["rank"]: (r["numerator"], r["denominator"], r["percentage"], r["passed"]) for r in c.collect()} == {"family": (1, 2, 50.0, True), "genus": (1, 2, 50.0, False)}


def test_metrics_mix_identities(spark):
    rows = [("f", 1, "parseable", "2024-01-01", 1, "0", 0.0), ("f", 2, "parseable", "2024-01-02", 2, "1", 1.0), ("f", 1, "n50", "2024-01-03", 3, "7", 7.0), ("f", 2, "n50", "2024-01-02", 4, "9", 9.0), ("f", 1, "n50", "2024-01-01", 5, "5", 5.0)]
    df = spark.createDataFrame(rows, "e string, i int, m string, at string, s long, t string, v double")
    got = la.latest_metrics(df, entity=["e"], identity="i", metric="m", at="at", sequence="s", text="t", numeric="v")
    assert {r["m"]: r["v"] for r in got.collect()} == {"parseable": 0.0, "n50": 7.0}


def test_imports_and_ledgers(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    apply = lambda how: sorted((r["k"], r["v"]) for r in di.apply_import(old, new, "k", ["v"], how).collect())
    assert apply("update") == [(1, "a"), (2, None), (3, "c")] and apply("skip") == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(Exception, match="exists"):
        apply("error")
    assert di.same_rows(old, old.orderBy(F.desc("k"))) and not di.same_rows(old, new)
    assert di.append_once(old, spark.createDataFrame([(1, "a"), (5, "z"), (5, "z")], old.schema), "k", "v").count() == 1
    with pytest.raises(Exception, match="conflict"):
        di.append_once(old, spark.createDataFrame([(1, "other")], old.schema), "k", "v").collect()
    assert la.insert_or_ignore(old, new, ["k"]).count() == 3


def test_selections(spark):
    files = spark.createDataFrame([("s", 1, "r1"), ("s", 2, "r2")], "entity_type string, entity_id long, file_role string")
    with pytest.raises(ValueError, match="criterion"):
        se.select_files(files, [])
    states = spark.createDataFrame([("s", 1, "ACCEPTED")], "entity_type string, entity_id long, state string")
    assert [r["entity_id"] for r in se.select_files(files, [], states=states, state="ACCEPTED").collect()] == [1]
    src, links, live = (spark.createDataFrame(x, y) for x, y in (([(1,), (2,), (3,)], "source_id long"), ([(1, "f1"), (2, "f2")], "source_id long, file_id string"), ([("f1",)], "file_id string")))
    assert sorted(r["source_id"] for r in se.active_sources(src, links, live, "source_id").collect()) == [1, 3]
    acc = spark.createDataFrame([("GCF_1.1",), ("GCF_1.2",), ("GCF_10.1",)], "a string")
    assert se.accession_matches(acc, "a", "GCF_1").count() == 2 and se.accession_matches(acc, "a", "GCF_1.2").count() == 1


def test_releases_accept_warnings(spark):
    keys = "entity_type string, entity_id long"
    files = spark.createDataFrame([("s", k, f"f{k}") for k in range(1, 5)], f"{keys}, file_id string")
    decisions = spark.createDataFrame([("s", 1, "FAIL", "ACCEPT_WITH_WARNING"), ("s", 2, "PASS", None), ("s", 3, "FAIL", None), ("s", 4, "PASS_WITH_WARNINGS", "EXCLUDED")], f"{keys}, decision string, curated_decision string")
    none, gone = spark.createDataFrame([], keys), spark.createDataFrame([], f"{keys}, root_type string, root_id long")
    assert sorted(r["file_id"] for r in se.release_files(files, decisions, none, none).collect()) == ["f1", "f2"]
    assert sorted(r["entity_id"] for r in se.release_exclusions(decisions, gone).collect()) == [3, 4]


def test_stale_jobs_and_region_order(spark):
    jobs = spark.createDataFrame([(1, "a", "RUNNING", None, None), (2, "b", "RUNNING", None, None), (3, "a", "completed", "t0", None), (4, None, "RUNNING", None, None)], "job_id long, analysis_name string, status string, finished_at string, error string")
    got = {r["job_id"]: (r["status"], r["finished_at"], r["error"] is None) for r in se.sweep_stale(jobs, "a", F.lit("now")).collect()}
    assert got == {1: ("interrupted", "now", False), 2: ("RUNNING", None, True), 3: ("completed", "t0", True), 4: ("RUNNING", None, True)}
    rows = spark.createDataFrame([("c2", "5", "9", "x"), ("c1", "10", "20", "b"), ("c1", "9", "20", "b"), ("c1", "10", "20", None), ("c1", "10", "3", "z")], "seqid string, start string, end string, subject_id string")
    assert [tuple(r)[1:] for r in page(rows, se.region_order()).collect()] == [("9", "20", "b"), ("10", "3", "z"), ("10", "20", None), ("10", "20", "b"), ("5", "9", "x")]


def test_read_only_sql_is_read_only(spark):
    from tessera import catalog

    catalog.register(spark, {"t_read": spark.range(3)})
    assert catalog.query(spark, "WITH x AS (SELECT id FROM t_read WHERE id IN (SELECT max(id) FROM t_read)) SELECT count(*) AS n, 'java_method' AS s FROM x").first()["n"] == 1
    bad = [
        "SELECT java_method('java.lang.System', 'setProperty', 'probe', 'x')", "SELECT * FROM t_read WHERE id = (SELECT reflect('java.lang.Math', 'abs', 1))", "WITH x AS (SELECT try_reflect('java.lang.Math', 'abs', 1) AS v) SELECT * FROM x",
        "SELECT * FROM parquet.`/tmp/x`", "SELECT id FROM t_read JOIN CSV.`/etc/passwd` ON true", "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t_read", "DROP VIEW t_read", "CREATE TABLE zz AS SELECT 1", "INSERT INTO t_read SELECT 1", "SET a=b",
    ]
    for text in bad:
        with pytest.raises(catalog.NotAQuery):
            catalog.query(spark, text)
