"""Measurements, the ownership tree, and dated trees."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment as al
from tessera.operators import entities as en
from tessera.operators import measure as me
from tessera.operators import timetree as tt
from tessera.sinks import files as out
from tessera.sources import lines


def test_measure(spark):
    numbered = lines.from_rows(spark.createDataFrame([("a", ">x circular\nACGT\n>y\nAC\n"), ("b", ">z\nNN\n")], "path string, text string"))
    got = {(r["path"], r["metric_name"]): (r["metric_value"], r["metric_numeric"], r["metric_unit"]) for r in me.measure(numbered, "fasta").collect()}
    assert got["a", "total_length"] == ("6", 6.0, "bp") and got["b", "n_percent"] == ("100.0", 100.0, "percent") and got["a", "circular_sequence_count"][1] == 1 and got["a", "parseable"][1] == 1
    assert {r["metric_name"] for r in me.measure(numbered, "fasta", role="sequence").collect()} == {*me.SEQUENCE_METRICS, "parseable"}
    fastq = lines.from_rows(spark.createDataFrame([("a", "@r\nAC\n+\n!I\n")], "path string, text string"))
    assert {r["metric_name"]: r["metric_value"] for r in me.measure(fastq, "fastq").collect()}["quality_encoding"] == "sanger_phred33"
    gff = lines.from_rows(spark.createDataFrame([("a", "c\ts\tgene\t1\t9\t.\t+\t.\tID=g\n")], "path string, text string"))
    assert {r["metric_name"]: r["metric_numeric"] for r in me.measure(gff, "gff3").collect()}["gene_count"] == 1
    assert me.measure(numbered, "protein").count() == 2 * 8
    with pytest.raises(ValueError, match="unknown format"):
        me.measure(numbered, "cram")
    files = spark.createDataFrame([("run", 1, "f1", "reads_1"), ("run", 1, "f2", "reads_2"), ("run", 2, "f3", "reads_1")], "entity_type string, entity_id long, file_id string, file_role string")
    counts = spark.createDataFrame([("f1", 5), ("f2", 5), ("f3", 1)], "file_id string, records long")
    assert [(r["entity_id"], r["paired_read_count_match"]) for r in me.paired_counts(files, counts).collect()] == [(1, 1)]


def tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "organism": make([("O1",), ("O2",)], "organism_id string"), "sample": make([("S1", "O1"), ("S2", "O1"), ("S3", "O2")], "sample_id string, organism_id string"), "run": make([("R1", "S1")], "run_id string, sample_id string"),
        "assembly": make([("A1", "S1"), ("A2", "S2")], "assembly_id string, sample_id string"), "annotation": make([("N1", "A1"), ("N2", "A2")], "annotation_id string, assembly_id string"),
    }


def test_ownership(spark):
    t = tables(spark)
    owner = en.owners(t)
    assert {(r["entity_type"], r["entity_id"]): r["organism_id"] for r in owner.collect()}["annotation", "N2"] == "O1" and owner.count() == 10
    size = lambda g: {k: sorted(r[0] for r in v.select(f"{k}_id").collect()) for k, v in g.items()}
    g = en.graph(t, "O1", spark.createDataFrame([("sample", "S2")], "entity_type string, entity_id string"))
    assert size(g) == {"organism": ["O1"], "sample": ["S1"], "run": ["R1"], "assembly": ["A1"], "annotation": ["N1"]}
    whole = en.graph(t, "O1")
    assert size(en.matched(whole, "assembly", "A2")) == {"organism": ["O1"], "sample": ["S2"], "run": [], "assembly": ["A2"], "annotation": ["N2"]}
    assert size(en.matched(whole, "sample", "S1")) == {"organism": ["O1"], "sample": ["S1"], "run": ["R1"], "assembly": ["A1"], "annotation": ["N1"]}
    nested = en.nested(t["organism"], t["sample"], "organism_id", ["sample_id"], "samples")
    assert {r["organism_id"]: [x["sample_id"] for x in r["samples"]] for r in nested.collect()} == {"O1": ["S1", "S2"], "O2": ["S3"]}
    files = spark.createDataFrame([("assembly", "A1", "f1"), ("assembly", "A2", "f2")], "entity_type string, entity_id string, file_id string")
    below = spark.createDataFrame([("assembly", "A1")], "entity_type string, entity_id string")
    assert en.impact(below, {"files": files}).first()["n"] == 1
    assert en.member_taxa(files, owner, t["organism"]).where("organism_id = 'O1'").count() == 2
    where = spark.createDataFrame([("f1", "s3"), ("f1", "disk")], "file_id string, remote string")
    assert sorted((r["file_id"], r["remote"]) for r in en.with_locations(files, where, ["remote"]).collect()) == [("f1", "disk"), ("f1", "s3"), ("f2", "")]


def test_dated_tree(spark):
    tree = tt.edges(spark, "((A:1,B:2)ab:3,('C c',D)cd)root;")
    got = tt.clades(tree, spark.createDataFrame([("A", "B"), ("A", "D"), ("C c", "D"), ("A", "zz")], "a string, b string"))
    label = {r["node"]: r["label"] for r in tree.collect()}
    assert {(r["a"], r["b"]): label.get(r["mrca"]) for r in got.collect()} == {("A", "B"): "ab", ("A", "D"): "root", ("C c", "D"): "cd", ("A", "zz"): None}
    ids = {v: k for k, v in label.items()}
    bounds = spark.createDataFrame([(ids["root"], 5.0, 10.0), (ids["ab"], 20.0, 30.0), (ids["cd"], 1.0, 2.0)], "node long, low double, high double")
    assert [tuple(r) for r in tt.bound_conflicts(tree, bounds).collect()] == [(ids["root"], ids["ab"])]
    for bad in ("(A,B", "(A,B));", "A,B;", "(A);x"):
        with pytest.raises(ValueError):
            tt.parse_newick(bad)


def test_deep_tree(spark):
    text = "(a,b)"
    for i in range(105):
        text = f"({text},x{i})"
    tree = tt.edges(spark, f"{text}root;")
    tree = spark.createDataFrame(tree.collect(), tree.schema)
    label = {r["label"]: r["node"] for r in tree.where("label <> ''").collect()}
    got = tt.clades(tree.where("label IN ('', 'root', 'a', 'x104')"), spark.createDataFrame([("a", "x104")], "a string, b string"))
    assert [r["mrca"] for r in got.collect()] == [label["root"]]


def test_alignment_files(spark, tmp_path):
    r = spark.createDataFrame([(0, "s1", "AC"), (1, "s2", "A-")], "record_no long, seqid string, sequence string")
    rows, columns = al.alignment_rows(r), al.alignment_columns(r)
    out.write_alignment(rows, columns, al.alignment_summary(rows, columns), str(tmp_path / "q"))
    text = spark.read.text(str(tmp_path / "q/column_qc")).where(~F.col("value").startswith("column")).orderBy("value").collect()
    assert [x["value"] for x in text] == ["1\t1.000000\t1\tA\t1.000000", "2\t0.500000\t1\tC\t1.000000"]
    assert out.template_header(["a", "b"]) == "a\tb\n"
