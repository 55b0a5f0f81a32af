"""Readers and writers on small literal files."""

import gzip
import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import composition as co
from tessera.operators import features as fe
from tessera.operators import metadata as md
from tessera.operators import reads as rd
from tessera.sinks import files as out
from tessera.sources import events as ev
from tessera.sources import features as gff
from tessera.sources import hits, lines, reports, sequences, tables, taxonomy
from tessera.streaming import events as st


def numbered(spark, text, path="f"):
    return lines.from_rows(spark.createDataFrame([(path, text)], "path string, text string"))


def test_line_ends(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree\n\nfour")
    with gzip.open(tmp_path / "b.txt.gz", "wb") as f:
        f.write(b"x\ny\n")
    got = [(r["path"][-6:], r["line_no"], r["line"]) for r in lines.numbered_lines(spark, str(tmp_path)).orderBy("path", "line_no").collect()]
    assert [x[1:] for x in got] == [(1, "one"), (2, "two"), (3, "three"), (4, ""), (5, "four"), (1, "x"), (2, "y")]


FASTA = ">ctg1 circular\nACGTNacgtn--RY\nNNN\n>ctg2\nCCGGTT\n\n>ctg1 duplicate\nAAAA\n>empty\n"


def test_fasta(spark):
    r = sequences.fasta_records(numbered(spark, FASTA))
    assert [(x["seqid"], x["sequence"]) for x in r.orderBy("record_no").collect()] == [("ctg1", "ACGTNacgtn--RYNNN"), ("ctg2", "CCGGTT"), ("ctg1", "AAAA"), ("empty", "")]
    s = co.assembly_stats(r).first().asDict()
    want = {"sequence_count": 4, "total_length": 27, "mean_sequence_length": 6.75, "median_sequence_length": 5.0, "contig_n50": 17, "contig_l50": 1, "contig_n90": 4, "contig_l90": 3, "gap_count": 1, "invalid_base_count": 0, "empty_sequence_count": 1, "duplicate_sequence_id_count": 1, "duplicate_header_count": 0, "circular_sequence_count": 1}
    assert {k: s[k] for k in want} == want
    assert (round(s["gc_percent"], 3), round(s["n_percent"], 3), round(s["ambiguous_base_percent"], 3), round(s["gap_percent"], 3)) == (44.444, 18.519, 7.407, 7.407)
    assert {x["seqid"]: x["length"] for x in co.sequence_lengths(r).collect()} == {"ctg1": 21, "ctg2": 6, "empty": 0}
    back = "\n".join(x["value"] for x in out.fasta_lines(r.orderBy("record_no")).collect())
    assert back == ">ctg1 circular\nACGTNacgtn--RYNNN\n>ctg2\nCCGGTT\n>ctg1 duplicate\nAAAA\n>empty"


@pytest.mark.parametrize("text", ["ACGT\n>x\nA", ">\nAC", ">x\nAé"])
def test_bad_fasta(spark, text):
    with pytest.raises(Exception, match="sequence|header"):
        sequences.fasta_records(numbered(spark, text)).collect()


FASTQ = "@r1\nACGTN\n+\nIIIII\n@r2\nacgt\n+\nIIII\n@r1\nACGT\n+\n!!!!\n"


def test_fastq(spark):
    r = sequences.fastq_records(numbered(spark, FASTQ))
    s = co.read_stats(r).first().asDict()
    assert (s["read_count"], s["total_bases"], s["read_length_n50"], s["read_length_l50"], s["quality_encoding"]) == (3, 13, 4, 2, "sanger_phred33")
    assert (round(s["q20_percent"], 3), round(s["q30_percent"], 3), s["gc_percent"], s["duplicate_percent"]) == (69.231, 69.231, 50.0, 0.0)
    assert s["overrepresented_sequence_count"] == 3 and s["duplicate_is_sampled"] is False
    for bad in ("@r\nAC\n+\n", "r\nA\n+\nI\n", "@r\nAC\n+\nI\n", "@r\nA\nx\nI\n"):
        with pytest.raises(Exception, match="record|header|lengths|separator"):
            sequences.fastq_records(numbered(spark, bad)).collect()


def test_proteins(spark):
    r = spark.createDataFrame([("p1", "MKT*X"), ("p1", "MMA*"), ("p2", "XXX"), ("p3", "")], "seqid string, sequence string")
    s = co.protein_stats(r, cds_count=F.lit(4)).first().asDict()
    assert (s["protein_count"], s["protein_duplicate_id_count"], s["protein_empty_count"], round(s["protein_x_percent"], 3), s["protein_internal_stop_count"], s["protein_missing_start_count"], s["protein_missing_stop_count"], s["cds_protein_count_match"]) == (4, 1, 1, 33.333, 1, 1, 2, 1)


GFF = "##gff-version 3\n#x\nctg1\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Name=a%20b\nctg1\ts\tmRNA\t1\t9\t.\t+\t.\tID=t1;Parent=g1\nctg1\ts\tCDS\t1\t3\t.\t+\t0\tID=c1;Parent=t1,tx\nctg1\ts\tCDS\t4\t5\t.\t+\t1\tID=c2;Parent=ty\nctgX\ts\tgene\t1\t5\t1.5\t-\t.\tNote=n\nbroken\tline\n##FASTA\nctg1\ts\tgene\t1\t9\t.\t+\t.\tID=no\n"


def test_gff(spark):
    f = gff.parse_features(numbered(spark, GFF), strict=False)
    rows = f.orderBy("line_number").collect()
    assert [(r["type"], r["id"], r["parent"], r["score"]) for r in rows] == [("gene", "g1", None, None), ("mRNA", "t1", "g1", None), ("CDS", "c1", "t1,tx", None), ("CDS", "c2", "ty", None), ("gene", None, None, 1.5)]
    s = fe.structure_stats(f, lengths=spark.createDataFrame([("ctg1", 100)], "seqid string, length long")).first().asDict()
    want = {"feature_count": 5, "gene_count": 2, "mrna_count": 1, "cds_count": 2, "exon_count": 0, "feature_type_count": 3, "seqid_count": 2, "seqid_mismatch_count": 1, "end_beyond_sequence_count": 0, "coordinate_error_count": 0, "missing_id_count": 1, "duplicate_id_count": 0, "missing_parent_count": 2, "cds_length_multiple3_percent": 50.0, "cds_phase0_percent": 50.0}
    assert {k: s[k] for k in want} == want
    with pytest.raises(Exception, match="nine columns"):
        gff.parse_features(numbered(spark, GFF)).collect()
    m = spark.createDataFrame([("ID=a%20b+c;K=1;K=2;bad;=x",), (".",), (None,)], "a string").select(gff.attribute_map(F.col("a")).alias("m")).collect()
    assert m[0]["m"]["ID"] == "a b+c" and m[0]["m"]["K"] == "2" and m[1]["m"] == {} and m[2]["m"] == {}
    bed = out.bed_lines(fe.bed_rows(f)).collect()
    assert bed[0]["value"] == "ctg1\t0\t9\tg1\t0\t+" and bed[4]["value"] == "ctgX\t0\t5\tgene\t1.5\t-"


def test_gtf_and_longest(spark, tmp_path):
    text = 'c\ts\tgene\t1\t90\t.\t+\t.\tgene_id "A";\nc\ts\ttranscript\t1\t50\t.\t+\t.\tgene_id "A"; transcript_id "t1";\nc\ts\ttranscript\t1\t90\t.\t+\t.\tgene_id "A"; transcript_id "t2";\nc\ts\tCDS\t1\t30\t.\t+\t0\tgene_id "A"; transcript_id "t1";\nc\ts\tCDS\t1\t10\t.\t+\t0\tgene_id "A"; transcript_id "t2";\n'
    f = gff.parse_features(numbered(spark, text, "x"), "gtf")
    assert [(r["id"], r["parent"]) for r in f.orderBy("line_number").collect()] == [("A", None), ("t1", "A"), ("t2", "A"), (None, "t1"), (None, "t2")]
    assert [r["name"] for r in fe.longest_transcripts(f, "gtf").collect()] == ["t1"]
    assert [r["name"] for r in fe.longest_transcripts(f, "gtf", measure="span").collect()] == ["t2"]
    index = gff.ensure_index(spark, f"{tmp_path}/i", "h1", lambda: f)
    assert index.count() == 5 and gff.ensure_index(spark, f"{tmp_path}/i", "h1", lambda: 1 / 0).count() == 5


def test_reads(spark):
    rows = [(99, "chr1", 10, 60, "5S10M2D10M", 300, "chr1", 2), (147, "chr1", 200, 20, "20M", -300, "chr1", 0), (4, None, 0, 0, "*", 0, None, None), (1024 + 16, "chr2", 0, 40, "10M5N10M", 0, None, 1), (256, "chr1", 5, 0, "10M", 0, None, None), (512, "chr1", 5, 0, "10M", 0, None, None)]
    r = spark.createDataFrame(rows, "flag int, rname string, pos long, mapq int, cigar string, tlen int, mate string, nm int")
    m = rd.read_metrics(r).first().asDict()
    assert (m["alignment_count"], m["mapped_count"], m["primary_mapped_count"], m["paired_count"], m["proper_pair_count"], m["duplicate_count"], m["insert_size_count"], m["insert_size_mean"], m["soft_clipped_bases"]) == (6, 5, 4, 2, 2, 1, 1, 300.0, 5)
    assert m["error_rate"] == pytest.approx(3 / 80)
    c = rd.coverage_metrics(r, {"chr1": 300, "chr2": 100}).first().asDict()
    assert (c["bases_ge_1"], c["aligned_bases"], c["mean_depth"]) == (60, 60, 0.15)


def test_blast(spark):
    text = "# c\nq1\ts1\t90.5\t1\t10\t1e-5\nq1\ts2\tx\t2\t9\t0.1\nq2 \ts1\t\t1\t5\t1e-3\nshort\tline\n\ts\t1\t1\t1\t1\n"
    h, a = hits.blast(numbered(spark, text), ["q", "s", "pident", "qstart", "qend", "evalue"], metrics=["pident", "evalue"], numeric=["evalue"], most=1)
    assert [(r["query_id"], r["subject_id"], r["rank"], r["pident"], r["qstart"], r["evalue"]) for r in a.orderBy("line_no").collect()] == [("q1", "s1", 1, 90.5, 1, 1e-5), ("q1", "s2", 2, None, 2, 0.1), ("q2", "s1", 1, None, 1, 1e-3)]
    assert sorted((r["query_id"], r["metric_name"], r["metric_value"], r["metric_numeric"]) for r in h.collect()) == [("q1", "evalue", "1e-5", 1e-5), ("q1", "pident", "90.5", None), ("q2", "evalue", "1e-3", 1e-3)]
    assert hits.parse_hits("plugin:x", None) is None


def test_hmmer_and_blocks(spark):
    text = "# Program:         hmmsearch\nseq1 - PF1 PF00001 1e-9 50.1 0 x\nseq1 - PF2 - 2e-3 10 0 x\n"
    h = hits.hmmer_table(numbered(spark, text))
    assert sorted((r["query_id"], r["subject_id"], r["metric_name"], r["metric_numeric"], r["rank"]) for r in h.collect())[0] == ("seq1", "PF1", "evalue", 1e-9, 1)
    dom = " ".join(["T", "-", "9", "Q", "-", "9", "1", "2", "3", "1", "1", "1e-4", "1e-6", "33", "0", "1", "9", "4", "20", "3", "22", "0.9", "free text here"])
    _, a = hits.hmmer_domains(numbered(spark, dom), swap=False)
    r = a.first()
    assert (r["query_id"], r["subject_id"], r["qstart"], r["qend"], r["evalue"], r["bitscore"], r["extra"]["hmm_to"]) == ("Q", "T", 4, 20, 1e-6, 33.0, "9")
    row = "1\tQ#1\tSpecific\t225\t3\t9\t1e-5\t40\tcd1\tshort\tN\tsf"
    text = f"DATA\nSESSION\t1\tp\nQUERY\tQ#1\tPeptide\t50\tprot one\nDOMAINS\n{row}\n{row}\nENDDOMAINS\nSITES\nx\nENDSITES\nENDQUERY\nENDSESSION\nENDDATA\n{row}\n"
    _, a = hits.domain_blocks(numbered(spark, text))
    assert [(r["query_id"], r["subject_id"], r["rank"], r["qstart"], r["extra"]["short_name"]) for r in a.orderBy("line_no").collect()] == [("prot one", "cd1", 1, 3, "short"), ("prot one", "cd1", 2, 3, "short")]
    with pytest.raises(Exception, match="repeated query"):
        hits.domain_blocks(numbered(spark, text.replace("ENDSESSION\nENDDATA", f"QUERY\tQ#1\tP\t5\tagain\nDOMAINS\n{row}\nENDDATA")))[1].collect()


def plain_blocks(lines):
    """Block reports read line by line: (path, line_no, query, rank, session)."""
    out, ranks = [], {}
    state = {}
    for path, n, line in sorted(lines):
        s = state.setdefault(path, {"mode": "", "session": "", "query": None, "end": False})
        s["end"] |= line == "ENDDATA"
        if s["end"] or not line.strip(" ") or line.startswith("#"):
            continue
        f = line.split("\t")
        if line.startswith("SESSION"):
            s.update(session=f[1].strip() if len(f) > 1 else "", mode="")
        elif line.startswith("QUERY\t"):
            s.update(query=(f[1].strip(), f[4]), mode="")
        elif line in ("DOMAINS", "SITES", "MOTIFS") or line.startswith("END"):
            s["mode"] = line
        elif s["mode"] == "DOMAINS":
            key = path, s["session"], s["query"][0]
            ranks[key] = ranks.get(key, 0) + 1
            out.append((path, n, s["query"][1], ranks[key], s["session"]))
    return out


DOMAIN = "1\tQ#1\tSpecific\t225\t3\t9\t1e-5\t40\tcd1\tshort\tN\tsf"


def test_blocks_are_the_same_wherever_reports_are_cut(spark):
    draw, rows = random.Random(3), []
    for path in ("a", "b", "\u00e9", "z"):
        n, k = -3, 0
        rows.append((path, n, "QUERY\tQ#0\tPeptide\t9\tprot 0"))
        for _ in range(150):
            n += draw.choice((1, 1, 7, 10**12))
            line = draw.choice(("QUERY\tQ#{0}\tPeptide\t9\tprot {0}", "DOMAINS", "DOMAINS", *[DOMAIN] * 5, "ENDDOMAINS", "SITES", "MOTIFS", "SESSION", "SESSION\t{0}", "", "#", "  "))
            k += line.startswith("QUERY")
            rows.append((path, n, line.format(k)))
        if path != "a":
            rows += [(path, n + 5, "ENDDATA"), (path, n + 6, "QUERY\tQ#1\tP\t5\tlate"), (path, n + 7, "DOMAINS"), (path, n + 8, DOMAIN)]
    df, want = spark.createDataFrame(rows, "path string, line_no long, line string"), sorted(plain_blocks(rows))
    places = sorted(r[:2] for r in rows)
    for cut in ([], places, places[5::9], places[-2:], [(p, n + 1) for p, n in places[::11]], [("a", -99), ("c", 5), ("zz", 1)]):
        _, a = hits.domain_blocks(df, places=cut)
        assert sorted((r["path"], r["line_no"], r["query_id"], r["rank"], r["extra"]["session"]) for r in a.collect()) == want and len(want) > 20
    lines = ["QUERY\tQ#1\tP\t5\tx", "DOMAINS", DOMAIN, "QUERY\tQ#1\tP\t5\tx", "DOMAINS", "#", DOMAIN]
    for bad, why in ((lines, "repeated query"), (lines[1:3], "domain before a query at p:2"), (["QUERY\tQ#1", *lines[1:3]], "malformed query"), ([*lines[:2], "x\ty"], "malformed domain")):
        df = spark.createDataFrame([("p", k, t) for k, t in enumerate(bad, 1)], "path string, line_no long, line string")
        with pytest.raises(Exception, match=why):
            hits.domain_blocks(df, places=[("p", k) for k in range(1, 9)])[1].collect()


def test_lines_of_one_report_go_to_many_tasks(spark):
    """Before, all lines of a report were one task's."""
    n = 40_000
    line = F.when(F.col("id") % 4 == 0, F.concat(F.lit("QUERY\tQ#"), F.col("id").cast("string"), F.lit("\tP\t9\tx"))).when(F.col("id") % 4 == 1, "DOMAINS").otherwise(DOMAIN)
    _, a = hits.domain_blocks(spark.range(n).select(F.lit("f").alias("path"), F.col("id").alias("line_no"), line.alias("line")))
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", a._jdf.queryExecution().executedPlan().toString())
    assert any("span" in d for d in dealt) and not any(re.fullmatch(r"path#\d+", d) for d in dealt)
    assert a.groupBy("rank").count().orderBy("rank").collect() == [(1, n // 4), (2, n // 4)]


def test_tsv_and_json(spark, tmp_path):
    text = "﻿# c\n\na\tb\t\n1\t\"x\t\n2\ty\n"
    got = tables.tsv(numbered(spark, text), ["b", "a", "zz"], required=["a"]).orderBy("line_no").collect()
    assert [(r["a"], r["b"], r["zz"]) for r in got] == [("1", '"x', None), ("2", "y", None)]
    for bad, why in (("a\tb\n1\n", "ragged"), ("b\n1\n", "missing")):
        with pytest.raises(Exception, match=why):
            tables.tsv(numbered(spark, bad), ["a"], required=["a"]).collect()
    (tmp_path / "x.csv").write_text('a,b\n1,"x,\ny"\n')
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "x.csv"), ["a", "b"]).collect()] == [("1", "x,\ny")]
    report = spark.createDataFrame([("p", json.dumps({"results": {"Complete": 95.5}, "n": 3}))], "path string, text string")
    m = hits.report_metrics(report, "text", {"complete": ["$.C", "$.results.Complete"], "n": ["$.n"], "none": ["$.z"]}, required=["complete"]).collect()
    assert sorted((r["metric_name"], r["metric_numeric"]) for r in m) == [("complete", 95.5), ("n", 3.0)]
    a = spark.createDataFrame([("u1", "s2 x"), ("u1", "s1"), ("u1", "s2")], "unit string, seqid string")
    assert tables.assignments(a).first().asDict() == {"unit": "u1", "seqids": ["s1", "s2"], "repeated": 1}


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><workbookPr/></workbook>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>ab</t></r><r><t>c</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>day</t></is></c><c r="C1" t="inlineStr"><is><t>ok</t></is></c></row><row/><row><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>43831</v></c><c r="C3" t="b"><v>1</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    (tmp_path / "t.xlsx").write_bytes(data.getvalue())
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "t.xlsx"), ["name", "day", "ok"]).collect()] == [("abc", "2020-01-01", "true")]


def test_taxonomy(spark):
    names, nodes = "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tA\t|\t\t|\tscientific name\t|\n2\t|\tb\t|\t\t|\tsynonym\t|\n", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n"
    n, a = taxonomy.nodes_from_dump(numbered(spark, names), numbered(spark, nodes), numbered(spark, "9\t|\t2\t|\n"), numbered(spark, "8\t|\n"))
    assert sorted((r["taxid"], r["parent_taxid"], r["rank"], r["scientific_name"]) for r in n.collect()) == [(1, 1, "no_rank", "root"), (2, 1, "genus", "A")]
    assert sorted((r["alias_taxid"], r["current_taxid"], r["status"]) for r in a.collect()) == [(8, None, "DELETED"), (9, 2, "MERGED")]
    text = spark.createDataFrame([(json.dumps({"taxonomy": {"taxId": 2, "parents": [1], "rank": "Species Group", "currentScientificName": {"name": "A"}, "secondaryTaxIds": [7], "extinct": True}}),)], "value string")
    n, a = taxonomy.nodes_from_json(text)
    assert tuple(n.first()) == (2, 1, "species_group", "A", 1) and tuple(a.first()) == (7, 2, "MERGED")
    assert [r["problem"] for r in taxonomy.snapshot_problems(n).collect()] == ["unknown parent", "no root"]


def test_reports(spark):
    one = {"accession": "GCF_1", "organism": {"organism_name": "x", "tax_id": 5}, "assembly_info": {"release_date": "2020-01", "paired_assembly": {"accession": "GCA_1"}}}
    two = {"accession": "GCA_1", "submitter": "me"}
    texts = spark.createDataFrame([("a", json.dumps({"reports": [one]})), ("b", json.dumps(two)), ("c", json.dumps([{"accession": "Z"}])), ("d", '{"accession":"L1"}\n{"accession":"L2"}')], "path string, text string")
    flat = reports.flat_records(reports.report_objects(texts)).withColumn("i", F.xxhash64("path", "n")).withColumn("o", F.ascii("path") * 10 + F.col("n"))
    assert sorted(r["accession"] for r in flat.collect()) == ["GCA_1", "GCF_1", "L1", "L2", "Z"]
    got = reports.merge_aliases(flat, "i", ["accession", "paired_accession"], "o", ["accession", "submitter", "organism_name", "release_date"]).collect()
    assert sorted((r["accession"], r["submitter"], r["organism_name"], r["release_date"], r["merged"]) for r in got if r["merged"] > 1) == [("GCA_1", "me", "x", "2020-01", 2)]
    m = reports.sample_attributes(spark.createDataFrame([('[{"name":"Geo Loc","value":"X"},{"name":"geo-loc","value":"Y"}]',)], "j string"), "j").first()["attributes"]
    assert m == {"geo_loc": "X"}


def test_events_and_streams(spark, tmp_path):
    e = ev.events(numbered(spark, '{"event_id":"a","type":"metric","metric":{"x":1}}\n{"event_id":"b","type":"artifact"}\n'))
    assert sorted((r["event_id"], r["type"]) for r in e.collect()) == [("a", "metric"), ("b", "artifact")]
    with pytest.raises(Exception, match="not an event"):
        ev.events(numbered(spark, "{}")).collect()
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "v", 1.0), (1, "2024-01-01 00:01:00", "v", 1.0), (2, "2024-01-02 00:00:00", "v", 2.0)], "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assert st.run_once(st.once(stream), "once_t", f"{tmp_path}/c1").count() == 2
    assert sorted((r["n"], r["total"]) for r in st.run_once(st.windowed(stream), "win_t", f"{tmp_path}/c2", "complete").collect()) == [(1, 2.0), (2, 2.0)]


def test_sinks_and_sql(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", None, 'a"b\tc'), ("x", 2, "-y")], "a string, b int, c string")
    assert [r["value"] for r in out.tsv_lines(df, df.columns).collect()] == ["'=1+1\t\t\"a\"\"b\tc\"", "x\t2\t'-y"]
    assert out.write_bundle({"t": df}, str(tmp_path / "b"))["t"][0] == 2
    assert out.table_digest(df).first()["checksum"] == out.table_digest(df.orderBy("c")).first()["checksum"]
    assert out.six_places(spark.range(1).select(F.lit(1 / 3).alias("v")), ["v"]).first()["v"] == "0.333333"
    catalog.register(spark, {"t_x": df})
    assert catalog.query(spark, "SELECT count(*) AS n FROM t_x WHERE b = 2").first()["n"] == 1
    for bad in ("DROP VIEW t_x", "CREATE TABLE q AS SELECT 1", "INSERT INTO t_x SELECT 1, 2, 3", "SET a=b"):
        with pytest.raises(catalog.NotAQuery):
            catalog.query(spark, bad)


def test_metadata(spark):
    c = md.Contract({"id": md.Field("id", True, r"ORG_\d{3}"), "day": md.Field("date"), "at": md.Field("datetime"), "n": md.Field("integer", low=1)}, "id")
    rows = [(" org_001 ", "2024-02-30", "2024-01-02 03:04", "1.0"), ("ORG_002", "2024-02-29", "2024-01-02T03:04:05.678+02:00", "1_0"), ("none", "n/a", None, "0")]
    got = md.validate(spark.createDataFrame(rows, "id string, day string, at string, n string"), c).orderBy(F.col("id").asc_nulls_last()).collect()
    assert [tuple(r) for r in got] == [("ORG_001", None, "2024-01-02T03:04:00", None, ["day: invalid", "n: invalid"]), ("ORG_002", "2024-02-29", "2024-01-02T03:04:05+02:00", 10, []), (None, None, None, 0, ["id: missing", "n: invalid"])]
    with pytest.raises(ValueError, match="unknown columns"):
        md.validate(spark.range(1).select(F.lit("x").alias("other")), c)


def test_lines_over_splits(spark, tmp_path):
    """Files of several splits, with every kind of line end, against Python's own splitting."""
    import gzip
    import random
    import re

    rng = random.Random(3)
    texts = {}
    for k in range(3):
        text = "".join("x" * rng.choice([0, 1, 5, 200]) + str(n) + rng.choice(["\n", "\r\n", "\r", "\n\n"]) for n in range(900)) + ("" if k else "last")
        (tmp_path / f"f{k}.txt").write_bytes(text.encode())
        texts[f"f{k}.txt"] = text
    with gzip.open(tmp_path / "g.txt.gz", "wb") as f:
        f.write(texts["f0.txt"].encode())
    texts["g.txt.gz"] = texts["f0.txt"]
    (tmp_path / "empty.txt").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        got = [(r["path"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in lines.numbered_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(name, n, line) for name, text in texts.items() for n, line in enumerate(re.split("\r\n|\r|\n", re.sub("(\r\n|\r|\n)$", "", text)), 1)]
    assert sorted(got) == sorted(want)


def test_records_over_parts_and_bad_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sequences, "PART", 3)
    text = "".join(f">r{k} d\n" + "AC\n" * (k % 5) for k in range(40))
    numbered = lines.from_rows(spark.createDataFrame([("a", text), ("b", ">x\nGG")], "path string, text string"))
    got = [(r["path"], r["record_no"], r["seqid"], r["sequence"]) for r in sequences.fasta_records(numbered).orderBy("path", "record_no").collect()]
    assert got == [*[("a", k, f"r{k}", "AC" * (k % 5)) for k in range(40)], ("b", 0, "x", "GG")]
    (tmp_path / "bad.fa").write_bytes(b">caf\xe9\nAC\n")
    (tmp_path / "bad.fq").write_bytes(b"@caf\xe9\nA\n+\nI\n")
    with pytest.raises(Exception, match="not UTF-8"):
        sequences.fasta_records(lines.numbered_lines(spark, str(tmp_path / "bad.fa"))).collect()
    with pytest.raises(Exception, match="not UTF-8"):
        sequences.fastq_records(lines.numbered_lines(spark, str(tmp_path / "bad.fq"))).collect()


def test_quality_offsets(spark):
    reads = spark.createDataFrame([(0, "AC", "hh"), (1, "AC", "hi")], "record_no long, sequence string, quality string")
    name = lambda **kind: co.read_stats(reads, **kind).first()["quality_encoding"]
    assert name() == name(offset="33") == "sanger_phred33" and name(offset="auto") == "ambiguous_assumed_phred33" and name(offset=64) == "illumina_phred64"
    with pytest.raises(ValueError, match="offset"):
        name(offset="nonsense")
    with pytest.raises(Exception, match="below the offset"):
        co.read_stats(spark.createDataFrame([(0, "A", "5")], reads.schema), offset=64).collect()
    numbered = reads.withColumnRenamed("record_no", "n")
    assert co.read_stats(numbered, order="n", sample=1).first()["duplicate_sampled_read_count"] == 1
    empty = spark.createDataFrame([(0, "", "")], reads.schema)
    assert co.read_stats(empty).select("read_length_n50", "read_length_l50").first()[:] == (0, 1)


def test_bam_and_sam(spark, tmp_path):
    from tessera.sources import alignments as aln

    rows = [{"qname": f"q{k}", "flag": k, "rname": "c1" if k % 2 else None, "pos": k - 1, "mapq": 7, "cigar": "3M" if k % 3 else "*", "mate": "c2", "tlen": -k, "seq": "ACG"[: k % 4] or "*", "nm": k or None} for k in range(30)]
    data = aln.encode({"c1": 100, "c2": 50}, rows)
    (tmp_path / "a.bam").write_bytes(data)
    got = [{k: v for k, v in r.asDict().items() if k not in ("path", "record_no")} for r in aln.bam(spark, str(tmp_path / "a.bam")).orderBy("record_no").collect()]
    assert got == rows
    for bad in (data[:-60], b"no", aln.encode({}, [])[:20]):
        with pytest.raises(ValueError, match="there|here"):
            list(aln.decode(bad, "there"))
    line = lambda r: "\t".join([r["qname"], str(r["flag"]), r["rname"] or "*", str(r["pos"] + 1), "7", r["cigar"], "c2", "0", str(r["tlen"]), r["seq"], "*"] + ([f"NM:i:{r['nm']}"] if r["nm"] else []))
    text = "@HD\tx\n" + "\n".join(map(line, rows))
    numbered = lines.from_rows(spark.createDataFrame([("a", text)], "path string, text string"))
    assert [{k: v for k, v in r.asDict().items() if k not in ("path", "record_no")} for r in aln.sam(numbered).orderBy("record_no").collect()] == rows
    with pytest.raises(Exception, match="no alignment at a:1"):
        aln.sam(lines.from_rows(spark.createDataFrame([("a", "q\t1")], "path string, text string"))).collect()


def test_templates_and_workbooks(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(out.table_template([("id", "text", True), ("n & m", "number", False)], [("a<b", 1), (None, "x")]))
    assert [tuple(r) for r in tables.xlsx(spark, str(tmp_path / "t.xlsx")).collect()] == [("a<b", "1"), ("", "x")]


def test_stream_to_files(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        rows = st.run_to(stream, str(tmp_path / "rows"), str(tmp_path / "state"))
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a"), (2, "b")]
