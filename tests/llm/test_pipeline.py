"""The pipeline on small tables: each stage against its rule, and the queries that are registered."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    body = lambda k, n=70: " ".join(f"word{(k * 31 + i * 7) % 997}" for i in range(n))
    passage = " ".join(f"secretword{i}" for i in range(25))
    rows = [(k, body(k), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, (body(k, 40).upper()).replace(" ", "!! "), "en", "s0") for k in range(20)]
    rows += [(200, rows[5][1], "en", "s1"), (201, rows[6][1].replace("word2 ", "wordx "), "en", "s1"), (202, body(900) + "\n" + passage, "en", "s2"), (203, "intro words here\n" + body(7), "en", "s2"), (204, None, None, None), (205, "", None, None)]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect() or [], stage(spark, docs, folder).schema)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "mixing" or docs.columns == columns
    assert not any(100 <= i < 120 for i in seen["quality"]) and set(range(60)) <= set(seen["quality"])
    assert 200 not in seen["line_dedup"] and seen["line_dedup"][203]["text"] == "intro words here" and seen["line_dedup"][203]["n_chars"] == 16
    assert 202 not in seen["decontamination"] and set(range(60)) <= set(seen["decontamination"])
    assert all(r["taken"] == r["copies"] * r["size"] > 0 for r in seen["mixing"].values())


def test_input_columns_stay_as_they_are(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit(0.25), "n_lines": F.lit(9).cast("short"), "matches": F.lit(7).cast("long"), "row": F.lit("r"), "n_removed": F.lit(None).cast("string"), "kept": F.lit(False), "predicted": F.lit("p")})
    extra = ("score", "n_lines", "matches", "row", "n_removed", "kept", "predicted")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        rows = out.select(*extra).distinct().collect()
        assert [tuple(r) for r in rows] == [(0.25, 9, 7, "r", None, False, "p")], name
    bare = docs.select("doc_id", "text", "source")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, bare, folder)
        assert out.count() > 0 and (name == "mixing" or out.columns == bare.columns)
        assert stage(spark, bare.limit(0), folder).count() == 0


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and {"doc_id", "taken"} <= set(got.columns)


def test_registered():
    assert len([n for n in QUERIES if n.startswith("op")]) == 10 and set(ORACLES) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
