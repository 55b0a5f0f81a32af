"""Line runs against a search over all pairs of positions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.linedup import dedup_lines


def expected(rows, least):
    """A line goes if a run around it, of enough words, has an equal one that starts earlier; blank lines go between two that go."""
    lines = []
    for doc, text in sorted(rows):
        for n, t in enumerate(text.split("\n")):
            if t.split():
                lines.append((doc, n, t))
    gone = set()
    for p in range(len(lines)):
        for q in range(p):
            k = 0
            while p + k < len(lines) and lines[q + k][2] == lines[p + k][2] and lines[p + k][0] == lines[p][0] and lines[q + k][0] == lines[q][0]:
                k += 1
            if sum(len(lines[p + i][2].split()) for i in range(k)) >= least:
                gone |= {lines[p + i][:2] for i in range(k)}
    full = [x[:2] for x in lines]
    for (doc, a), (other, b) in zip(full, full[1:]):
        if doc == other and (doc, a) in gone and (doc, b) in gone:
            gone |= {(doc, n) for n in range(a, b)}
    return {doc: "\n".join(t for n, t in enumerate(text.split("\n")) if (doc, n) not in gone) for doc, text in rows}


@pytest.mark.parametrize("seed", range(4))
def test_runs(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 2, 3, 9]))) for _ in range(14)]
    rows = [(k * 7 % 101, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("uid", F.lit("clash"))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, min_words=8).collect()}
    assert got == expected(rows, 8)


def test_odd_rows(spark):
    line = " ".join(["word"] * 60)
    rows = [(1, line), (1, line), (2, f"x\n{line}\n\ny"), (3, None), (4, ""), (None, line), (5, f"{line}\n{line}")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted((r["doc_id"] or 99, r["text"], r["n_lines"], r["n_removed"]) for r in got if r["text"] is not None)
    assert texts == [(1, line, 1, 0), (1, line, 1, 0), (2, "x\n\ny", 4, 1), (4, "", 1, 0), (5, "", 2, 2), (99, "", 1, 1)]
    assert [(r["n_lines"], r["n_removed"]) for r in got if r["text"] is None] == [(0, 0)]


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
