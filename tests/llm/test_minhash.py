"""Near duplicates against all pairs in Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.components import _components, connected_components
from tessera.llm.minhash import near_duplicates

WORDS = [f"w{k}" for k in range(400)]


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def expected(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    rows, k = [], 0
    passage = [rng.choice(WORDS) for _ in range(60)]
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([3, 8, 30, 90, 200]))]
        for _ in range(rng.choice([1, 2, 25])):
            text = list(base)
            for _ in range(int(len(text) * rng.choice([0, 0, 0.01, 0.03, 0.06]))):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            if rng.random() < 0.2:
                text = text[: int(len(text) * rng.choice([0.7, 0.9, 0.95]))]
            if rng.random() < 0.2:
                text += passage
            rows.append((k * 3 % 1009, " ".join(text)))
            k += 1
    return rows + [(2000, ""), (2001, None), (2002, " \t\n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "Ää b c d"), (2007, "ää b c d")]


@pytest.mark.parametrize(("seed", "width", "num", "den"), [(0, 3, 85, 100), (1, 5, 8, 10), (2, 3, 85, 100), (3, 1, 8, 10)])
def test_components(spark, seed, width, num, den):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("sketch", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, width=width, num=num, den=den).collect()}
    assert got == expected(rows, width, num, den)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "a b c d e f"), (3, "x y z"), (3, "q r s t")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=85, den=100).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("n", [1000, 10_000])
def test_rounds_on_random_chains(spark, n):
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (n + 5, n + 9)], "a long, b long")
    labels, rounds = _components(links)
    assert {(r["component"], r["count"]) for r in labels.groupBy("component").count().collect()} == {(0, n), (n + 5, 2)}
    assert rounds <= 2 * math.log2(n)


def test_hubs_and_random_links(spark):
    rng = random.Random(4)
    links = [(500, k) for k in range(600)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(160)] + [(1000, 1001)] * 3
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        if a != b:
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: find(a) for a, b in links if a != b} | {b: find(b) for a, b in links if a != b}


def test_one_id_with_several_texts_links_by_each(spark):
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (5, "v w x y z"), (2, "a b c d e f"), (7, "p q r s t u"), (9, "v w x y z"), (1, "nothing of that sort here"), (5, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=85, den=100).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (2, 2, True), *[(5, 2, False)] * 4, (7, 2, False), (9, 2, False)]


def test_long_text(spark):
    text = " ".join(f"w{k % 7919}" for k in range(60_000))
    rows = [(1, text), (2, text + " end"), (3, text[: len(text) // 2])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, expected(rows, 5, 8, 10)[i][1]) for i in (1, 2, 3)]
