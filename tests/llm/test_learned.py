"""Classifiers by held-out accuracy, nearest neighbours by recall, kernels by their definition, and odd rows."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, subword, toxicity
from tessera.llm.ann import fit_codebook, nearest
from tessera.llm.sampling import labelled_sample
from tessera.llm.subword import features, pieces


def corpus(rng, toxic_share=0.2):
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    rows = []
    for k in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
        bad, poor = rng.random() < toxic_share, rng.random() < 0.3
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["blockhead", "nitwit", "numskull", "dunderhead"])
        if poor:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        rows.append((k, ". ".join(words), int(not poor), int(bad and not poor)))
    return rows


def test_classifiers_on_held_out_rows(spark):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 1, 1), (5000, None, None), (3, rows[3][2], rows[3][3])], "doc_id long, quality int, toxic int")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels, rows=300)).join(labels.dropDuplicates(["doc_id"]), "doc_id").where("held_out").collect()
    assert len(scored) > 100 and np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.95
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, rows=300)).join(labels.dropDuplicates(["doc_id"]), "doc_id").where("held_out").collect()
    assert len(scored) > 100 and np.mean([r["predicted"] == r["toxic"] for r in scored]) > 0.95


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "a " * 70_000), (3, "a " * 70_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for scored in (quality.score_quality(docs, quality.fit_quality(docs, none)), toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none))):
        got = scored.collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert scored.limit(0).count() == 0


def test_gapped_insults():
    rows = corpus(random.Random(4), 0.4)
    model = toxicity.train([r[1] for r in rows if r[2]], [r[3] for r in rows if r[2]])
    bad = ["nitwit", "n.i.t.w.i.t", "nitxwit", "numskulll", "blockhe4d", "dunder-head"]
    assert (model.decide(bad) > 0).all()
    assert (model.text_features(["you n i t w i t there"])[0][1]) > 0


def test_string_kernel_by_definition():
    words, decay = ["gata", "cat", "abcabc"], 0.6
    rows, _ = toxicity.encode(words)
    got = toxicity.self_kernel(rows, decay)
    for row, value in zip(rows, got, strict=True):
        phi = {}
        for i, j, k in itertools.combinations(range(len(row)), 3):
            if row[i] and row[j] and row[k]:
                u = (row[i], row[j], row[k])
                phi[u] = phi.get(u, 0) + decay ** (k - i + 1)
        assert np.isclose(value, sum(v * v for v in phi.values()), rtol=1e-4)


def spectrum(word, decay):
    """Subsequences of three of a word's only window, as a unit vector."""
    row = toxicity.encode([word])[0][0]
    phi = {}
    for i, j, k in itertools.combinations(range(len(row)), 3):
        if row[i] and row[j] and row[k]:
            phi[row[i], row[j], row[k]] = phi.get((row[i], row[j], row[k]), 0) + decay ** (k - i + 1)
    norm = sum(v * v for v in phi.values()) ** 0.5
    return {u: v / norm for u, v in phi.items()}


def test_decisions_are_those_of_the_nystrom_machine():
    rows = corpus(random.Random(4), 0.4)
    model = toxicity.train([r[1] for r in rows], [r[3] for r in rows], landmarks=40, counterexamples=300)
    marks = [spectrum(m, model.decay) for m in model.marks]
    words = ["nitwit", "nit-wit", "blockheads", "gata", "numskull", "zzz", "t0p"]
    for word, got in zip(words, model.decide(words), strict=True):
        phi = spectrum(word, model.decay)
        kernel = [sum(v * m.get(u, 0) for u, v in phi.items()) for m in marks]
        assert np.isclose(got, np.dot(kernel, model.alpha) + model.bias, atol=2e-3), word


def test_scores_by_sentences_against_plain_python():
    rows = corpus(random.Random(5), 0.4)
    model = toxicity.train([r[1] for r in rows], [r[3] for r in rows], landmarks=40, counterexamples=300)
    texts = [r[1] for r in rows[:60]] + ["", None, 'He said "you nitwit." Then (fine!) more. x', "no stop at all nitwit here", "nitwit. " * 3, "a. b? c! d"]
    got = model.text_features(texts)
    for text, row in zip(texts, got, strict=True):
        words = (text or "").split()
        value = [float(v) for v in model.decide(words)] if words else []
        marked, worst = 0, None
        for word, v in zip(words, value, strict=True):
            worst = v if worst is None else max(worst, v)
            if (word[:-1] if len(word) > 1 and word[-1] in "\"')]}" else word)[-1] in ".!?":
                marked, worst = marked + (worst > 0), None
        marked += worst is not None and worst > 0
        share = 100 * sum(v > 0 for v in value) / max(1, len(value))
        assert np.allclose(row, [1, math.log1p(marked), min(10, share), min(2, max([-2, *value]))], atol=1e-3), text


def test_long_texts_are_read_whole(monkeypatch):
    rows = corpus(random.Random(6), 0.3)
    bad = toxicity.train([r[1] for r in rows], [r[3] for r in rows], landmarks=40, counterexamples=300)
    good = quality.train([r[1] for r in rows], [r[2] for r in rows])
    filler = "gata bela cora. " * 40_000
    assert bad.score([filler + "nitwit numskull blockhead. "])[0] > bad.score([filler])[0]
    texts = [rows[k][1] for k in range(40)] + [" ".join(r[1] for r in rows[:60]), "", None, "a a a a"]
    one, two = good.score(texts), bad.text_features(texts)
    monkeypatch.setattr(subword, "PIECE", 200)
    assert np.allclose(good.score(texts), one, atol=1e-9)
    assert np.allclose(bad.text_features(texts)[:, 2:], two[:, 2:], atol=1e-9)


def test_quality_scores_by_definition():
    """The folded table against the mean of the features' numbers, feature by feature."""
    rows = corpus(random.Random(7))
    model = quality.train([r[1] for r in rows[:300]], [r[2] for r in rows[:300]], epochs=1)
    for text in [rows[0][1], "one", "", "aa aa ab"]:
        total, count = 0.0, 0
        for _, _, data, starts, _ in pieces([text]):
            for at, bucket in features(data, starts, model.sizes, model.buckets):
                for b in bucket.tolist():
                    total, count = total + model.table[b], count + 1
        assert np.isclose(model.score([text])[0], 1 / (1 + math.exp(-(model.bias + total / (count + quality.PRIOR)))))


def test_training_without_usable_rows_says_so(spark):
    docs = spark.createDataFrame([(k, "word " * 50) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="no labelled text"):
        quality.fit_quality(docs, labels, longest=10)


def test_quality_is_fitted_outside_the_driver(spark):
    """The driver's Python holds the model, not the sample or the training; the model is that of the same rows trained here."""
    rows = [(k, f"{t} " * (19_000 // len(t)), good) for k, t, good, _ in corpus(random.Random(8))[:160]]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    tracemalloc.start()
    try:
        model = quality.fit_quality(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.table.nbytes < 1_000_000 and peak < 6_000_000
    texts, y, share = labelled_sample(docs, labels, "quality", modulus=4, remainder=2, rows=1200, longest=20_000)
    same = quality.train(texts, y, odds=share / (1 - share) * (len(y) - sum(y)) / sum(y))
    assert np.array_equal(model.table, same.table) and model.bias == same.bias and (model.sizes, model.buckets) == (same.sizes, same.buckets)


def test_features_by_definition():
    texts = ["ab abc  abc\tx", "", None, "x x é"]
    for first, last, data, starts, old in pieces(texts):
        assert old == 0
        got = features(data, starts, (3,), 1 << 10)
        raw = data.decode()
        assert (first, last) == (0, 4) and len(got[0][0]) == len(raw.split())
        grams = [i for i in range(len(data) - 2) if data[i + 1] != 32]
        assert got[1][0].tolist() == grams
        assert len(got[2][0]) == 2
        same = got[0][1]
        assert same[1] == same[2] and same[0] != same[1]


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 24)).astype(np.float32)
    x[600] = x[50]
    x[601] = 3 * x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] + [1.0] * 23), (5150, [1.0, 2.0]), (None, [1.0] * 24), (5200, [None] + [1.0] * 23), (5250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = nearest(df, F.col("vec_id") % 50 == 0, rerank=100).collect()
    n = x.astype(np.float64)
    norm = np.sqrt((n * n).sum(axis=1))
    hits = 0
    for q in range(0, 1200, 50):
        score = n @ n[q] / (norm * norm[q])
        score[q] = -9
        want = sorted(range(1200), key=lambda i: (-round(score[i], 12), i))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(np.isclose(r["score"], score[r["vec_id"]], atol=1e-12) for r in mine)
        hits += len(set(want) & {r["vec_id"] for r in mine})
    assert hits >= 0.95 * 120 and {r["query_id"] for r in got} == set(range(0, 1200, 50))
    assert {r["vec_id"] for r in got if r["query_id"] == 50 and r["rank"] <= 2} == {600, 601}
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def cosines(rows, queries, k):
    """Brute force in exact fractions of the given doubles, by length."""
    from fractions import Fraction
    from math import isfinite

    good = [(i, [Fraction(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if queries(i):
            near = []
            for j, v in good:
                if j != i and len(v) == len(q):
                    dot, size = sum(a * b for a, b in zip(q, v, strict=True)), sum(a * a for a in q) * sum(b * b for b in v)
                    near.append((-float(dot * abs(dot) / size), j))
            out[i] = [(j, math.copysign(abs(s) ** 0.5, -s)) for s, j in sorted(near)[:k]]
    return out


def test_neighbours_of_extremes_and_all_lengths(spark):
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1, 1) * 10.0 ** rng.choice([-200, 0, 200]) for _ in range(3 + k % 2)]) for k in range(60)]
    rows += [(100, [1e-200, 1e-200]), (101, [1e200, 1e200]), (102, [5e-324, 0.0]), (103, [1.0, 1e308]), (104, [1.0]), (105, [-3.0]), (150, [1e-320, 1e-320]), (200, [2.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = cosines(rows, lambda i: i % 10 == 0 or i > 99, 4)
    got = {}
    for r in nearest(df, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") > 99), k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {i for i, near in want.items() if near}
    for i, near in got.items():
        assert np.allclose([s for _, s in near], [s for _, s in want[i]], atol=1e-12), i


def test_repeated_rows_and_blocks_of_queries(spark, monkeypatch):
    from tessera.llm import ann

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(90)]
    df = spark.createDataFrame([*rows, *rows[:20], (3, rows[50][1])], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, nearest(df, F.col("vec_id") % 2 == 0).collect()))
    assert len(whole) == 45 * 5 and [r[2] for r in whole if r[0] == 50][0] == 3
    assert sorted(r[2] for r in whole if r[0] == 0).count(0) == 0
    monkeypatch.setattr(ann, "QUERY_NUMBERS", 80)
    assert sorted(map(tuple, nearest(df, F.col("vec_id") % 2 == 0).collect())) == whole


def test_no_vector_is_shuffled(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(1, 40)], "vec_id long, embedding array<double>")
    plan = nearest(df, F.col("vec_id") % 2 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and all("v#" not in line for line in plan.splitlines() if "Exchange" in line)


def test_codebook_lowers_the_parallel_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    loss = {}
    for t in (0.0, 0.5):
        book = fit_codebook(x, threshold=t)
        p = book.pad(x)
        got = np.stack([book.centres[s][c] for s, c in enumerate(book.assign(p).T)], axis=1)
        loss[t] = ((p * (p - got)).sum(axis=(1, 2)) ** 2).mean()
    assert loss[0.5] < 0.6 * loss[0.0]
