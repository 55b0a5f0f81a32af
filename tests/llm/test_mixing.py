"""Source mixing against an iterative reshare and a sequential sample."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix, source_targets


def reshared(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by the rule itself: stop at the cap, reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {(None if k == 3 else f"s{k}"): rng.choice([0, 5, 100, 1000, 20000]) for k in range(rng.randint(1, 9))}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = reshared(sizes)
    for r in got.collect():
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(900, None, "a"), (None, "x y", "b"), (7, "dup", "b"), (7, "dup", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = mix(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want, taken = reshared(size), {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in size)
    # complete epochs first, then the smallest keys
    for s in size:
        mine = sorted((r for r in got if r["source"] == s and r["size"]), key=lambda r: (r["key"], r["doc_id"] is not None, r["doc_id"] or 0))
        times = [r["taken"] // r["size"] for r in mine]
        assert times == sorted(times, reverse=True) and max(times) - min(times) <= 1
    again = mix(docs.repartition(7)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in again)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
