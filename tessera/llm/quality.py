"""Quality classifier: supervised subword embeddings.

Word and character n-gram vectors, hashed into a table and learned, are averaged
over a document; a linear layer and softmax give the class. Trained by stochastic
gradient descent in numpy. As averaging and the linear layer commute, scoring needs
one learned number per table row, and so one pass of table look-ups over a text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import held_out, sample_rows, warn_of_missing
from tessera.llm.subword import features, pieces


#: A text's mean is taken over its features and so many neutral ones, so that a few words prove little.
PRIOR = 20


@dataclass(frozen=True)
class Model:
    """Difference of the two classes' logits: bias plus the mean of ``table`` over a text's features."""

    table: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    buckets: int

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probability of label 1 for each whole text; a text without words gets that of the bias."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for first, last, data, starts, old in pieces(texts):
            for at, bucket in features(data, starts, self.sizes, self.buckets, old):
                bounds = np.searchsorted(at, np.append(starts, len(data)))
                run = np.concatenate(([0.0], np.cumsum(self.table[bucket])))
                total[first:last] += np.diff(run[bounds])
                count[first:last] += np.diff(bounds)
        out = self.bias + total / (count + PRIOR)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train(texts: Sequence[str], labels: Sequence[int], *, sizes: tuple[int, ...] = (3, 4), buckets: int = 1 << 15, width: int = 10, epochs: int = 6, rate: float = 0.5, odds: float = 1.0, seed: int = 7) -> Model:
    """Learn the embeddings. ``odds``: those of label 1 in the corpus over those in the sample.

    Without labelled texts of both classes: the share of label 1 for all.
    """
    rng = np.random.default_rng(seed)
    rows = (len(sizes) + 1) * buckets + 1
    y = np.asarray(labels, dtype=np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(rows), float(np.log(share / (1 - share))), sizes, buckets)
    held: list[list[np.ndarray]] = [[] for _ in texts]
    for first, last, data, starts, old in pieces(texts, 1 << 16):
        got = features(data, starts, sizes, buckets, old)
        at, bucket = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        doc = np.searchsorted(starts, at, side="right") - 1
        for k in range(last - first):
            held[first + k].append(bucket[doc == k])
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for parts in held:
        ids, counts = np.unique(np.concatenate(parts), return_counts=True)
        bags.append((ids, counts / (counts.sum() + PRIOR)))
    e = rng.uniform(-1 / width, 1 / width, (rows, width))
    w = np.zeros((2, width))
    b = np.zeros(2)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share_of = bags[k]
            hidden = share_of @ e[ids]
            z = w @ hidden + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            lr = rate * (1 - done / steps)
            back = w.T @ p
            w -= lr * np.outer(p, hidden)
            b -= lr * p
            # A mean dilutes each row's gradient by its share; dividing by the largest share keeps steps of the same order for long texts.
            e[ids] -= lr * np.outer(share_of / max(1e-12, share_of.max()), back)
            done += 1
    return Model(e @ (w[1] - w[0]), float(b[1] - b[0] + np.log(odds)), sizes, buckets)


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", modulus: int = 4, remainder: int = 2, rows: int = 1200, longest: int = 20_000) -> Model:
    """Fit on a bounded sample: at most ``rows`` texts of each class, of at most ``longest`` characters, outside the held-out fold.

    One task gets the sample and trains; only the model comes to the driver.
    """
    found, ones, every = sample_rows(docs, labels, label, modulus=modulus, remainder=remainder, rows=rows, longest=longest)
    share = (ones + 1) / (every + 2)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            sample = pd.concat(parts).sort_values("doc_id")
            y = sample["y"].tolist()
            odds = share / (1 - share) * (len(y) - sum(y)) / max(1, sum(y)) if 0 < sum(y) < len(y) else 1.0
            model = train(sample["text"].tolist(), y, odds=odds)
            yield pd.DataFrame({"weights": [model.table.astype("<f8").tobytes()], "bias": [model.bias], "sizes": [list(model.sizes)], "buckets": [model.buckets], "classes": [len(set(y))]})

    got = found.repartition(1).mapInPandas(fit, "weights binary, bias double, sizes array<int>, buckets int, classes int").collect()
    warn_of_missing(label, got[0]["classes"] if got else 0, ones, every, longest)
    if not got:
        return train([], [])
    return Model(np.frombuffer(got[0]["weights"], dtype="<f8"), got[0]["bias"], tuple(got[0]["sizes"]), got[0]["buckets"])


def score_quality(docs: DataFrame, model: Model, *, threshold: float = 0.7, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Score every whole text of ``docs``; keeps its columns and adds score, predicted and held_out.

    Clashing columns of those names are replaced. Null and empty texts get the
    score of no features. Null ids are not held out. Repeated rows are scored
    alike; an empty table gives an empty table.
    """
    docs = docs.drop("score", "predicted", "held_out")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()))

    score = F.pandas_udf(run, "double")
    scored = docs.withColumn("score", score(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
