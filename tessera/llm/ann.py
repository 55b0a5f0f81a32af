"""Approximate nearest neighbours by score-aware anisotropic quantisation.

For inner products, the part of a quantisation error that is parallel to the
vector matters more than the rest. Product-quantiser codebooks of 16 centres for
each slice of the vector (four bits) are fitted to
|r|^2 + (eta - 1) (x.r)^2 for unit vectors x and residuals r, with eta from the score
threshold that matters; assignment and centre updates both use that loss. A query
is scored against all codes of a block by table scans, two four-bit codes in one
look-up, and the best are reranked exactly on the original vectors.

The stated queries meet all rows in blocks: a block of queries, of bounded size, goes
to all tasks, and rows stay where they are. A task reads its rows block by block and
keeps each query's nearest so far, so only those are shuffled, never a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

CENTRES = 16
#: Rows of a block; components of the queries of a block.
ROWS, QUERY_NUMBERS = 2048, 1 << 18


@dataclass(frozen=True)
class Codebook:
    """``centres``: (slices, 16, width) for vectors padded to slices * width; ``eta``: weight of the parallel error."""

    centres: np.ndarray
    eta: float

    @property
    def slices(self) -> int:
        return self.centres.shape[0]

    def pad(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors as (rows, slices, width)."""
        m, _, w = self.centres.shape
        out = np.zeros((len(x), m * w))
        out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
        return out.reshape(len(x), m, w)

    def assign(self, p: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of padded unit vectors: nearest centres, then coordinate descent on the anisotropic loss."""
        n, m, _ = p.shape
        square, along = np.empty((m, n, CENTRES)), np.empty((m, n, CENTRES))
        for s in range(m):
            own = (p[:, s] ** 2).sum(axis=1)[:, None]
            dot = p[:, s] @ self.centres[s].T
            along[s] = own - dot
            square[s] = own - 2 * dot + (self.centres[s] ** 2).sum(axis=1)
        codes = square.argmin(axis=2)
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=0)
        for _ in range(sweeps):
            for s in range(m):
                rest = total - along[s][np.arange(n), codes[s]]
                codes[s] = (square[s] + (self.eta - 1) * (rest[:, None] + along[s]) ** 2).argmin(axis=1)
                total = rest + along[s][np.arange(n), codes[s]]
        return codes.T.astype(np.uint8)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes in a byte."""
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, slices / 2, 256): inner products with both centres of each byte."""
        dot = np.einsum("qsw,scw->qsc", self.pad(q), self.centres)
        return (dot[:, 1::2, :, None] + dot[:, 0::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)


def fit_codebook(x: np.ndarray, *, width: int = 2, threshold: float = 0.2, rounds: int = 8, seed: int = 3) -> Codebook:
    """Fit to the rows of ``x``: alternate assignment and the closed-form update of the centres."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    m = -(-d // width)
    m += m % 2
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    book = Codebook(np.zeros((m, CENTRES, width)), eta)
    p = book.pad(x)
    centres = p[rng.choice(len(p), CENTRES, replace=len(p) < CENTRES)].transpose(1, 0, 2) + rng.normal(0, 1e-6, (m, CENTRES, width))
    for turn in range(rounds):
        book = Codebook(centres.copy(), eta if turn > 1 else 1.0)
        codes = book.assign(p).astype(np.int64)
        got = np.stack([centres[s][codes[:, s]] for s in range(m)], axis=1)
        along = (p * (p - got)).sum(axis=2)
        total = along.sum(axis=1)
        for s in range(m):
            rest = total - along[:, s]
            own = (p[:, s] ** 2).sum(axis=1)
            for c in range(CENTRES):
                mine = np.flatnonzero(codes[:, s] == c)
                if not len(mine):
                    centres[s, c] = p[rng.integers(len(p)), s]
                    continue
                a = p[mine, s]
                left = len(mine) * np.eye(width) + (book.eta - 1) * a.T @ a
                right = a.sum(axis=0) + (book.eta - 1) * (a * (rest[mine] + own[mine])[:, None]).sum(axis=0)
                centres[s, c] = np.linalg.solve(left, right)
            along[:, s] = own - (p[:, s] * centres[s][codes[:, s]]).sum(axis=1)
            total = rest + along[:, s]
    return Codebook(centres, eta)


def scan(tables: np.ndarray, packed: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the ``most`` best approximate scores for each query, and of all that tie with the last of them.

    Near-identical vectors share codes and so scores: all of them are reranked.
    """
    out = []
    columns = np.ascontiguousarray(packed.T)
    for lo in range(0, len(tables), 64):
        part = tables[lo : lo + 64]
        score = np.zeros((len(part), len(packed)), dtype=np.float32)
        for s in range(len(columns)):
            score += part[:, s].take(columns[s], axis=1)
        if most >= len(packed):
            out += [np.arange(len(packed))] * len(part)
            continue
        least = np.partition(score, len(packed) - most, axis=1)[:, len(packed) - most]
        out += [np.flatnonzero(row >= floor) for row, floor in zip(score, least, strict=True)]
    return out


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component between 1/2 and 1: the cosine stays, and no product over- or underflows."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def nearest(vectors: DataFrame, queries: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = 256, fit_rows: int = 4096, width: int = 2) -> DataFrame:
    """The ``k`` nearest rows by cosine of each row for which ``queries`` holds, itself excluded.

    Returns query_id, rank (from 1), vec_id, score (cosine of the original vectors
    in double precision), nearest first, ties to the smaller id. Codebooks are
    fitted to ``fit_rows`` rows chosen by a hash of the id; every row is indexed.
    In each block of rows the ``rerank`` best by table scan, and those that tie with
    the last, are scored exactly, so recall rises with the number of blocks.

    Rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite components take no part. A vector is compared with those of its own
    length, each length having an index of its own. Repeated vectors are rows of
    their own; rows that repeat a query's id never match it, and equal rows with one
    id are one query. Other columns are not read. Fewer candidates than ``k`` are
    all returned; an empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    # A length without queries needs no index.
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.max("q").alias("asked")).where("asked").orderBy("d").collect()
    parts = [_nearest(rows.where(F.size("v") == r["d"]), r["d"], k, rerank, fit_rows, width) for r in sizes]
    if not parts:
        return vectors.sparkSession.createDataFrame([], RESULT)
    out = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


RESULT = "query_id long, rank int, vec_id long, score double"


def _nearest(rows: DataFrame, dims: int, k: int, rerank: int, fit_rows: int, width: int) -> DataFrame:
    """(query_id, query, vec_id, score): the nearest rows that each task has found, for vectors of one length."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(fit_rows).select("v").collect()
    book = fit_codebook(scaled(np.array([r["v"] for r in sample])), width=width)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = scaled(np.array(batch["v"].tolist(), dtype=np.float64))
                codes = np.concatenate([book.pack(book.assign(book.pad(x[lo : lo + 1024]))) for lo in range(0, len(x), 1024)])
                yield pd.DataFrame({"vec_id": batch["vec_id"], "q": batch["q"], "v": [r.tobytes() for r in x], "code": [c.tobytes() for c in codes]})

    index = stored(rows.mapInPandas(encode, "vec_id long, q boolean, v binary, code binary"), "ann-index")
    asked = stored(index.where("q").select("vec_id", "v").distinct().withColumn("query", F.xxhash64("v")), "ann-queries")
    block = max(1, QUERY_NUMBERS // dims)
    blocks = max(1, -(-asked.count() // block))
    found = []
    for b in range(blocks):
        # Bounded: about ``block`` queries.
        mine = asked.where(F.pmod(F.xxhash64("vec_id", "query"), F.lit(blocks)) == b).orderBy("vec_id", "query").collect()
        if mine:
            near = index.select("vec_id", "v", "code").mapInPandas(_searcher(book, _matrix(pd.Series([bytes(r["v"]) for r in mine])), np.array([r["vec_id"] for r in mine]), np.array([r["query"] for r in mine]), k, rerank), "query_id long, query long, vec_id long, score double")
            # The driver forgets a block before it takes the next.
            found.append(near if blocks == 1 else stored(near, "ann-found"))
    return reduce(DataFrame.unionByName, found)


def _searcher(book: Codebook, q: np.ndarray, own: np.ndarray, name: np.ndarray, k: int, rerank: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The k best of each query so far: scores, and ids (no row: -inf).
        best, who = np.full((len(q), k), -np.inf), np.zeros((len(q), k), dtype=np.int64)
        qnorm = np.sqrt((q * q).sum(axis=1))
        for batch in _blocks(batches):
            rows = batch.sort_values("vec_id", kind="stable")
            x, ids = _matrix(rows["v"]), rows["vec_id"].to_numpy()
            packed = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
            norm = np.sqrt((x * x).sum(axis=1))
            for lo in range(0, len(q), 256):
                # One more than needed, for the query's own row.
                for i, some in enumerate(scan(book.tables(q[lo : lo + 256]), packed, rerank + 1), lo):
                    some = some[ids[some] != own[i]]
                    score = np.append(best[i], (x[some] * q[i]).sum(axis=1) / (norm[some] * qnorm[i]))
                    both = np.append(who[i], ids[some])
                    top = np.lexsort((both, -score))[:k]
                    best[i], who[i] = score[top], both[top]
        at, place = np.nonzero(best > -np.inf)
        yield pd.DataFrame({"query_id": own[at], "query": name[at], "vec_id": who[at, place], "score": best[at, place]})

    return search


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together to about ROWS rows, and cut to ROWS at most."""
    held, size = [], 0
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            part = batch.iloc[lo : lo + ROWS]
            if held and size + len(part) > ROWS:
                yield pd.concat(held)
                held, size = [], 0
            held.append(part)
            size += len(part)
    if held:
        yield pd.concat(held)
