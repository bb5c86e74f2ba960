"""Exact dense search over a batch of queries, tile by tile.

Documents stream through Arrow; a task multiplies tiles of bounded size and keeps the k best of each query over its whole
partition. The product only picks candidates: these are scored again, dimension by dimension, so a score doesn't depend on
where its vectors lie. Queries are a bounded batch: they are collected only after a check of their number and go out with the
closure, else they are searched in turns of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .sparse import DIGITS, top_k

#: Queries that go to the executors at once; their vectors are some MB.
TURN = 4_096
#: Scores of a product that a task holds at once, and candidates that are scored again at once.
TILE, CANDIDATES = 1 << 20, 1 << 16


def similarities(docs: DataFrame, query: list[float], metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(doc_id, score) for one query vector, as Column expressions only."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return docs.select(F.col(id_col).alias("doc_id"), V.similarity(metric, F.col(vector_col), q).alias("score"))


def exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of the rows of a and b, summed in the order of the dimensions as in ``functions.vector``."""
    dots, a2, b2 = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    with np.errstate(all="ignore"):
        for x, y in zip(a.T, b.T):
            if metric == "euclidean":
                dots += (x - y) ** 2
                continue
            dots += x * y
            if metric == "cosine":
                a2 += x * x
                b2 += y * y
        if metric == "dot":
            return dots
        if metric == "euclidean":
            return 1 / (1 + np.sqrt(dots))
        norms = np.sqrt(a2) * np.sqrt(b2)
        return np.where(norms == 0, 0.0, np.fmax(-1, np.fmin(1, dots / norms)))


class Best:
    """The k best rows of each query over a stream of blocks, from a least score on; ties go to the smaller id.

    Candidates are all rows that may be as good as the k-th best by the product, whose error is bounded by the norms.
    """

    def __init__(self, metric: str, queries: np.ndarray, k: int, digits: int | None = DIGITS, least: float = -np.inf):
        self.metric, self.q, self.k, self.digits = metric, queries, k, digits
        self.q2 = (queries * queries).sum(1)
        self.low = np.full(len(queries), least)
        self.row, self.id, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        rows = max(1, min(len(self.q), TILE // 512))
        step = max(1, TILE // rows)
        with np.errstate(all="ignore"):
            for d in range(0, len(x), step):
                part = x[d : d + step]
                x2 = (part * part).sum(1)
                for at in range(0, len(self.q), rows):
                    self._tile(slice(at, at + rows), ids[d : d + step], part, x2)

    def _tile(self, at: slice, ids: np.ndarray, x: np.ndarray, x2: np.ndarray) -> None:
        high = self.q[at] @ x.T
        # An upper bound of the score, to which the error of the product and the rounding of the score are added.
        if self.metric == "euclidean":
            size = self.q2[at][:, None] + x2[None]
            high *= -2
            high += size
            high -= 1e-12 * size
            np.maximum(high, 0, out=high)
            np.sqrt(high, out=high)
            high += 1
            np.divide(1, high, out=high)
        elif self.metric == "cosine":
            high /= np.sqrt(self.q2[at])[:, None]
            high /= np.sqrt(x2)[None]
            high += 1e-12
        else:
            high += 1e-12 * np.sqrt(self.q2[at])[:, None] * np.sqrt(x2)[None]
        slack = 2e-9 if self.digits is not None else 0.0
        low = self.low[at] - slack - 1e-12 * np.abs(np.where(np.isinf(self.low[at]), 0, self.low[at]))
        keep = ~(high < low[:, None])  # what isn't a number stays a candidate
        if keep.sum() > len(high) * 4 * self.k and high.shape[1] > 4 * self.k:
            # Below the tile's own k-th best by twice the error: not among the best.
            safe = np.where(np.isnan(high), -np.inf, high)
            kth = np.partition(safe, -self.k, axis=1)[:, -self.k]
            if self.metric == "dot":
                bound = kth - 4e-12 * np.sqrt(self.q2[at]) * np.sqrt(x2.max())
            elif self.metric == "cosine":
                bound = kth - 4e-12
            else:
                far = np.maximum(1 / kth - 1, 0)
                bound = 1 / (1 + np.sqrt(far * far + 4e-12 * (self.q2[at] + x2.max())))
            bound = bound - slack - 1e-12 * np.abs(bound)
            keep &= ~(high < np.where(np.isfinite(bound), bound, -np.inf)[:, None])
        row, column = np.nonzero(keep)
        for part in range(0, len(row), CANDIDATES):
            self._merge(at.start + row[part : part + CANDIDATES], ids, x, column[part : part + CANDIDATES])

    def _merge(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, column: np.ndarray) -> None:
        score = exact(self.metric, self.q[row], x[column])
        if self.digits is not None:
            score = np.round(score, self.digits)
        good = ~(score < self.low[row])
        row, id_, score = row[good], ids[column[good]], score[good]
        if self.id is not None:
            row, id_, score = np.concatenate([self.row, row]), np.concatenate([self.id, id_]), np.concatenate([self.score, score])
        order = np.lexsort((np.unique(id_, return_inverse=True)[1] if id_.dtype == object else id_, -score, row))
        row, id_, score = row[order], id_[order], score[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < self.k
        self.row, self.id, self.score = row[kept], id_[kept], score[kept]
        full = np.flatnonzero(np.arange(len(row)) - first == self.k - 1)
        self.low[row[full]] = np.maximum(self.low[row[full]], score[full])


def search(docs: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", turn: int = TURN) -> DataFrame:
    """(query_id, doc_id, score, rank). queries: query_id, embedding. Vectors of another length fail the query."""
    if metric not in ("cosine", "dot", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    total = queries.count()
    turns = -(-total // turn)
    slot = F.pmod(F.xxhash64("query_id"), F.lit(max(turns, 1)))
    found = None
    for t in range(turns):
        rows = queries.where(slot == t).select("query_id", "embedding").collect()
        part = _turn(docs, rows, k, metric, id_col, vector_col)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _turn(docs.limit(0), [], k, metric, id_col, vector_col)
    return top_k(found, k)


def _turn(docs: DataFrame, rows: list, k: int, metric: str, id_col: str, vector_col: str) -> DataFrame:
    ids = np.array([r.query_id for r in rows], np.int64)
    q = np.array([r.embedding for r in rows], float) if rows else np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(metric, q, k)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(flat) != batch.num_rows * q.shape[1]:
                raise ValueError(f"expected {q.shape[1]} dimensions")
            best.add(batch.column(0).to_numpy(zero_copy_only=False), flat.reshape(batch.num_rows, -1))
        if best.id is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.row]), pa.array(best.id), pa.array(best.score)], ["query_id", "doc_id", "score"])

    vectors = docs.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return vectors.mapInArrow(run, "query_id long, doc_id long, score double")
