"""Operator 7: exact top-k inner products by no-random-access aggregation of sorted lists.

Vectors are quantised to integers. A task holds its vectors in blocks of about ``ENTRIES`` components; each component of a block is
one list, sorted once and read sequentially from both of its ends (the falling and the rising list). After a read to a
depth, what a list has not shown lies between its two frontiers. So every vector has a lower and an upper bound
of its score: the entries read, plus for each unread component the lesser or the greater of the frontiers' products.
The k-th best lower bound is the threshold; a vector whose upper bound is below it is an outsider that can't qualify.
Reading goes on, depth by depth, until ``FEW`` or fewer candidates are left to a query or the lists are read; then the
candidates' final scores are resolved. No vector is looked up while lists are read.

The threshold only prunes vectors whose upper bound is below it, so ties survive and every result is exact. A query's
threshold is carried from block to block of a task, which gives its k best once. Depths are the same for all queries, so the
bounds of many queries are matrix products. Queries are a written table, which every task reads in batches; neither
side is broadcast or collected. All sums are exact: in float64 while they stay below 2**53, else in int64, else in whole
numbers of any size (float32 below 2**24).

Defined results: null vectors and those with a null or non-finite component take no part (no query, no candidate), nor do
rows without an id; a shorter vector counts as filled up with zeros; components of 2**62 or more after scaling count as
2**62, and scores beyond 64 bits as the last 64-bit number, in their order too; ties of a score go to the smaller id; rows that repeat an
id are candidates each, but no candidate for a query of the same id, and repeated query rows are one query; fewer
candidates than k give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, slices

K, EVERY, SCALE = 5, 50, 256
#: Components of a block, blocks that a task holds before it answers the queries, queries of a batch.
ENTRIES, HELD, QUERIES = 1 << 20, 4, 128
#: How deep each list is read from either end, as a share of a block; at 1/2 all of it is read.
DEPTHS = (1 / 4, 3 / 8, 7 / 16, 1 / 2)
#: Candidates whose final scores are resolved instead of reading on.
FEW = 256
LARGEST, LAST = 1 << 62, (1 << 63) - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    near = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * scale))
    return F.transform(vector, lambda x: F.floor(near(x)).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """One row a list, short ones filled up with zeros."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.diff(ends, prepend=0)
    dims = int(sizes.max(initial=0))
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    found = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    found[row, np.arange(len(flat)) - (ends - sizes)[row]] = flat
    return found


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    dims = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in parts])


def largest(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max())) if x.size else 0


def exact_kind(x: np.ndarray, q: np.ndarray) -> type:
    """The fastest type in which all products of the rows and their sums are exact."""
    most = largest(x) * largest(q) * max(1, min(x.shape[1], q.shape[1]))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


class SortedLists:
    """A block's vectors by id, and how far each has been read at each depth."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.n = len(ids)
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")  # column d: the list of component d, rising
        self.kept: dict = {}

    def as_kind(self, kind: type) -> np.ndarray:
        if kind not in self.kept:
            self.kept[kind] = self.vectors.astype(kind)
        return self.kept[kind]

    def read(self, depth: float, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Read to a depth from both ends: (entries seen, 1 where unseen, lower and upper frontiers)."""
        if (depth, kind) not in self.kept:
            t = min(int(np.ceil(self.n * depth)), (self.n + 1) // 2)
            x = self.vectors
            unseen = np.zeros(x.shape, bool)
            middle = self.lists[t : self.n - t]
            np.put_along_axis(unseen, middle, True, axis=0)
            ends = np.take_along_axis(x, self.lists[[t - 1, self.n - t]], axis=0)
            self.kept[depth, kind] = np.where(unseen, 0, x).astype(kind), unseen.astype(kind), ends[0].astype(kind), ends[1].astype(kind)
        return self.kept[depth, kind]

    def top(self, own: np.ndarray, queries: np.ndarray, k: int, best: list[tuple[np.ndarray, np.ndarray]], depths: list[float] | None = None) -> None:
        """Merges each query's k best of this block into best, a list of (ids, scores) by falling (score, -id)."""
        dims = min(self.vectors.shape[1], queries.shape[1])
        kind = exact_kind(self.vectors, queries)
        low = -LAST - 1 if kind is np.int64 else -(1 << 200) if kind is object else -np.inf
        q = queries[:, :dims].astype(kind)
        carried = np.array([s[k - 1] if len(s) >= k else low for _, s in best], kind)
        first, last = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        left = np.arange(len(q))
        for depth in DEPTHS if self.n > FEW else DEPTHS[-1:]:
            x = q[left]
            if depth < DEPTHS[-1]:
                seen, unseen, bottom, top = (a[..., :dims] for a in self.read(depth, kind))
                at = x @ seen.T
                upper = at + np.maximum(x * bottom, x * top) @ unseen.T
                lower = at + np.minimum(x * bottom, x * top) @ unseen.T
            else:
                upper = lower = at = x @ self.as_kind(kind)[:, :dims].T
            for row, query in enumerate(left):  # a query's own rows are no candidates
                if first[query] < last[query]:
                    upper[row, first[query] : last[query]] = lower[row, first[query] : last[query]] = low
            threshold = carried[left]
            if self.n > k:
                threshold = np.maximum(threshold, np.partition(lower, self.n - k, axis=1)[:, self.n - k])
            if kind is object:  # scores beyond 64 bits tie with the last number
                threshold = np.array([low if s <= -LAST - 1 else min(s, LAST) for s in threshold], object)
            candidates = upper >= threshold[:, None]
            done = candidates.sum(1) <= FEW if depth < DEPTHS[-1] else np.ones(len(left), bool)
            for row in np.flatnonzero(done):
                query = left[row]
                found = np.flatnonzero(candidates[row])
                found = found[(found < first[query]) | (found >= last[query])]
                scores = self.as_kind(kind)[found, :dims] @ q[query]
                ids = np.concatenate([best[query][0], self.ids[found]])
                scores = np.concatenate([best[query][1], np.array([max(-LAST - 1, min(LAST, s)) for s in scores], object) if kind is object else scores.astype(np.int64)])
                order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
                best[query] = ids[order], scores[order]
            if depths is not None:
                depths += [2 * depth] * int(done.sum())
            left = left[~done]
            if not len(left):
                break


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of queries its k best rows of vectors, its own id excepted."""
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", quantised(F.col("v"), scale).alias("v"))
    path = scratch(spark, "queries")
    pick(queries).groupBy("id").agg(F.min("v").alias("v")).write.parquet(path)

    def query_batches() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        for batch in ds.dataset(root, filesystem=system, format="parquet").to_batches(columns=["id", "v"], batch_size=QUERIES):
            if batch.num_rows:
                yield batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, x = np.concatenate([i for i, _ in held]), stacked([v for _, v in held])
            size = max(256, ENTRIES // max(1, x.shape[1]))
            blocks = [SortedLists(ids[at : at + size], x[at : at + size]) for at in range(0, len(ids), size)]
            for own, q in query_batches():
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
                for block in blocks:
                    block.top(own, q, k, best)
                sizes = [len(i) for i, _ in best]
                scores = [int(s) for _, found in best for s in found]
                columns = [np.repeat(own, sizes), np.concatenate([i for i, _ in best]), scores]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for part in slices([batch], 4_096, 8 * ENTRIES):
                held.append((part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1))))
                n += held[-1][1].size + 1
                if n >= HELD * ENTRIES:
                    yield from out()
                    held.clear()
                    n = 0
        if n:
            yield from out()

    found = pick(vectors).mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs
QUALIFY rank <= {K}
"""
