"""Exact top-k against whole numbers of any size."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import topk

BASE = "/root/testdata/sf0.001"


def brute(rows, queries, k):
    out = []
    for q_id, q in queries:
        found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), i) for i, v in rows if i != q_id)[:k]
        out += [(q_id, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("bits", [4, 12, 20, 24, 28, 31, 40, 61])
def test_every_size_of_component(bits):
    rnd = np.random.default_rng(bits)
    x = rnd.integers(-(1 << bits), 1 << bits, (700, 6))
    ids = rnd.permutation(700)
    own, best = ids[::70].copy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 10
    q, read = x[::70], []
    for at in (0, 300, 350):
        topk.SortedLists(ids[at : {0: 300, 300: 350, 350: 700}[at]], x[at : {0: 300, 300: 350, 350: 700}[at]]).top(own, q, 5, best, read)
    want = brute(list(zip(ids.tolist(), x.tolist())), list(zip(own.tolist(), q.tolist())), 5)
    got = sorted((int(o), n + 1, int(i), int(s)) for o, (found, scores) in zip(own, best) for n, (i, s) in enumerate(zip(found, scores)))
    assert got == want and len(read) == 30


def test_lists_are_not_read_further_than_needed():
    """Few vectors stand out: reading stops before the lists' middle, and the result is that of a full read."""
    rnd = np.random.default_rng(3)
    x = rnd.integers(-20, 20, (5_000, 8))
    x[::100] += 400
    best, read = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], []
    topk.SortedLists(np.arange(5_000), x).top(np.array([-1]), np.full((1, 8), 3), 5, best, read)
    assert read == [0.5]
    assert list(zip((-best[0][1]).tolist(), best[0][0].tolist())) == sorted(zip((-3 * x.sum(1)).tolist(), range(5_000)))[:5]


def test_bounds_hold_at_every_depth():
    rnd = np.random.default_rng(8)
    x, q = rnd.integers(-50, 50, (999, 5)), rnd.integers(-9, 9, 5)
    block = topk.SortedLists(np.arange(999), x)
    for depth in topk.DEPTHS[:-1]:
        seen, unseen, bottom, top = block.read(depth, np.int64)
        upper, lower = seen @ q + unseen @ np.maximum(q * bottom, q * top), seen @ q + unseen @ np.minimum(q * bottom, q * top)
        assert (lower <= x @ q).all() and (x @ q <= upper).all() and 0 < unseen.mean() < 1


def test_odd_vectors(spark):
    """Null, non-finite, empty, short and huge ones, ties, repeated ids, no id, clashing columns."""
    n = float("nan")
    rows = [(0, [1.0, 2.0]), (50, [2.0, -1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [n, 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [3.0])]
    rows += [(9, [1e8, -1e8]), (10, [1e30, 1.0]), (1, [0.5, 0.5]), (None, [9.0, 9.0]), (100, [1e30, 1e30]), (150, None)]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, score double, rank int")
    whole = lambda v: [max(-(1 << 62), min(1 << 62, int(np.floor(256 * x)))) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 50 = 0"), 4).collect()))
    assert got == brute(good, [(i, v) for i, v in good if i % 50 == 0], 4)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    few = topk.search(df.where("vec_id < 2"), df.where("vec_id = 0")).collect()
    assert [(r.vec_id, r["rank"]) for r in few] == [(1, 1), (1, 2)]


def test_registered_query_and_its_sql(spark):
    e = spark.read.parquet(f"{BASE}/embeddings.parquet").collect()
    whole = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in e]
    got = sorted(map(tuple, topk.op7_topk(spark, BASE).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(whole, [w for w in whole if w[0] % 50 == 0], 5)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{BASE}/embeddings.parquet'")
    assert got == sorted(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({topk.SQL})").fetchall())


def test_many_blocks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    df = spark.range(2_000).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (k + 1.3)) for k in range(12)]).alias("embedding"))
    e = [(r.vec_id, [int(np.floor(256 * x)) for x in r.embedding]) for r in df.collect()]
    monkeypatch.setattr(topk, "ENTRIES", 300 * 12)
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 50 = 0")).collect()))
    assert got == brute(e, [x for x in e if x[0] % 50 == 0], 5)
