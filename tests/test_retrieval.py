"""Anchors of the retrieval operators."""

import math

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import predicates as P
from saltmarsh.functions import text as T
from saltmarsh.functions import vector as V
from saltmarsh.operators import cache as C
from saltmarsh.operators import context as Cx
from saltmarsh.operators import dense as D
from saltmarsh.operators import embed as E
from saltmarsh.operators import evaluate as Ev
from saltmarsh.operators import fusion as Fu
from saltmarsh.operators import memory as M
from saltmarsh.operators import rerank as R
from saltmarsh.operators.chunk import ChunkConfig, chunk, chunk_text
from saltmarsh.operators.retrieve import HybridEngine, RagQuery
from saltmarsh.operators.sparse import SparseIndex
from saltmarsh.plans import retrieval_queries as Q


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_tokens(spark):
    r = one(spark, t=T.tokens(F.lit("Marsh-Store: High-Performance, 2x Été!")), n=T.tokens(F.lit(None).cast("string")), f=T.filtered_tokens(F.lit("the cat is on the mat the")), g=T.bigrams(T.tokens(F.lit("a b c"))), e=T.bigrams(T.tokens(F.lit("a"))))
    assert r.t == ["marsh", "store", "high", "performance", "2x", "été"] and r.n == []
    assert r.f == ["cat", "mat"]
    assert [tuple(x) for x in r.g] == [("a", "b"), ("b", "c")] and r.e == []


@pytest.mark.parametrize("text", ["aé漢😀z", "plain", "😀😀", ""])
def test_byte_truncate(spark, text):
    df = spark.range(12).select("id", T.byte_truncate(F.lit(text), F.col("id").cast("int")).alias("t"))
    for r in df.collect():
        want = text.encode()[: r.id].decode("utf-8", "ignore")
        assert r.t == want


def test_lexical_overlap(spark):
    r = one(spark, a=T.lexical_overlap(F.lit("The cat"), F.lit("the CAT sat")), b=T.lexical_overlap(F.lit(""), F.lit("x")))
    assert r.a == pytest.approx(2 / 3) and r.b == 0


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = one(spark, c=V.cosine(v(1, 0, 0), v(2, 0, 0)), z=V.cosine(v(0, 0), v(1, 1)), n=V.l2_norm(v(3, 4)), e=V.similarity("euclidean", v(0, 0), v(3, 4)), u=V.normalize(v(3, 4)), d=V.dot(v(1, 2, 3), v(1, 1)), m=V.calculate(F.lit("mod"), F.lit(-7.0), F.lit(3.0)), x=V.calculate(F.lit("div"), F.lit(1.0), F.lit(0.0)))
    assert (r.c, r.z, r.n, r.d, r.m, r.x) == (1, 0, 5, 3, -1, None)
    assert r.e == pytest.approx(1 / 6) and r.u == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="expected 3 dimensions"):
        one(spark, c=V.check_dim(v(1, 2), 3))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "fast database engine for storage"), (2, "storage engine internals"), (3, "cooking pasta at home"), (4, "")], "doc_id long, text string")


def queries(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, text string")


def test_bm25(spark, docs):
    hits = SparseIndex.build(docs).search(queries(spark, (1, "storage engine"), (2, "nothing"), (3, "")), 10).collect()
    assert {(h.query_id, h.doc_id) for h in hits} == {(1, 1), (1, 2)}
    avgdl, idf = (5 + 3 + 4 + 0) / 4, math.log((4 - 2 + 0.5) / (2 + 0.5) + 1)
    want = 2 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / avgdl))
    assert next(h.score for h in hits if h.doc_id == 2) == pytest.approx(want)
    assert next(h["rank"] for h in hits if h.doc_id == 2) == 1


def test_bm25_updates(spark, docs):
    index = SparseIndex.build(docs)
    new = index.add(spark.createDataFrame([(2, "pasta sauce")], "doc_id long, text string"))
    hit = lambda i, q: {h.doc_id for h in i.search(queries(spark, (1, q)), 5).collect()}
    assert hit(new, "pasta") == {2, 3} and hit(new, "internals") == set()
    assert hit(index.remove(spark.createDataFrame([(3,)], "doc_id long")), "pasta") == set()
    assert hit(index.clear(), "storage") == set()


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_dense_turns_agree_with_columns(spark, small, metric):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").limit(60)
    q = rows.limit(5).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    got = {(r.query_id, r["rank"]): r for r in D.search(rows, q, 3, metric, turn=2).collect()}
    for r in q.collect():
        want = D.similarities(rows, r.embedding, metric).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(3).collect()
        assert [got[r.query_id, k + 1].doc_id for k in range(3)] == [w.doc_id for w in want]
        assert [got[r.query_id, k + 1].score for k in range(3)] == pytest.approx([w.score for w in want])


def lists(spark, dense, sparse):
    make = lambda rows: spark.createDataFrame([(1, d, s) for d, s in rows], "query_id long, doc_id string, score double")
    return make(dense), make(sparse)


def test_fusions(spark):
    dense, sparse = lists(spark, [("d1", 0.95), ("d2", 0.85), ("d3", 0.6)], [("d2", 15.0), ("d1", 10.0), ("d4", 5.0)])
    borda = {r.doc_id: r.score for r in Fu.borda(dense, sparse, 10).collect()}
    assert borda == {"d1": 5, "d2": 5, "d3": 1, "d4": 1}
    rrf = {r.doc_id: r for r in Fu.reciprocal_rank(dense, sparse, 10).collect()}
    assert rrf["d1"].score == rrf["d2"].score == pytest.approx(1 / 61 + 1 / 62) and (rrf["d1"]["rank"], rrf["d2"]["rank"]) == (1, 2)
    assert rrf["d4"].dense_score is None and rrf["d4"].sparse_score == 5
    dense, sparse = lists(spark, [("a", 0.9), ("b", 0.1)], [("b", 8.0), ("a", 2.0)])
    w = {r.doc_id: r.score for r in Fu.weighted(dense, sparse, 0.8, 5).collect()}
    assert w["a"] == pytest.approx(0.8) and w["b"] == pytest.approx(0.2)
    none = dense.limit(0)
    assert {r.doc_id: r.score for r in Fu.fuse(none, sparse, "rrf", 5).collect()} == {"a": 2.0, "b": 8.0}
    z = {r.doc_id: r.normalized for r in Fu.z_score(sparse).collect()}
    assert z == pytest.approx({"a": -1, "b": 1})
    assert [r.normalized for r in Fu.min_max(sparse.where("doc_id = 'a'")).collect()] == [1]


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([(1, "db", 4.5), (2, None, None), (3, "web", 2.0)], "id long, cat string, rating double")
    m = P.Typed(numeric=["rating"], text=["cat"])
    ids = lambda c: {r.id for r in df.where(P.compile(c, m)).collect()}
    assert ids(P.eq("cat", "db")) == {1} and ids(P.ne("cat", "db")) == {2, 3}
    assert ids(P.not_in("cat", ["db", "web"])) == {2} and ids(P.is_in("cat", ["db", "web"])) == {1, 3}
    assert ids(P.gte("rating", 4)) == {1} and ids(P.negate(P.gte("rating", 4))) == {2, 3}
    assert ids(P.all_of()) == {1, 2, 3} and ids(P.any_of()) == set()
    assert ids(P.contains("cat", "e")) == {3} and ids(P.contains("rating", "4")) == set()
    assert ids(P.eq("rating", "4.5")) == set()
    assert ids(P.from_flags(["cat=db", "rating=4.5"])) == {1}


def test_variant_predicates(spark):
    rows = [(1, '{"tier":"gold","score":85,"active":true}'), (2, '{"tier":"silver","score":85.5}'), (3, '{"score":"85"}'), (4, "{}")]
    df = spark.createDataFrame(rows, "id long, j string").withColumn("v", F.try_parse_json("j"))
    ids = lambda c: {r.id for r in df.where(P.compile(c, P.Variant("v"))).collect()}
    assert ids(P.eq("score", 85)) == {1} and ids(P.eq("score", 85.5)) == {2} and ids(P.eq("score", "85")) == {3}
    assert ids(P.gt("score", 80)) == {1, 2} and ids(P.ne("tier", "gold")) == {2, 3, 4}
    assert ids(P.eq("active", True)) == {1} and ids(P.contains("tier", "old")) == {1}


def test_explain_and_rerank(spark):
    cov, phrase, prox, total = R.score_pair(["fast", "database"], ["a", "fast", "database", "here"])
    assert (cov, phrase, prox, total) == (1, 1, 1, pytest.approx(1))
    assert R.score_pair(["x"], ["y", "x"]) == (1, 1, 1, pytest.approx(1)) and R.score_pair([], ["x"]) == (0, 0, 0, 0)
    assert R.score_pair(["a", "a", "b"], ["b", "c", "a"])[2] == 1 and R.score_pair(["a", "b"], ["b"]) == (0.5, 0, 1, pytest.approx(0.45))
    c = spark.createDataFrame([(1, "exact", "fast database", "a fast database", 0.5), (1, "other", "fast database", "something else", 0.6)], "query_id long, doc_id string, query string, text string, score double")
    rows = {r.doc_id: r for r in R.rerank(c, 5).collect()}
    assert rows["exact"].new_rank == 1 and rows["exact"].rank_delta == 1 and rows["other"].rank_delta == -1
    assert rows["exact"].reranked_score == pytest.approx(0.7 + 0.15)


def test_mmr(spark):
    rows = [(1, "d1", 0.9, [1.0, 0.0]), (1, "d2", 0.88, [0.99, 0.05]), (1, "d3", 0.5, [0.0, 1.0])]
    c = spark.createDataFrame(rows, "query_id long, doc_id string, score double, embedding array<double>").withColumn("query_embedding", F.array(F.lit(1.0), F.lit(0.1)))
    order = lambda lam: [r.doc_id for r in R.mmr(c, 2, lam).orderBy("new_rank").collect()]
    assert order(0.95) == ["d1", "d2"] and order(0.4) == ["d1", "d3"]


def test_hybrid_engine_filters_after_the_cut(spark):
    docs = spark.createDataFrame([(i, f"word{i} common", "x" if i < 10 else "y", [1.0, i / 100]) for i in range(40)], "doc_id long, text string, kind string, embedding array<double>")
    engine = HybridEngine(docs.drop("embedding"), docs.select("doc_id", "embedding"))
    q = spark.createDataFrame([(1, "common", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    late = engine.query(q, RagQuery(top_k=3, condition=F.col("kind") == "y")).collect()
    early = engine.query(q, RagQuery(top_k=3, condition=F.col("kind") == "y", prefilter=True)).collect()
    assert late == [] and [r.doc_id for r in sorted(early, key=lambda r: r["rank"])] == [10, 11, 12]
    empty = engine.query(q, RagQuery(top_k=0))
    assert empty.count() == 0 and "rank" in empty.columns


def test_context(spark):
    rows = [(1, 1, "a", 0.5, "first text", "s", None, None), (1, 2, "b", 0.25, "é" * 100, None, "c", "u"), (1, 3, "c", 0.1, "tiny", None, None, None)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, doc_id string, score double, text string, source string, category string, url string")
    all_of = Cx.assemble(hits, Cx.ContextConfig(max_chars=10_000, layout="markdown")).first()
    assert all_of.context.startswith("### [1] a (Score: 0.500) [source: s]\nfirst text\n\n### [2] b (Score: 0.250) [category: c]\n") and not all_of.was_truncated
    assert [c.source for c in all_of.citations] == ["s", "u", None]
    cut = Cx.assemble(hits, Cx.ContextConfig(max_chars=100, layout="numbered", include_scores=False)).first()
    assert cut.was_truncated and cut.doc_count == 2 and cut.context.endswith("... [truncated]") and "�" not in cut.context
    assert cut.total_chars == len(cut.context.encode())
    drop = Cx.assemble(hits, Cx.ContextConfig(max_chars=100, layout="numbered", include_scores=False, truncate_last=False)).first()
    assert drop.doc_count == 1 and len(drop.citations) == 1 and drop.was_truncated
    xml = Cx.assemble(hits.limit(1), Cx.ContextConfig(layout="xml", header="H")).first()
    assert xml.context == 'H\n\n<context>\n  <document id="a" index="1" score="0.500">\n    first text\n  </document>\n</context>'


def test_chunks_of_one_text():
    words = "one two three four five six seven eight nine ten"
    assert [t for _, _, t in chunk_text(words, ChunkConfig("fixed_tokens", 4, 1, 1))] == ["one two three four", "four five six seven", "seven eight nine ten"]
    assert [t for _, _, t in chunk_text("Para one is here.\n\nPara two is here.\r\n\r\nstill two", ChunkConfig("paragraph", min_chunk_size=5))] == ["Para one is here.", "Para two is here.\r\n\r\nstill two"]
    assert [t for _, _, t in chunk_text("Hi. This one is longer. Short! Another long sentence? End", ChunkConfig("sentence", min_chunk_size=10))] == ["Hi. This one is longer.", "Short! Another long sentence? End"]
    assert chunk_text(" \n ", ChunkConfig()) == [] and chunk_text(None, ChunkConfig()) == [] and chunk_text("abc", ChunkConfig("fixed_chars", 0)) == []


@pytest.mark.parametrize("strategy", ["fixed_chars", "fixed_tokens", "paragraph", "sentence"])
def test_chunks_of_rows(spark, small, strategy):
    config = ChunkConfig(strategy, 40, 10, 8)
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40).select("doc_id", "text").union(spark.createDataFrame([(-1, "   "), (-2, None), (-3, "héé😀 wörld " * 9)], "doc_id long, text string"))
    got = {}
    for r in chunk(docs, config).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.end_char, r.text))
        assert r.chunk_id == f"{r.doc_id}_chunk_{r.chunk_index}"
    for r in docs.collect():
        assert got.get(r.doc_id, []) == chunk_text(r.text, config)
        if strategy == "fixed_chars":
            assert all(r.text.encode()[a:b].decode() == t for a, b, t in got.get(r.doc_id, []))


def test_embedder(spark):
    v = E.hash_embedding("Fast fast database", 16)
    assert sum(x * x for x in v) == pytest.approx(1) and E.hash_embedding("...", 4) == [1, 0, 0, 0]
    assert E.fnv1a(b"") == 0xCBF29CE484222325 and E.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    df = spark.createDataFrame([(1, "Fast fast database"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.embedding for r in E.embed(df, 16).collect()}
    assert rows[1] == pytest.approx(v) and rows[2][0] == 1
    table = spark.createDataFrame([("x", [1.0])], "text string, embedding array<double>")
    with pytest.raises(Exception, match="no embedding for"):
        E.lookup(df, table).collect()


def test_metrics(spark):
    s = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, ["x", "y"], ["y", "z"]), (3, ["p"], ["q"]), (4, [], [])], "query_id long, retrieved_ids array<string>, ground_truth_ids array<string>")
    r = Ev.macro(s, 2).first()
    assert r.mrr == pytest.approx((1 + 0.5) / 4) and r.hit_rate == 0.5 and r.precision == pytest.approx(0.25) and r.recall == pytest.approx((1 + 0.5) / 4)
    ideal = 1 + 1 / math.log2(3)
    assert r.ndcg == pytest.approx((1 + (1 / math.log2(3)) / ideal) / 4)
    assert Ev.macro(s.limit(0), 2).first().mrr == 0 and Ev.macro(s, 0).first().precision == 0


def test_self_eval(spark, docs):
    r = Ev.self_eval(docs.where("doc_id < 4"), 3).first()
    assert r.hit_rate == 1 and r.n_samples == 3


def test_cache(spark):
    entry = "entry_id long, query string, embedding array<double>, results array<struct<doc_id:long,score:double>>, created_at long, last_accessed long"
    rows = [(1, "a", [1.0, 0.0], [(7, 1.0)], 100, 100), (2, "b", [0.0, 1.0], [(8, 1.0)], 150, 150), (3, "c", [0.0, 0.0], [(9, 1.0)], 150, 150)]
    e = spark.createDataFrame(rows, entry)
    q = spark.createDataFrame([(1, [0.99, 0.05]), (2, [0.0, 0.0]), (3, [0.7, 0.7]), (4, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    hits = C.lookup(e, q, F.lit(160), C.CacheConfig(threshold=0.9)).collect()
    assert [(h.query_id, h.entry_id) for h in hits] == [(1, 1)]
    assert C.lookup(e, q, F.lit(160), C.CacheConfig(threshold=0.9, ttl=60)).count() == 0
    assert {r.entry_id for r in C.invalidate(e, spark.createDataFrame([(8,)], "doc_id long")).collect()} == {1, 3}
    new = spark.createDataFrame([(4, "d", [1.0, 1.0], [(5, 1.0)], 160, 160)], entry)
    assert {r.entry_id for r in C.insert(e, new, F.lit(160), C.CacheConfig(capacity=2)).collect()} == {3, 4}
    assert {r.entry_id: r.last_accessed for r in C.touch(e, C.lookup(e, q, F.lit(160)), F.lit(160)).collect()}[1] == 160
    assert C.clear(e).count() == 0 and C.stats(1, 3, 2)["hit_rate"] == 0.25


def test_cache_lookup_searches_every_live_entry(spark, monkeypatch):
    monkeypatch.setattr(C, "TURN", 7)
    e = spark.range(30).selectExpr("id AS entry_id", "array(1D, CAST(id AS DOUBLE)) AS embedding", "array(id) AS results", "0L AS created_at")
    q = spark.range(30).selectExpr("id AS query_id", "array(1D, CAST(id AS DOUBLE)) AS embedding")
    hits = C.lookup(e, q, F.lit(1), C.CacheConfig(capacity=2, threshold=0.5)).collect()
    assert sorted((h.query_id, h.entry_id) for h in hits) == [(k, k) for k in range(30)]


def test_cache_lookup_in_tiles_is_exact(spark, monkeypatch):
    """Against plain expressions, with equal entries, other lengths, nulls and text ids; and no tile beyond its bound."""
    monkeypatch.setattr(D, "TILE", 64)
    rows = [(f"e{k:02d}", [float((k * 7 + j * 3) % 11 - 5) for j in range(4 + k % 2)] if k else None, [k], 0) for k in range(60)]
    e = spark.createDataFrame([(*r[:1], r[1] if r[0] != "e05" else [None, 1.0, 2.0, 3.0, 0.5], *r[2:]) for r in rows], "entry_id string, embedding array<float>, results array<long>, created_at long")
    q = spark.createDataFrame([(str(k), [float((k * 5 + j) % 7 - 3) for j in range(4 + k % 2)]) for k in range(40)], "query_id string, embedding array<double>")
    pairs = q.crossJoin(e.select("entry_id", F.col("embedding").alias("e"))).where(F.size("embedding") == F.size("e"))
    best = {}
    for r in pairs.select("query_id", "entry_id", V.cosine(F.col("embedding"), F.col("e")).alias("s"), V.l2_norm(F.col("embedding")).alias("n")).collect():
        if r.n > 0 and r.s >= 0.5:
            best[r.query_id] = min(best.get(r.query_id, (2, "")), (-r.s, r.entry_id))
    got = {r.query_id: (-r.similarity, r.entry_id) for r in C.lookup(e, q, F.lit(1), C.CacheConfig(threshold=0.5)).collect()}
    assert got == best and len(got) > 20


def test_dense_holds_tiles_and_ties_equal_vectors(spark, monkeypatch):
    """A task's products stay within TILE, and equal vectors tie wherever they lie: those at distance 0 score 1."""
    import numpy as np

    monkeypatch.setattr(D, "TILE", 4096)
    rng, most = np.random.default_rng(1), []
    x = np.tile(rng.normal(size=(100, 64)), (30, 1))
    own = D.Best._tile
    monkeypatch.setattr(D.Best, "_tile", lambda self, at, ids, part, x2: (most.append(len(self.q[at]) * len(part)), own(self, at, ids, part, x2)))
    for metric in ("cosine", "dot", "euclidean"):
        best = D.Best(metric, x[:50], 40)
        for at in range(0, len(x), 700):
            best.add(np.arange(at, min(at + 700, len(x))), x[at : at + 700])
        scores = np.round([D.exact(metric, np.repeat(x[k : k + 1], len(x), 0), x) for k in range(50)], 9)
        want = np.lexsort((np.broadcast_to(np.arange(len(x)), scores.shape), -scores), axis=1)[:, :40]
        assert (best.id.reshape(50, 40) == want).all() and (best.score == np.take_along_axis(scores, want, 1).ravel()).all()
    assert max(most) <= 4096 and best.score.max() == 1
    assert (best.id.reshape(50, 40)[:, :30] == np.arange(30) * 100 + np.arange(50)[:, None]).all()


def test_memory(spark):
    rows = [("e1", "ag", "t1", 1000, "LSM tree compaction notes", ["Storage"], 0.5, None), ("e2", "ag", "t2", 4000, "unrelated words", ["misc"], 0.9, None)]
    e = spark.createDataFrame(rows, "id string, agent_id string, task_id string, timestamp long, content string, tags array<string>, importance double, embedding array<double>")
    r = M.recall(e, queries(spark, (1, "lsm tree")), F.lit(4600), 2).orderBy("rank").collect()
    assert r[0].id == "e1" and r[0].relevance == pytest.approx(0.5) and r[0].recency == pytest.approx(0.5)
    assert [x.id for x in M.with_tag(e, "STORAGE").collect()] == ["e1"] and M.of_task(e, "t2").count() == 1 and M.of_agent(e, "ag").count() == 2
    assert M.newest(e, 1).count() == 2  # ten at least


def test_memory_of_times_to_come(spark, tmp_path):
    """Recency is 1 for an episode after the clock; the registered query goes on beyond 1, as its SQL does."""
    e = spark.createDataFrame([("e1", 7200, "x", 0.0)], "id string, timestamp long, content string, importance double")
    assert M.recall(e, queries(spark, (1, "a")), F.lit(3600), 1).first().recency == 1
    assert M.recall(e, queries(spark, (1, "a")), F.lit(3600), 1, clamped=False).first().recency == pytest.approx(2)
    rows = [(100, 1, "user", "the words"), (5000, 2, "user", "no match")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(Q.SQL["memory_recall"]).fetchall()
    assert sorted(map(tuple, Q.memory_recall(spark, str(tmp_path)).collect())) == sorted(want) and max(r[5] for r in want) > 40


def test_the_last_window_stays_where_none_was_kept(spark):
    """20 characters in windows of 10, 12 bytes at least: only the window that ends the text is left; repeated rows are apart."""
    texts = [(1, "abcdefghij" * 2), (1, "abcdefghij" * 2), (2, "é" * 25), (3, "  "), (4, "x")]
    c = ChunkConfig("fixed_chars", 10, 0, 12)
    got = sorted((r.doc_id, r.chunk_index, r.start_char, r.end_char, r.text) for r in chunk(spark.createDataFrame(texts, "doc_id long, text string"), c).collect())
    want = sorted((k, n, *piece) for k, t in texts for n, piece in enumerate(chunk_text(t, c)))
    assert got == want and got[:2] == [(1, 0, 10, 20, "abcdefghij")] * 2


def test_a_written_index_finds_the_same(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    q = spark.createDataFrame([(1, "the tion of er"), (2, "heit der ung"), (3, "")], "query_id long, text string")
    lazy = SparseIndex.build(docs)
    rows = lambda index: sorted(map(tuple, index.search(q, 5).collect()))
    kept = lazy.write(f"file://{tmp_path}/index")
    assert rows(kept) == rows(lazy) and len(rows(lazy)) == 10
    import saltmarsh.operators.sparse as sparse

    few, sparse.LITERAL_TERMS = sparse.LITERAL_TERMS, 1
    try:
        assert rows(kept) == rows(lazy)
    finally:
        sparse.LITERAL_TERMS = few
    gone = docs.where("doc_id % 2 = 0").select("doc_id")
    assert all(r[1] % 2 for r in rows(kept.remove(gone)))


def test_agents_in_turns_route_alike(spark):
    from saltmarsh.operators import routing as Ro

    tasks = spark.createDataFrame([(k, ("plan", "code", "test")[k % 3], "", k % 4, ["reflection", "code_execution"][: k % 3]) for k in range(30)], "task_id long, title string, description string, priority int, required array<string>")
    agents = spark.createDataFrame([(k, ("coder", "critic", "planner")[k % 3], [("reflection", "code_execution", "storage_ops")[k % 3]], k % 5) for k in range(25)], "agent_id long, role string, capabilities array<string>, active int")
    for s in ("default", "least_loaded", "priority", "adaptive"):
        one, many = (sorted(map(str, Ro.route(tasks, agents, s, turn=t).collect())) for t in (100, 4))
        assert one == many and len(one) == 30


def test_batches_are_unpacked_in_parts():
    import pyarrow as pa

    from saltmarsh.operators.arrow import ROWS, sized

    texts = ["x" * 300_000, None, "", "é" * 900_000, *["y" * 200_000] * 9, *[""] * 10_000]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["k", "t"])
    parts = list(sized([whole.slice(0, 1), whole.slice(1)], 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([whole])) and max(p.num_rows for p in parts) <= ROWS
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 1 << 20 for p in parts)
    lists = pa.RecordBatch.from_arrays([pa.array([["the"] * 10_000, None, []] * 20, pa.list_(pa.string()))], ["t"])
    cut = list(sized([lists], -1))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([lists])) and len(cut) > 10
