"""The registry and the pipeline."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from saltmarsh.llm import mixing, secrets
from saltmarsh.llm.common import written


def test_registry():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "/root/testdata/sf0.01"), "stage")
        found.append(docs)
    return found


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_each_stage_takes_effect(stages):
    n = [df.count() for df in stages]
    assert n[1] < n[0] and n[2] < n[1] and n[3] == n[2] and n[5] == n[4]
    assert n[0] - n[1] < 0.3 * n[0]
    assert not any(secrets.spans(r.text) for r in stages[3].collect())
    a, b = ({r.doc_id: r.text for r in df.collect()} for df in stages[2:4])
    assert all(a[k] == b[k] for k in a if not secrets.spans(a[k]))
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert 0.9 < words(stages[4]) / words(stages[3]) < 1.1


def test_ids_round_trip(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    from saltmarsh.llm.bpe import Codec, default_tokenizer

    codec = Codec(default_tokenizer())
    for r in stages[5].limit(50).collect():
        assert codec.decode(r.ids) == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_stages_of_odd_and_of_no_rows(odd, none, folder, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    docs = odd.select(*none.columns)
    path = folder(documents=docs, labels=labels)
    rows = corpus_pipeline.run(spark, path).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    path = folder(documents=none, labels=labels.limit(0))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_one_of_each_group_stays(odd, none, spark):
    rows = corpus_pipeline.drop_near_duplicates(spark, odd.select(*none.columns), "").collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 3, 5, 7, 8]
    twice = odd.where("doc_id in (5, 8)").select(*none.columns)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, twice.union(twice), "").collect()) == [5, 8]


def test_one_row_of_each_group_stays_whatever_the_ids(none, spark):
    """Rows are told apart by themselves: neither a null id nor one that another group keeps saves a row."""
    a, b, c = ("some words of a text that is number %s and goes on for a while" % n for n in ("one", "two", "three"))
    rows = [(None, a), (None, a), (None, a), (1, b), (None, b), (2, c), (1, c + " "), (3, b)]
    rows += [(1, "all of this text is quite another one than the first"), (0, "all of this text is quite another one than the first")]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], none.schema)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (1, b), (1, c + " "), (0, rows[-1][1])], key=str)


def test_the_mixture_tells_rows_apart_by_more_than_the_id(none, spark):
    """A third of the rows without an id, and ids that two texts of different sizes and sources share."""
    rows = [(k if k % 3 else None, f"w{k} " * (k % 7 + 1), "en", "abc"[k % 3], 9) for k in range(60)]
    rows += [(500, "x " * 40, "en", "a", 80), (500, "y", "en", "c", 1), (501, "z " * 3, "en", "b", 6), (501, "v " * 30, "en", "c", 60)]
    docs = spark.createDataFrame(rows, none.schema).coalesce(1)
    got = Counter(r.text for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    mixed = mixing.budgeted(mixing.measured(docs, keep=("text",))).select("doc_id", "size", "source", "key", "row", (F.col("epochs") * F.col("size") + F.col("partial")).alias("taken")).collect()
    assert sum(r.taken > 0 and r.doc_id is None for r in mixed) > 5
    # Rows without an id tie in the order of the mix: their copies are held by source and size.
    text = {(r.doc_id, r["size"], r.source): [] for r in mixed}
    for k, t, _, s, _ in rows:
        text[k, len(t.split()), s].append(t)
    for (k, size, s), texts in text.items():
        want = sorted(-(-r.taken // r["size"]) for r in mixed if (r.doc_id, r["size"], r.source) == (k, size, s))
        assert sorted(got[t] for t in texts) == want


def test_the_mixture_keeps_rows_without_words_once(odd, none, spark):
    docs = odd.select(*none.columns)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert [got[k, t] for k, t in ((3, ""), (4, None), (6, " \t\n "))] == [1, 1, 1]
    assert corpus_pipeline.mix_sources(spark, none, "").count() == 0


def test_no_text_is_shuffled_by_the_mixture(spark, real):
    """After the rows are written, the only exchange that could carry texts would be a join's; the cuts are broadcast."""
    plan = mixing.repeated(real)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
