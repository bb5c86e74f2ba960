"""Shards and mixtures."""

import zlib
from collections import Counter

import duckdb

from saltmarsh.llm import mixing, sharding
from saltmarsh.llm.bucketed import running
from pyspark.sql import functions as F


def run_sql(sql, path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def test_running_over_buckets_equals_a_plain_running_sum(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.xxhash64("id").alias("k"), F.col("id").alias("v"))
    got = {(r.g, r.k): r.out for r in running(df, ["g"], ["k"], F.col("v"), "out", 7).collect()}
    for g in "012":
        total = 0
        for r in sorted((r for r in df.collect() if r.g == g), key=lambda r: r.k):
            assert got[g, r.k] == total
            total += r.v


def test_shards_of_odd_rows(odd, folder):
    rows = sharding.interleave(odd, shards=3).collect()
    assert len(rows) == 10
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    null = next(r for r in rows if r.doc_id == 4)
    assert (null["size"], null.text_crc32, null.source) == (8, 0, None)
    long = next(r for r in rows if r.doc_id == 7)
    assert long.text_crc32 == zlib.crc32("\x00 é ß 漢字 😀 <|endoftext|> password: abcdefghijkl".encode())


def test_shards_match_the_mixture(real):
    rows = sharding.interleave(real, shards=4).collect()
    whole = Counter(r.source for r in rows)
    for s in range(4):
        own = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(own[x] - n / 4) <= 1.5 for x, n in whole.items())


def test_a_hot_source_uses_many_buckets(spark, monkeypatch):
    monkeypatch.setattr("saltmarsh.llm.sharding.ranges_for", lambda n: 50)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 400, "hot").otherwise("cold").alias("source"))
    rows = sharding.interleave(df, shards=5).collect()
    for s in range(5):
        assert Counter(r.source for r in rows if r.shard == s) == {"hot": 80, "cold": 20}


def test_shards_are_the_same_again(real):
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert key(sharding.interleave(real)) == key(sharding.interleave(real.repartition(7)))


def test_native_operators_of_an_empty_table(none):
    assert sharding.interleave(none).count() == 0
    assert mixing.mix(none).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **{s: level * weight[s] for s in free}}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixture_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    want = brute_targets(sizes)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_mixture_hits_every_budget(real, monkeypatch):
    monkeypatch.setattr("saltmarsh.llm.mixing.ranges_for", lambda n: 13)
    rows = mixing.mix(real).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_oracles_agree_on_odd_rows(odd, folder):
    path = folder(documents=odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars"))
    for module in (mixing, sharding):
        query = module.op9_mixing if module is mixing else module.op3_sharding
        got = sorted((r.asDict() for r in query(odd.sparkSession, path).collect()), key=lambda r: r["doc_id"])
        assert got == sorted(run_sql(module.SQL, path), key=lambda r: r["doc_id"])


def test_native_plans_hold_no_python(real):
    for df in (sharding.interleave(real), mixing.mix(real)):
        assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


def test_a_hot_id_or_row_is_split(spark, monkeypatch):
    """A third of the rows share an id, another third are one and the same row: no range holds more than its share."""
    monkeypatch.setattr("saltmarsh.llm.mixing.ranges_for", lambda n: 12)
    monkeypatch.setattr("saltmarsh.llm.sharding.ranges_for", lambda n: 12)
    df = spark.range(6_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, 8).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("w"), F.col("id"))).otherwise("two words").alias("text"), F.lit("s").alias("source"))
    rows = mixing.measured(df)
    from saltmarsh.llm.common import written

    seen = []
    monkeypatch.setattr("saltmarsh.llm.bucketed.written", lambda d, name: seen.append(w := written(d, name)) or w)
    assert sum(r.partial + r.epochs * r["size"] for r in mixing.budgeted(rows).collect()) == sum(r["size"] for r in rows.collect())
    assert sharding.interleave(df, 5).groupBy("shard").count().where("count <> 1200").isEmpty()
    for d in seen:
        column = next(c for c in d.columns if c.endswith("__range"))
        assert d.groupBy(column).count().agg(F.max("count")).first()[0] < 2 * 6_000 / 12 + 200
