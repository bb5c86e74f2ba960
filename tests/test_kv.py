"""The change-log store."""

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import kv as K
from saltmarsh.operators import store as S
from saltmarsh.sources import documents as Src


@pytest.fixture
def store(spark, tmp_path):
    return K.KVStore(spark, f"file://{tmp_path}/db")


def keys(df):
    return [bytes(r.key).decode() for r in df.collect()]


def test_scan_and_delete(store):
    store.write_batch([("put", b"a", b"1"), ("put", b"b", b"2"), ("put", b"c", b"3")])
    store.delete(b"b")
    store.write_batch([("put", b"d", b"4"), ("put", b"e", b"5")])
    assert keys(store.scan()) == ["a", "c", "d", "e"] and keys(store.scan(b"c", b"e")) == ["c", "d"]
    assert keys(store.scan(limit=2, reverse=True)) == ["e", "d"]
    assert keys(store.scan(b"e", b"c")) == keys(store.scan(b"c", b"c")) == keys(store.scan(b"x", b"z")) == []
    assert keys(K.prefix_scan(store.log(), F.lit(bytearray(b"d")))) == ["d"]


def test_empty_value_is_no_delete(store):
    store.put(b"k", b"")
    assert store.get(b"k") == b""
    store.delete(b"k")
    assert store.get(b"k") is None and store.get(b"unknown") is None


def test_later_operations_win_and_batches_count(store):
    assert store.write_batch([("put", b"k", b"1"), ("delete", b"k"), ("put", b"k", b"2")]) == 3
    assert store.get(b"k") == b"2" and store.last_seq == 3 and store.write_batch([]) == 0
    with pytest.raises(K.InvalidArgument):
        store.write_batch([("merge", b"k", b"3")])


def test_recovery(spark, store):
    store.put(b"k1", b"1")
    store.put(b"k2", b"2")
    store.delete(b"k1")
    again = K.KVStore(spark, store.path)
    assert again.last_seq == store.last_seq and keys(again.scan()) == ["k2"]
    with open(store.path.removeprefix("file://") + "/manifest/000000000009.json", "w") as f:
        f.write('{"version": 9, "added')
    assert keys(K.KVStore(spark, store.path).scan()) == ["k2"]


def test_readers_keep_their_version(store):
    store.put(b"a", b"1")
    before = store.scan()
    store.put(b"b", b"2")
    assert keys(before) == ["a"] and keys(store.scan()) == ["a", "b"]


def test_missing_folder(spark, tmp_path):
    with pytest.raises(K.InvalidArgument):
        K.KVStore(spark, f"file://{tmp_path}/none", K.Options(create_if_missing=False))


def test_compaction(store):
    for f in range(4):
        store.write_batch([("put", f"k_{f:02d}_{i:02d}".encode(), b"v") for i in range(10)])
    assert store.stats()["files_per_level"] == {0: 4}
    assert store.compact() == 1
    assert store.stats()["files_per_level"] == {1: 1} and store.scan().count() == 40
    store.delete(b"k_00_00")
    for i in range(3):
        store.put(f"n{i}".encode(), b"v")
    assert store.compact() == 1 and store.get(b"k_00_00") is None
    assert K.inspect(store.log())[0].first().tombstones == 0  # the bottom level keeps no deletes


def test_merge_and_overlap(spark):
    make = lambda *p: spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in p], "key binary, value binary")
    m = K.merge_sources(make((b"apple", b"1"), (b"k", b"first")), make((b"banana", b"2"), (b"k", b"second"))).collect()
    assert [(bytes(r.key), bytes(r.value)) for r in m] == [(b"apple", b"1"), (b"banana", b"2"), (b"k", b"first")]
    r = spark.range(1).select(K.overlaps(F.lit("a"), F.lit("c"), F.lit("c"), F.lit("d")).alias("x"), K.overlaps(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("y")).first()
    assert r.x and not r.y


def test_bloom(spark):
    of = lambda a, b: spark.range(a, b).select(F.concat(F.lit("key"), F.col("id")).cast("binary").alias("key"))
    bits, m, k = K.bloom_bits(of(0, 1000))
    assert k == 7 and K.might_contain(of(0, 1000), bits, m, k).count() == 1000
    assert K.might_contain(of(10_000, 15_000), bits, m, k).count() < 150


def test_compaction_policy(spark):
    f = spark.createDataFrame([("a", 1, 20 << 20, bytearray(b"a"), bytearray(b"f")), ("b", 1, 1, bytearray(b"g"), bytearray(b"k")), ("c", 2, 1, bytearray(b"e"), bytearray(b"z"))], "file string, level int, bytes long, min_key binary, max_key binary")
    assert K.pick_compaction(f) == {"level": 1, "target": 2, "inputs": ["a", "c"], "bottom": True}
    assert K.pick_compaction(f.where("file <> 'a'")) is None


def test_operations_file(spark):
    lines = ["put a 1", "# no", "// no", "", '{"op":"SET","key":"b","value":"2"}', '{"delete":{"key":"a"}}', "remove b"]
    rows = Src.parse_ops(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.op, r.key, r.value) for r in rows] == [("put", "a", "1"), ("put", "b", "2"), ("delete", "a", None), ("delete", "b", None)]
    with pytest.raises(Exception, match="unknown operation"):
        Src.parse_ops(spark.createDataFrame([("merge a b",)], "value string")).collect()


def test_document_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "text": "one"}, {"text": "two"}]')
    (tmp_path / "b.json").write_text('{"id": "y", "text": "one"}\n{"id": "z", "text": "two"}\n')
    a = Src.documents(spark, f"file://{tmp_path}/a.json").collect()
    assert {(r.id, r.text) for r in a} == {("x", "one"), ("batch_doc_1", "two")}
    assert {r.id for r in Src.documents(spark, f"file://{tmp_path}/b.json").collect()} == {"y", "z"}
    for kind in ("json", "tsv", "text"):
        Src.write(spark.createDataFrame([(1, "t")], "id long, text string"), f"file://{tmp_path}/out-{kind}", kind)
    assert spark.read.text(f"file://{tmp_path}/out-text").first().value == "1  t"
    (tmp_path / "w.json").write_text('{"tasks": [{"id": "a", "title": "A"}, {"id": "b", "title": "B", "depends_on": ["a"]}]}')
    tasks, edges = Src.workflow(spark, f"file://{tmp_path}/w.json")
    assert tasks.count() == 2 and [tuple(r) for r in edges.collect()] == [("b", "a")]


def test_documents(spark):
    rows = [(1, 1, False, "old"), (1, 2, False, "new"), (2, 1, False, "gone"), (2, 2, True, None)]
    d = spark.createDataFrame(rows, "doc_id long, version int, is_delete boolean, text string")
    assert [(r.doc_id, r.text) for r in S.current(d).collect()] == [(1, "new")]
    dead = S.tombstones(spark.createDataFrame([(1,), (9,)], "doc_id long"), d, 3)
    assert [(r.doc_id, r.version) for r in dead.collect()] == [(1, 3)] and S.current(d.union(dead)).count() == 0
    chunks = spark.createDataFrame([(1, 1, 0, "c", 0, 1, "o"), (1, 2, 1, "d", 1, 2, "w"), (1, 2, 0, "c", 0, 1, "n")], "doc_id long, version int, chunk_index int, chunk_id string, start_char long, end_char long, text string")
    assert [c.text for c in S.with_chunks(d, chunks).first().chunks] == ["n", "w"]


def test_open_readers_survive_compaction(spark, tmp_path):
    """A DataFrame keeps the version it was opened with; vacuum deletes what no version names."""
    store = K.KVStore(spark, f"file://{tmp_path}/db", K.Options(l0_files=2))
    store.put(b"a", b"1")
    store.put(b"b", b"2")
    old = store.scan()
    assert store.compact() == 1
    store.delete(b"a")
    assert [bytes(r.key) for r in old.collect()] == [b"a", b"b"]
    assert store.vacuum() == 0 and [bytes(r.key) for r in store.scan().collect()] == [b"b"]
    assert store.vacuum(older_than=0) == 2
    assert [bytes(r.key) for r in K.KVStore(spark, f"file://{tmp_path}/db").scan().collect()] == [b"b"]
    store.close()
    with pytest.raises(K.Closed):
        store.put(b"c", b"3")


def test_operations_are_evaluated_once(spark, tmp_path):
    """Sequence numbers fit what was written even where the operations give other rows each time."""
    store = K.KVStore(spark, f"file://{tmp_path}/once")
    ops = spark.range(50).select(F.col("id").alias("op_idx"), F.encode(F.rand().cast("string"), "UTF-8").alias("key"), F.encode(F.lit("v"), "UTF-8").alias("value"), F.lit(False).alias("is_delete")).where(F.rand() < 0.5)
    n = store.write(ops)
    assert n == store.log().count() and store.last_seq == store.log().agg(F.max("seq")).first()[0]
    assert store.write(ops.limit(0)) == 0 and store.version == 1


def test_large_runs_are_split_by_key(spark, tmp_path):
    store = K.KVStore(spark, f"file://{tmp_path}/split", K.Options(l0_files=1, target_file_bytes=2_000))
    store.write_batch([("put", f"k{i:05d}".encode(), str(i * 7919).encode() * 5) for i in range(600)])
    store.compact()
    files = store.log().select(F.input_file_name().alias("f"), "key").groupBy("f").agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("a").collect()
    assert len(files) > 2 and all(x.b < y.a for x, y in zip(files, files[1:]))
