"""Operator 2: SimHash near-duplicates, linked through BK-trees.

Fingerprints: A-Z in lower case, words, shingles of ``width`` words with repeats, XXH64 (seed 42) of each, and bit i
of the fingerprint is 1 if it is set in over half of the hashes. Two fingerprints link at ``radius`` or fewer bits.

Links: 64 bits are 8 blocks; two fingerprints that differ in at most 2 bits agree in 6 blocks at least, so each distinct
fingerprint goes, once for each choice of 2 blocks, to the shard of its other 48 bits. A shard has at most 2**16 distinct
fingerprints, whatever the data: that is the proven bound on a tree. In its shard a fingerprint is looked up in the
BK-tree of those before it (children keyed by Hamming distance to the parent, only edges within the radius followed)
and then added. The trees are not broadcast from the driver: it must not hold the fingerprints of all documents, so a
shard's tree and its queries meet in one task. Of a shard's links only a spanning forest leaves the task; components are
the same.

Components: large-star/small-star rounds over a written edge table, whose pairs are distinct fingerprints, so a
group of equal copies is one node.

Defined results: null and empty texts have fingerprint 0 and link like any other; repeated rows are in one component; a
null doc_id keeps its row and is never a component's id (null only if the component has no other); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, written

WIDTH, RADIUS, HASH_SEED = 3, 2, 42
BLOCKS = 8
#: Pairs that a task hands on at once.
PAIRS = 1 << 16
#: For each choice of 2 of the 8 blocks, the mask of the other 48 bits, as a signed 64-bit integer.
MASKS = [
    int(np.uint64(~(0xFF << 8 * i | 0xFF << 8 * j) & 0xFFFFFFFFFFFFFFFF).astype(np.int64))
    for i in range(BLOCKS)
    for j in range(i + 1, BLOCKS)
]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int64)


def hashes(text: str, width: int = WIDTH) -> list[int]:
    words = text.encode().lower().split()  # bytes: A-Z only, and split() takes exactly \x20\x09-\x0D
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)]
    join, h = b" ".join, xxhash.xxh64_intdigest
    return [h(join(s), HASH_SEED) for s in zip(*(words[i:] for i in range(width)))]


def fingerprint(h: list[int] | np.ndarray) -> int:
    """Signed 64-bit fingerprint of the shingle hashes."""
    if not len(h):
        return 0
    octets = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(hashes(t or "", width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Values in a metric tree; a node's children are keyed by their integer Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Indexes of the values within the radius; only edges within it of the distance can lead to more."""
        found, todo = [], [0] if self.values else []
        while todo:
            k = todo.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            todo += [child for edge, child in self.children[k].items() if d - radius <= edge <= d + radius]
        return found

    def way(self, value: int) -> list[tuple[int, int]]:
        """(index, distance) of the values that a new one passes on its way down from the root."""
        found, k = [], 0 if self.values else None
        while k is not None:
            found.append((k, d := (self.values[k] ^ value).bit_count()))
            k = self.children[k].get(d)
        return found

    def add(self, value: int) -> int:
        way, new = self.way(value), len(self.values)
        self.values.append(value)
        self.children.append({})
        if way:
            k, d = way[-1]
            self.children[k][d] = new
        return new


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within the radius, directly or by steps, and no more than needed for it."""
    tree, root, links = BKTree(), [], []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for value in values:
        near = tree.near(value & 0xFFFFFFFFFFFFFFFF, radius)
        new = tree.add(value & 0xFFFFFFFFFFFFFFFF)
        root.append(new)
        for k in near:
            if (other := top(k)) != top(new):
                root[top(new)] = other
                links.append((values[k], value))
    return links


def in_shards(rows: DataFrame, shard: int, pairs: Callable[..., Iterable[tuple[int, int]]]) -> DataFrame:
    """(a, b): what ``pairs`` finds in each shard of two rows or more. The first ``shard`` columns of rows name a shard, which
    meets in one task; ``pairs`` takes the other columns, as arrays of its rows."""
    names = rows.columns[:shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:shard]], axis=0)) + 1
            starts, ends = np.insert(cut, 0, 0), np.append(cut, len(columns[0]))
            found = chain.from_iterable(pairs(*(c[starts[k] : ends[k]] for c in columns[shard:])) for k in np.flatnonzero(ends - starts > 1))
            while some := list(islice(found, PAIRS)):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            # The last shard may go on in the next batch.
            same = np.all([c == c[-1] for c in held[:shard]], axis=0)
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from out([x[:last] for x in held])
            held = [x[last:] for x in held]
        if held and len(held[0]):
            yield from out(held)

    return rows.repartition(*names).sortWithinPartitions(*rows.columns).mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints of nodes.fp that give the components; radius is 2 at most."""
    if radius > 2:
        raise ValueError("the shards keep pairs of 2 or fewer differing bits")
    choice = F.explode(F.array(*[F.struct(F.lit(p).cast("byte").alias("p"), F.col("fp").bitwiseAND(F.lit(m)).alias("rest")) for p, m in enumerate(MASKS)])).alias("s")
    # A shard is one of 2**16 rows at most.
    return in_shards(nodes.select("fp", choice).select("s.p", "s.rest", "fp"), 2, lambda fp: forest(fp.tolist(), radius))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's smallest node.

    Large-star links each larger neighbour of a node to the smallest node around it, small-star the same for smaller
    ones, until nothing changes. Every round is a written table, so a lost executor costs no more than a round.
    """

    def star(df: DataFrame, large: bool) -> DataFrame:
        around = df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else df
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = around.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    df = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    n = df.count()
    for _ in range(rounds if n else 0):
        new = written(star(star(df, True), False), "stars")
        was, n = n, new.count()
        # Both are sets: as many edges, none of them new, is no change.
        settled = n == was and new.join(df, ["a", "b"], "left_anti").isEmpty()
        discard(df)
        df = new
        if settled:
            break
    else:
        if n:
            raise RuntimeError("components did not settle")
    return df.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, width: int = WIDTH, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of df."""
    fps = written(fingerprints(df, width, id_col, text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes, radius))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
