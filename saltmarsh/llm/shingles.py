"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, as the pipeline drops them.

Operator 2's method, with its parts: a 64-bit SimHash of each text, BK-trees over the fingerprints in shards that meet in one
task, links, components. Words and shingles are those of operator 2 (A-Z in lower case, XXH64), five wide and without
repeats, as similarity is one of sets; texts of one set are one node. Every link is a pair that a tree found.

Radius: 28 bits. For sets of similarity 0.8 a bit differs with a probability of 0.1875 at most (4 shingles against 5; 0.153
from 100 on), so a pair is farther apart with 1.1e-6 (1.2e-8 from 100 on); worked out for up to 259 common shingles.

Shards: equal bits, as operator 2 has them, can't hold pairs 28 bits apart. Here a shard is a MinHash bucket, 32 bands of 5
rows: a pair at exactly 0.8 shares none with a probability of 3e-6, one at 0.9 with 1e-12. A bucket of over ``SHARD`` nodes
is cut into parts, and each two parts are a shard, so that no tree is larger than two parts and every pair still meets.

Every pair that the trees give is then checked on the exact sets, so no pair below 0.8 links. Links are sought in two
rounds: first each node is paired with the nearest that it passes on its way into its tree, then trees give all pairs
within the radius that the first round left in different components (a link inside of one would change nothing). Nothing is
capped: a bucket has as many nodes as the data gives it, and one of many unlike texts costs a look at each pair.

Texts aren't copied where the rows come straight from Parquet files, each read once. While the pairs, and the rows to drop, are
at most ``FEW`` their numbers are broadcast and only the texts of pairs are shuffled, to meet for the check; beyond that all
texts are shuffled, up to three times (two rounds of checks, the drop).

Defined results: null and empty texts have the empty set and are one node; texts of fewer than five words are one
shingle; repeated rows are in one component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, written
from .simhash import BKTree, components, fingerprint, hashes, in_shards

WIDTH, RADIUS, BANDS, ROWS, SEED = 5, 28, 32, 5, 42
#: Row numbers that are broadcast at once: some 20 MB.
FEW = 1_000_000
#: Nodes of a part of a bucket, and pairs with one node that one task checks.
SHARD, CHECKS = 4096, 1000
_RND = np.random.default_rng(SEED)
#: A permutation of 32 bits for each row of each band, and what folds a band's rows to a bucket.
_TIMES = _RND.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_FOLD = _RND.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of the text's shingle hashes."""
    return np.unique(np.array(hashes(text or "", WIDTH), np.uint64))


def bands(s: np.ndarray) -> np.ndarray:
    """A bucket for each band; none for the empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    x, least = (s >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(least, (_TIMES * x[at : at + 4096]).min(1), out=least)
    return (least.reshape(BANDS, ROWS).astype(np.uint64) * _FOLD).sum(1).view(np.int64)


def numbered(df: DataFrame) -> DataFrame:
    """df with row, unique: a row's file and its place there, which every later read finds again. Rows that don't come straight
    from Parquet files, each read once, are written first."""

    def straight(plan) -> bool:
        while plan.nodeName() in ("Project", "SubqueryAlias"):
            plan = plan.children().head()
        return plan.nodeName() == "LogicalRelation"

    def placed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
        # One row a file.
        files = found.groupBy("__file").agg(F.count_if(F.col("__at") == 0).alias("times"))
        return found, written(files.withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__file")).cast("long")), "files")

    plan = df._jdf.queryExecution().analyzed()
    try:
        if not (straight(plan) and plan.deterministic()):
            raise AnalysisException("not a table of files")
        found, files = placed(df)
        if not files.where("times > 1").isEmpty():
            raise AnalysisException("a file is read more than once")
    except AnalysisException:
        found, files = placed(written(df, "rows"))
    row = F.shiftleft("__k", 36).bitwiseOR(F.col("__at"))
    return found.join(F.broadcast(files.drop("times")), "__file").withColumn("row", row).select(*df.columns, "row")


def shingled(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, node, n, fp, bands), written: node stands for the text's set, n is its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            node = pa.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64())
            found = [node, pa.array(map(len, sets), pa.int64()), pa.array(map(fingerprint, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], ["row", "node", "n", "fp", "bands"])

    return written(rows.select("row", text_col).mapInArrow(run, "row long, node long, n long, fp long, bands array<long>"), "shingled")


def _alike(m: int, n: int) -> bool:
    """Whether sets of these sizes can share 0.8 of their union."""
    return 5 * min(m, n) >= 4 * max(m, n)


def nearest(node: np.ndarray, fp: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Each node of a shard with the nearest one within the radius that it passes on its way into the tree. A fingerprint is
    in the tree once."""
    tree, held = BKTree(), []
    for a, value, size in zip(node.tolist(), (fp.view(np.uint64)).tolist(), n.tolist()):
        way = tree.way(value)
        if near := [(d, held[k][0]) for k, d in way if d <= RADIUS and _alike(held[k][1], size)]:
            yield min(near)[1], a
        if not way or way[-1][1]:
            tree.add(value)
            held.append((a, size))


def apart(node: np.ndarray, fp: np.ndarray, n: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs (smaller, larger) of a shard within the radius whose components differ."""
    tree, held, at = BKTree(), [], {}
    if (root == root[0]).all():
        return
    for x in zip(node.tolist(), n.tolist(), root.tolist(), (fp.view(np.uint64)).tolist()):
        for k in tree.near(x[3], RADIUS):
            yield from ((min(y[0], x[0]), max(y[0], x[0])) for y in held[k] if y[2] != x[2] and _alike(y[1], x[1]))
        if x[3] not in at:
            at[x[3]] = tree.add(x[3])
            held.append([])
        held[at[x[3]]].append(x)


def _similar(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) whose sets share 0.8 of their union: 9 times the common is 4 times both or more. The text of a comes
    first, those of its b follow; one a with many b is several pieces."""
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("a")) / CHECKS)
    pairs = pairs.withColumn("piece", F.pmod(F.col("b"), parts).cast("int"))
    first = pairs.select("a", "piece").distinct().withColumns({"b": F.lit(None).cast("long"), "node": F.col("a")})
    wanted = first.unionByName(pairs.withColumn("node", F.col("b"))).join(nodes.select("node", "row"), "node").select("row", "a", "piece", "b")
    wanted = written(wanted, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in slices(batches):
            found = []
            for a, b, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                s = shingles(text)
                if b is None:
                    one = s
                elif 9 * len(np.intersect1d(one, s, True)) >= 4 * (len(one) + len(s)):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    texts = rows.select("row", text_col).join(few(wanted), "row").select("a", "piece", "b", text_col)
    texts = texts.repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first())
    found = written(texts.mapInArrow(run, "a long, b long"), "links")
    discard(wanted)
    return found


def roots(rows: DataFrame, marks: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, root) of the nodes of shingled rows that have near copies; root is the component's smallest node."""
    first = marks.groupBy("node").agg(F.min(F.struct("row", "n", "fp", "bands")).alias("f"))
    nodes = written(first.select("node", "f.*"), "nodes")
    inside = Window.partitionBy("bucket")
    buckets = nodes.select("node", F.explode("bands").alias("bucket")).withColumns({"least": F.min("node").over(inside), "nodes": F.count(F.lit(1)).over(inside)})
    buckets = written(buckets.where("nodes > 1").withColumn("parts", F.ceil(F.col("nodes") / SHARD)).withColumn("part", F.expr("pmod(node, parts)")).drop("nodes"), "buckets")
    candidates = written(nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "row", "n", "fp"), "candidates")
    discard(nodes)
    # The bucket's smallest node is in each part, so that near copies in different parts meet in the first round.
    part = F.expr("explode(CASE WHEN node = least THEN sequence(0L, parts - 1) ELSE array(part) END) AS shard")
    shards = buckets.select("bucket", part, "node").join(few(candidates), "node").select("bucket", "shard", "node", "fp", "n")
    firsts = written(in_shards(shards, 2, nearest).distinct(), "pairs")
    links = _similar(firsts, candidates, rows, text_col)
    rooted = written(candidates.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    mixed = buckets.select("bucket", "node").join(few(rooted.select("node", "root")), "node").groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = written(mixed.where("lo <> hi").select("bucket"), "mixed")
    both = F.expr("explode(transform(sequence(0L, parts - 1), x -> least(x, part) * parts + greatest(x, part))) AS shard")
    shards = buckets.join(mixed, "bucket", "left_semi").select("bucket", both, "node").join(few(rooted), "node").select("bucket", "shard", "node", "fp", "n", "root")
    rest = written(in_shards(shards, 2, apart).distinct().join(firsts, ["a", "b"], "left_anti"), "pairs")
    more = _similar(rest, candidates, rows, text_col)
    found = components(links.unionByName(more))
    discard(buckets, candidates, firsts, links, rooted, mixed, rest, more)
    return found


def near_copies(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """df with a unique row number and, written, (row, root): rows of one root are near copies, directly or by steps."""
    rows = numbered(df)
    marks = shingled(rows, text_col)
    found = marks.select("row", "node").join(roots(rows, marks, text_col), "node", "left")
    found = written(found.select("row", F.coalesce("root", "node").alias("root")), "found")
    discard(marks)
    return rows, found


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """A written table of row numbers, with a broadcast hint if it has at most ``most`` rows: then the texts that it is joined
    with stay where they are. Beyond that they are shuffled."""
    return F.broadcast(rows) if rows.count() <= most else rows
