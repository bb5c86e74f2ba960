"""A versioned key-value store over an append-only change log of Parquet files and a manifest.

Log rows: seq BIGINT, key BINARY, value BINARY (null for a delete), is_delete BOOLEAN. The newest row of a key decides
(max_by on seq: hash aggregation with map-side partials); filters on the key commute with that and reach the scan.
Commits write data first and then one manifest line under a temporary name that is renamed, so readers see whole
versions; a DataFrame pins the version it was opened with: compaction leaves the files that it replaces, and ``vacuum``
deletes them once they are old enough that no reader can still use them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

SCHEMA = StructType([StructField("seq", LongType()), StructField("key", BinaryType()), StructField("value", BinaryType()), StructField("is_delete", BooleanType())])


class StoreError(Exception):
    """Root of the store's errors."""


class InvalidArgument(StoreError):
    """A bad option or operation."""


class Corruption(StoreError):
    """A manifest or file that can't be read."""


class NotFound(StoreError):
    """A key, document or entity that isn't there."""


class Conflict(StoreError):
    """A version that another writer has committed."""


class Closed(StoreError):
    """A store that was closed."""


@dataclass(frozen=True)
class Options:
    create_if_missing: bool = True
    target_file_bytes: int = 64 << 20
    levels: int = 7
    l0_files: int = 4
    base_level_bytes: int = 10 << 20
    level_factor: int = 10
    bloom_bits: int = 10


def latest(log: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key that is no delete: (key, value, seq)."""
    keys = keys or ("key",)
    newest = log.groupBy(*keys).agg(F.max_by(F.struct("value", "is_delete"), "seq").alias("v"), F.max("seq").alias("seq"))
    return newest.where(~F.col("v.is_delete")).select(*keys, F.col("v.value").alias("value"), "seq")


def bounds(start: Column | None = None, end: Column | None = None, key: str = "key") -> Column:
    """start <= key < end; an inverted or empty range holds nothing."""
    found = F.lit(True)
    if start is not None:
        found = found & (F.col(key) >= start)
    if end is not None:
        found = found & (F.col(key) < end)
    return found


def overlaps(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Closed key ranges that share a key."""
    return ~((a_max < b_min) | (b_max < a_min))


def scan(log: DataFrame, start: Column | None = None, end: Column | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Live rows of the range in key order; a reverse scan orders first and then cuts."""
    found = latest(log.where(bounds(start, end))).select("key", "value").orderBy(F.desc("key") if reverse else F.asc("key"))
    return found.limit(limit) if limit is not None else found


def prefix_scan(log: DataFrame, prefix: Column) -> DataFrame:
    return latest(log.where(F.startswith("key", prefix))).select("key", "value").orderBy("key")


def get(log: DataFrame, key: Column) -> DataFrame:
    """One row, or none if the key is deleted or unknown."""
    return latest(log.where(F.col("key") == key)).select("key", "value")


def merge_sources(*sources: DataFrame) -> DataFrame:
    """(key, value, src_idx) of ordered sources: of equal keys the source named first wins; deletes aren't known here."""
    every = None
    for k, source in enumerate(sources):
        part = source.select("key", "value", F.lit(k).alias("src_idx"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("key").agg(F.min_by("value", "src_idx").alias("value"), F.min("src_idx").alias("src_idx")).orderBy("key")


def compacted(log: DataFrame, bottom: bool) -> DataFrame:
    """The newest row of each key; deletes go only where no older data can be below."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("value", "is_delete"), "seq").alias("v"), F.max("seq").alias("seq"))
    rows = newest.select("seq", "key", "v.value", "v.is_delete")
    return rows.where(~F.col("is_delete")) if bottom else rows


def inspect(log: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts and key bounds, first rows by key)."""
    return (
        log.agg(F.count(F.lit(1)).alias("entries"), F.count_if("is_delete").alias("tombstones"), F.count_if(~F.col("is_delete")).alias("values"), F.min("key").alias("min_key"), F.max("key").alias("max_key")),
        log.orderBy("key", F.desc("seq")).limit(n),
    )


def pick_compaction(files: DataFrame, options: Options = Options()) -> dict | None:
    """files (file, level, bytes, min_key, max_key) -> {level, target, inputs} or None; the catalogue is small.

    Four files of level 0 go together with what they overlap on level 1; else the first file of the first level that is
    over its size, with what it overlaps below.
    """
    rows = sorted(files.collect(), key=lambda r: (r.level, r.min_key, r.file))
    of = lambda level: [r for r in rows if r.level == level]

    def task(level: int, inputs: list) -> dict:
        low, high = min(r.min_key for r in inputs), max(r.max_key for r in inputs)
        below = [r for r in of(level + 1) if not (r.max_key < low or high < r.min_key)]
        deeper = [r for r in rows if r.level > level + 1 and not (r.max_key < low or high < r.min_key)]
        return {"level": level, "target": level + 1, "inputs": [r.file for r in [*inputs, *below]], "bottom": not deeper}

    if len(of(0)) >= options.l0_files:
        return task(0, of(0))
    for level in range(1, options.levels - 1):
        if of(level) and sum(r.bytes for r in of(level)) > options.base_level_bytes * options.level_factor ** (level - 1):
            return task(level, of(level)[:1])
    return None


class KVStore:
    """Control plane: sequence numbers, the manifest, commits and compaction."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(self.path)):
            if not options.create_if_missing:
                raise InvalidArgument(f"{path} does not exist")
            self._fs.mkdirs(self._path(f"{self.path}/manifest"))
            self._fs.mkdirs(self._path(f"{self.path}/data"))
        self.closed = False
        self.version, self.last_seq, self.files = self._recover()

    def _recover(self) -> tuple[int, int, dict[str, dict]]:
        """Replays the manifest's edits in order; an edit that can't be read ends the replay."""
        version, last, files = 0, 0, {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/manifest")) if s.getPath().getName().endswith(".json"))
        # One job reads the whole folder; an edit is a few lines of JSON.
        texts = {r.name: r.value for r in self.spark.read.text(f"{self.path}/manifest/*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()} if names else {}
        for name in names:
            try:
                edit = json.loads(texts.get(name, ""))
                for gone in edit["deleted"]:
                    files.pop(gone, None)
                for f in edit["added"]:
                    files[f["file"]] = f
                version, last = edit["version"], max(last, edit["last_seq"])
            except (ValueError, KeyError):
                break
        return version, last, files

    def _commit(self, added: list[dict], deleted: list[str], last_seq: int) -> None:
        version = self.version + 1
        edit = json.dumps({"version": version, "last_seq": last_seq, "added": added, "deleted": deleted})
        final = self._path(f"{self.path}/manifest/{version:012d}.json")
        temp = self._path(f"{self.path}/manifest/.{version:012d}.tmp")
        out = self._fs.create(temp, True)
        out.write(bytearray(edit.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            raise Conflict(f"version {version} was committed by another writer")
        self.version, self.last_seq = version, last_seq
        for gone in deleted:
            self.files.pop(gone, None)
        self.files |= {f["file"]: f for f in added}

    def _write(self, rows: DataFrame, level: int, name: str, input_bytes: int = 0) -> dict:
        """One run of files, each of about target_file_bytes, split by ranges of the key where there are several."""
        path = f"{self.path}/data/{name}"
        if (parts := -(-input_bytes // max(1, self.options.target_file_bytes))) > 1:
            rows = rows.repartitionByRange(parts, "key")
        writer = rows.select(*SCHEMA.names).sortWithinPartitions("key", F.desc("seq")).write
        if self.options.bloom_bits:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(path)
        one = self.spark.read.schema(SCHEMA).parquet(path).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("s"), F.hex(F.min("key")).alias("a"), F.hex(F.max("key")).alias("b")).first()
        size = sum(s.getLen() for s in self._fs.listStatus(self._path(path)))
        return {"file": name, "level": level, "bytes": size, "rows": one.n, "max_seq": one.s or 0, "min_key": one.a or "", "max_key": one.b or ""}

    def log(self) -> DataFrame:
        """The change log as of now."""
        paths = [f"{self.path}/data/{f}" for f in sorted(self.files)]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def write(self, ops: DataFrame) -> int:
        """ops (op_idx, key, value, is_delete): one commit, sequence numbers in the order of op_idx; returns how many. The
        operations are evaluated once; what is committed is what was written."""
        if self.closed:
            raise Closed(self.path)
        rows = ops.withColumn("seq", F.col("op_idx").cast("long") + self.last_seq + 1).withColumn("value", F.when(~F.col("is_delete"), F.col("value")))
        name = f"l0-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"
        meta = self._write(rows, 0, name)
        if not meta["rows"]:
            self._fs.delete(self._path(f"{self.path}/data/{name}"), True)
            return 0
        self._commit([meta], [], meta["max_seq"])
        return meta["rows"]

    def write_batch(self, ops: list[tuple]) -> int:
        """("put", key, value) and ("delete", key); later operations on a key win; an empty batch does nothing."""
        rows = []
        for k, op in enumerate(ops):
            if op[0] not in ("put", "delete"):
                raise InvalidArgument(f"unknown operation {op[0]!r}")
            rows.append((k, bytearray(op[1]), bytearray(op[2]) if op[0] == "put" else None, op[0] == "delete"))
        if not rows:
            return 0
        return self.write(self.spark.createDataFrame(rows, "op_idx long, key binary, value binary, is_delete boolean"))

    def put(self, key: bytes, value: bytes) -> None:
        self.write_batch([("put", key, value)])

    def delete(self, key: bytes) -> None:
        self.write_batch([("delete", key)])

    def get(self, key: bytes) -> bytes | None:
        row = get(self.log(), F.lit(bytearray(key))).first()
        return None if row is None else bytes(row.value)

    def scan(self, start: bytes | None = None, end: bytes | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
        as_lit = lambda b: None if b is None else F.lit(bytearray(b))
        return scan(self.log(), as_lit(start), as_lit(end), limit, reverse)

    def catalogue(self) -> DataFrame:
        rows = [(f["file"], f["level"], f["bytes"], bytearray.fromhex(f["min_key"]), bytearray.fromhex(f["max_key"])) for f in self.files.values()]
        return self.spark.createDataFrame(rows, "file string, level int, bytes long, min_key binary, max_key binary")

    def stats(self) -> dict:
        levels: dict[int, int] = {}
        for f in self.files.values():
            levels[f["level"]] = levels.get(f["level"], 0) + 1
        return {"version": self.version, "last_sequence": self.last_seq, "files_per_level": levels, "bytes": sum(f["bytes"] for f in self.files.values())}

    def compact(self, passes: int = 100) -> int:
        """Runs compactions until none is due; returns how many ran. Replaced files stay for open readers until vacuum()."""
        done = 0
        for _ in range(passes):
            task = pick_compaction(self.catalogue(), self.options)
            if task is None:
                break
            log = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/data/{f}" for f in task["inputs"]])
            meta = self._write(compacted(log, task["bottom"]), task["target"], f"l{task['target']}-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}", sum(self.files[f]["bytes"] for f in task["inputs"]))
            self._commit([meta], task["inputs"], self.last_seq)
            done += 1
        return done

    def vacuum(self, older_than: float = 7 * 86_400) -> int:
        """Deletes runs that the current version doesn't name and that were last changed so many seconds ago; returns how
        many. Readers that are older than that must open the store anew."""
        now, gone = self.spark.sparkContext._jvm.System.currentTimeMillis(), 0
        for s in self._fs.listStatus(self._path(f"{self.path}/data")):
            if s.getPath().getName() not in self.files and now - s.getModificationTime() >= older_than * 1000:
                gone += self._fs.delete(s.getPath(), True)
        return gone

    def flush(self) -> int:
        """The current version; every commit is already durable."""
        return self.version

    def close(self) -> None:
        """Every commit is already durable; later writes fail."""
        self.closed = True

    def options_dict(self) -> dict:
        return asdict(self.options)


def bloom_bits(keys: DataFrame, bits_per_key: int = 10) -> tuple[DataFrame, int, int]:
    """(set bits, number of bits, hashes) of a Bloom filter with double hashing on crc32, as one aggregation."""
    n = keys.count()
    m, k = max(64, n * bits_per_key), min(30, max(1, round(bits_per_key * 0.69314718056)))
    return keys.select(F.explode(bloom_positions(F.col("key"), m, k)).alias("bit")).distinct(), m, k


def bloom_positions(key: Column, m: int, k: int) -> Column:
    h1 = F.crc32(key)
    h2 = F.crc32(F.concat(key, F.lit(bytearray(b"\x01")))) % F.lit(m - 1) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (h1 + i * h2) % F.lit(m))


def might_contain(probes: DataFrame, bits: DataFrame, m: int, k: int) -> DataFrame:
    """Probes (key) whose bits are all set."""
    hit = probes.select("key", F.explode(F.array_distinct(bloom_positions(F.col("key"), m, k))).alias("bit"))
    need = probes.select("key", F.size(F.array_distinct(bloom_positions(F.col("key"), m, k))).alias("need"))
    found = hit.join(bits, "bit", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return need.join(found, "key").where("n = need").select("key")
