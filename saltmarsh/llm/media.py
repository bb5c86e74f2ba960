"""Operator 10: media columns, through a Spark data source over archive directories.

Storing: each payload (UTF-8, zero bytes up to a positive multiple of 64) becomes a lossless 8-bit greyscale PNG, 64
samples wide; the images of a task go into ZIP archives of about ``ARCHIVE`` bytes in the shared folder. An archive is
written under its own name and counts only through the manifest, a table of the rows that successful tasks returned, so a
retried or lost task leaves nothing that is read.

Reading: ``spark.read.format("archive_members")`` plans byte ranges of about ``range_bytes`` over the archives of the
manifest, larger ones where there would be more than ``RANGES`` of them; no member list reaches the driver. The task of a range reads the archive's central directory, takes the
members whose offset falls into the range, reads each by its offset, checks its CRC-32, and streams payload batches as
Arrow. A member or directory that can't be read, or is read short, is tried again by itself, from its offset with a new
handle; when that fails ``retries`` times the task fails: nothing is dropped.

Features: byte mean and variance, share of zero bytes, and the steps between neighbouring rows, as whole numbers.

Defined results: null counts as empty, whose payload is 64 zero bytes; equal texts give equal values; texts of any
length are stored whole; repeated rows each give a row; a null doc_id keeps its row; an empty table gives none; columns
other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch, slices

WIDTH, ARCHIVE, RANGE, RANGES, RETRIES = 64, 32 << 20, 8 << 20, 100_000, 3
PNG = b"\x89PNG\r\n\x1a\n"


def filesystem(path: str):
    """(pyarrow file system, path in it); works for every scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + path)


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % WIDTH or WIDTH * (not data))


def to_png(data: bytes) -> bytes:
    """A greyscale image of 8-bit samples, WIDTH a row, without row filters."""
    height = len(data) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(height, WIDTH)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0))
    return PNG + head + chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made; raises ValueError for anything else."""
    if image[:8] != PNG:
        raise ValueError("no PNG")
    at, body, width, height = 8, b"", 0, 0
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        part = image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(data: bytes) -> str:
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    n, total = rows.size, int(rows.sum())
    variance = (n * int((rows * rows).sum()) - total * total) * 1000 // (n * n)
    steps = int(np.abs(np.diff(rows, axis=0)).sum()) * 1000 // max(1, n - WIDTH)
    return f"rows={len(rows)};mean={total * 1000 // n};var={variance};zeros={int((rows == 0).sum())};steps={steps}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE) -> str:
    """Writes the payloads of df's rows into archives; returns the manifest's path (path string, bytes long)."""
    spark = df.sparkSession
    folder, manifest = scratch(spark, "media"), scratch(spark, "manifest")
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        name, buffer, archive, n = "", io.BytesIO(), None, 0

        def close() -> pa.RecordBatch:
            nonlocal archive
            archive.close()
            archive = None
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(buffer.getbuffer())
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": buffer.tell()}], pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    name, buffer, n = f"{uuid.uuid4().hex}.zip", io.BytesIO(), 0
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                size = len((text or "").encode())
                archive.writestr(zipfile.ZipInfo(f"{n}/{'' if doc_id is None else doc_id}/{size}.png"), to_png(payload(text)))
                n += 1
                if buffer.tell() >= archive_bytes:
                    yield close()
                    buffer = io.BytesIO()
        if archive is not None:
            yield close()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(run, "path string, bytes long").write.parquet(manifest)
    return manifest


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    """Options: manifest (its path), range_bytes, retries."""

    def __init__(self, options: dict):
        self.manifest = options["manifest"]
        self.range_bytes, self.retries = int(options.get("range_bytes", RANGE)), int(options.get("retries", RETRIES))

    def partitions(self) -> list[ByteRange]:
        """Ranges of all archives; one row an archive of tens of MB is all that is read here."""
        import pyarrow.dataset as ds

        system, root = filesystem(self.manifest)
        rows = ds.dataset(root, filesystem=system, format="parquet").to_table().to_pylist()
        step = max(self.range_bytes, sum(r["bytes"] for r in rows) // RANGES)
        found = [ByteRange(r["path"], at, min(at + step, r["bytes"])) for r in sorted(rows, key=lambda r: r["path"]) for at in range(0, r["bytes"], step)]
        return found or [ByteRange("", 0, 0)]  # Spark asks for one partition at least

    def again(self, read: Callable[[], Any]) -> Any:
        """What read gives, tried again after an error of the storage or damaged bytes."""
        for attempt in range(self.retries + 1):
            try:
                return read()
            except (OSError, struct.error, zipfile.BadZipFile):
                if attempt == self.retries:
                    raise
                time.sleep(min(0.1 * 2**attempt, 2))

    def directory(self, system, path: str) -> list[zipfile.ZipInfo]:
        with system.open_input_file(path) as f:
            return zipfile.ZipFile(f).infolist()

    def member(self, system, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset."""
        with system.open_input_file(path) as f:
            head = f.read_at(30, info.header_offset)
            names, extra = struct.unpack_from("<HH", head, 26)
            data = f.read_at(info.compress_size, info.header_offset + 30 + names + extra)
        if head[:4] != b"PK\3\4" or len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise OSError(f"member {info.filename} of {path} at {info.header_offset} is damaged")
        return data

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, path = filesystem(partition.path)
        rows: list[tuple] = []
        size = 0
        for info in self.again(lambda: self.directory(system, path)):
            if not partition.start <= info.header_offset < partition.end:
                continue
            image = self.again(lambda info=info: self.member(system, path, info))
            _, doc_id, n_bytes = info.filename[:-4].split("/")
            rows.append((int(doc_id) if doc_id else None, int(n_bytes), image))
            size += len(image)
            if size > 4 << 20:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, n, images = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def load(spark: SparkSession, manifest: str, range_bytes: int = RANGE, retries: int = RETRIES) -> DataFrame:
    """(doc_id, n_bytes, media) of every member."""
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").options(manifest=manifest, range_bytes=range_bytes, retries=retries).load()


def described(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            images = batch.column(2).to_pylist()
            data = list(map(from_png, images))
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(map(len, data), pa.int64(), size=len(data)),
                pa.array(map(sha, data), pa.string(), size=len(data)),
                pa.array([zlib.crc32(d[-WIDTH:]) for d in data], pa.int64()),
                pa.array(map(len, images), pa.int64(), size=len(data)),
                pa.array(map(sha, images), pa.string(), size=len(data)),
                pa.array(map(feature, data), pa.string(), size=len(data)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(load(spark, store(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
