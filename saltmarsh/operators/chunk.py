"""Chunking. Offsets are UTF-8 bytes.

Fixed windows of characters are Column expressions. Strategies whose state runs along the text are Arrow table functions:
a batch of texts in, one row a chunk out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from ..functions.text import trim_unicode
from .arrow import sized


@dataclass(frozen=True)
class ChunkConfig:
    """strategy: fixed_chars, fixed_tokens, paragraph or sentence."""

    strategy: str = "fixed_tokens"
    size: int = 256
    overlap: int = 32
    min_chunk_size: int = 20


def _step(size: int, overlap: int) -> int:
    return max(1, size - min(overlap, size - 1))


def _n(text: str) -> int:
    return len(text.encode())


def fixed_tokens(text: str, c: ChunkConfig) -> list[tuple[int, int, str]]:
    """Windows of ``size`` words; (start, end) in characters, inner white space kept."""
    spans, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    out, k = [], 0
    while c.size > 0 and k < len(spans):
        end = min(k + c.size, len(spans))
        piece = text[spans[k][0] : spans[end - 1][1]]
        if _n(piece.strip()) >= c.min_chunk_size or (not out and end == len(spans)):
            out.append((spans[k][0], spans[end - 1][1], piece))
        if end == len(spans):
            break
        k += _step(c.size, c.overlap)
    return out


def paragraph(text: str, c: ChunkConfig) -> list[tuple[int, int, str]]:
    """Ends at the second line feed in a row; any other character, white space too, starts the count anew."""
    out, start, feeds = [], None, 0
    for i, ch in enumerate(text):
        if ch == "\n":
            feeds += 1
            if feeds >= 2 and start is not None:
                piece = text[start:i].strip()
                if _n(piece) >= c.min_chunk_size:
                    out.append((start, i, piece))
                start = None
        else:
            feeds = 0
            if start is None and not ch.isspace():
                start = i
    if start is not None:
        piece = text[start:].strip()
        if _n(piece) >= c.min_chunk_size or not out:
            out.append((start, len(text), piece))
    return out


def sentence(text: str, c: ChunkConfig) -> list[tuple[int, int, str]]:
    """A short sentence is carried into the next; a short rest is joined to the last chunk by one space."""
    out, start, n = [], 0, len(text)
    for i, ch in enumerate(text):
        ends = ch == "\n" or ch in ".!?" and (i + 1 == n or text[i + 1].isspace() or text[i + 1] in "\"'")
        if ends:
            piece = text[start : i + 1].strip()
            if _n(piece) >= c.min_chunk_size:
                out.append((start, i + 1, piece))
                start = i + 1
    rest = text[start:].strip()
    if rest:
        if out and _n(rest) < c.min_chunk_size:
            first, _, last = out[-1]
            out[-1] = (first, n, f"{last} {rest}")
        else:
            out.append((start, n, rest))
    return out


STRATEGIES: dict[str, Callable] = {"fixed_tokens": fixed_tokens, "paragraph": paragraph, "sentence": sentence}


def chunk_text(text: str | None, config: ChunkConfig) -> list[tuple[int, int, str]]:
    """(start byte, end byte, chunk) of one text; blank texts have none."""
    if text is None or not text.strip():
        return []
    if config.strategy == "fixed_chars":
        n, out, at = len(text), [], 0
        while config.size > 0:
            end = min(at + config.size, n)
            piece = text[at:end]
            if _n(piece.strip()) >= config.min_chunk_size or (not out and end == n):
                out.append((at, end, piece))
            if end == n:
                break
            at += _step(config.size, config.overlap)
    else:
        out = STRATEGIES[config.strategy](text, config)
    if text.isascii():
        return out
    # Bytes before each character that a chunk begins or ends at, in one pass.
    at, before, n = 0, {}, 0
    for k in sorted({k for a, b, _ in out for k in (a, b)}):
        n += _n(text[at:k])
        at, before[k] = k, n
    return [(before[a], before[b], t) for a, b, t in out]


def chunk(docs: DataFrame, config: ChunkConfig = ChunkConfig(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, start_char, end_char, text, and the columns to keep of the chunk's document)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    if config.strategy == "fixed_chars":
        found = _fixed_chars(rows, config)
    else:
        schema = StructType().add("doc_id", rows.schema["doc_id"].dataType)
        for name, kind in (("chunk_index", IntegerType()), ("start_char", LongType()), ("end_char", LongType()), ("text", StringType())):
            schema = schema.add(name, kind)
        schema = StructType([*schema.fields, *rows.schema.fields[2:]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sized(batches, 1):
                source, index, start, end, text = [], [], [], [], []
                for row, t in enumerate(batch.column(1).to_pylist()):
                    for k, (a, b, piece) in enumerate(chunk_text(t, config)):
                        source.append(row)
                        index.append(k)
                        start.append(a)
                        end.append(b)
                        text.append(piece)
                of = [c.take(pa.array(source, pa.int32())) for c in (batch.column(0), *batch.columns[2:])]
                yield pa.RecordBatch.from_arrays(
                    [of[0], pa.array(index, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(text, pa.string()), *of[1:]],
                    schema.names,
                )

        found = rows.mapInArrow(run, schema)
    named = F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return found.select("doc_id", "chunk_index", named.alias("chunk_id"), "start_char", "end_char", "text", *[F.col("kept")[c].alias(c) for c in keep])


def _fixed_chars(rows: DataFrame, c: ChunkConfig) -> DataFrame:
    n, step, more = F.length("text"), _step(c.size, c.overlap), rows.columns[2:]
    rows = rows.where(trim_unicode(F.col("text")) != "").where(F.lit(c.size > 0))
    last = F.greatest(F.ceil((n - c.size) / F.lit(step)).cast("int"), F.lit(0))
    # All windows of a row, their byte offsets and their numbers stay in the row: repeated rows are documents by themselves.
    steps = F.transform(F.sequence(F.lit(0), last), lambda w: F.octet_length(F.substring(F.col("text"), w * step + 1, F.lit(step))).cast("long"))
    starts = F.aggregate(steps, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    x = rows.select("doc_id", "text", *more, last.alias("last"), starts.alias("starts"))
    piece = lambda w: F.substring(F.col("text"), w * step + 1, F.lit(c.size))
    windows = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.struct(w.alias("w"), piece(w).alias("piece"), F.element_at("starts", w + 1).alias("start_char")))
    long_enough = lambda s: F.octet_length(trim_unicode(s["piece"])) >= c.min_chunk_size
    good = F.filter(windows, long_enough)
    # A window that ends the text is kept, however short, where none before it was.
    kept = F.when(F.size(good) > 0, good).otherwise(F.filter(windows, lambda s: s["w"] == F.col("last")))
    found = x.select("doc_id", *more, F.posexplode(kept).alias("chunk_index", "c"))
    return found.select("doc_id", "chunk_index", "c.start_char", (F.col("c.start_char") + F.octet_length("c.piece")).alias("end_char"), F.col("c.piece").alias("text"), *more)
