"""Operator 4: token counts of a SentencePiece BPE model, by heap-and-linked-list merging without identifiers.

A symbol list starts with one symbol a character; the adjacent pair that is the best-ranked piece (ties: leftmost) is
popped from a heap and merged, until none is left. The count is initial symbols minus merges, plus what byte fallback adds:
a symbol that is no piece of the vocabulary costs one token for each UTF-8 byte.

A text is cut only where no piece of the vocabulary could span the cut (read off the vocabulary: two characters that
never stand next to each other inside a piece), so counting the parts is exact; counts of parts are kept in a bounded memo.

Spaces: the model has identity normalisation, one dummy prefix space, and U+2581 for each space; an empty text has no token.

Defined results: null counts as empty; control and unknown characters fall back to bytes; U+2581 in the text is a space;
texts of any length are counted whole; of pairs that rank alike the leftmost merges first; repeated rows each give a row;
an empty table gives none; columns other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, slices

SPACE, LIMIT = "▁", 4096


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = found = 0
        while True:
            byte = data[at]
            at += 1
            found |= (byte & 127) << shift
            if byte < 128:
                return found
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at : at + n]
        at += n


class PieceCounter:
    """Counts tokens under one model file."""

    def __init__(self, path: str):
        import struct

        self.rank: dict[str, float] = {}
        kinds = {}
        for number, value in _fields(open(path, "rb").read()):
            if number != 1:
                continue
            piece, score, kind = "", 0.0, 1
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            kinds[piece] = kind
            if kind in (1, 4):
                self.rank[piece] = -score
        self.pairs = {(a, b) for p in self.rank for a, b in zip(p, p[1:])}
        self.split = re.compile(self._pattern())
        self.memo = Memo(self.count_part)

    def _pattern(self) -> str:
        """Parts that end where no piece can span: before a space after anything else, and between a letter and
        what is none, unless some piece has such a pair of characters."""
        chars = {c for pair in self.pairs for c in pair}
        numeral = "".join(re.escape(c) for c in sorted(chars) if re.match(r"[^\W\d_]", c) and not c.isalpha())
        mixed = any(a != SPACE and a.isalpha() != b.isalpha() for a, b in self.pairs)
        if any(a != SPACE and b == SPACE for a, b in self.pairs):
            return "(?s).+"
        if mixed:
            return f"(?s){SPACE}*[^{SPACE}]+|{SPACE}+"
        # [^\W\d_] is the letters and some numerals; those that stand in a piece go with the other characters.
        return f"{SPACE}*(?:[^\\W\\d_{numeral}]+|(?:[^{SPACE}\\w]+|[\\d_{numeral}]+)+)|{SPACE}+"

    def count_part(self, part: str) -> int:
        n = len(part)
        rank = self.rank
        symbols: list[str | None] = list(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        get = rank.get
        heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(part, part[1:])) if (r := get(a + b)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, piece = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != len(piece) or left + symbols[j] != piece:
                continue  # one of the two was merged since
            symbols[i], symbols[j] = piece, None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(piece + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, piece + symbols[k]))
            if (h := before[i]) >= 0 and (r := get(symbols[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, symbols[h] + piece))
        # Byte fallback: only single characters can be no pieces.
        return n - merges + sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in rank)

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo = self.memo
        return sum(map(memo.__getitem__, self.split.findall(SPACE + text.replace(" ", SPACE))))


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    """One for each model and worker."""
    return PieceCounter(path)


def count_tokens(df: DataFrame, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit); the model's path must be readable on every executor."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = pa.array(map(count, texts), pa.int64(), size=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
