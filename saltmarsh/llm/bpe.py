"""Operator 5: byte-level BPE encoding and decoding through a lexicon transducer, with exact merges for unseen words.

The lexicon: words (parts between single spaces) are counted over all documents, the most frequent ``lexicon_words`` are
encoded once by exact merging and compiled into a minimal acyclic transducer (``lexicon.py``). It is written to the
shared folder and handed to executors as a Spark file; workers memory-map it. It decides speed, never results.

Encoding: many texts are cut at once, on the classes of their bytes, where a pre-token ends whatever stands around: at added
special tokens, before white space, around its last character, and between letters, numerals and other characters. So parts are
independent; each different part of the texts at hand is looked up in the transducer, and merged exactly if it isn't there.
A part of more than one pre-token goes through the pre-token pattern. Decoding maps ids to their bytes, in order, read as UTF-8.

Defined results: null counts as empty and has no ids; any text round-trips; texts are encoded whole at any length; of pairs
that rank alike the leftmost merges first; repeated rows each give a row; an empty table gives none; columns other than id
and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, sized_slices, written
from .lexicon import Lexicon, build

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Longest word that is merged among others.
SHORT = 48
#: Bytes of text that are encoded at once, and whose words are counted at once.
ENCODED_BYTES, COUNTED_BYTES = 1_000_000, 16 << 20
LEXICON_WORDS = 131_072
ID_BITS = 32
ID_MASK, NEVER = (1 << ID_BITS) - 1, 1 << 62


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


#: Classes of bytes: what isn't looked at (no white space), letters, numerals, others, the apostrophe of contractions, space,
#: other white space of one byte, white space of several bytes.
UNKNOWN, LETTER, NUMERAL, OTHER, APOSTROPHE, BLANK, WHITE, WIDE = range(8)


@lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each character below U+10000, as the pattern has it, and of each byte of a text; those of longer characters
    are left unknown."""
    chars = "".join("!" if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x10000))
    found = np.full(len(chars), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMERAL, r"\p{N}+"), (WIDE, r"\s+")):
        for m in regex.finditer(pattern, chars):
            found[m.start() : m.end()] = kind
    found[:128][found[:128] == WIDE] = WHITE
    found[ord(" ")], found[ord("'")] = BLANK, APOSTROPHE
    return found, np.concatenate((found[:128], np.full(128, UNKNOWN, np.uint8)))


@lru_cache(1)
def borders() -> np.ndarray:
    """Whether a part begins between bytes of two classes, at 8 times the first and the second."""
    found = np.zeros((8, 8), bool)
    found[:BLANK, BLANK:] = True
    # What follows white space other than a space, as it never belongs to the next pre-token.
    found[WHITE, :BLANK] = True
    for a in (LETTER, NUMERAL, OTHER):
        for b in (LETTER, NUMERAL, OTHER, APOSTROPHE):
            found[a, b] = a != b and (a, b) != (OTHER, APOSTROPHE)
    return found.ravel()


class Codec:
    """Exact encoder and decoder of a tokenizer file; with a lexicon it looks words up first."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        spec = json.load(open(path, encoding="utf-8"))
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level tokenizers without normalizer and prefix space")
        of = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(of[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.byte_ids = [vocab[c] for c in byte_letters()]
        #: pair of ids -> rank and new id in one number, which sorts by rank
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault((vocab[a], vocab[b]), rank << ID_BITS | vocab[a + b])
        self.bytes = {i: raw(s) for s, i in vocab.items()}
        self.special = {}
        for added in spec["added_tokens"]:
            if any(added[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError("only plain added tokens")
            self.special[added["content"]] = added["id"]
            self.bytes[added["id"]] = added["content"].encode()
        self.cut = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.lexicon = lexicon
        #: by id: the id with a comma after it, and its bytes
        self.id_lines = pa.array([b"%d," % i for i in range(max(self.bytes) + 1)], pa.large_binary())
        self.id_bytes = pa.array([self.bytes.get(i, b"") for i in range(len(self.id_lines))], pa.large_binary())
        # The same merges as sorted arrays, for many words at once.
        pairs = np.array(list(self.merges), np.int64).reshape(-1, 2)
        order = np.argsort(keys := pairs[:, 0] << ID_BITS | pairs[:, 1])
        self.pair_keys, self.pair_merges = keys[order], np.array(list(self.merges.values()), np.int64)[order]
        self.byte_array = np.array(self.byte_ids, np.int64)
        self.byte_merges = np.array([self.merges.get((a, b), NEVER) for a in self.byte_ids for b in self.byte_ids], np.int64)
        #: special tokens and the parts of the lexicon that were met; their ids, each with a comma after it; their bytes
        self.frequent = pa.array(list(self.special), pa.string())
        self.lines, self.raw = (t.take(pa.array(self.special.values(), pa.int64(), size=len(self.special))) for t in (self.id_lines, self.id_bytes))

    def merge(self, token: str) -> list[int]:
        """The ids of one pre-token: the lowest-rank pair merges first, leftmost of equals."""
        ids: list[int | None] = [self.byte_ids[b] for b in token.encode()]
        get = self.merges.get
        if len(ids) < 100:
            ranks = [get(p, NEVER) for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < NEVER:
                i = ranks.index(best)
                ids[i] = best & ID_MASK
                del ids[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), NEVER)
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            return ids
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            new = m & ID_MASK
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (m, i, new, ids[k]))
            if (h := before[i]) >= 0 and (m := get((ids[h], new))) is not None:
                heapq.heappush(heap, (m, h, ids[h], new))
        return [i for i in ids if i is not None]

    def merge_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many pre-tokens: all ids in order, and how many each has. Each round merges the best pair of every short one."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for k, w in enumerate(words):
            if len(w) > SHORT:
                long = self.merge(w)
                out.append((np.full(len(long), k), np.array(long, np.int64)))
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        data = [words[k].encode() for k in short]
        raw = np.frombuffer(b"".join(data), np.uint8)
        ids = self.byte_array[raw]
        word = np.repeat(np.array(short, np.int64), np.fromiter(map(len, data), np.int64, len(data)))

        def best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a << ID_BITS | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            return np.where(self.pair_keys[at] == key, self.pair_merges[at], NEVER)

        rank = np.full(len(ids), NEVER)  # of each symbol with the one after it
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.byte_merges[raw[inner].astype(np.int64) << 8 | raw[inner + 1]]
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            counts = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            done = least == NEVER
            if done.any():
                gone = np.repeat(done, counts)
                out.append((word[gone], ids[gone]))
                ids, word, rank = ids[~gone], word[~gone], rank[~gone]
                least, counts = least[~done], counts[~done]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, counts))
            at = hit[np.concatenate(([True], word[hit][1:] != word[hit][:-1]))]  # leftmost of each word
            ids[at] = least & ID_MASK
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            # The merged symbol takes the rank of the one that goes with what follows; both neighbours are ranked anew.
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))
            rank[at] = NEVER
            right = at[(at + 1 < len(ids)) & (word[np.minimum(at + 1, len(ids) - 1)] == word[at])]
            rank[right] = best(ids[right], ids[right + 1])
            left = at[(at > 0) & (word[at - 1] == word[at])]
            rank[left - 1] = best(ids[left - 1], ids[left])
        if not out:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, ids = (np.concatenate(x) for x in zip(*out))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def exact(self, text: str) -> list[int]:
        """The ids of a text without special tokens, through the pattern."""
        return [i for token in PATTERN.findall(text) for i in self.merge(token)]

    def _entries(self, ids: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
        """The lines and the bytes of parts, of which each has so many of the ids."""
        ends = np.concatenate(([0], np.cumsum(sizes)))
        found = (taken(texts, ids) for texts in (self.id_lines, self.id_bytes))
        return [pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at[ends]), data]) for data, at in found]

    def _merged(self, parts: list[str]) -> list[pa.Array]:
        # A word of letters, with or without a space before it, is one pre-token.
        tokens = [[p] if (p[1:] if p[0] == " " else p).isalpha() else PATTERN.findall(p) for p in parts]
        ids, sizes = self.merge_many([t for own in tokens for t in own])
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, tokens)])]
        return self._entries(ids, np.diff(ends))

    def entries(self, parts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of different parts, by numbers: lines (ids with a comma after each) and bytes; from those met, the transducer, or by merging."""
        at = pc.fill_null(pc.index_in(parts, value_set=self.frequent), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if self.lexicon is not None and len(new) and len(self.frequent) - len(self.special) < self.lexicon.n_words:
            numbers = self.lexicon.numbers(parts.take(pa.array(new)))
            met, new = new[numbers >= 0], new[numbers < 0]
            at[met] = len(self.frequent) + np.arange(len(met))
            lines, raw = self._entries(*self.lexicon.ids_of_all(numbers[numbers >= 0]))
            self.frequent = pa.concat_arrays([self.frequent, parts.take(pa.array(met))])
            self.lines, self.raw = pa.concat_arrays([self.lines, lines]), pa.concat_arrays([self.raw, raw])
        at[new] = len(self.frequent) + np.arange(len(new))
        lines, raw = self._merged(parts.take(pa.array(new)).to_pylist())
        return at, pa.concat_arrays([self.lines, lines]), pa.concat_arrays([self.raw, raw])

    def parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of which each can be encoded by itself; joined they are the texts. Special tokens are parts. Also the number of
        parts before each text and after the last."""
        texts = texts.cast(pa.string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
        if ends[0] == ends[-1]:
            return pa.array([], pa.string()), np.zeros(len(ends), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0])
        ends = ends - ends[0]
        of_char, of_byte = classes()
        kinds = of_byte[data]
        if len(wide := np.flatnonzero(data >= 0xC0)):
            first = data[wide]
            two, three = wide[first < 0xE0], wide[(first >= 0xE0) & (first < 0xF0)]
            kinds[two] = kinds[two + 1] = of_char[(data[two] & 31).astype(np.int32) << 6 | data[two + 1] & 63]
            kinds[three] = kinds[three + 1] = kinds[three + 2] = of_char[(data[three] & 15).astype(np.int32) << 12 | (data[three + 1] & 63).astype(np.int32) << 6 | data[three + 2] & 63]
        stops = np.zeros(len(data) + 1, bool)  # where the library splits before it looks for pre-tokens
        stops[ends] = True
        spans = []
        if self.cut is not None and self.cut.search(data):
            spans = [m.span() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()) for m in self.cut.finditer(data, a, b)]
            for a, b in spans:
                stops[a] = stops[b] = True
        begins = stops[:-1].copy()
        begins[1:] |= borders()[kinds[:-1] << 3 | kinds[1:]]
        # Of several white characters before a word the last is apart from those before it.
        white = kinds >= BLANK
        last = np.flatnonzero(white[1:-1] & white[:-2]) + 1
        begins[last[~white[last + 1] & ~stops[last + 1] & (kinds[last] != WIDE)]] = True
        for a, b in spans:
            begins[a + 1 : b] = False
        at = np.flatnonzero(begins)
        offsets = np.append(at, len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(at, ends)

    def encoded(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """Each text's ids joined by commas, and the bytes that these ids stand for."""
        parts, first = self.parts(texts)
        parts = parts.dictionary_encode()
        at, *entries = self.entries(parts.dictionary)
        numbers = at[parts.indices.to_numpy()]
        (lines, line_at), (raw, raw_at) = (taken(x, numbers) for x in entries)
        for a, b, c, d in zip(*(x[first[k : len(first) - 1 + k]].tolist() for x in (line_at, raw_at) for k in (0, 1))):
            yield bytes(lines[a : max(a, b - 1)]), bytes(raw[c:d])

    def encode(self, text: str) -> list[int]:
        return [int(i) for line, _ in self.encoded(pa.array([text], pa.string())) if line for i in line.split(b",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def taken(texts: pa.Array, numbers: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The texts of these numbers one after another, and where each begins, with the end of the last."""
    found = texts.take(pa.array(numbers))
    return found.buffers()[2] or pa.py_buffer(b""), np.frombuffer(found.buffers()[1], np.int64, len(found) + 1) if len(found) else np.zeros(1, np.int64)


@lru_cache(1)
def codec(path: str, lexicon: str | None) -> Codec:
    """A worker keeps the last one only: its memos are large. The lexicon is a Spark file: a new executor fetches it again."""
    return Codec(path, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def frequent_words(df: DataFrame, words: int = LEXICON_WORDS, text_col: str = "text") -> list[str]:
    """The most frequent parts between spaces in the whole table; at most ``words`` of them reach the driver.

    Every part is counted: a task first sums its own, so what is shuffled has one row a word and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 0, COUNTED_BYTES):
            found = pc.split_pattern(batch.column(0), " ").flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    counts = counted.where("length(word) between 1 and 48").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    # How many words there are at each step of the count, 8 steps to a doubling: a few hundred rows at any size. The
    # words above the step that still fits are collected; a sorted limit would send so many from every partition.
    counts = written(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "word-counts")
    total, least = 0, None
    for r in sorted(counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.step):
        total += r.n
        if total > words:
            break
        least = r.step
    if least is None:
        return []
    top = counts.where(F.col("step") >= least).select("word", "n").collect()
    return [r.word for r in sorted(top, key=lambda r: (-r.n, r.word))]


def publish(spark: SparkSession, data: bytes, name: str) -> str:
    """Writes the bytes into the shared folder and makes them a Spark file; returns the file's name."""
    path = f"{scratch(spark, name)}.bin"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def fit(df: DataFrame, tokenizer: str | None = None, words: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Builds and publishes the lexicon of df's frequent words; returns its Spark file's name."""
    exact = Codec(tokenizer or default_tokenizer())
    frequent = frequent_words(df, words, text_col)
    # A word's first part as a text's first and after a space, the other parts as they are.
    found, first = exact.parts(pa.array(frequent, pa.string()))
    found = found.to_pylist()
    heads = set(map(found.__getitem__, first[:-1].tolist())) - exact.special.keys()
    # A word in lower case seldom begins a text or line; without its space it needs no entry.
    parts = {" " + w for w in heads} | {w for w in heads if not w[0].islower()}
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        parts.update(found[a + 1 : b])
    parts = sorted(parts - exact.special.keys())
    return publish(df.sparkSession, build((p.encode(), exact.exact(p)) for p in parts), "lexicon")


def encode(df: DataFrame, tokenizer: str | None = None, lexicon: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``with_ids`` also ids array<int>; one row for each row of df."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, lexicon)
        for batch in sized_slices(batches, 1, ENCODED_BYTES):
            n, digests, decoded, ids = [], [], [], []
            for line, raw in own.encoded(batch.column(1)):
                n.append(line.count(b",") + 1 if line else 0)
                digests.append(hashlib.sha256(line).hexdigest())
                decoded.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(line, np.int32, sep=",") if line else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, lexicon=fit(docs))
