"""Operator 6: language identification by cross-parsing against suffix automata.

Training: a bounded sample of the labelled documents outside the held-out part. Each language's first ``docs`` documents
by a hash key are cut, whole, into pieces of ``PIECE`` characters, and the first ``pieces`` of those by a hash key, from
wherever in the texts, make the language's training text. Its suffix automaton recognises exactly its substrings. Both
bounds are parameters, so what reaches the driver is bounded however long, many or repeated the documents are.

Cross-parsing: from each position the longest stretch that occurs in a language's text is one phrase; then the next begins.
A language explains a text well if it needs few phrases. A phrase points into the training text, so it costs the
logarithm of that text's length: languages with less training text can't win by it, nor lose. The fewest phrases, so
weighed and per character, win. Texts are parsed in blocks of ``BLOCK`` characters (a phrase ends with its block, for
all languages alike), so whole texts of any length are parsed, all blocks of a batch and all languages step by step
together in NumPy.

The automata are one hash table of arcs, (state, letter) to state, in open addressing: its size follows the training
text, whatever the alphabets. It is the only broadcast.

Normalised text: letters in lower case, each run of anything else one space. ``score`` is the winner's share of a softmax
over the phrase rates.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language first by
code point; without labelled text every text is ``und``; texts are parsed whole at any length; repeated rows each give
a row (and train as one document); an empty table gives none; columns other than id, text and lang aren't read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_key, remainder, slices

DOCS, PIECES, PIECE, BLOCK, UND = 400, 100, 200, 512, "und"
MOD, HELD = 4, 2
SHARP = 40.0


class _Letters:
    """Code point -> lower-case letter's code point, or 0 if it is none; made once for each worker."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            table = np.zeros(0x110000, np.uint32)
            for c in range(0x110000):
                ch = chr(c)
                if ch.isalpha():
                    low = ch.lower()
                    table[c] = ord(low) if len(low) == 1 else c
            cls.table = table
        return cls.table


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters with 0 for a space, lengths, letters counted) of the normalised texts, one after the other."""
    joined = "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = _Letters.get()[points]
    keep = low > 0
    keep[1:] |= low[:-1] > 0  # of other characters only the first after a letter
    at = np.concatenate(([0], ends))
    kept, letters = np.concatenate(([0], np.cumsum(keep))), np.concatenate(([0], np.cumsum(low > 0)))
    return low[keep], kept[at[1:]] - kept[at[:-1]], letters[at[1:]] - letters[at[:-1]]


class SuffixAutomaton:
    """States and transitions of the automaton of one text; every state is accepting for our purpose."""

    def __init__(self, text: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


class Arcs:
    """(state, symbol) -> state in open addressing; a missing arc is -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at, left = self.first(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            slot, who = np.unique(at[free], return_index=True)  # one key a slot, the others move on
            placed = left[free][who]
            self.keys[slot], self.values[slot] = keys[placed], values[placed]
            rest = ~np.isin(left, placed)
            left, at = left[rest], (at[rest] + 1) & (1 << self.bits) - 1

    def first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.first(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (1 << self.bits) - 1
            there = self.keys[at[left]]
            hit = there == keys[left]
            found[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return found

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.values.nbytes


class Parser:
    """The automata of all languages as one table of arcs; symbol 0 is any letter that no training text has."""

    def __init__(self, texts: dict[str, np.ndarray]):
        self.langs = sorted(texts)
        self.letters = np.unique(np.concatenate(list(texts.values()))) if texts else np.zeros(0, np.uint32)
        self.width = len(self.letters) + 1
        keys, values, self.roots, at = [], [], [], 0
        for lang in self.langs:
            automaton = SuffixAutomaton(self.symbols(texts[lang]).tolist())
            for state, arcs in enumerate(automaton.next):
                for c, to in arcs.items():
                    keys.append((state + at) * self.width + c)
                    values.append(to + at)
            self.roots.append(at)
            at += len(automaton.next)
        self.arcs = Arcs(np.array(keys, np.int64), np.array(values, np.int32))
        #: bits of a pointer into each language's text
        self.cost = np.log2([len(texts[lang]) + 1 for lang in self.langs])

    def symbols(self, letters: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return np.zeros(len(letters), np.int32)
        at = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        return np.where(self.letters[at] == letters, at + 1, 0).astype(np.int32)

    def phrases(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(languages, texts): phrases needed for each text."""
        n_lang = len(self.langs)
        per = -(-lengths // BLOCK)
        of = np.repeat(np.arange(len(lengths)), per)
        first = np.cumsum(lengths) - lengths
        nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        start = first[of] + nth * BLOCK
        size = np.minimum(lengths[of] - nth * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size, of = start[order], size[order], of[order]
        roots = np.repeat(np.array(self.roots, np.int32)[:, None], len(of), 1)
        state, count = roots.copy(), np.zeros((n_lang, len(of)), np.int32)
        # Blocks by falling size: those that go on are a prefix.
        live = np.searchsorted(-size, -np.arange(1, BLOCK + 1), side="right")
        for step in range(int(size[0]) if len(size) else 0):
            k = live[step]
            c = symbols[start[:k] + step]
            own = state[:, :k]
            to = self.arcs.get((own.astype(np.int64) * self.width + c).ravel()).reshape(own.shape)
            stuck = to < 0
            if stuck.any():
                lang, col = np.nonzero(stuck)
                count[lang, col] += own[lang, col] != roots[lang, col]
                again = self.arcs.get(roots[lang, col].astype(np.int64) * self.width + c[col])
                lost = again < 0
                again[lost] = roots[lang[lost], col[lost]]
                count[lang[lost], col[lost]] += 1  # a letter the language lacks is a phrase by itself
                to[lang, col] = again
            state[:, :k] = to
        count += state != roots
        total = np.zeros((n_lang, len(lengths)))
        for row in range(n_lang):
            total[row] = np.bincount(of, weights=count[row], minlength=len(lengths))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        letters, lengths, n_letters = normalise([t or "" for t in texts])
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts)
        rates = self.phrases(self.symbols(letters), lengths) * (self.cost / self.cost.max())[:, None] / np.maximum(lengths, 1)
        best = rates.argmin(0)
        weights = np.exp(-SHARP * (rates - rates.min(0)))
        score = 1 / weights.sum(0)
        named = [self.langs[b] if n else UND for b, n in zip(best.tolist(), n_letters.tolist())]
        return named, np.where(n_letters > 0, score, 0.0).tolist()


def fit(df: DataFrame, docs: int = DOCS, pieces: int = PIECES, mod: int = MOD, held: int = HELD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language -> normalised training text: of ``docs`` documents a language, ``pieces`` pieces of their whole texts.

    Keys are uniform, so a bound on the key leaves a few times ``docs`` of a language before anything is sorted or shuffled."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (remainder(F.col("doc_id"), mod) != held))
    bounds = {r.lang: int(min(1.0, 4 * docs / r.n) * (1 << 60)) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not bounds:
        return {}
    first = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    key, bound = hash_key("langid", F.col("doc_id")), F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")]
    few = rows.where(key < bound).withColumn("h", F.xxhash64("text"))
    chosen = few.select("doc_id", "lang", "h").distinct().withColumn("k", first(hash_key("langid", F.col("doc_id")), "doc_id", "h")).where(F.col("k") <= docs)
    whole = few.join(F.broadcast(chosen), ["doc_id", "lang", "h"], "left_semi").groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text"))  # docs rows a language at most
    cut = whole.select("doc_id", "lang", "h", F.explode(F.sequence(F.lit(0), F.expr(f"(length(text) - 1) div {PIECE}"))).alias("nth"), "text")
    cut = cut.select("doc_id", "lang", "h", "nth", F.substring(F.col("text"), F.col("nth") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    drawn = cut.withColumn("k", first(F.xxhash64("doc_id", "h", "nth"), "doc_id", "h", "nth")).where(F.col("k") <= pieces).select("lang", "k", "piece").collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(drawn, key=lambda r: (r.lang, r.k)):
        texts.setdefault(row.lang, []).append(row.piece)
    return {lang: text for lang, parts in texts.items() if len(text := normalise(parts)[0]) and text.any()}


def identify(df: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row of df; only the text decides."""
    parser = df.sparkSession.sparkContext.broadcast(Parser(model))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser.value
        for batch in slices(batches):
            named, score = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(remainder(F.col("doc_id"), MOD) == HELD, F.lit(False)).alias("held_out")
    return identify(docs, fit(docs)).select("doc_id", held, "lang_pred", "score")
