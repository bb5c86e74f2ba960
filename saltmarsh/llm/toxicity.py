"""Operator 1: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is the logistic of the summed weights of its words; the
document's is the noisy-or of its sentences, 1 - product(1 - p). Only document labels are known: the gradient of
the noisy-or puts the blame for a toxic label on the sentences that explain it, and every sentence of a clean document
counts as clean. So the trained model also locates offending sentences.

Each distinct word of a sentence counts once; its weight sums those of its features: the word and its first 4 to 6
letters. Features are kept as strings, so there are no hash collisions and an unknown word weighs nothing.

Features enter training only if they stand in toxic documents more often than chance explains, so that a few labels
don't teach noise.

Training uses a bounded sample: about ``sample`` labelled documents of each class, by a bound on a hash key, outside the
held-out part, and of those in the key's order as many as have ``sample_bytes`` bytes of text together; classes are weighted
back halfway to their shares of all labelled documents. Training texts are read whole. Sums run in sorted order, so
the same tables give the same scores in every process.

Defined results: null and empty texts have no sentence and score 0; without labels of both classes every score
is 0; a label of several rows is toxic if one says so; of several texts of one id the one with the smallest hash trains;
texts are scored whole at any length; repeated rows each give a row and tie; an empty table gives none; columns other than
id, text and label aren't read, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, hash_key, remainder, slices

SAMPLE, SAMPLE_BYTES, MIN_DOCS, Z, ROUNDS = 2_000, 32 << 20, 4, 3.0, 150
THRESHOLD, SENTENCE_THRESHOLD = 0.7, 0.5
MOD, HELD = 3, 1
SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = "\"'()[]{}<>,;:*-_"


def features(word: str) -> tuple[str, ...]:
    """Of a lower-case word as it stands between white space; always in the same order."""
    w = word.strip(EDGES)
    return (w + "$", *(w[:n] for n in (4, 5, 6) if len(w) >= n)) if w else ()


class Model:
    """Weights of features, and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.memo = Memo(self.word, 100_000)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(v for f in features(word) if (v := get(f)))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence."""
        word = self.memo.__getitem__
        bias = self.bias
        # Each distinct word once, in the text's order: sums don't depend on the process.
        return [(m.start(), m.end(), bias + sum(map(word, dict.fromkeys(m[0].lower().split())))) for m in SENTENCE.finditer(text)]

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(probability of the document, offending sentences as (start, end, probability), worst first)."""
        if not text or not self.weights:
            return 0.0, []
        found = self.sentences(text)
        if not found:
            return 0.0, []
        z = np.array([s[2] for s in found])
        clean = -np.logaddexp(0, z).sum()  # log of the product of 1 - p
        cut = np.log(SENTENCE_THRESHOLD / (1 - SENTENCE_THRESHOLD))
        bad = sorted(((s, e, float(1 / (1 + np.exp(-v)))) for s, e, v in found if v >= cut), key=lambda x: (-x[2], x[0]))
        return float(-np.expm1(clean)), bad


def train(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), min_docs: int = MIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Fits by full-batch Adam on the noisy-or likelihood; weights: of a clean and of a toxic document."""
    if len(set(labels)) < 2:
        return Model({}, 0.0)
    words: dict[str, int] = {}
    parts: list[tuple[str, ...]] = []  # features by word
    token, sentence_of, doc_of = array("i"), array("i"), array("i")
    n_docs, n_toxic = Counter(), Counter()  # by feature
    for d, text in enumerate(texts):
        own = set()
        for m in SENTENCE.finditer(text):
            ids = list(dict.fromkeys([words.setdefault(w, len(words)) for w in m[0].lower().split()]))
            own.update(ids)
            token.extend(ids)
            sentence_of.extend([len(doc_of)] * len(ids))
            doc_of.append(d)
        parts += [features(w) for w in islice(words, len(parts), None)]
        found = set().union(*map(parts.__getitem__, own))
        n_docs.update(found)
        if labels[d]:
            n_toxic.update(found)
    # Features that stand in toxic documents more often than chance explains; the rest could only fit noise.
    rate = sum(labels) / len(labels)
    names = {f: k for k, f in enumerate(sorted(f for f, n in n_docs.items() if n >= min_docs and n_toxic[f] - n * rate >= Z * (n * rate * (1 - rate)) ** 0.5))}
    if not names:
        return Model({}, 0.0)
    pairs = array("i", (x for k, fs in enumerate(parts) for f in fs if f in names for x in (k, names[f])))
    pw, pf = np.array(pairs, np.int32).reshape(-1, 2).T
    token, sentence_of, doc_of = (np.array(x, np.int32) for x in (token, sentence_of, doc_of))
    y = np.array(labels)[: len(texts)]
    cost = np.where(y == 1, weights[1], weights[0])
    n_w, n_f, n_s = len(words), len(names), len(doc_of)
    theta, bias = np.zeros(n_f), -5.0
    m1, m2, b1, b2 = np.zeros(n_f + 1), np.zeros(n_f + 1), 0.9, 0.99
    for t in range(1, rounds + 1):
        word = np.bincount(pw, weights=theta[pf], minlength=n_w)
        z = bias + np.bincount(sentence_of, weights=word[token], minlength=n_s)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = -np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=len(y))
        some = np.maximum(-np.expm1(log_clean), 1e-9)
        # d loss / d z: p in a clean document, -p (1 - P) / P in a toxic one.
        pull = np.where(y == 1, -np.exp(log_clean) / some, 1.0) * cost
        gz = p * pull[doc_of]
        gw = np.bincount(token, weights=gz[sentence_of], minlength=n_w)
        grad = np.append(np.bincount(pf, weights=gw[pw], minlength=n_f) / len(y) + 1e-5 * theta, gz.sum() / len(y))
        m1, m2 = b1 * m1 + (1 - b1) * grad, b2 * m2 + (1 - b2) * grad * grad
        step = 0.25 * (m1 / (1 - b1**t)) / (np.sqrt(m2 / (1 - b2**t)) + 1e-8)
        theta, bias = theta - step[:-1], bias - step[-1]
    return Model({f: float(theta[k]) for f, k in names.items() if abs(theta[k]) > 0.02}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, mod: int = MOD, held: int = HELD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains on about ``sample`` documents of each class, ``sample_bytes`` of text at most (of one document at least); ids
    and sizes are chosen before any text is collected."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), mod) != held))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    there = known.join(rows.select("doc_id"), "doc_id", "left_semi")
    counts = {r.toxic: r["count"] for r in there.groupBy("toxic").count().collect()}
    # The keys are uniform, so a bound on the key takes about ``sample`` of a class, wherever its rows are; a sorted limit
    # would send so many from every partition.
    key = hash_key("toxic", F.col("doc_id"))
    wanted = F.lit(False)
    for c, n in counts.items():
        wanted = wanted | ((F.col("toxic") == c) & (key < int(min(1.0, sample / n) * (1 << 60))))
    labelled = {r.doc_id: r.toxic for r in there.where(wanted).collect()}
    picked = rows.where(F.col("doc_id").isin(list(labelled)) & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    # One text an id: the partial minima of a task are as many as the ids.
    sizes = picked.groupBy("doc_id").agg(F.min(F.struct("h", F.octet_length("text").alias("n"))).alias("least")).select("doc_id", "least.*", key.alias("key")).collect() if labelled else []
    chosen, total = {}, [0, 0]
    for r in sorted(sizes, key=lambda r: (r.key, r.doc_id)):
        c = labelled[r.doc_id]
        if not total[c] or total[c] + r.n <= sample_bytes:
            chosen[r.doc_id], total[c] = c, total[c] + r.n
    if len(set(chosen.values())) < 2:
        return Model({}, 0.0)
    least = F.create_map(*[F.lit(x) for r in sizes if r.doc_id in chosen for x in (r.doc_id, r.h)])[F.col("doc_id")]
    found = picked.where(F.col("doc_id").isin(list(chosen)) & (F.col("h") == least)).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    found = sorted(found, key=lambda r: r.doc_id)
    classes = Counter(chosen.values())
    # Halfway, in odds, between the sample's shares and those of all labels: a rare class isn't drowned.
    share = [(counts[c] / classes[c]) ** 0.5 for c in (0, 1)]
    mean = sum(share[c] * classes[c] for c in (0, 1)) / len(chosen)
    return train([r.text for r in found], [chosen[r.doc_id] for r in found], (share[0] / mean, share[1] / mean))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, offending array<start, end, score>) for each row of df, worst sentence first; only the text decides."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            found = [own.score(t) for t in batch.column(1).to_pylist()]
            bad = pa.array([[dict(zip(("start", "end", "score"), s)) for s in b] for _, b in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), bad], ["doc_id", "score", "offending"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, offending array<struct<start long, end long, score double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    held = F.coalesce(remainder(F.col("doc_id"), MOD) == HELD, F.lit(False)).alias("held_out")
    worst = F.try_element_at("offending", F.lit(1))
    return scored.select(
        "doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), worst["start"].alias("worst_start"), worst["end"].alias("worst_end")
    )
