"""Toxicity and language: held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import langid, toxicity

BASE = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.op6_language_id(spark, BASE).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 0.2 < len(held) / len(rows) < 0.3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, none, spark):
    model = langid.fit(spark.read.parquet(f"{BASE}/documents.parquet"))
    rows = langid.identify(odd, model).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (3, 4, 6)] == ["und"] * 3 and by[4].score == 0
    assert by[8].lang_pred != "und"
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.fit(none) == {}


def test_phrases_are_longest_matches():
    parser = langid.Parser({"x": np.frombuffer(b"banana", np.uint8).astype(np.uint32), "y": np.frombuffer(b"bandana", np.uint8).astype(np.uint32)})

    def brute(text, model):
        n = i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[i : j + 1] in model:
                j += 1
            i, n = max(j, i + 1), n + 1
        return n

    texts = ["banana", "anab", "nad", "zz", "bandanabanana", "a", "naznaz", ""]
    symbols = parser.symbols(np.array([ord(c) for t in texts for c in t], np.uint32))
    got = parser.phrases(symbols, np.array([len(t) for t in texts]))
    assert got.T.tolist() == [[brute(t, "banana"), brute(t, "bandana")] for t in texts]


def phrases_of(text, model, block):
    """Longest matches one after the other, by search in the text itself; a phrase ends with its block."""
    n = 0
    for at in range(0, len(text), block):
        part, i = text[at : at + block], 0
        while i < len(part):
            j = i
            while j < len(part) and part[i : j + 1] in model:
                j += 1
            i, n = max(j, i + 1), n + 1
    return n


def test_language_query_against_brute_force(spark, folder, none):
    """Whole rows of the registered query: labels, held-out flag, scores."""
    docs = spark.read.parquet(f"{BASE}/documents.parquet").where("n_chars < 1500").limit(120)
    docs = docs.union(spark.createDataFrame([(7_000, None, "en", "a", 0), (7_001, "12 -", None, "a", 4), (None, "der die das", "de", "a", 11), (7_002, "x", "en", None, 1)], none.schema))
    path = folder(documents=docs)
    model = {k: "".join(map(chr, v)) for k, v in langid.fit(docs).items()}
    bits = {k: np.log2(len(v) + 1) for k, v in model.items()}
    got = {r.doc_id: r for r in langid.op6_language_id(spark, path).collect()}
    for r in docs.collect():
        letters, _, n = langid.normalise([r.text or ""])
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        if not n[0]:
            assert tuple(got[r.doc_id]) == (r.doc_id, held, "und", 0.0)
            continue
        text = "".join(map(chr, letters))
        rate = {k: phrases_of(text, m, langid.BLOCK) * bits[k] / max(bits.values()) / len(text) for k, m in model.items()}
        best = min(sorted(rate), key=rate.get)
        assert (got[r.doc_id].held_out, got[r.doc_id].lang_pred) == (held, best)
        assert got[r.doc_id].score == pytest.approx(1 / sum(np.exp(-langid.SHARP * (x - rate[best])) for x in rate.values()))


def test_a_language_with_little_training_text(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    model = langid.fit(docs)
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r.text and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    for few in model:
        parser = langid.Parser({k: v[:500] if k == few else v for k, v in model.items()})
        named = [n for at in range(0, len(rows), 64) for n in parser.predict([r.text for r in rows[at : at + 64]])[0]]
        for lang in model:
            own = [n == lang for n, r in zip(named, rows) if r.lang == lang]
            assert sum(own) / len(own) >= 0.97


def test_training_text_comes_from_whole_texts(spark, none):
    """Pieces are drawn from everywhere in a text; bounds hold however long a text is and however often a row repeats."""
    text = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(17_000))
    docs = spark.createDataFrame([(1, text, "en", "a", 9)] * 3 + [(k, "kurz und gut", "de", "a", 9) for k in (1, 3, 5)], none.schema)
    got = langid.fit(docs, docs=2, pieces=40)
    assert 0.8 * 40 * langid.PIECE < len(got["en"]) <= 41 * langid.PIECE
    words = "".join(map(chr, got["en"])).split(chr(0))
    at = [i for i, w in enumerate(text.split()) if w in set(words)]
    assert min(at) < 2_000 and max(at) > 15_000
    assert langid.fit(docs, docs=1)["de"].tolist() == langid.normalise(["kurz und gut"])[0].tolist()


def test_model_of_a_large_alphabet_is_small():
    rnd = np.random.default_rng(1)
    zh = rnd.integers(0x4E00, 0x4E00 + 6_000, 20_000).astype(np.uint32)
    parser = langid.Parser({"zh": zh, "de": rnd.integers(97, 123, 20_000).astype(np.uint32)})
    assert parser.arcs.nbytes < 20e6
    assert parser.predict(["".join(map(chr, zh[70:75])) + "." + "".join(map(chr, zh[900:904])), "abc def ghi"])[0] == ["zh", "de"]


def test_a_text_is_parsed_in_blocks():
    parser = langid.Parser({"x": np.full(2000, ord("a"), np.uint32)})
    n = 3 * langid.BLOCK + 1
    assert parser.phrases(parser.symbols(np.full(n, ord("a"), np.uint32)), np.array([n])).tolist() == [[4.0]]


def test_normalise():
    letters, lengths, n = langid.normalise(["Ab,  c!", "", "12", "É"])
    assert letters.tolist() == [ord("a"), ord("b"), 0, ord("c"), 0, ord("é"), 0]
    assert lengths.tolist() == [5, 0, 0, 2] and n.tolist() == [3, 0, 0, 1]


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(*(spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels")))


def test_toxicity_of_held_out_rows(spark, model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    docs = docs.where(F.col("doc_id").isin(list(truth)))
    rows = toxicity.score(docs, model).collect()
    toxic, clean = [r for r in rows if truth[r.doc_id]], [r for r in rows if not truth[r.doc_id]]
    print(sum(r.score >= 0.7 for r in toxic), len(toxic), sum(r.score >= 0.7 for r in clean), len(clean))
    assert sum(r.score >= 0.7 for r in toxic) / len(toxic) > 0.85
    assert sum(r.score >= 0.7 for r in clean) / len(clean) < 0.02
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in toxic:
        if r.score > 0.9 and r.offending:
            s = r.offending[0]
            assert model.score(text[r.doc_id][s.start : s.end])[0] == pytest.approx(s.score)


def test_noisy_or():
    m = toxicity.Model({"bad$": 9.0, "worse$": 12.0}, -9.0)
    p, spans = m.score("all good here. bad words. worse words!\nfine")
    one = lambda z: 1 / (1 + np.exp(-z))
    assert p == pytest.approx(1 - (1 - one(-9)) ** 2 * (1 - one(0)) * (1 - one(3)))
    assert [(s, e) for s, e, _ in spans] == [(25, 37), (14, 24)]


def test_repeats_in_a_sentence_count_once():
    m = toxicity.Model({"meh$": 3.0}, -5.0)
    assert m.score("meh " * 50)[0] == pytest.approx(m.score("meh")[0])


def test_toxicity_of_odd_rows(odd, none, model):
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (3, 4))
    assert toxicity.score(none, model).count() == 0


def test_training_without_both_classes(spark, none, real):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    empty = toxicity.fit(real, labels)
    assert empty.weights == {} and {r.score for r in toxicity.score(real, empty).collect()} == {0.0}
    assert toxicity.fit(none, labels).weights == {}


def test_scores_depend_on_text_only(spark, model, real):
    moved = real.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"), "n_chars")
    assert sorted(r.score for r in toxicity.score(real, model).collect()) == sorted(r.score for r in toxicity.score(moved, model).collect())


def test_toxicity_query_is_the_models_score(spark, small=BASE):
    """Whole rows of the registered query, against noisy-or of sentences worked out apart from the model's code."""
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.op1_toxicity(spark, small).collect()}
    every = docs.collect()
    assert len(rows) == len(every)
    for r in every:
        clean = 1.0
        for sentence in toxicity.SENTENCE.findall(r.text or ""):
            z = model.bias
            for w in set(sentence.lower().split()):
                w = w.strip(toxicity.EDGES)
                z += sum(model.weights.get(f, 0.0) for f in ([w + "$", *(w[:n] for n in (4, 5, 6) if len(w) >= n)] if w else []))
            clean *= 1 - 1 / (1 + np.exp(-z))
        got = rows[r.doc_id]
        assert got.score == pytest.approx(1 - clean, abs=1e-9)
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and got.predicted == int(got.score >= 0.7)


def test_training_sample_is_bounded(spark, none):
    """Rows by sample, bytes by sample_bytes; a repeated id trains once."""
    seen = []
    texts = [(k, f"{'bad' if k % 2 else 'good'} text number {k}. " + "x" * 5_000, "en", "a", 9) for k in range(40)]
    docs = spark.createDataFrame(texts + [texts[1]] * 30 + [(1, "another text", "en", "a", 9)], none.schema)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    original = toxicity.train
    toxicity.train = lambda t, y, *a, **k: seen.append((t, y)) or original(t, y, *a, **k)
    try:
        toxicity.fit(docs, labels, sample_bytes=21_000)
        toxicity.fit(docs, labels, sample=10)
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = original
    for c in (0, 1):
        own = [t for t, y in zip(*seen[0]) if y == c]
        assert 1 <= len(own) <= 5 and sum(map(len, own)) <= 21_000
    assert len(seen[1][0]) < 25 and len(seen[2][0]) == len(set(seen[2][0])) > 20


def test_scores_are_the_same_in_every_process(tmp_path):
    import os
    import subprocess
    import sys

    code = "from saltmarsh.llm import toxicity as t\nx = [f'word{k % 17} bad{k % 5} thing{k % 3}. fine{k} here' for k in range(200)]\nm = t.train(x, [int(k % 5 == 0) for k in range(200)], rounds=30)\nprint([m.score(s) for s in x])"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    outs = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": s}, cwd=root, capture_output=True, text=True, check=True).stdout for s in "123"}
    assert len(outs) == 1 and len(outs.pop()) > 1_000
