"""Near copies of the pipeline against brute force."""

import random

import corpus_pipeline
import numpy as np

from saltmarsh.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def changed(rnd, text, share):
    return " ".join(f"new{rnd.getrandbits(30)}" if rnd.random() < share else w for w in text.split())


def planted(docs, seed=4):
    """(text, copy) with a few words changed: most pairs at 0.8 or above, some below."""
    rnd, pairs = random.Random(seed), []
    for r in docs.select("text").orderBy("doc_id").collect():
        if r.text and 100 <= len(set(r.text.split())) and len(r.text.split()) <= 3_000:
            pairs += [(r.text, changed(rnd, r.text, share)) for share in (0.005, 0.01, 0.02, 0.05)]
    return pairs


def test_copies_with_a_few_changed_words_go(spark, real):
    near = [p for p in planted(real) if similarity(*p) >= 0.8]
    far = [p for p in planted(real) if similarity(*p) < 0.7]
    assert len(near) > 50 and len(far) > 10
    one = lambda k, t: (k, t, "en", "a", len(t))
    # Each pair by itself: words are told apart by the pair's number, so that only planted links are there.
    apart = lambda k, t: " ".join(f"{w}.{k}" for w in t.split())
    rows = [one(2 * k + c, apart(k, p[c])) for k, p in enumerate(near + far) for c in (0, 1)]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {2 * k for k in range(len(near + far))} | {2 * k + 1 for k in range(len(near), len(near + far))}


def test_links_give_the_components_of_brute_force(spark, real):
    rnd = random.Random(7)
    base = [r.text for r in real.where("n_chars between 600 and 3000").orderBy("doc_id").limit(12).collect()]
    texts = list(base)
    for _ in range(90):
        texts.append(changed(rnd, rnd.choice(texts), rnd.choice([0.01, 0.02, 0.04])))
    top = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if similarity(a, texts[j]) >= 0.8:
                x, y = top[i], top[j]
                top = [y if t == x else t for t in top]
    rows, found = shingles.near_copies(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))
    root = {r.k: r.root for r in rows.join(found, "row").collect()}
    assert len(root) == len(texts)
    assert all((root[i] == root[j]) == (top[i] == top[j]) for i in range(len(texts)) for j in range(i))
    assert 12 < len(set(top)) < len(texts)


def test_bands_find_what_is_at_the_threshold():
    rnd = np.random.default_rng(5)
    for n in (9, 90, 9_000):
        for _ in range(100):
            s = rnd.integers(0, 1 << 63, n, np.uint64)
            cut = n // 9  # the two share 7 parts of 9, a little below 0.8
            assert (shingles.bands(s[cut:]) == shingles.bands(s[: n - cut])).any()


def some_sets(rnd, n):
    """Sets of 40 to 60 numbers, most of them near copies of others, some twice."""
    sets = [rnd.integers(0, 1 << 63, 50, np.uint64)]
    while len(sets) < n:
        s = sets[rnd.integers(len(sets))].copy()
        at = rnd.choice(len(s), rnd.integers(0, 12), False)
        s[at] = rnd.integers(0, 1 << 63, len(at), np.uint64)
        sets.append(s[: max(40, len(s) - int(rnd.integers(0, 3)))])
    return sets


def test_trees_give_all_pairs_within_the_radius():
    rnd = np.random.default_rng(6)
    sets = some_sets(rnd, 150)
    fp = np.array([shingles.fingerprint(s) for s in sets], np.int64)
    n, node, root = np.array([len(s) for s in sets]), np.arange(150), rnd.integers(0, 4, 150)
    bits = lambda i, j: ((int(fp[i]) ^ int(fp[j])) & (1 << 64) - 1).bit_count()
    can = {(i, j) for j in range(150) for i in range(j) if bits(i, j) <= shingles.RADIUS and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j])}
    found = list(shingles.apart(node, fp, n, root))
    assert len(found) == len(set(found)) and set(found) == {(i, j) for i, j in can if root[i] != root[j]}
    assert 0 < len(found) < len(can) < 150 * 149 / 2
    firsts = list(shingles.nearest(node, fp, n))
    assert set(firsts) <= can and len({j for _, j in firsts}) == len(firsts) > 50


def test_the_radius_holds_what_is_at_the_threshold():
    rnd = np.random.default_rng(8)
    for n in (5, 100, 9_000):
        for _ in range(100):
            s = rnd.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + rnd.integers(0, 2, n, np.uint64)
            cut = n // 5  # the two share 0.8 of their union
            a, b = (shingles.fingerprint(x) & (1 << 64) - 1 for x in (s[cut:], s))
            assert (a ^ b).bit_count() <= shingles.RADIUS


def test_parts_of_a_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SHARD", 3)
    monkeypatch.setattr(shingles, "CHECKS", 2)
    words = [f"w{k}" for k in range(300)]
    # A chain: each differs from the one before in one place, so the first and the last are far apart.
    texts = []
    for k in range(30):
        words[10 * k] = f"new{k}"
        texts.append(" ".join(words))
    assert similarity(texts[0], texts[1]) >= 0.8 > similarity(texts[0], texts[-1])
    rows, found = shingles.near_copies(spark.createDataFrame(list(enumerate([*texts, "something else altogether here now"])), "k int, text string"))
    root = {r.k: r.root for r in rows.join(found, "row").collect()}
    assert len({root[k] for k in range(30)}) == 1 and root[30] != root[0]


def test_texts_of_files_are_not_copied(spark, real):
    rows, found = shingles.near_copies(real)
    assert set(real.inputFiles()) <= set(rows.inputFiles())
    assert rows.count() == real.count() == rows.select("row").distinct().count() == found.count()


def test_a_file_read_twice_has_rows_of_its_own(spark, real, none):
    path = real.inputFiles()[0]
    twice = spark.read.parquet(path, path)
    rows = shingles.numbered(twice)
    assert rows.select("row").distinct().count() == 2 * real.count()
    kept = [corpus_pipeline.drop_near_duplicates(spark, d.select(none.columns), "").select("doc_id").collect() for d in (real, twice)]
    assert sorted(kept[0]) == sorted(kept[1])
