"""SimHash near-duplicates against brute force."""

import random
import re

import pytest
import xxhash

from saltmarsh.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(pairs):
    ids = {}
    for k, fp in pairs:
        ids.setdefault(fp & (1 << 64) - 1, []).append(k)
    fps, root = list(ids), {}

    def top(f):
        while root.get(f, f) != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    least = {}
    for f in fps:
        for k in ids[f]:
            if k is not None:
                least[top(f)] = min(k, least.get(top(f), k))
    return {f: least.get(top(f)) for f in fps}


def test_fingerprints(odd, real):
    for df in (odd, real):
        text = sorted(((r.doc_id is None, r.doc_id or 0, brute_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.fp & (1 << 64) - 1) for r in simhash.fingerprints(df).collect())
        assert got == text


def test_components_of_real_rows(real):
    rows = simhash.near_duplicates(real).collect()
    want = brute_components([(r.doc_id, r.fp) for r in rows])
    assert all(r.component_id == want[r.fp & (1 << 64) - 1] for r in rows)
    assert len(rows) == real.count() and len({r.component_id for r in rows}) < len(rows)


def test_components_of_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == 1
    assert by[3] == by[4] == by[6] == 3
    assert by[5] == 5
    assert sum(r.doc_id is None for r in rows) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_links_give_the_components_of_brute_force(spark, seed):
    rnd = random.Random(seed)
    fps = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        for _ in range(8):
            fps.add(base)
            for _ in range(rnd.choice([1, 1, 2, 3])):
                base ^= 1 << rnd.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    want = brute_components([(k, f) for k, f in enumerate(signed)])
    groups = {}
    for f in signed:
        groups.setdefault(want[f & (1 << 64) - 1], []).append(f)
    for members in groups.values():
        assert {found.get(f, f) for f in members} == {min(members)}


def test_a_dense_ball_is_one_component(spark):
    """Every fingerprint within two bits of a center: the hot shards of each choice of blocks."""
    fps = [0, *(1 << i for i in range(63)), *(1 << i | 1 << j for i in range(63) for j in range(i))]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.components(simhash.links(nodes)).collect()
    assert len(found) == len(fps) - 1 and {r.root for r in found} == {0}


def test_tree_follows_only_edges_within_the_radius():
    rnd = random.Random(3)
    values = [rnd.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.near(q, 2)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0


def test_registered_query_of_odd_rows(odd, folder):
    """Whole rows of op2 by brute force: fingerprints bit by bit, components by all pairs."""
    import xxhash

    from saltmarsh.llm import simhash

    rows = [(r.doc_id, r.text) for r in odd.collect()]

    def bits(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [bits(t) for _, t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                x, y = top[i], top[j]
                top = [y if t == x else t for t in top]
    want = [(k, f"{fps[i]:016x}", min((rows[j][0] for j in range(len(rows)) if top[j] == top[i] and rows[j][0] is not None), default=None)) for i, (k, _) in enumerate(rows)]
    got = simhash.op2_simhash(odd.sparkSession, folder(documents=odd)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
