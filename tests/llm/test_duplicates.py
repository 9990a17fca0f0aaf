"""MinHash and embedding near-dedup against brute force, with hot groups and odd rows."""

import random

import numpy as np
from conftest import DATA

from tapeloom.llm import embeddings, minhash
from tapeloom.llm import queries as Q
from tapeloom.llm.common import connected


def reached(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def brute(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, reached(ids, links)


def near_copies(seed, groups=6, copies=25, words=120):
    rng = random.Random(seed)
    texts, i = {}, 0
    for g in range(groups):
        base = [f"w{g}x{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
            texts[i * 7 % 1000003] = " ".join(copy).upper() if i % 3 else "  ".join(copy) + "\n"
            i += 1
    return texts


def test_minhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 6)  # groups of many blocks
    monkeypatch.setattr(minhash, "STAR", 5)
    for width, percent in ((3, 85), (5, 80), (1, 50)):
        texts = near_copies(width)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        sizes, parts = brute(texts, width, percent)
        rows = minhash.near_duplicates(df, width=width, percent=percent).collect()
        assert {r.doc_id: r.n_shingles for r in rows} == sizes
        assert {r.doc_id: r.component_id for r in rows} == parts
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_minhash_query_equals_its_sql(spark, duck, same_rows):
    same_rows(Q.op7_minhash_dedup(spark, DATA), duck.execute(Q.ORACLES["op7_minhash_dedup"]))


def test_minhash_odd_rows(spark):
    rows = [(5, None, 1), (6, "", 1), (7, "one two", 1), (8, "One  TWO\n", 1), (8, "One  TWO\n", 2), (None, "one two", 1), (9, "one", 1), (10, "long " * 50_000, 1), (3, "long " * 60_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert found == sorted([(5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (8, 1, 7, False), (None, 1, None, True), (9, 1, 9, True), (10, 1, 3, False), (3, 1, 3, True)], key=repr)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64) << np.uint64(1))
    b = np.unique(np.concatenate([a[:2700], rng.integers(0, 2**63, 300).astype(np.uint64) << np.uint64(1)]))
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12
    first, second = minhash.permutations()
    one = minhash.signature(a[:1])  # coordinates of one shingle are the second permutation, shifted
    place = int(first[a[0] >> np.uint64(43)])
    assert list(one[:3]) == [second[place][-1], second[place][-2], second[place][-3]]


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(2)
    order = list(range(200))
    rng.shuffle(order)
    edges = list(zip(order[:120], order[1:120], strict=False)) + [(order[130], x) for x in order[131:]] + [(5000, 5000), (None, 3)]
    found = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reached({x for e in edges if e[0] is not None for x in e}, [e for e in edges if e[0] is not None])
    assert found == want


def brute_vectors(rows):
    ok = [(i, lab, np.array(v, float) / np.abs(np.array(v, float)).max()) for i, lab, v in rows if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.array(v, float).any()]
    links = [(a, b) for x, (a, la, u) in enumerate(ok) for b, lb, v in ok[x + 1 :] if la == lb and len(u) == len(v) and u @ v / np.sqrt(u @ u * (v @ v)) >= 0.93]
    n = {i: 0 for i, *_ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, reached(list(n), links)


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(4)
    bases = rng.normal(size=(12, 16))
    rows = [(i, int(i % 2), (bases[i % 12] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3, 0.45])).tolist()) for i in range(240)]
    rows += [(1000, None, [1.0] * 16), (1001, 1, None), (1002, 1, [0.0] * 16), (1003, 1, [float("nan")] + [1.0] * 15), (1004, 1, [None] + [1.0] * 15), (1005, 1, [1.0, 2.0]), (1006, 1, [2.0, 4.0]), (1007, 1, []), (1008, 0, [1e200] * 16), (1009, 0, [3e-200] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    n, parts = brute_vectors(rows)
    found = embeddings.near_duplicates(df, exact=True).collect()
    assert {r.vec_id: r.n_links for r in found} == n and {r.vec_id: r.component_id for r in found} == parts
    found = embeddings.near_duplicates(df, cell_rows=20).collect()  # six cells, so that links cross them
    assert sum(r.n_links for r in found) >= 0.97 * sum(n.values()) and all(r.n_links <= n[r.vec_id] for r in found)
    assert sum(r.component_id == parts[r.vec_id] for r in found) >= 0.99 * len(found)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    again = embeddings.near_duplicates(df.union(df.filter("vec_id < 3"))).collect()
    assert all(r.n_links >= n[r.vec_id] for r in again) and len(again) == len(rows) + 3


def test_cells_prune_and_find(spark):
    """Few of all pairs are compared, three copies of a vector are made, and nearly all links at the threshold are found."""
    rng = np.random.default_rng(7)
    bases = rng.normal(size=(4000, 64))
    bases /= np.sqrt((bases * bases).sum(1, keepdims=True))
    noise = rng.normal(size=bases.shape)
    noise -= (noise * bases).sum(1, keepdims=True) * bases
    noise /= np.sqrt((noise * noise).sum(1, keepdims=True))
    x = np.concatenate([bases, 0.94 * bases + np.sqrt(1 - 0.94**2) * noise])
    c = embeddings.centres(x, len(x) // embeddings.CELL_ROWS)
    cells = embeddings.cells_of(x, c, embeddings.PROBES)
    assert cells.shape[1] == 3
    sizes = np.bincount(cells.ravel(), minlength=len(c))
    assert (sizes * sizes).sum() < 0.1 * len(x) ** 2
    found = (cells[:4000, :, None] == cells[4000:, None, :]).any((1, 2))
    assert found.mean() >= 0.9


def test_embedding_query_equals_its_sql(spark, duck, same_rows):
    same_rows(Q.op3_embedding_dedup(spark, DATA), duck.execute(Q.ORACLES["op3_embedding_dedup"]))
