import numpy as np

from boardstat.llm import forest

from .fixtures import components


def clustered(seed=3):
    """Random vectors, near copies of two of them, exact copies, and vectors that cannot link."""
    draw = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        centres = draw.normal(size=(60, 32))
        rows += [(v, label) for v in centres]
        rows += [(centres[0] + draw.normal(size=32) * s, label) for s in draw.uniform(0.05, 0.4, 150)]
        rows += [(centres[1] + draw.normal(size=32) * 0.2, label) for _ in range(30)]
        rows += [(centres[2] * 3, label), *[(centres[3], label)] * 4]
    rows = [([float(np.float32(x)) for x in v], label) for v, label in rows]
    good = len(rows)
    rows += [(None, 1), ([0.0] * 32, 1), ([float("nan")] * 32, 0), ([float("inf")] + [1.0] * 31, 0), ([None] + [1.0] * 31, 1),
             (rows[0][0], None), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)], good


def expected(rows, good):
    usable = rows[:good] + rows[-2:]
    links = []
    for k, (i, v, a) in enumerate(usable):
        for j, w, b in usable[k + 1:]:
            if a == b and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links.append((i, j))
    counts = dict.fromkeys((r[0] for r in rows), 0)
    for pair in links:
        for i in pair:
            counts[i] += 1
    return counts, components(list(counts), links)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, 5, "a") for i, v, x in rows],
                                 "vec_id long, embedding array<float>, label int, rep long, leaf string")


def test_links_against_brute_force(spark):
    rows, good = clustered()
    counts, known = expected(rows, good)
    for leaf_rows, trees in ((1024, 6), (16, 8)):  # one leaf; deep trees and dense leaves in blocks
        got = {r["vec_id"]: r for r in forest.near_vectors(frame(spark, rows), leaf_rows=leaf_rows, trees=trees,
                                                               block_rows=leaf_rows).collect()}
        assert got.keys() == counts.keys()
        found, all_links = sum(r["n_links"] for r in got.values()), sum(counts.values())
        assert all(got[i]["n_links"] <= n for i, n in counts.items())
        assert found >= 0.9 * all_links and (leaf_rows < 1024 or found == all_links)
        if found == all_links:
            assert {i: r["component_id"] for i, r in got.items()} == known
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_repeated_rows_are_vectors_of_their_own(spark):
    rows = frame(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)])
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in forest.near_vectors(rows).collect()) == [
        (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_empty_table(spark):
    assert forest.near_vectors(frame(spark, [])).collect() == []
    assert len(forest.near_vectors(frame(spark, [(1, None, None)])).collect()) == 1


def test_a_pair_counts_in_its_first_shared_leaf():
    a, b = np.array([[1, 5, -1], [2, 7, 9]]), np.array([[5, 8, -2], [7, 9, 11]])
    assert forest._first_shared(a, b, 5).tolist() == [True, True]
    assert forest._first_shared(a, b, 9).tolist() == [False, False]
    assert forest._first_shared(a, b, 7).tolist() == [False, True]


def test_deep_trees_keep_the_pairs_of_a_dense_group():
    """Depth 9 is what a label of 262,144 distinct vectors gets; a third of them are near copies of one vector."""
    draw, n, d = np.random.default_rng(5), 16_384, 64
    for noise in (0.23, 0.5):  # mean cosine within the group about 0.95 and 0.8
        vectors = draw.normal(size=(n, d)) / np.sqrt(d)
        vectors[:n // 3] = vectors[0] / np.linalg.norm(vectors[0]) + draw.normal(size=(n // 3, d)) * noise / np.sqrt(d)
        vectors[n // 6:n // 3] = vectors[:n // 3 - n // 6] + draw.normal(size=(n // 3 - n // 6, d)) * 0.35 / np.sqrt(d)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        a = np.r_[np.arange(n // 3 - n // 6), draw.integers(0, n // 6, 4000)]
        b = np.r_[np.arange(n // 3 - n // 6) + n // 6, draw.integers(0, n // 6, 4000)]
        near = (vectors[a] * vectors[b]).sum(axis=1) >= forest.THRESHOLD
        a, b = a[near], b[near]
        found = np.zeros(len(a), bool)
        for t in range(forest.TREES):
            rows, leaves = forest.grow(vectors, 9, t).leaves(vectors)
            held = [set() for _ in range(n)]
            for row, leaf in zip(rows.tolist(), leaves.tolist()):
                held[row].add(leaf)
            found |= np.array([bool(held[x] & held[y]) for x, y in zip(a, b)])
        assert len(a) > 1000 and found.mean() >= 0.999


def tables(n=16_000, d=64):
    """Vectors in all directions, of low rank, about a common mean, and with a third in one dense group; each with pairs
    planted near the threshold at the end."""
    draw = np.random.default_rng(8)
    made = {"all": draw.normal(size=(n, d)), "rank": draw.normal(size=(n, 8)) @ draw.normal(size=(8, d)),
            "mean": draw.normal(size=(n, d)) + draw.normal(size=d), "dense": draw.normal(size=(n, d))}
    made["dense"][:n // 3] = made["dense"][0] + draw.normal(size=(n // 3, d)) * 0.2
    for name, v in made.items():
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        a, b = np.arange(n - 1000, n - 500), np.arange(n - 500, n)
        v[b] = v[a] + draw.normal(size=(500, d)) * 0.36 / np.sqrt(d)
        v[b] /= np.linalg.norm(v[b], axis=1, keepdims=True)
        near = (v[a] * v[b]).sum(axis=1) >= forest.THRESHOLD
        yield name, v, a[near], b[near]


def test_pairs_found_and_pairs_compared():
    """The recall near the threshold, and the part of all pairs that the leaves of all trees compare."""
    for name, v, a, b in tables():
        depth = int(np.ceil(np.log2(len(v) / forest.LEAF)))
        found, compared = np.zeros(len(a), bool), 0
        for t in range(forest.TREES):
            rows, leaves = forest.grow(v, depth, t).leaves(v)
            compared += (np.bincount(leaves).astype(float) ** 2).sum() / len(v) ** 2
            held = [set() for _ in v]
            for row, leaf in zip(rows.tolist(), leaves.tolist()):
                held[row].add(leaf)
            found |= np.array([bool(held[x] & held[y]) for x, y in zip(a, b)])
        assert len(a) > 300 and found.mean() >= 0.97, (name, found.mean())
        # the dense group, a ninth of all pairs, is compared whole in the one or two leaves it has in each of the eight trees
        assert compared < (16 / 9 + 0.2 if name == "dense" else 0.2), (name, compared)
