import math
import random

import numpy as np

from tessera.llm import embeddings


def plain(rows, threshold=0.9):
    """Rows with distinct ids."""
    sound = {}
    for k, v in rows:
        if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            sound[k] = np.array(v, np.float32).astype(float)
    links = {k: set() for k, _ in rows}
    for a, x in sound.items():
        for b, y in sound.items():
            if a != b and len(x) == len(y) and np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)) >= threshold:
                links[a].add(b)
    root = {}
    for k in sorted(k for k, _ in rows if k is not None):
        if k not in root:
            todo = [k]
            while todo:
                n = todo.pop()
                if n not in root:
                    root[n] = k
                    todo += links[n]
    return sorted((k, len(links[k]), root[k], root[k] == k) for k, _ in rows if k is not None)


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    return [(int(i), (centres[r.integers(12)] * r.uniform(0.1, 9) + r.normal(size=dim) * r.choice([0.1, 0.4, 1.0])).tolist()) for i in r.permutation(n * 3)[:n]]


def held(spark, rows, **how):
    df = spark.createDataFrame([(k, v, 0, 1, 2) for k, v in rows], "vec_id long, embedding array<float>, id int, n int, cell int")
    return sorted(tuple(r) for r in embeddings.near_duplicates(df, **how).collect())


def test_against_all_pairs(spark):
    rows = vectors(400, 16, 1)
    assert held(spark, rows, tile=40) == plain(rows)
    assert held(spark, rows) == plain(rows)


def test_odd_vectors(spark):
    rows = vectors(60, 8, 2) + vectors(40, 5, 3)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1e-30] * 8, [1e30] * 8, [-0.0] * 7 + [1.0], [0.0] * 7 + [1.0], rows[0][1], rows[0][1]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    assert held(spark, rows) == plain(rows)


def test_repeats_nulls_and_empty(spark):
    assert held(spark, []) == []
    assert held(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    rows = [(4, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [2.0, 0.0])]
    assert held(spark, rows) == [(4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False)]
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == [(1, 0, 1, True), (None, 0, None, False)]


def test_leading_dimensions_bound_the_rest():
    r = random.Random(4)
    x = np.array([v for _, v in vectors(300, 32, 5)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(c >= 0.9)))}
    for _ in range(5):
        pairs, ends = set(), sorted({*r.sample(range(1, 32), r.randint(0, 4)), 32})
        for i, j, cos in embeddings.close_pairs(x, x, 0.9, ends):
            pairs |= set(zip(i.tolist(), j.tolist()))
            assert np.allclose(cos, c[i, j], atol=1e-12)
        assert pairs == want


def test_far_cells_are_passed_over():
    r = np.random.default_rng(6)
    boxes = [(low := r.uniform(-1, 1, 3), low + r.uniform(0, 0.3, 3)) for _ in range(60)]
    got = set(embeddings.near_cells(boxes, 0.45))
    inside = [b[0] + (b[1] - b[0]) * r.uniform(size=(400, 3)) for b in boxes]
    for i in range(60):
        for j in range(i, 60):
            if np.linalg.norm(inside[i][:, None] - inside[j][None], axis=2).min() <= 0.45:
                assert (i, j) in got
    assert len(got) < 60 * 61 / 2 * 0.6


def test_large_and_small_doubles(spark):
    """Components whose squares overflow or vanish, one pair right at the threshold."""
    at = [0.9, math.sqrt(1 - 0.81)]
    rows = [(1, [1e200, 0.0]), (2, [at[0] * 1e200, at[1] * 1e200]), (3, [1e-200, 0.0]), (4, [at[0] * 1e-200, at[1] * 1e-200]), (5, [0.0, 1e300]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(df).collect()}
    assert got[3] == got[6] == 1 and got[4] == got[2] and got[5] == 5
