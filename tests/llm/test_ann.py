import math
import random

import numpy as np
from data import SF001

from repochron.llm.ann import best, grow, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, every=20, k=20):
    size = 0
    seen = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            seen[i] = np.array(v, np.float32).astype(float)
            size = size or len(v)
    out = {}
    for q in sorted(i for i in seen if i % every == 0):
        scores = sorted(((-(seen[q] * v).sum(), i) for i, v in seen.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_best_takes_smaller_ids_at_ties():
    rows = np.array([[1.0, 0], [0, 1], [1, 0], [0.5, 0.5], [2, 0]])
    at, score = best(np.array([1.0, 0]), rows, np.array([9, 1, 3, 4, 5]), 3)
    assert at.tolist() == [4, 2, 0] and score.tolist() == [2, 1, 1]


def test_every_row_gets_a_leaf_in_every_tree():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=(500, 8)), np.ones((50, 8))))
    forest = grow(x[::2], float((x * x).sum(axis=1).max()), 5, 10)
    leaves = forest.route(x)
    assert leaves.shape == (550, 5) and leaves.min() >= 0 and leaves.max() < forest.leaves
    held = np.bincount(leaves.ravel(), minlength=forest.leaves)
    order = forest.probe(x[:3], held, 10 ** 9)
    assert all(sorted(o) == list(range(forest.leaves)) for o in order)
    # the first leaves popped are those that the query itself falls into
    assert set(forest.probe(x[:1], held, 1)[0]) <= set(leaves[0].tolist())


def test_recall_on_embeddings(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [tuple(r) for r in emb.collect()]
    want = expected(rows)
    for leaf in (512, 20):
        got = lists(nearest(emb, leaf=leaf))
        assert got.keys() == want.keys()
        found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert found >= 0.9 * sum(map(len, want.values()))
        exact = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
        for q, near in got.items():
            assert len(near) == 20 and all(abs((exact[q] * exact[i]).sum() - s) < 1e-12 for i, s in near)
            assert near == sorted(near, key=lambda p: (-p[1], p[0]))


def test_copies_ties_and_hot_leaves(spark):
    rng = random.Random(2)
    rows = [(i, [1.0, 2.0, 0.0], 0) for i in range(300)]
    rows += [(300 + i, [rng.choice([-1.0, 0.0, 1.0]), rng.choice([0.0, 1.0]), 1.0], 0) for i in range(200)]
    emb = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    for chunk in (4096, 3):
        assert lists(nearest(emb, chunk=chunk)) == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (1, [0.0, 0.0], 1), (2, None, 1), (3, [float("nan"), 1.0], 1),
            (4, [1.0, None], 1), (5, [1.0, 2.0, 3.0], 1), (6, [-1.0, 0.5], 1), (None, [1.0, 1.0], 1), (7, [], 1),
            (20, [1.0, 2.0], 1), (8, [float("inf"), 1.0], 1), (40, None, 1)]
    emb = spark.createDataFrame(rows, SCHEMA)
    assert lists(nearest(emb)) == {0: [(20, 5.0), (6, 0.0)], 20: [(0, 5.0), (6, 0.0)]}
    assert nearest(emb.limit(0)).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA)
    assert nearest(alone).count() == 0
