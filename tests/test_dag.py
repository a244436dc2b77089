"""Commit-graph traversal against brute force on a small DAG with merges."""

import collections
import random

import pytest

from repochron import session
from repochron.operators import dag

# c0 <- c1 <- c2 <- c4 (merge of c2 and c3) <- c5 ; c1 <- c3 ; c6 root alone
PARENTS = {"c0": [], "c1": ["c0"], "c2": ["c1"], "c3": ["c1"], "c4": ["c2", "c3"], "c5": ["c4"], "c6": []}
REFS = {"c5": ["main"], "c3": ["v1", "a1"], "c6": ["z"]}


def brute_dist(start):
    dist, q = {start: 0}, collections.deque([start])
    while q:
        u = q.popleft()
        for p in PARENTS[u]:
            if p not in dist:
                dist[p] = dist[u] + 1
                q.append(p)
    return dist


def frames(spark):
    commits = spark.createDataFrame([("o", "r", h, p) for h, p in PARENTS.items()],
                                    "owner string, repo string, hash string, parents array<string>")
    refs = spark.createDataFrame([("o", "r", h, r) for h, rs in REFS.items() for r in rs],
                                 "owner string, repo string, hash string, ref string")
    return dag.parent_edges(commits), refs


def test_nearest_ref(spark):
    edges, refs = frames(spark)
    got = {r["hash"]: (r["depth"], r["ref"], r["name"]) for r in dag.nearest_ref(edges, refs).collect()}
    want = {}
    for h, rs in REFS.items():
        for r in rs:
            for c, d in brute_dist(h).items():
                if c not in want or (d, r) < want[c]:
                    want[c] = (d, r)
    assert {h: v[:2] for h, v in got.items()} == want
    assert got["c0"][2] == "a1~2" and got["c5"][2] == "main"


def test_tags_containing(spark):
    edges, refs = frames(spark)
    got = {(r["commit_hash"], r["tag"]) for r in
           dag.tags_containing(edges, refs.withColumnRenamed("ref", "tag")).collect()}
    want = {(c, r) for h, rs in REFS.items() for r in rs for c in brute_dist(h)}
    assert got == want


def random_history(rnd, n, merges=0.12):
    names = [f"n{i:03d}" for i in range(n)]
    parents = {}
    for i, h in enumerate(names):
        kind = rnd.random()
        if i == 0 or kind < 0.03:
            parents[h] = []
        elif kind < 0.03 + merges:
            parents[h] = rnd.sample(names[max(0, i - 20): i], min(rnd.choice((2, 2, 3)), i))
        else:
            parents[h] = [names[i - 1]]
    return parents


def walk(parents, start):
    dist, queue = {start: 0}, collections.deque([start])
    while queue:
        u = queue.popleft()
        for p in parents[u]:
            if p not in dist:
                dist[p] = dist[u] + 1
                queue.append(p)
    return dist


def check(spark, histories, refs, block):
    """``histories``: repo -> parents; ``refs``: (repo, hash, ref)."""
    commits = spark.createDataFrame([("o", r, h, p) for r, parents in histories.items() for h, p in parents.items()],
                                    "owner string, repo string, hash string, parents array<string>")
    tags = spark.createDataFrame([("o", *x) for x in refs], "owner string, repo string, hash string, ref string")
    edges = dag.parent_edges(commits)
    every = {}
    for repo, h, t in refs:
        for c, d in walk(histories[repo], h).items():
            every[repo, c, t] = min(d, every.get((repo, c, t), d))
    got = [(r["repo"], r["commit_hash"], r["tag"])
           for r in dag.tags_containing(edges, tags.withColumnRenamed("ref", "tag"), block=block).collect()]
    assert set(got) == set(every) and len(got) == len(every)
    best = {}
    for (repo, c, t), d in every.items():
        best[repo, c] = min(best.get((repo, c), (d, t)), (d, t))
    near = dag.nearest_ref(edges, tags, block=block).collect()
    assert {(r["repo"], r["hash"]): (r["depth"], r["ref"]) for r in near} == best and len(near) == len(best)


@pytest.mark.parametrize("block", [1000, 20])
def test_random_histories(spark, block):
    """In one block per repository, and cut into many blocks over several levels."""
    rnd = random.Random(6)
    a = random_history(rnd, 220)
    refs = [("a", h, t) for h, ts in {"n219": ["main"], "n070": ["t1"], "n071": ["t2", "t9"], "n020": ["t3", "t0"]}.items() for t in ts]
    check(spark, {"a": a, "b": random_history(rnd, 15), "c": random_history(rnd, 60, 0.5), "lone": {"x": []}},
          [*refs, ("b", "n010", "x"), ("c", "n059", "y"), ("c", "n003", "z"), ("lone", "x", "only")], block)


def ladder(n):
    """A merge at every commit: two lines, each commit has a parent in both."""
    return {f"{s}{i}": [f"{s}{i - 1}", f"{'ab'[s == 'a']}{i - 1}"] if i else [] for i in range(n) for s in "ab"}


def test_rounds_do_not_grow_with_merges(spark, monkeypatch):
    """Ladders of any length are one block; cut into blocks, written tables grow with the logarithm of the length."""
    tables = []

    def count(n, block):
        tables.clear()
        for name in ("write_through", "write_through_counted"):
            monkeypatch.setattr(dag, name, (lambda f: lambda df, label="": tables.append(label) or f(df, label))(getattr(session, name)))
        check(spark, {"r": ladder(n)}, [("r", f"a{n - 1}", "top"), ("r", f"b{n // 2}", "mid")], block)
        monkeypatch.undo()
        return len(tables)
    assert count(20, dag.BLOCK) == count(500, dag.BLOCK) <= 6
    few, many = count(64, 16), count(256, 16)
    assert many - few <= 22         # 2 runs x (2 doublings + at most 2 levels of 4 tables)


def test_refs_do_not_stay_in_the_smaller_graph(spark, monkeypatch):
    """Every commit is tagged: only the commits that blocks enter are laid out again."""
    laid = []
    monkeypatch.setattr(dag, "_layout", (lambda f: lambda commits, block: laid.append((commits.count(), block)) or f(commits, block))(dag._layout))
    check(spark, {"r": ladder(100)}, [("r", h, f"t{h}") for h in ladder(100) if h[0] == "a"], 40)
    assert max(block for _, block in laid) == 40 and sorted(n for n, _ in laid)[:2] == [8, 8]


def test_long_chains_are_followed_by_picked_commits(spark):
    rnd = random.Random(3)
    up = {f"n{i}": f"n{i - 1 if rnd.random() < 0.9 else rnd.randrange(i)}" for i in range(1, 300)}
    want = {("r", "n0"): 0, ("q", "y"): 0, ("q", "x"): 1}
    for i in range(1, 300):
        want["r", f"n{i}"] = want["r", up[f"n{i}"]] + 1
    rows = [("r", a, b, 0) for a, b in up.items()] + [("r", a, "n0", 1) for a in list(up)[5:9]] + [("q", "x", "y", 0)]
    edges = spark.createDataFrame(rows, "g string, a string, b string, pos int")
    got = dag.first_parent_depth(edges, chain=20).collect()
    assert {(r["g"], r["hash"]): r["at"] for r in got} == want and len(got) == len(want)
    ring = spark.createDataFrame([("r", f"n{i}", f"n{(i + 1) % 90}", 0) for i in range(90)], edges.schema)
    with pytest.raises(Exception, match="circle"):
        dag.first_parent_depth(ring, chain=20).collect()


@pytest.mark.parametrize("block", [1000, 1])
def test_a_circle_is_an_error(spark, block):
    ring = spark.createDataFrame([("o", "r", a, [b]) for a, b in (("x", "y"), ("y", "z"), ("z", "x"))],
                                 "owner string, repo string, hash string, parents array<string>")
    ref = spark.createDataFrame([("o", "r", "x", "main")], "owner string, repo string, hash string, ref string")
    with pytest.raises(Exception, match="circle"):
        dag.nearest_ref(dag.parent_edges(ring), ref, block=block).collect()


def test_no_edges_no_refs_and_null_parents(spark):
    commits = spark.createDataFrame([("o", "r", "x", []), ("o", "r", "y", ["x", None]), (None, "q", "z", ["w"])],
                                    "owner string, repo string, hash string, parents array<string>")
    edges = dag.parent_edges(commits)
    refs = spark.createDataFrame([("o", "r", "y", "v"), (None, "q", "z", "w"), ("o", "r", None, "n")],
                                 "owner string, repo string, hash string, ref string")
    assert sorted((r["repo"], r["hash"], r["name"]) for r in dag.nearest_ref(edges, refs).collect()) == [
        ("q", "w", "w~1"), ("q", "z", "w"), ("r", "x", "v~1"), ("r", "y", "v")]
    assert dag.nearest_ref(edges, refs.limit(0)).collect() == []
    assert [r["name"] for r in dag.nearest_ref(edges.limit(0), refs.where("repo = 'r'")).collect()] == ["v"]
