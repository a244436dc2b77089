"""Commit-graph traversal.

The graph is an edge table ``(key, child, parent, pos)`` exploded from the ``parents`` arrays; refs are
walked from child to parent. Histories are cut into blocks of commits:

* A repository of up to ``block`` parent edges is one block. All such repositories are solved by one shuffle:
  a task takes block after block and visits its commits once, children first.
* A larger one is laid out by the depth of its first-parent chains (a fourth of the commits is picked, the others follow their chain
  to the next one, and the picked ones are a shorter chain) and cut into blocks of commits that lie next to each other. Each block
  is reduced to its *entries*, the commits that have a child in another block, with an edge from each to every commit outside that it
  reaches through the block (the hops are kept), and its refs to the labels that they bring to commits outside. What is left is a
  smaller graph of entries, which is laid out and cut again until it is one block. Its labels are then handed back down, level by
  level, each block once more by itself.

So the number of rounds grows with the logarithm of the commits, not with their number of merges, and a task holds one
block. Only where a history is so wide that cutting it leaves most commits as entries does the next block grow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repochron.operators.ordered import ordered_scan
from repochron.session import write_through, write_through_counted

KEY = ("owner", "repo")
BLOCK = 1 << 16     # parent edges of a repository, or commits of a block, that one task visits at once
CHAIN = 1 << 16     # commits whose chains one task follows to their ends
PICKED = 4          # of longer chains one commit of so many is picked


def parent_edges(commits: DataFrame, key: Sequence[str] = KEY, hash_col: str = "hash",
                 parents_col: str = "parents") -> DataFrame:
    """One row per (child, parent) with the parent's position."""
    return commits.select(*key, F.col(hash_col).alias("child"),
                          F.posexplode(parents_col).alias("pos", "parent"))


def with_parent_dates(commits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Edges with the parent's committer date (self equi join on hash)."""
    e = parent_edges(commits, key)
    p = commits.select(*key, F.col("hash").alias("parent"),
                       F.col("committer_date").alias("parent_committer_date"))
    return e.join(p, [*key, "parent"], "left")


# --- one block -------------------------------------------------------------------------
#: Rows of a block: an edge ``a -> b`` (``hops``; ``out`` if b lies in another block), an entry ``a``, or a label (``hops``, ``ref``)
#: of ``a``.
ROW = "g string, block long, kind string, a string, b string, hops long, out boolean, ref string"
LABEL = "g string, hash string, depth long, ref string"


class _Block:
    def __init__(self):
        self.ids: dict[str, int] = {}
        self.edges: list[tuple[int, int, int]] = []
        self.leaving: list[tuple[int, str, int]] = []
        self.entries: list[int] = []
        self.labels: list[tuple[int, int, str]] = []

    def add(self, kind: str, a: str, b: str | None, hops: int | None, out: bool | None, ref: str | None) -> None:
        i = self.ids.setdefault(a, len(self.ids))
        if kind == "label":
            self.labels.append((i, hops, ref))
        elif kind == "entry":
            self.entries.append(i)
        elif out:
            self.leaving.append((i, b, hops))
        else:
            self.edges.append((i, self.ids.setdefault(b, len(self.ids)), hops))

    def order(self) -> tuple[list[int], list[list[tuple[int, int]]]]:
        """Commits, children first, and each one's parents in the block."""
        parents: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        waiting = [0] * len(self.ids)
        for a, b, hops in self.edges:
            parents[a].append((b, hops))
            waiting[b] += 1
        order = [i for i, n in enumerate(waiting) if not n]
        for i in order:
            for b, _ in parents[i]:
                waiting[b] -= 1
                if not waiting[b]:
                    order.append(b)
        if len(order) < len(parents):
            raise ValueError("the parent edges run in a circle")
        return order, parents

    def _best(self, order: list[int], parents: list[list[tuple[int, int]]]) -> list[tuple[int, str] | None]:
        best: list[tuple[int, str] | None] = [None] * len(order)
        for i, hops, ref in self.labels:
            if best[i] is None or (hops, ref) < best[i]:
                best[i] = (hops, ref)
        for i in order:
            if best[i] is not None:
                depth, ref = best[i]
                for b, hops in parents[i]:
                    if best[b] is None or (depth + hops, ref) < best[b]:
                        best[b] = (depth + hops, ref)
        return best

    def nearest(self) -> Iterator[tuple[str, int, str]]:
        """(hash, hops, ref): the nearest label, ties by name."""
        best = self._best(*self.order())
        return ((h, *best[i]) for h, i in self.ids.items() if best[i] is not None)

    def nearest_reduced(self) -> Iterator[tuple[str | None, str, int, str | None]]:
        """``reduced``, and (null, commit outside, hops, ref): the nearest label that the block brings there."""
        order, parents = self.order()
        yield from self.reduced(order, parents)
        best, found = self._best(order, parents), {}
        for i, b, hops in self.leaving:
            if best[i] is not None:
                label = (best[i][0] + hops, best[i][1])
                found[b] = min(found.get(b, label), label)
        yield from ((None, b, *label) for b, label in found.items())

    def _held(self, order: list[int], parents: list[list[tuple[int, int]]]) -> tuple[list[int], list[str]]:
        names = sorted({ref for _, _, ref in self.labels})
        bit = {ref: 1 << k for k, ref in enumerate(names)}
        held = [0] * len(order)
        for i, _, ref in self.labels:
            held[i] |= bit[ref]
        for i in order:
            if held[i]:
                for b, _ in parents[i]:
                    held[b] |= held[i]
        return held, names

    def every(self) -> Iterator[tuple[str, int, str]]:
        """(hash, 0, ref): all labels that reach a commit; sets are bits of one number per commit."""
        held, names = self._held(*self.order())
        return ((h, 0, ref) for h, i in self.ids.items() for ref in _of_bits(held[i], names))

    def every_reduced(self) -> Iterator[tuple[str | None, str, int, str | None]]:
        """``reduced``, and (null, commit outside, 0, ref): all labels that the block brings there."""
        order, parents = self.order()
        yield from self.reduced(order, parents)
        (held, names), found = self._held(order, parents), {}
        for i, b, _ in self.leaving:
            found[b] = found.get(b, 0) | held[i]
        yield from ((None, b, 0, ref) for b, bits in found.items() for ref in _of_bits(bits, names))

    def reduced(self, order: list[int], parents: list[list[tuple[int, int]]]) -> Iterator[tuple[str, str, int, None]]:
        """(entry, commit outside, hops, null): the fewest hops through this block."""
        leaving: dict[int, list[tuple[str, int]]] = {}
        for i, b, hops in self.leaving:
            leaving.setdefault(i, []).append((b, hops))
        place, names = {i: k for k, i in enumerate(order)}, {i: h for h, i in self.ids.items()}
        for entry in set(self.entries):
            hops_to, found = {entry: 0}, {}
            for i in order[place[entry]:]:
                if i in hops_to:
                    for b, hops in parents[i]:
                        hops_to[b] = min(hops_to.get(b, hops_to[i] + hops), hops_to[i] + hops)
                    for b, hops in leaving.get(i, ()):
                        found[b] = min(found.get(b, hops_to[i] + hops), hops_to[i] + hops)
            yield from ((names[entry], b, hops, None) for b, hops in found.items())


def _of_bits(bits: int, names: Sequence[str]) -> Iterator[str]:
    while bits:
        low = bits & -bits
        yield names[low.bit_length() - 1]
        bits ^= low


def _by_block(batches: Iterator[pa.RecordBatch], result: str, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> what ``_Block.<result>`` gives for each block."""
    kinds = {"hash": pa.string(), "a": pa.string(), "b": pa.string(), "ref": pa.string()}
    at, block, out = None, None, []

    def batch():
        rows = list(zip(*out)) or [()] * (len(names) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64()) if n != "g" else pa.string())
                                           for n, c in zip(["g", *names], rows)], names=["g", *names])

    for b in batches:
        for g, k, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (g, k) != at:
                if block is not None:
                    for found in getattr(block, result)():
                        out.append((at[0], *found))
                        if len(out) >= 1 << 16:
                            yield batch()
                            out = []
                at, block = (g, k), _Block()
            block.add(*row)
    if block is not None:
        for found in getattr(block, result)():
            out.append((at[0], *found))
            if len(out) >= 1 << 16:
                yield batch()
                out = []
    yield batch()


def _solve(rows: DataFrame, result: str) -> DataFrame:
    """All blocks, each in one task, sorted so that a task meets the rows of a block together."""
    smaller = result.endswith("_reduced")
    names = ["a", "b", "hops", "ref"] if smaller else ["hash", "depth", "ref"]
    schema = "g string, a string, b string, hops long, ref string" if smaller else LABEL
    dealt = rows.repartition("g", "block").sortWithinPartitions("g", "block")
    return dealt.mapInArrow(lambda batches: _by_block(batches, result, names), schema)


def _rows(edges: DataFrame | None = None, labels: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Rows of ``ROW``; edges bring ``g, block, a, b, hops, out``, the others ``g, block, hash`` and what they hold."""
    null = [F.lit(None).cast("string").alias("b"), F.lit(None).cast("boolean").alias("out")]
    parts = []
    if edges is not None:
        parts.append(edges.select("g", "block", F.lit("edge").alias("kind"), "a", "b", "hops", "out", F.lit(None).cast("string").alias("ref")))
    if labels is not None:
        parts.append(labels.select("g", "block", F.lit("label").alias("kind"), F.col("hash").alias("a"), null[0],
                                   F.col("depth").alias("hops"), null[1], "ref"))
    if entries is not None:
        parts.append(entries.select("g", "block", F.lit("entry").alias("kind"), F.col("hash").alias("a"), null[0],
                                    F.lit(None).cast("long").alias("hops"), null[1], F.lit(None).cast("string").alias("ref")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[c.split()[0] for c in ROW.split(", ")])


# --- many blocks of one repository -------------------------------------------------------
def first_parent_depth(edges: DataFrame, chain: int = CHAIN) -> DataFrame:
    """``g, hash, at``: hops from each commit to the end of its first-parent chain.

    Raises if the chains run in a circle, which no commit history does."""
    first = edges.groupBy("g", F.col("a").alias("hash")).agg(F.min_by("b", F.struct("pos", "b")).alias("up"))
    links, n = write_through_counted(first.select("g", "hash", "up", F.lit(1).cast("long").alias("at")), "chain")
    ends = write_through(edges.select("g", F.col("b").alias("hash")).distinct().join(links.select("g", "hash"), ["g", "hash"], "left_anti")
                         .select("g", "hash", F.lit(0).cast("long").alias("at")), "chain-ends")
    return _chain_depth(links, n, ends, chain, 0).unionByName(ends)


def _chain_depth(links: DataFrame, n: int, ends: DataFrame, chain: int, level: int) -> DataFrame:
    """``g, hash, at`` of links ``g, hash, up, at`` (``at`` hops to ``up``), ``n`` of them.

    Every commit follows its chain to the next picked one (by a hash of its name) by pointer doubling; only those on
    their way take part in the next round. The chain of picked ones is solved likewise, so the rows of all rounds
    together grow with the commits, not with the commits times the logarithm of their chain."""
    if n <= chain:
        return links.repartition("g").mapInArrow(_followed, "g string, hash string, at long")

    def picked(name):
        return F.pmod(F.xxhash64("g", name, F.lit(level)), F.lit(PICKED)) == 0

    waiting = links.withColumn("done", picked("up"))
    there = [ends.select("g", "hash", F.col("hash").alias("up"), "at", F.lit(True).alias("done")), waiting.where("done")]
    waiting = waiting.where("not done")
    for _ in range(n.bit_length() + 1):              # the followed length doubles each round
        onward = reduce(DataFrame.unionByName, there, waiting).select(
            "g", F.col("hash").alias("up"), F.col("up").alias("__up"), F.col("at").alias("__at"), F.col("done").alias("__done"))
        step = write_through(waiting.select("g", "hash", "up", "at").join(onward, ["g", "up"]).select(
            "g", "hash", F.col("__up").alias("up"), (F.col("at") + F.col("__at")).alias("at"), F.col("__done").alias("done")), "chain")
        there, waiting = [*there, step.where("done")], step.where("not done")
        if waiting.isEmpty():
            break
    else:
        raise ValueError("the parent edges run in a circle")
    found = reduce(DataFrame.unionByName, there[1:]).select("g", "hash", "up", "at")
    short, m = write_through_counted(found.where(picked("hash")), "chain")
    known = write_through(_chain_depth(short, m, ends, chain, level + 1), "chain-depth")
    after = known.unionByName(ends).select("g", F.col("hash").alias("up"), F.col("at").alias("__at"))
    rest = found.where(~picked("hash")).join(after, ["g", "up"])
    return known.unionByName(rest.select("g", "hash", (F.col("at") + F.col("__at")).alias("at")))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole chains -> depths."""
    links = {(g, h): (up, at) for b in batches
             for g, h, up, at in zip(*(b.column(c).to_pylist() for c in ("g", "hash", "up", "at")))}
    depth: dict[tuple[str, str], int] = {}
    for start in links:
        path, node = {}, start
        while node in links and node not in depth:
            if node in path:
                raise ValueError("the parent edges run in a circle")
            path[node] = links[node][1]
            node = (node[0], links[node][0])
        hops = depth.get(node, 0)
        for passed, at in reversed(path.items()):
            hops += at
            depth[passed] = hops
    g, h = zip(*depth) if depth else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(h, pa.string()), pa.array(depth.values(), pa.int64())],
                                     ["g", "hash", "at"])


def _layout(commits: DataFrame, block: int) -> DataFrame:
    """``g, hash, at, block``: neighbours by ``at`` share a block of ``block`` commits."""
    ranked = ordered_scan(commits, ["g"], ["at", "hash"], F.floor(F.col("at") / F.lit(max(1, block))).cast("long"), index="rank")
    return write_through(ranked.select("g", "hash", F.col("rank").alias("at"), F.floor(F.col("rank") / F.lit(block)).cast("long").alias("block")),
                         "layout")


def _placed(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """Edges with the block of their child, and whether the parent lies elsewhere."""
    a = layout.select("g", F.col("hash").alias("a"), "block")
    b = layout.select("g", F.col("hash").alias("b"), F.col("block").alias("__b"))
    return edges.join(a, ["g", "a"]).join(b, ["g", "b"]).select("g", "block", "a", "b", "hops", (F.col("block") != F.col("__b")).alias("out"))


def _large(edges: DataFrame, labels: DataFrame, block: int, result: str) -> DataFrame:
    """Labels of all commits of repositories that don't fit one block."""
    levels: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    commits = write_through(first_parent_depth(edges).join(labels.select("g", "hash").distinct(), ["g", "hash"], "full")
                            .select("g", "hash", F.coalesce("at", F.lit(0)).alias("at")), "commits")
    edges, size = edges.select("g", "a", "b", F.lit(1).cast("long").alias("hops")), None
    while True:
        layout = _layout(commits, block)
        n, last = layout.agg(F.count(F.lit(1)).alias("n"), F.max("block").alias("last")).first()
        if last == 0:
            break
        if size is not None and n > 0.75 * size:
            block *= 4                               # too wide: most commits are entries
            continue
        size = n
        placed = write_through(_placed(edges, layout), "placed")
        levels.append((placed, layout, labels))
        entries = placed.where("out").select("g", F.col("b").alias("hash")).distinct()
        commits = write_through(layout.join(entries, ["g", "hash"], "left_semi").select("g", "hash", "at", "block"), "entries")
        brought = labels.join(layout.select("g", "hash", "block"), ["g", "hash"])
        smaller = write_through(_solve(_rows(placed, brought, commits), f"{result}_reduced"), "reduced")
        edges = smaller.where("a is not null").select("g", "a", "b", "hops")
        labels = smaller.where("a is null").select("g", F.col("b").alias("hash"), F.col("hops").alias("depth"), "ref")
        commits = commits.drop("block")
    whole = F.lit(0).cast("long").alias("block")
    top = edges.select("g", whole, "a", "b", "hops", F.lit(False).alias("out"))
    found = write_through(_solve(_rows(top, labels.select("g", whole, "hash", "depth", "ref")), result), "labels")
    for placed, layout, own in reversed(levels):
        known = found.unionByName(own).join(layout.select("g", "hash", "block"), ["g", "hash"])
        found = write_through(_solve(_rows(placed.where("not out"), known), result), "labels")
    return found


def _labels(edges: DataFrame, starts: DataFrame, key: Sequence[str], block: int, result: str) -> DataFrame:
    """``key, hash, depth, ref`` from edges and ``(key, hash, ref)``."""
    k = list(key)
    g = F.to_json(F.struct(*k)).alias("g")
    pos = F.col("pos") if "pos" in edges.columns else F.lit(0).alias("pos")
    e = write_through(edges.where("child is not null and parent is not null")
                      .select(g, F.col("child").alias("a"), F.col("parent").alias("b"), pos), "edges")
    labels = write_through(starts.where("hash is not null").select(
        g, "hash", F.lit(0).cast("long").alias("depth"), "ref").distinct(), "refs")
    large, n_large = write_through_counted(e.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("g"), "large")
    small_e, small_l = (e, labels) if not n_large else (e.join(large, "g", "left_anti"), labels.join(large, "g", "left_anti"))
    whole = F.lit(0).cast("long").alias("block")
    out = _solve(_rows(small_e.select("g", whole, "a", "b", F.lit(1).cast("long").alias("hops"), F.lit(False).alias("out")),
                       small_l.select("g", whole, "hash", "depth", "ref")), result)
    if n_large:
        out = out.unionByName(_large(e.join(large, "g", "left_semi"), labels.join(large, "g", "left_semi"), block, result))
    names = F.from_json("g", edges.select(*k).schema)
    return out.select(names.alias("k"), "hash", "depth", "ref").select(*[F.col(f"k.{c}").alias(c) for c in k], "hash", "depth", "ref")


def nearest_ref(edges: DataFrame, refs: DataFrame, key: Sequence[str] = KEY, block: int = BLOCK) -> DataFrame:
    """For every commit reachable from a ref, the nearest ref by number of parent hops (ties: smallest ref
    name) and the name ``ref`` / ``ref~n``. ``refs``: ``(key, hash, ref)``."""
    found = _labels(edges, refs.select(*key, "hash", "ref"), key, block, "nearest")
    name = F.when(F.col("depth") == 0, F.col("ref")).otherwise(F.concat(F.col("ref"), F.lit("~"), F.col("depth").cast("string")))
    return found.withColumn("name", name)


def tags_containing(edges: DataFrame, tags: DataFrame, key: Sequence[str] = KEY, block: int = BLOCK) -> DataFrame:
    """Every (commit, tag) with the commit in the tag's history (the tagged commit included). That output is tags x
    ancestors by its meaning, so pass only the tags asked for."""
    found = _labels(edges, tags.select(*key, "hash", F.col("tag").alias("ref")), key, block, "every")
    return found.select(*key, F.col("hash").alias("commit_hash"), F.col("ref").alias("tag"))
