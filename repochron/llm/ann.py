"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are grown on a bounded sample of the vectors (inner products become angles by one
extra component), every vector is routed to one leaf in each tree, and a query pops tree
branches from one priority queue over all trees, nearest margin first, until the leaves it
has opened hold enough vectors (the budget). How many is measured: a fixed number of queries is
compared with all vectors, and the budget is the one that finds the wanted share of their
true neighbours, so clustered data are searched in few leaves and shapeless data in many. The vectors of the opened leaves are ranked by their exact
inner product in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repochron.llm.common import cut, table

TREES = 8
LEAF = 512                   # vectors a leaf should hold
SAMPLE_VALUES = 4_000_000    # components of the sample that grows the trees, at most
SAMPLE_LEAF = 8              # sample vectors that a leaf needs at least
RECALL = 0.93                # share of the true neighbours that calibration aims at
CALIBRATION = 64             # queries compared with all vectors to set the search budget
NEAREST = 20
CHUNK = 4096                 # vectors of one leaf that one task compares


@dataclass(frozen=True)
class Forest:
    """Flat trees: node ``i`` splits by ``normals[i] . x + offset[i]``; a child below zero is leaf ``-1 - child``."""
    normals: np.ndarray
    offset: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaves: int
    bound: float                 # largest squared norm of all vectors

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One more component that gives all vectors the same norm."""
        rest = np.sqrt(np.maximum(self.bound - (x * x).sum(axis=1), 0.0))
        return np.concatenate((x, rest[:, None]), axis=1)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree (rows x trees)."""
        lifted = self.lift(x)
        out = np.zeros((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, np.int64)
            live = np.flatnonzero(node >= 0)
            while len(live):
                at = node[live]
                side = np.einsum("ij,ij->i", lifted[live], self.normals[at]) + self.offset[at] > 0
                node[live] = self.children[at, side.astype(int)]
                live = live[node[live] >= 0]
            out[:, t] = -1 - node
        return out

    def probe(self, x: np.ndarray, held: np.ndarray, opened: int) -> list[list[int]]:
        """Leaves opened for each query row; ``held`` is the number of vectors of each leaf."""
        lifted = np.concatenate((x, np.zeros((len(x), 1))), axis=1)
        margin = lifted @ self.normals.T + self.offset if len(self.normals) else np.zeros((len(x), 0))
        out = []
        for row in margin:
            queue = [(-np.inf, int(r)) for r in self.roots]
            heapq.heapify(queue)
            found, total = [], 0
            while queue and total < opened:
                best, node = heapq.heappop(queue)
                if node < 0:
                    found.append(-1 - node)
                    total += int(held[-1 - node])
                    continue
                m = row[node]
                near, far = self.children[node, int(m > 0)], self.children[node, int(m <= 0)]
                heapq.heappush(queue, (best, int(near)))
                heapq.heappush(queue, (max(best, abs(m)), int(far)))
            out.append(found)
        return out


def grow(sample: np.ndarray, bound: float, trees: int, leaf: int, seed: int = 11) -> Forest:
    """Trees whose leaves hold at most ``leaf`` sample rows (more only where rows coincide)."""
    shape = Forest(np.zeros((0, 0)), np.zeros(0), np.zeros((0, 2), int), np.zeros(0, int), 0, bound)
    x = shape.lift(sample)
    rng = np.random.default_rng(seed)
    normals, offset, children, roots, leaves = [], [], [], [], 0
    for _ in range(trees):
        todo = [(np.arange(len(x)), -1, 0)]
        root = None
        while todo:
            rows, parent, side = todo.pop()
            split = None
            if len(rows) > leaf:
                for _try in range(4):
                    a, b = x[rows[rng.choice(len(rows), 2, replace=False)]]
                    normal = a - b
                    size = np.linalg.norm(normal)
                    if size == 0:
                        continue
                    normal = normal / size
                    cut_ = -float(np.median(x[rows] @ normal))
                    up = x[rows] @ normal + cut_ > 0
                    if 0.1 < up.mean() < 0.9:
                        split = normal, cut_, up
                        break
            if split is None:
                me = -1 - leaves
                leaves += 1
            else:
                me = len(normals)
                normals.append(split[0])
                offset.append(split[1])
                children.append([0, 0])
                todo += [(rows[~split[2]], me, 0), (rows[split[2]], me, 1)]
            if parent < 0:
                root = me
            else:
                children[parent][side] = me
        roots.append(root)
    width = x.shape[1]
    return Forest(np.array(normals).reshape(-1, width), np.array(offset), np.array(children, int).reshape(-1, 2),
                  np.array(roots), leaves, bound)


def best(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of the ``k`` largest inner products, ties to the smaller id."""
    rough = rows @ query
    if len(rough) > k:
        kth = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = np.flatnonzero(rough >= kth - 1e-9 * max(1.0, abs(kth)))
    else:
        at = np.arange(len(rough))
    score = (rows[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -score))[:k]
    return at[order], score[order]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``v`` (array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .where(finite & F.exists("v", lambda x: x != 0)))
    return rows


def nearest(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20,
            k: int = NEAREST, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL,
            calibration: int = CALIBRATION, sample_values: int = SAMPLE_VALUES, chunk: int = CHUNK) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. Equal vectors are indexed once,
    with their ``k + 1`` smallest ids (no larger id can be among the nearest), so copies do
    not crowd a leaf. The trees are grown on a hash-chosen sample of about
    ``sample_values / dimension`` vectors; all vectors are routed and searched. ``calibration``
    queries set the search budget for the share ``recall`` of true neighbours. A leaf that
    holds more than ``chunk`` vectors is compared in several tasks. Vectors that are null,
    empty, zero or hold null or non-finite components, rows with a null id, and vectors of
    another dimension than the most frequent one take no part; repeated rows with one id count
    once; an empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, id_col, vector_col)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], empty)
    dim = dims["d"]
    rows = rows.where(F.size("v") == dim).dropDuplicates(["vec_id", "v"])
    order = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = (rows.withColumn("k", order).where(F.col("k") <= k + 1)
               .groupBy("v").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    classes = cut(classes, "ann-vectors")
    total, bound = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    share = min(1.0, sample_values / dim / total)
    chosen = classes.where(F.pmod(F.xxhash64("cid", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).select("cid", "v")
    got = chosen.toArrow().sort_by("cid")
    sample = np.array(got["v"].combine_chunks().flatten().to_numpy()).reshape(-1, dim)
    forest = spark.sparkContext.broadcast(
        grow(sample, bound, trees, max(SAMPLE_LEAF, int(leaf * len(sample) / total))))

    def vectors(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = forest.value.route(vectors(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), leaves.shape[1])
                 .cast(pa.list_(pa.int32()))], ["cid", "v", "ids", "leaves"])

    routed = cut(classes.select("cid", "v", "ids").mapInArrow(
        route, "cid long, v array<double>, ids array<long>, leaves array<int>"), "ann-routed")
    members = routed.select("cid", "v", F.explode("leaves").alias("leaf"))
    counts = members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()      # bounded by the forest
    held = np.zeros(forest.value.leaves, np.int64)
    for r in counts:
        held[r["leaf"]] = r["n"]
    parts_of = spark.createDataFrame([(i, int(-(-n // chunk))) for i, n in enumerate(held.tolist())], "leaf int, g int")
    shared = spark.sparkContext.broadcast(held)

    asked = (rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v")
             .join(classes.select("v", "cid"), "v").select("query_id", "cid"))
    asked = cut(asked, "ann-queries")

    opened = _budget(routed, asked, forest.value, held, vectors, k, recall, calibration)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                leaves = forest.value.probe(vectors(part.column(1)), shared.value, opened)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves, pa.list_(pa.int32()))], ["cid", "v", "leaves"])

    queries = routed.select("cid", "v").join(asked.select("cid").distinct(), "cid", "left_semi")
    probes = cut(queries.mapInArrow(probe, "cid long, v array<double>, leaves array<int>"), "ann-probes")
    filed = (members.join(F.broadcast(parts_of), "leaf")
             .select("leaf", F.pmod(F.xxhash64("cid"), F.col("g")).cast("int").alias("part"), F.lit(0).alias("ask"),
                     "cid", "v", F.lit(0.0).alias("floor")))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, vecs = None, [], []
        rows_, names_ = None, None
        for b in batches:
            if not b.num_rows:
                continue
            leaf_, part_, ask = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cid, v = b.column(3).to_numpy(zero_copy_only=False), vectors(b.column(4))
            floor = b.column(5).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate(([True], (np.diff(leaf_) != 0) | (np.diff(part_) != 0) | (np.diff(ask) != 0))))
            out: tuple[list, ...] = ([], [], [])
            for s, e in zip(new, [*new[1:], b.num_rows]):
                where = (int(leaf_[s]), int(part_[s]))
                if where != last:
                    last, ids, vecs, rows_ = where, [], [], None
                if not ask[s]:
                    ids.append(cid[s:e])
                    vecs.append(v[s:e])
                    rows_ = None
                    continue
                if not ids:
                    continue
                if rows_ is None:
                    rows_, names_ = np.concatenate(vecs), np.concatenate(ids)
                for i in range(s, e):
                    at, score = best(v[i], rows_, names_, k + 1)
                    at, score = at[score >= floor[i]], score[score >= floor[i]]
                    out[0].append(np.full(len(at), cid[i]))
                    out[1].append(names_[at])
                    out[2].append(score)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["q", "cid", "score"])

    def compare(asks: DataFrame) -> DataFrame:
        """Best members of each opened leaf (``cid``, ``v``, ``leaf``, ``floor``) that reach the floor."""
        dealt = (asks.join(F.broadcast(parts_of), "leaf")
                 .select("leaf", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("part"), F.lit(1).alias("ask"),
                         "cid", "v", "floor"))
        return (filed.unionByName(dealt).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "ask")
                .mapInArrow(rank, "q long, cid long, score double").dropDuplicates(["q", "cid"]))

    # The leaves that a query itself falls into come first. Their k + 1-th best score is a floor
    # that every row of the result reaches, so the other leaves give only what passes it.
    own = len(forest.value.roots)
    near_leaves = probes.select("cid", "v", F.explode(F.slice("leaves", 1, own)).alias("leaf"), F.lit(float("-inf")).alias("floor"))
    first = cut(compare(near_leaves), "ann-first")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    floors = (first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k + 1)
              .select(F.col("q").alias("cid"), F.col("score").alias("floor")))
    far_leaves = (probes.join(floors, "cid", "left")
                  .select("cid", "v", F.explode(F.slice("leaves", own + 1, forest.value.leaves)).alias("leaf"),
                          F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
    found = first.unionByName(compare(far_leaves)).dropDuplicates(["q", "cid"])
    top = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    found = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    pairs = found.join(routed.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    lists = pairs.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (asked.join(lists, asked["cid"] == lists["q"]).select("query_id", F.posexplode(near).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score"))


def _budget(routed: DataFrame, asked: DataFrame, forest: Forest, held: np.ndarray, vectors, k: int,
            recall: float, calibration: int) -> int:
    """Vectors to open so that ``recall`` of the calibration queries' true neighbours are found."""
    some = (asked.select("cid").distinct().orderBy(F.xxhash64("cid"), "cid").limit(calibration)
            .join(routed.select("cid", "v"), "cid").toArrow().sort_by("cid"))
    if not some.num_rows:
        return 0
    qid, q = some["cid"].to_numpy(), vectors(some["v"].combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, rows = b.column(0).to_numpy(zero_copy_only=False), vectors(b.column(1))
            at, who, score = [], [], []
            for i, name in enumerate(qid):
                pos, s = best(q[i], rows, ids, k + 1)
                at.append(pos)
                who.append(np.full(len(pos), name))
                score.append(s)
            pos = np.concatenate(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(who)), pa.array(ids[pos]), pa.array(np.concatenate(score)),
                 b.column(2).take(pa.array(pos))], ["q", "cid", "score", "leaves"])

    rank = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    true = (routed.select("cid", "v", "leaves").mapInArrow(run, "q long, cid long, score double, leaves array<int>")
            .where("q <> cid").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k)
            .select("q", "leaves").collect())                        # calibration x k rows at most
    place = {}
    for name, order in zip(qid.tolist(), forest.probe(q, held, np.iinfo(np.int64).max)):
        upto = np.zeros(forest.leaves, np.int64)
        upto[order] = np.cumsum(held[order])
        place[name] = upto
    need = sorted(int(place[r["q"]][r["leaves"]].min()) for r in true)
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))))] if need else 0


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th embedding."""
    return nearest(table(spark, sf_dir, "embeddings"))
