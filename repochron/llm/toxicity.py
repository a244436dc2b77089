"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and texts whose label is unknown or withheld (U) train linear
classifiers in numpy. With class prior ``pi`` the risk is
``pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))``; when the bracket turns negative beyond
the tolerance, the step goes against it, so that U cannot be overfitted as negative.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.common import U64, cut, mix64, table

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz":
    _LETTER[_c] = True
_MULT = U64(0x9E3779B97F4A7C15)
PIECE = 1 << 20


def word_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-cased UTF-8 bytes: (feature, byte offset of its word).

    Words are runs of letters (a-z and all bytes above 127). A word gives one feature for
    each prefix of 4 to 8 bytes that is shorter than itself, and one for the whole word.
    """
    letter = _LETTER[data]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), starts
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    head = np.zeros(len(starts), np.uint64)
    feats, at = [], []
    for k in range(8):
        byte = padded[starts + k].astype(np.uint64)
        head |= np.where(size > k, byte, U64(0)) << U64(8 * k)
        if k + 1 in PREFIXES:
            longer = size > k + 1
            feats.append(mix64(head[longer] * _MULT + U64(k + 1)))
            at.append(starts[longer])
    whole = head.copy()
    long_ = np.flatnonzero(size > 8)
    k = 8
    while len(long_):                                    # words are short: few rounds
        whole[long_] = whole[long_] * _MULT + data[starts[long_] + k]
        k += 1
        long_ = long_[size[long_] > k]
        if k >= 64:                                      # the few runs that are longer, whole
            for i in long_.tolist():
                whole[i] = xxhash.xxh64_intdigest(data[starts[i]: ends[i]].tobytes())
            break
    feats.append(mix64(whole * _MULT + U64(99)))
    at.append(starts)
    return (np.concatenate(feats) >> U64(64 - BITS)).astype(np.int64), np.concatenate(at)


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, feature, weight) of whole texts; weight is ``1 + log(count)``."""
    rows, cols, vals = [], [], []
    held, bounds, size, first = [], [0], 0, 0

    def flush():
        nonlocal held, bounds, size, first
        if size:
            f, at = word_features(np.frombuffer(b"\n".join(held) + b"\n", np.uint8))
            row = np.searchsorted(np.array(bounds[1:]), at, side="right")
            key, n = np.unique(row * (1 << BITS) + f, return_counts=True)
            rows.append((key >> BITS) + first)
            cols.append(key & ((1 << BITS) - 1))
            vals.append(1 + np.log(n))
        first += len(held)
        held, bounds, size = [], [0], 0

    for t in texts:
        held.append((t or "").lower().encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        bounds.append(size)
        if size >= PIECE:
            flush()
    flush()
    empty = np.zeros(0, np.int64)
    if not rows:
        return empty, empty, np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


#: (number of texts, row, feature, weight)
Sparse = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def sparse(texts: list[str | None]) -> Sparse:
    return (len(texts), *counted(texts))


@dataclass(frozen=True)
class Model:
    """Average of linear members; ``weights`` has one slot per hashed feature."""
    weights: np.ndarray
    bias: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        r, c, v = counted(texts)
        return np.bincount(r, v * self.weights[c], len(texts)) + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit_nnpu(positive: Sparse, unlabelled: Sparse, prior: float, members: int = 3,
             epochs: int = 20, batch: int = 512, rate: float = 0.1, l2: float = 3e-3,
             tolerance: float = 0.0, seed: int = 7, smooth: float = 2.0, doubt: float = 1.0,
             least: float = 0.02, floor: float = 1.0, scale: float = 0.5, ridge: float = 2.0) -> Model:
    """Train ``members`` classifiers with the non-negative risk and average them.

    Loss is the logistic loss; ``prior`` is the share of positives among the unlabelled.
    Without a positive text the model says 0.0001 for everything.
    """
    n_p, n_u = positive[0], unlabelled[0]
    if not n_p or not n_u:
        return Model(np.zeros(1 << BITS), -9.2)
    p, u = positive[1:], unlabelled[1:]

    odds = feature_odds(np.bincount(p[1], minlength=1 << BITS), np.bincount(u[1], minlength=1 << BITS), n_p, n_u,
                        smooth, doubt, least, floor) * scale

    def csr(x, n):
        r, c, v = x
        kept = odds[c] != 0
        r, c, v = r[kept], c[kept], v[kept]
        return np.searchsorted(r, np.arange(n + 1)), c, v * odds[c]

    pp, pc, pv = csr(p, n_p)
    up, uc, uv = csr(u, n_u)
    prior = min(max(prior, 1e-4), 0.9)
    total, bias = np.zeros(1 << BITS), 0.0
    for m in range(members):
        rng = np.random.default_rng(seed + m)
        w, b = np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
        g2 = np.full(1 << BITS, 1e-8)
        gb2 = 1e-8
        steps = max(1, n_u // batch)
        each = max(8, min(n_p, batch // 2))
        for _ in range(epochs):
            order = rng.permutation(n_u)
            for s in range(steps):
                ui = order[s::steps]
                pi = rng.integers(0, n_p, each)

                def take(ptr, c, v, rows):
                    n = ptr[rows + 1] - ptr[rows]
                    at = np.repeat(ptr[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    return np.repeat(np.arange(len(rows)), n), c[at], v[at]

                pr, pcc, pvv = take(pp, pc, pv, pi)
                ur, ucc, uvv = take(up, uc, uv, ui)
                zp = np.bincount(pr, pvv * w[pcc], len(pi)) + b
                zu = np.bincount(ur, uvv * w[ucc], len(ui)) + b
                sp, su = _sigmoid(zp), _sigmoid(zu)
                negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
                if negative >= -tolerance:
                    gp = prior * ((sp - 1) - sp) / len(pi)           # +1 loss, minus prior x -1 loss
                    gu = su / len(ui)
                else:                                                # undo the overfit bracket
                    gp = prior * sp / len(pi)
                    gu = -su / len(ui)
                cols = np.concatenate((pcc, ucc))
                grad = np.bincount(cols, np.concatenate((pvv * gp[pr], uvv * gu[ur])), 1 << BITS)
                grad = grad + l2 * w
                gb = float(gp.sum() + gu.sum())
                g2 += grad * grad
                gb2 += gb * gb
                w -= rate * grad / np.sqrt(g2)
                b -= rate * gb / np.sqrt(gb2)
        total += w * odds / members
        bias += b / members
    plain = total / np.where(odds == 0, 1, odds)
    zp, zu = (np.bincount(np.repeat(np.arange(n), np.diff(ptr)), v * plain[c], n) + bias
              for n, ptr, c, v in ((n_p, pp, pc, pv), (n_u, up, uc, uv)))
    slope, shift = calibrate(zp, zu, prior, ridge / n_p)
    return Model(total * slope, bias * slope + shift)


def feature_odds(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, smooth: float = 2.0, doubt: float = 1.0,
                 least: float = 0.02, floor: float = 1.0) -> np.ndarray:
    """Log-odds of each feature's documents in P against U; 0 for features that take no part.

    They scale the features, so that few positives suffice against many rare words: a feature
    has to be seen in several positives, and its count there enters by a lower bound."""
    usual = (in_u + 1.0) / (n_u + 2.0)
    sure = np.maximum(in_p - doubt * np.sqrt(in_p), 0.0)
    odds = np.log((sure + smooth * usual) / (n_p + smooth) / usual)
    return np.where((in_p >= max(2, least * n_p)) & (odds > floor), odds, 0.0)


def calibrate(zp: np.ndarray, zu: np.ndarray, prior: float, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and shift that minimise the same risk over two numbers (convex, damped Newton steps)."""
    a, b = 1.0, 0.0

    def risk(a, b):
        return -prior * np.mean(a * zp + b) + np.mean(np.logaddexp(0, a * zu + b)) + ridge * (a - 1) ** 2

    for _ in range(50):
        s = _sigmoid(a * zu + b)
        h = s * (1 - s)
        grad = np.array([-prior * zp.mean() + np.mean(s * zu) + 2 * ridge * (a - 1), -prior + s.mean()])
        hess = np.array([[np.mean(h * zu * zu) + 2 * ridge, np.mean(h * zu)], [np.mean(h * zu), h.mean()]])
        step, size = np.linalg.solve(hess + 1e-9 * np.eye(2), grad), 1.0
        while size > 1e-4 and risk(a - size * step[0], b - size * step[1]) > risk(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.05), b


def _fold(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def _share(name: str, share: float):
    """Deterministic Bernoulli choice by id."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(name)), F.lit(1 << 30)) < int(share * (1 << 30))


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int,
                  ) -> tuple[Sparse, Sparse, float]:
    """Hashed features of the two training samples, and the class prior.

    Labels of the fold ``crc32(id) mod 4 = 2`` are never read. Positives are confirmed
    toxic documents; the unlabelled set is drawn from all documents outside that fold with
    labels withheld. ``max_positive`` and ``max_unlabelled`` bound both samples: ids are
    chosen by hash with the share that gives at most the bound on average. The chosen
    positive ids (bounded) are broadcast, so no text is shuffled but the sample's.
    """
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (_fold("doc_id") != 2))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    seen = marks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    rows = docs.where(F.col("doc_id").isNotNull() & (_fold("doc_id") != 2))
    n_docs = rows.select("doc_id").count()
    if not seen["p"] or not n_docs:
        return sparse([]), sparse([]), 0.0
    prior = seen["p"] / seen["n"]
    chosen = (marks.where((F.col("toxic") == 1) & _share("p", min(1.0, max_positive / seen["p"])))
              .select("doc_id", F.lit(True).alias("is_p")))
    picked = (rows.join(F.broadcast(chosen), "doc_id", "left")
              .withColumn("is_u", _share("u", min(1.0, max_unlabelled / n_docs)))
              .where("is_p or is_u")
              .groupBy("doc_id", F.xxhash64("text").alias("h"))      # repeated rows count once
              .agg(F.any_value("text").alias("text"), F.max("is_p").alias("is_p"), F.max("is_u").alias("is_u"))
              .select("doc_id", "h", "is_p", "is_u", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                r, c, v = counted(part.column(4).to_pylist())
                cut_ = np.searchsorted(r, np.arange(1, part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(4)],
                     pa.array([x.astype(np.int32).tobytes() for x in np.split(c, cut_)], pa.binary()),
                     pa.array([x.astype(np.float32).tobytes() for x in np.split(v, cut_)], pa.binary())],
                    ["doc_id", "h", "is_p", "is_u", "cols", "vals"])

    found = cut(picked.mapInArrow(
        run, "doc_id long, h long, is_p boolean, is_u boolean, cols binary, vals binary"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for p_, u_, c in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                c = np.frombuffer(c, np.int32)
                total[0, c] += bool(p_)
                total[1, c] += bool(u_)
        f = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(total[0, f]), pa.array(total[1, f])], ["f", "p", "u"])

    # which features take part is settled by counts, so only those come to the driver
    got = found.mapInArrow(count, "f long, p long, u long").groupBy("f").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    in_p, in_u = np.zeros(1 << BITS), np.zeros(1 << BITS)
    in_p[got["f"].to_numpy()], in_u[got["f"].to_numpy()] = got["p"].to_numpy(), got["u"].to_numpy()
    size = found.agg(F.count_if("is_p").alias("p"), F.count_if("is_u").alias("u")).first()
    if not size["p"] or not size["u"]:
        return sparse([]), sparse([]), prior
    kept = docs.sparkSession.sparkContext.broadcast(feature_odds(in_p, in_u, size["p"], size["u"]) != 0)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32))
                     for c, v in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(4)], pa.array([c[kept.value[c]].tobytes() for c, _ in pairs], pa.binary()),
                 pa.array([v[kept.value[c]].tobytes() for c, v in pairs], pa.binary())], b.schema.names)

    part = found.mapInArrow(narrow, found.schema).toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])

    def gather(flag: str) -> Sparse:
        rows_ = part.filter(part[flag])
        cols = [np.frombuffer(x, np.int32) for x in rows_["cols"].to_pylist()]
        vals = [np.frombuffer(x, np.float32) for x in rows_["vals"].to_pylist()]
        row = np.repeat(np.arange(len(cols), dtype=np.int32), [len(x) for x in cols])
        return len(cols), row, np.concatenate(cols), np.concatenate(vals)

    return gather("is_p"), gather("is_u"), prior


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.3, max_positive: int = 3000, max_unlabelled: int = 8000,
                   keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row, then the columns ``keep``.

    Only the text is an input of the score; whole texts count. The classifiers are fitted
    once on the bounded samples of ``training_rows`` (documented parameters), then every row
    is scored where it lies: one scan, no shuffle. Null and empty texts get the score of a
    text without words; rows with a null id are scored, not held out and never trained on;
    repeated rows get equal scores; labels that are null or lack a document are ignored, and
    several labels of one id count as toxic if one says so; without a usable positive label
    every score is 0.0001; an empty table gives no rows. Other columns are ignored, so
    their names cannot clash (``keep`` must not name an output column).
    """
    keep = list(keep or [])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep) if c != text_col])
    model = fit_nnpu(*training_rows(src.select("doc_id", "text"), labels, max_positive, max_unlabelled))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                score = _sigmoid(m.logits(part.column(1).to_pylist()))
                cols = [part.column(i) for i in range(part.num_columns) if i != 1 or text_col in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score)], out.names)

    src = src.withColumn("held_out", F.coalesce(_fold("doc_id") == 2, F.lit(False)))
    out = (src if text_col in keep else src.drop("text")).withColumn("score", F.lit(0.0)).schema
    return src.mapInArrow(run, out).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        *[F.col("text" if c == text_col else f"k{i}").alias(c) for i, c in enumerate(keep)])


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all their columns) that are not predicted toxic, by ``score_toxicity``."""
    names = docs.columns
    plain = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(names)
                                                                               if c != text_col])
    kept = ["t" if c == text_col else f"c{k}" for k, c in enumerate(names)]
    scored = score_toxicity(plain, labels, "i", "t", keep=kept).where("predicted = 0")
    return scored.select(*[F.col(k).alias(c) for k, c in zip(kept, names)])


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
