"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repochron.llm.common import U64, connected, cut, table, text_bytes

SHINGLE = 3
DISTANCE = 3
SEED = 42
BLOCK = 4096        # rows of a bucket that one comparison holds on each side
BUNDLE = 512        # small buckets are compared together up to so many rows


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """64-bit SimHash of a text: a bit is set if it is set in over half the shingle hashes.

    A-Z are lower-cased, words are runs of bytes other than space and 0x09-0x0D, repeats
    count. Fewer words than a shingle: the whole sequence is the one shingle; none: 0.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    norm = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(norm, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1:].tolist())
    n, counts = len(tokens) - words + 1, np.zeros(64, np.int64)
    hashes = np.fromiter((hashed(norm[s:e], SEED) for s, e in pairs), np.uint64, n)
    for at in range(0, n, 1 << 14):
        part = hashes[at: at + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``t`` (hash of the text) and ``fp`` (the fingerprint as a signed long) of every row;
    null text is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                fps = np.array([fingerprint(t, words) for t in text_bytes(part.column(2))], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fps.view(np.int64))], ["doc_id", "t", "fp"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, t long, fp long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def within(queries: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Boolean matrix: which lanes are within ``radius`` bits of which query.

    Lanes are stored as vertical bit planes, 64 lanes to a word. For each plane the words
    that differ are added to bit-sliced counters by carry-save steps; a counter that would
    pass ``radius`` sticks in an overflow word. Query blocks whose lanes have all
    overflowed are abandoned.
    """
    n, words = len(lanes), -(-len(lanes) // 64)
    bits = np.unpackbits(lanes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)      # plane x word
    valid = np.zeros(words * 64, np.uint8)
    valid[:n] = 1
    dead0 = ~np.packbits(valid, bitorder="little").view(np.uint64)
    width = max(1, radius.bit_length())
    out = np.zeros((len(queries), n), bool)
    alive = np.arange(len(queries))
    count = [np.zeros((len(queries), words), np.uint64) for _ in range(width)]
    over = np.repeat(dead0[None, :], len(queries), axis=0)
    for k in range(64):
        flip = (np.uint64(0) - ((queries[alive] >> U64(k)) & U64(1)))[:, None]
        carry = planes[k][None, :] ^ flip
        for c in range(width):
            count[c], carry = count[c] ^ carry, count[c] & carry
        over |= carry
        if radius + 1 < 1 << width:                      # counter passed the radius itself
            over |= _above(count, radius)
        if k % 4 == 3 and k > 8:
            keep = ~(over == ~U64(0)).all(axis=1)
            if not keep.all():
                alive, over, count = alive[keep], over[keep], [c[keep] for c in count]
                if not len(alive):
                    return out
    hit = np.unpackbits((~over).view(np.uint8).reshape(len(alive), words * 8), axis=1, bitorder="little")
    out[alive] = hit[:, :n].astype(bool)
    return out


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter is over ``radius``."""
    more = np.zeros_like(count[0])
    same = ~more
    for c in range(len(count) - 1, -1, -1):
        if radius >> c & 1:
            same = same & count[c]
        else:
            more, same = more | (same & count[c]), same & ~count[c]
    return more


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) that join all values connected within the block."""
    values = np.unique(values)
    near = np.zeros((len(values), len(values)), bool)
    for at in range(0, len(values), 1024):
        near[at: at + 1024] = within(values[at: at + 1024], values, radius)
    open_ = near.sum(axis=1) > 1
    us, vs = [], []
    for seed in range(len(values)):
        if not open_[seed]:
            continue
        group = front = np.array([seed])
        open_[seed] = False
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & open_)
            open_[front] = False
            group = np.concatenate((group, front))
        us.append(values[group[1:]])
        vs.append(np.full(len(group) - 1, values[seed]))
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def near_links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links ``u``, ``v`` whose components are those of all pairs within ``distance`` bits.

    ``fps``: one row per different fingerprint (``fp``). The 64 bits are cut into
    ``distance + 2`` bands; two fingerprints within ``distance`` agree in at least two of
    them, so each goes to one bucket for each pair of bands (about 26 key bits for distance
    3). A bucket of more than ``block`` rows is dealt into parts and every pair of parts is
    compared in a task of its own, so no task holds more than two parts and no pair is
    lost. A bucket gives a spanning forest, not its pairs.
    """
    bands = distance + 2
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(bands)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m
              for m in (masks[i] | masks[j] for i, j in combinations(range(bands), 2))]
    keys = F.array(*[F.struct(F.lit(i).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("b"))
                     for i, m in enumerate(signed)])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.b")
    sizes = rows.groupBy("t", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = (F.ceil(F.col("n") / F.lit(block))).cast("int")
    own = F.pmod(F.xxhash64("fp", "t"), F.col("g")).cast("int")
    rows = (rows.join(sizes, ["t", "b"]).withColumn("g", parts).withColumn("p", own)
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
            .select("t", "b", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []       # whole buckets, waiting for their bundle
        open_: list[np.ndarray] = []      # the bucket that may go on
        size, last = 0, None

        def emit(parts):
            u, v = forest(np.concatenate(parts).view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            new = np.ones(n, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
            new[0] = last is None or last != tuple(c[0] for c in cols[:4])
            last = tuple(c[-1] for c in cols[:4])
            cuts = np.flatnonzero(new)
            bounds = [0, *cuts.tolist(), n] if not new[0] else [*cuts.tolist(), n]
            for at, to in zip(bounds[:-1], bounds[1:]):
                if new[at] and open_:
                    held += open_
                    open_ = []
                    if size >= BUNDLE:
                        yield emit(held)
                        held, size = [], 0
                open_.append(cols[4][at:to])
                size += to - at
        if held or open_:
            yield emit(held + open_)

    dealt = rows.repartition("t", "b", "i", "j").sortWithinPartitions("t", "b", "i", "j")
    return dealt.mapInArrow(run, "u long, v long")


def components(docs: DataFrame, words: int, distance: int, id_col: str, text_col: str, block: int) -> DataFrame:
    """``doc_id``, ``t``, ``fp`` and ``root`` (a fingerprint that names the component) of every row."""
    fps = cut(fingerprints(docs, id_col, text_col, words), "simhash")
    each = fps.select("fp").distinct()
    roots = connected(near_links(each, distance, block)).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, distance: int = DISTANCE,
                    id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` of every row.

    Fingerprints at ``distance`` or fewer differing bits are linked; ``component_id`` is the
    smallest id reachable. Null and empty texts have fingerprint zero and link like others;
    rows with a null id link too but never give the component's name (null if no member has
    an id); repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    rows = cut(components(docs, words, distance, id_col, text_col, block), "simhash-rows")
    names = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-names")
    return rows.join(names, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE, distance: int = DISTANCE,
                id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` (all columns) with one row of each near-duplicate component.

    The row with the smallest id stays (rows without an id only where no member has one; then,
    and between rows that share the id, the smallest hash of the text decides; of equal rows
    one stays). Handles nulls, empty texts and empty tables like ``near_duplicates``.
    """
    rows = components(docs, words, distance, id_col, text_col, block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t")).alias("r")
    kept = cut(rows.groupBy("root").agg(first).select(F.coalesce("r.doc_id", F.lit(0)).alias("_i"), F.col("r.n").alias("_n"),
                                                      F.col("r.t").alias("_t")).distinct(), "simhash-kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_i"),
                        F.col(id_col).cast("long").isNull().alias("_n"), F.xxhash64(text).alias("_t"))
    again = F.row_number().over(Window.partitionBy("_i", "_n", "_t").orderBy("_i", "_n", "_t"))
    return (whole.join(kept, ["_i", "_n", "_t"], "left_semi").withColumn("_k", again).where("_k = 1").select("_row.*"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
