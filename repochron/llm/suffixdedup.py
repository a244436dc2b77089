"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A string of ``min_len`` bytes that starts at two places has the same smallest q-gram hash at
the same offset in both. So every window is filed under that q-gram (its *anchor*), and
only windows of one anchor can be equal. Initial buckets are these q-grams, counted over the
whole corpus; buckets with one occurrence end there. The windows of one anchor occurrence
lie side by side: their joint bytes (the *context*) are hashed, equal contexts collapse to
one row, and the different contexts of a bucket are laid out in one text whose suffix
buckets are refined by the bucket identifiers of later offsets until ``min_len`` bytes are
sorted. A bucket with more contexts than one task should hold is split on the cluster first: its
windows are dealt by their offset to the anchor, and the bytes that all windows of such a range
have in common with the bucket's text become the next, longer gram. Ranges narrow until the bucket
fits or the gram is the window itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.common import U64, cut, mix64, table, text_bytes

MIN_LEN = 400
GRAM = 128
GROUP_LIMIT = 12_000        # contexts of one bucket refined in one task; larger buckets are split
RANGES = 4                  # ranges of offsets that a range is split into
CHUNK = 1 << 22             # bytes of one text hashed at a time
PIECE = 1 << 20
_POS = U64((1 << 24) - 1)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes from each position (doubling of lengths)."""
    done, size, rest = None, 0, _BYTE[data]
    step, mult = 1, 0x9E3779B97F4A7C15 | 1
    with np.errstate(over="ignore"):
        while True:
            if gram & step:
                if done is None:
                    done = rest
                else:
                    n = len(rest) - size
                    done = done[:n] * U64(mult) + rest[size:]
                size += step
            if size == gram:
                return done
            rest = rest[:-step] * U64(mult) + rest[step:]
            mult = mult * mult & 0xFFFFFFFFFFFFFFFF
            step *= 2


def anchors(data: np.ndarray, doc_end: np.ndarray, min_len: int, gram: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor runs of a buffer of texts: (key, anchor position, first window, windows).

    ``doc_end[i]`` is the end of the text that holds byte ``i``; windows never cross it. The
    smallest hash wins, the leftmost at ties, so equal windows have the same anchor.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - min_len + 1
    if n <= 0:
        return none.view(np.uint64), none, none, none
    raw = mix64(gram_hashes(data, gram))
    low = (raw & ~_POS) | np.arange(len(raw), dtype=np.uint64)
    span, size = min_len - gram + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size:])
    at = (low[:n] & _POS).astype(np.int64)
    valid = np.arange(n) + min_len <= doc_end[:n]
    at[~valid] = -1
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((edge, [n])))
    keep = at[edge] >= 0
    edge, count = edge[keep], count[keep]
    return raw[at[edge]], at[edge], edge, count


def anchor_rows(docs: DataFrame, min_len: int, gram: int) -> DataFrame:
    """One row per anchor occurrence: text (``doc_id``, ``t``), first window ``lo``, number of
    windows ``n_win``, bucket ``key`` and context hash ``c``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = text_bytes(part.column(2))
                for rows, buf, starts, base in buffers(texts, min_len):
                    ends = np.concatenate((starts[1:], [len(buf)]))
                    data = np.frombuffer(buf, np.uint8)
                    key, pos, lo, n_win = anchors(data, np.repeat(ends, ends - starts), min_len, gram)
                    own = np.searchsorted(starts, lo, side="right") - 1
                    ctx = [xxhash.xxh3_64_intdigest(buf[x: x + k + min_len - 1], p)
                           for x, k, p in zip(lo.tolist(), n_win.tolist(), ((pos - lo) * 65536 + n_win).tolist())]
                    row = pa.array(rows[own], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(row), part.column(1).take(row),
                         pa.array(lo - starts[own] + base[own], pa.int64()), pa.array(n_win.astype(np.int32)),
                         pa.array(key.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64))],
                        ["doc_id", "t", "lo", "n_win", "key", "c"])

    return docs.mapInArrow(run, "doc_id long, t long, lo long, n_win int, key long, c long")


def buffers(texts: list[bytes], min_len: int):
    """Texts of ``min_len`` bytes or more, joined to buffers: (rows, bytes, starts, base offsets).

    A text longer than ``CHUNK`` comes in chunks that overlap by ``min_len - 1`` bytes, so
    each of its windows lies in exactly one chunk."""
    rows, parts, base, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < min_len:
            continue
        for at in range(0, max(1, len(t) - min_len + 1), CHUNK):
            part = t[at: at + CHUNK + min_len - 1]
            rows.append(i)
            parts.append(part)
            base.append(at)
            size += len(part)
            if size >= PIECE:
                yield _joined(rows, parts, base)
                rows, parts, base, size = [], [], [], 0
    if parts:
        yield _joined(rows, parts, base)


def _joined(rows, parts, base):
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.array(rows), b"".join(parts), np.concatenate(([0], np.cumsum(sizes)[:-1])), np.array(base, np.int64)


def refine(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Which of ``starts`` share their next ``depth`` bytes with another of them.

    Buckets of the first 8 bytes are refined by sorting on the pair (own bucket, bucket of the
    suffix that begins where the sorted prefix ends); identifiers are positions of buckets in
    the sorted order, updated in place and used by the next pass, so the sorted prefix
    doubles. Suffixes alone in their bucket are not sorted again.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 8, np.uint8)))
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = (first << U64(8)) | padded[k: k + n]
    size = min(8, depth)
    if size < 8:
        first >>= U64(8 * (8 - size))
    order = np.argsort(first, kind="stable")
    bucket, many = _buckets(order, first[order], np.zeros(n, np.int64), 0)
    active = order[many]
    while size < depth and len(active):
        step = min(size, depth - size)
        later = active + step
        pair = bucket[np.minimum(later, n - 1)]
        pair[later >= n] = -1
        by = np.lexsort((pair, bucket[active]))
        active, pair = active[by], pair[by]
        own = bucket[active]
        new = np.ones(len(active), bool)
        new[1:] = (own[1:] != own[:-1]) | (pair[1:] != pair[:-1])
        head = np.ones(len(active), bool)
        head[1:] = own[1:] != own[:-1]
        index = np.arange(len(active))
        bucket[active] = own + index[new][np.cumsum(new) - 1] - index[head][np.cumsum(head) - 1]
        sizes = np.diff(np.concatenate((index[new], [len(active)])))
        active = active[np.repeat(sizes > 1, sizes)]
        size += step
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    active = active[wanted[active]]
    ids, count = np.unique(bucket[active], return_counts=True)
    shared = np.zeros(n, bool)
    if len(active):
        shared[active] = count[np.searchsorted(ids, bucket[active])] > 1
    return shared[starts]


def _buckets(order: np.ndarray, keys: np.ndarray, bucket: np.ndarray, base: int):
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    head = np.flatnonzero(new)
    bucket[order] = base + head[np.cumsum(new) - 1]
    sizes = np.diff(np.concatenate((head, [len(keys)])))
    return bucket, np.repeat(sizes > 1, sizes)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the true runs."""
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    at = np.flatnonzero(edge == 1)
    return at, np.flatnonzero(edge == -1) - at


SPANS = "doc_id long, t long, lo long, n_win int"


def _shared_windows(contexts: DataFrame, min_len: int) -> DataFrame:
    """Runs of repeated windows in contexts that occur once (``n`` = 1), one task per buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        group: list[tuple] = []
        size, last = 0, None

        def emit(rows):
            text = np.frombuffer(b"".join(r[-1] for r in rows), np.uint8)
            wins = np.array([r[4] for r in rows])
            at = np.concatenate(([0], np.cumsum([len(r[-1]) for r in rows])[:-1]))
            starts = np.repeat(at - np.concatenate(([0], np.cumsum(wins)[:-1])), wins) + np.arange(wins.sum())
            hit = refine(text, starts, min_len)
            out, k = ([], [], [], []), 0
            for r, w in zip(rows, wins.tolist()):
                if r[1] == 1:
                    for x, size_ in zip(*_runs(hit[k: k + w])):
                        for o, v in zip(out, (r[2], r[3], r[5] + int(x), int(size_))):
                            o.append(v)
                k += w
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.int32())], ["doc_id", "t", "lo", "n_win"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(8)]
            for key, c, n, doc, t, wins, lo, ctx in zip(*cols):
                if last is not None and key != last[0]:
                    if len(group) > 1:
                        done += group
                    else:
                        size -= sum(len(r[-1]) for r in group)
                    group = []
                    if size >= 2 * PIECE:
                        yield emit(done)
                        done, size = [], 0
                if last == (key, c):             # a repeated row of the same text
                    continue
                last = (key, c)
                group.append((key, n, doc, t, wins, lo, ctx))
                size += len(ctx)
        if len(group) > 1:
            done += group
        if done:
            yield emit(done)

    dealt = contexts.repartition("key").sortWithinPartitions("key", "c")
    return dealt.select("key", "c", "n", "doc_id", "t", "n_win", "lo", "ctx").mapInArrow(run, SPANS)


SUB = "doc_id long, t long, key long, c long, n long, n_win int, lo long, p int, ctx binary"


def split_context(ctx: bytes, key: int, n_win: int, p: int, width: int, min_len: int, gram: int
                  ) -> Iterator[tuple[int, int, int, int]]:
    """One bucket's context by ranges of ``width`` offsets between window and anchor (at ``p``).

    Yields (bucket, first window, windows, context hash) per range. All windows of a range hold the
    same stretch around the anchor, whose hash names the bucket: equal windows have the same offset
    and bytes, so they fall into one bucket.
    """
    for r in range((p - n_win + 1) // width, p // width + 1):
        low, high = r * width, min(r * width + width - 1, min_len - gram)
        first, last = max(0, p - high), min(n_win - 1, p - low)
        core = ctx[p - low: p - high + min_len]
        sub = ctx[first: last + min_len]
        yield (xxhash.xxh3_64_intdigest(core, (key + r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF), first,
               last - first + 1, xxhash.xxh3_64_intdigest(sub, (p - first) * 65536 + last - first + 1))


def _split(contexts: DataFrame, width: int, min_len: int, gram: int) -> DataFrame:
    """Contexts of large buckets, split by ranges of offsets; ``p`` is the anchor's place (null: not searched yet)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out: tuple[list, ...] = tuple([] for _ in range(9))
                cols = [b.column(i).slice(at, 256).to_pylist() for i in range(8)]
                for doc, t, key, n, n_win, lo, p, ctx in zip(*cols):
                    if p is None:
                        raw = mix64(gram_hashes(np.frombuffer(ctx, np.uint8), gram)).view(np.int64)
                        p = int(np.argmax(raw == key))       # the leftmost one is the anchor
                    for bucket, first, wins, c in split_context(ctx, key, n_win, p, width, min_len, gram):
                        row = (doc, t, bucket, c, n, wins, lo + first, p - first, ctx[first: first + wins + min_len - 1])
                        for o, v in zip(out, row):
                            o.append(v)
                for i in (2, 3):
                    out[i][:] = np.array(out[i], np.uint64).view(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)

    names = ["doc_id", "t", "key", "c", "n", "n_win", "lo", "p", "ctx"]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return contexts.select("doc_id", "t", "key", "n", "n_win", "lo", "p", "ctx").mapInArrow(run, SUB)


def _refined(contexts: DataFrame, any_large: bool, min_len: int, gram: int, group_limit: int) -> DataFrame:
    """Runs of repeated windows in contexts that occur once, of buckets of any size.

    Buckets of up to ``group_limit`` contexts are refined in a task. Larger ones are split, at most
    log(min_len) / log(RANGES) times; sub-contexts found twice are settled there, the rest of a
    bucket goes on without its equal copies, and buckets of one sub-context end.
    """
    out = _shared_windows(contexts.where(F.col("d") <= group_limit), min_len)
    large = contexts.where(F.col("d") > group_limit).dropDuplicates(["key", "c"]).withColumn("p", F.lit(None).cast("int"))
    width = min_len - gram + 1
    while any_large and width > 1:
        width = -(-width // RANGES)
        parts = cut(_split(large, width, min_len, gram), "split-buckets")
        each = cut(parts.groupBy("key", "c").agg(
            F.sum("n").alias("n"), F.min(F.struct("doc_id", "t", "lo", "n_win", "p")).alias("r"),
            F.first("ctx").alias("ctx")).select("key", "c", "n", "r.*", "ctx"), "split-contexts")
        out = out.unionByName(parts.where("n = 1").join(each.where("n > 1").select("key", "c"), ["key", "c"], "left_semi")
                              .select("doc_id", "t", "lo", "n_win"))
        sizes = cut(each.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "split-sizes")
        rest = each.join(sizes, "key")
        out = out.unionByName(_shared_windows(rest.where(F.col("d") <= group_limit), min_len))
        large = rest.where(F.col("d") > group_limit)
        any_large = not sizes.where(F.col("d") > group_limit).isEmpty()
    return out


def repeated_spans(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM,
                   group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Runs of windows that also start elsewhere: ``doc_id``, ``t``, ``lo``, ``n_win``.

    ``docs``: ``doc_id``, ``t`` (hash of the text), ``text``. A run covers the bytes from ``lo``
    to ``lo + n_win + min_len - 1``.
    """
    gram = min(gram, min_len)
    found = cut(anchor_rows(docs, min_len, gram), "anchors")
    # counts are written first: a join of two plain scans lets Spark split a hot bucket
    keys = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    found = cut(found.join(keys, "key", "left_semi"), "anchors2")
    first = F.min(F.struct("doc_id", "t", "lo", "n_win")).alias("r")
    each = found.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), first)
    each = cut(each.select("key", "c", "n", "r.*"), "contexts")
    whole = (found.join(each.where("n > 1").select("key", "c"), ["key", "c"], "left_semi")
             .select("doc_id", "t", "lo", "n_win"))
    many = cut(each.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "key-sizes")
    asked = (each.join(many, "key")
             .groupBy("doc_id", "t").agg(F.collect_list(F.struct("key", "c", "n", "n_win", "lo", "d")).alias("asked")))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "t", "key", "c", "n", "n_win", "lo", "d", "ctx"]
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                rows = [(doc, t, a["key"], a["c"], a["n"], a["n_win"], a["lo"], a["d"],
                         text[a["lo"]: a["lo"] + a["n_win"] + min_len - 1])
                        for doc, t, text, asks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                                      text_bytes(part.column(2)), part.column(3).to_pylist())
                        for a in asks]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()]
    same = F.col("a.t").eqNullSafe(F.col("b.t")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    contexts = (docs.alias("a").join(asked.alias("b"), same)
                .select("a.doc_id", "a.t", "a.text", "b.asked")
                .mapInArrow(slices, "doc_id long, t long, key long, c long, n long, n_win int, lo long, d long, ctx binary"))
    contexts = cut(contexts, "context-bytes")
    any_large = not many.where(F.col("d") > group_limit).isEmpty()
    return whole.unionByName(_refined(contexts, any_large, min_len, gram, group_limit))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
                   gram: int = GRAM, group_limit: int = GROUP_LIMIT, with_text: bool = False) -> DataFrame:
    """Every row without the bytes covered by a ``min_len``-byte string that also starts elsewhere.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with
    ``with_text``, ``spans`` (start, length of removed runs) and ``kept`` (binary). Strings are
    judged on the input: all places of a repeated string go, in the same text too. Null
    texts count as empty; texts shorter than ``min_len`` stay; rows with a null id and
    repeated rows count like any other (equal rows are copies of each other); an empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"),
                      text.cast("binary").alias("text"))
    spans = (repeated_spans(src, min_len, gram, group_limit)
             .groupBy("doc_id", "t").agg(F.collect_set(F.struct("lo", "n_win")).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for data, marks in zip(text_bytes(part.column(1)), part.column(2).to_pylist()):
                    runs, kept = [], data
                    if marks:
                        runs = merge(sorted((m["lo"], m["lo"] + m["n_win"] + min_len - 1) for m in marks))
                        edges = [0, *[e for r in runs for e in r], len(data)]
                        kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))
                    for o, v in zip(out, (len(data), len(data) - len(kept), len(runs),
                                          hashlib.sha256(kept).hexdigest(),
                                          [{"start": s, "length": e - s} for s, e in runs], kept)):
                        o.append(v)
                cols = [part.column(0), *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                    cols, names = [*cols, pa.array(out[4], kind), pa.array(out[5], pa.binary())], [*names, "spans", "kept"]
                yield pa.RecordBatch.from_arrays(cols, names)

    same = F.col("a.t").eqNullSafe(F.col("b.t")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    rows = src.alias("a").join(spans.alias("b"), same, "left").select("a.doc_id", "a.text", "b.spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += ", spans array<struct<start:bigint,length:bigint>>, kept binary"
    return rows.mapInArrow(run, schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of sorted intervals (touching ones join)."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated 400-byte strings."""
    return remove_repeats(table(spark, sf_dir, "documents"))
