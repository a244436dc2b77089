"""Periodic runs of words: scale tiles, boundary Z-functions, fragments stitched by document and period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repochron.llm.common import U64, cut, mix64, table, text_bytes

EXPONENT = 4       # a run is at least so many periods long
SHORTEST = 6       # and at least so many words
TILE = 4096        # words that a tile answers for, unless its octave asks for more
PORTION = 1 << 20  # bytes of texts that a task holds as words
SIDE_BY_SIDE = 1 << 18   # words of texts that are screened together


def portions(batch: pa.RecordBatch, column: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``most`` bytes of text (a longer text is a part of its own)."""
    sizes, start, held = [len(t) for t in text_bytes(batch.column(column))], 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def codes_of(words: list[bytes]) -> np.ndarray:
    """Words as numbers: equal exactly if the words are."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def tile_words(scale: int) -> int:
    """Words between the starts of two tiles of an octave (a multiple of ``scale``)."""
    return max(TILE, 8 * scale)


def blocks_of_a_run(scale: int, exponent: int, shortest: int) -> int:
    """Whole neighbouring aligned blocks of ``scale`` words that recur one period on, in any run of the octave
    (``scale`` <= period < 2 ``scale``): two at least."""
    return max(2, (max(shortest, exponent * scale) - 2 * scale + 1) // scale)


def widen(h: np.ndarray, scale: int) -> np.ndarray:
    """Hashes of all windows of ``2 * scale`` words from those of ``scale`` words."""
    return mix64(h[:-scale] * U64(0x9E3779B97F4A7C15) + h[scale:])


def recurring(h: np.ndarray, scale: int) -> np.ndarray:
    """Row j, column c: whether the block at ``j * scale`` may recur ``scale + c`` words on."""
    blocks = len(h) // scale
    anchors, body = h[: blocks * scale: scale], h[scale:]
    same = np.zeros((blocks, scale), bool)
    np.equal(body[: (blocks - 1) * scale].reshape(blocks - 1, scale), anchors[:-1, None], out=same[:-1])
    rest = body[(blocks - 1) * scale:]
    same[-1, : len(rest)] = rest == anchors[-1]
    return same


def tiles_in_question(h: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> Iterator[tuple[int, int]]:
    """(scale, number) of the tiles that may hold a part of a run, from hashes of the words.

    The octave of scale P has the periods P to 2P - 1. Words that equal those one period on stand in
    stretches of at least ``(exponent - 1)`` periods, so such a stretch holds neighbouring whole blocks of
    P words, aligned to P, that all recur one period on (``blocks_of_a_run``). Block hashes, of twice the
    width in each octave, tell which blocks may do so; equal blocks have equal hashes, so no run is missed.
    """
    n, scale = len(h), 1
    while max(shortest, exponent * scale) <= n:
        same = recurring(h, scale)
        need = blocks_of_a_run(scale, exponent, shortest)
        chain = same[: max(0, len(same) - need + 1)].copy()
        for k in range(1, need):
            chain &= same[k: k + len(chain)]
        rows = np.flatnonzero(chain.any(axis=1))
        if len(rows):
            step = tile_words(scale)
            rows = (rows[:, None] + np.arange(need)).ravel()
            for k in np.unique(rows * scale // step).tolist():
                yield scale, k
        h = widen(h, scale)
        scale *= 2


def tiles_of(words: list[bytes], exponent: int = EXPONENT, shortest: int = SHORTEST) -> Iterator[tuple[int, int, np.ndarray]]:
    """Overlapping tiles (scale, start, word codes) of one text, octave by octave. A tile answers for ``tile_words``
    words and carries one block before and three after them."""
    codes = codes_of(words)
    for scale, k in tiles_in_question(hashes_of(words), exponent, shortest):
        step = tile_words(scale)
        start = max(0, k * step - scale)
        yield scale, start, codes[start: (k + 1) * step + 3 * scale]


def hashes_of(words: list[bytes]) -> np.ndarray:
    return mix64(np.fromiter(map(hash, words), np.int64, len(words)).view(U64))


def screen(texts: list[list[bytes]], exponent: int = EXPONENT, shortest: int = SHORTEST) -> np.ndarray:
    """Which texts have a tile in question. Texts are tested side by side first: a single block of any
    alignment that recurs puts a text forward, which every text with a tile in question has."""
    hashes = [hashes_of(t) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(texts), bool)
    group: list[int] = []
    held = 0
    for i in [*order.tolist(), None]:
        if i is None or held > SIDE_BY_SIDE:
            for j in _put_forward(group, hashes, exponent, shortest):
                out[j] = next(tiles_in_question(hashes[j], exponent, shortest), None) is not None
            group, held = [], 0
        if i is not None and sizes[i] >= shortest:
            group.append(i)
            held += int(sizes[i])
    return out


def _put_forward(group: list[int], hashes: list[np.ndarray], exponent: int, shortest: int) -> list[int]:
    """Members of ``group`` (longest first) with a recurring block; a separator of its own ends each."""
    if not group:
        return []
    sizes = np.array([len(hashes[i]) for i in group])
    ends = np.cumsum(sizes + 1)
    h = np.empty(ends[-1], U64)
    for i, end, size in zip(group, ends.tolist(), sizes.tolist()):
        h[end - size - 1: end - 1] = hashes[i]
    h[ends - 1] = mix64(np.arange(len(group), dtype=U64) + U64(0x632BE59BD9B4E019))
    hit, scale = np.zeros(len(group), bool), 1
    while True:
        last = int(np.searchsorted(-sizes, -max(shortest, exponent * scale), "right"))
        if not last:
            break
        h = h[: ends[last - 1] - scale + 1]
        same = recurring(h, scale)
        if scale == 1:      # every alignment is the same here
            need = blocks_of_a_run(1, exponent, shortest)
            for k in range(1, need):
                same = same[:-1] & recurring(h, 1)[k:]
        rows = np.flatnonzero(same.any(axis=1)) * scale
        hit[np.searchsorted(ends, rows, "right")] = True
        h = widen(h, scale)
        scale *= 2
    return [i for i, x in zip(group, hit.tolist()) if x]


def z_function(s: list[int], stop: int) -> list[int]:
    """For each i in 1 .. stop - 1 the length of the longest common prefix of ``s`` and ``s[i:]``."""
    n, z, left, right = len(s), [0] * min(stop, len(s)), 0, 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def fragments(words: np.ndarray, scale: int, start: int) -> dict[int, list[list[int]]]:
    """Period -> stretches [first, last + 1) of one tile whose words equal those one period on.

    At the boundary before each block a Z-function forward gives, for all periods of the octave at once,
    how far the words from there agree with those one period on; one backward gives how far they agree
    before it. Each block that agrees whole makes a stretch, cut at one block beyond it on either side;
    neighbouring ones are joined. Positions are those of the document.
    """
    step, found = tile_words(scale), {}
    first = -(-start // step) * step        # the words before it belong to the tile before
    text = words.tolist()
    for at in range(first - start, min(first - start + step, len(text) - 2 * scale + 1), scale):
        ahead = text[at: at + 4 * scale]
        forward = z_function(ahead, 2 * scale)
        if max(forward[scale:], default=0) < scale:
            continue
        before = text[max(0, at - scale): at][::-1]
        beyond = text[at: at + 2 * scale][::-1]
        backward = z_function([*before, -1, *beyond], len(before) + 2 + len(beyond) - scale)
        for period in range(scale, len(forward)):
            if forward[period] >= scale:
                # the words before at + period, read backward, begin at this place of ``beyond``
                back = backward[len(before) + 1 + len(beyond) - period] if before else 0
                low, high = start + at - back, start + at + min(forward[period], 2 * scale)
                spans = found.setdefault(period, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
    return found


TILE_SCHEMA = "key long, scale long, start long, words array<int>"


def explode_tiles(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """``key``, ``text`` -> one row per tile that may hold a part of a run."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "scale", "start", "words"]

        def flush(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], names=names)

        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for scale, start, words in tiles_of(text.split(), exponent, shortest):
                    rows.append((key, scale, start, words))
                    held += len(words)
                    if held > 1 << 20:
                        yield flush(rows)
                        rows, held = [], 0
            if rows:
                yield flush(rows)

    return docs.select("key", "text").mapInArrow(explode, TILE_SCHEMA)


def solve_tiles(tiles: DataFrame) -> DataFrame:
    """Fragments ``key, period, low, high`` of every tile, each tile by itself."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(3)
            values, offsets = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
            out: list[tuple[int, int, int, int]] = []
            for k, (key, scale, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                for period, spans in fragments(values[offsets[k]: offsets[k + 1]], scale, start).items():
                    out.extend((key, period, low, high) for low, high in spans)
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "period", "low", "high"])

    return tiles.mapInArrow(solve, "key long, period long, low long, high long")


def stitch(parts: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """Runs ``key, start, length, period`` from fragments: those of one document and period that overlap
    or touch are one stretch; of periods that give the same run the smallest stays. A group holds one
    document's fragments of one period, at most one for each block and fewer than its words."""
    same = Window.partitionBy("key", "period").orderBy("low", "high")
    reach = F.max("high").over(same.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("low") > F.coalesce("reach", F.lit(-1)), 1).otherwise(0)).over(same)
    whole = (parts.withColumn("reach", reach).withColumn("island", island)
             .groupBy("key", "period", "island").agg(F.min("low").alias("start"), F.max("high").alias("last")))
    length = F.col("last") - F.col("start") + F.col("period")
    return (whole.select("key", "start", length.alias("length"), "period")
            .where(F.col("length") >= F.greatest(F.lit(shortest), F.lit(exponent) * F.col("period")))
            .groupBy("key", "start", "length").agg(F.min("period").alias("period")))


def _finished(ids, n_words, runs, kept) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())],
                                      names=["__id", "n_words", "runs", "collapsed"])


def without_repeats(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words that no run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        edge[run["start"] + run["period"]] += 1
        edge[run["start"] + run["length"]] -= 1
    return [w for w, d in zip(words, np.cumsum(edge).tolist()) if not d]


def collapse(docs: DataFrame) -> DataFrame:
    """``__id``, ``text``, ``runs`` -> ``n_words``, ``runs``, ``collapsed``."""
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            every = [t.split() for t in text_bytes(batch.column(1))]
            kept = [b" ".join(without_repeats(w, runs) if runs else w) for w, runs in zip(every, batch.column(2).to_pylist())]
            yield _finished(batch.column(0), [len(w) for w in every], batch.column(2), kept)

    kind = docs.schema["__id"].dataType.simpleString()
    return docs.select("__id", "text", "runs").mapInArrow(finish, f"__id {kind}, n_words long, {RUNS}, collapsed string")


RUNS = "runs array<struct<start:long,length:long,period:long>>"
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT,
                  shortest: int = SHORTEST) -> DataFrame:
    """Every maximal run of words in each text, and the text without what the runs repeat.

    A run is a stretch of words with smallest period q (words q apart are equal) of at least
    ``max(shortest, exponent * q)`` words that can't be extended; ``exponent`` is 4 or more.
    Documents explode into overlapping tiles per octave of periods, as far as block hashes leave a tile in
    question; tiles are dealt evenly over all tasks and solved by themselves with Z-functions at their
    block boundaries; fragments meet by document and period and are stitched. Only texts with a tile in
    question are shuffled; all others are finished where they lie.

    Returns id, ``n_words``, ``runs`` (structs start, length, period, by start, then period) and ``collapsed``
    (the words that no run holds after its first period, joined by one blank). Words are what stands between
    blanks and 0x09-0x0D. Null and empty texts have no words, no runs and an empty ``collapsed``. Rows count one by
    one: repeated and null ids stay apart; an empty table gives no rows; other columns don't matter. Long texts
    are taken whole: tiles of one text go to many tasks.
    """
    if exponent < 4:
        raise ValueError("exponent must be 4 or more")
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    kind = narrow.schema["__id"].dataType.simpleString()

    def open_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            yield batch.filter(pa.array(screen([t.split() for t in text_bytes(batch.column(1))], exponent, shortest)))

    def finish_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            every = [t.split() for t in text_bytes(batch.column(1))]
            plain = ~screen(every, exponent, shortest)
            every = [w for w, p in zip(every, plain.tolist()) if p]
            runs = pa.array([[]] * len(every), ARROW_RUNS)
            yield _finished(batch.column(0).filter(pa.array(plain)), [len(w) for w in every], runs, [b" ".join(w) for w in every])

    # keys are given once, in a written table, so that they hold for every later read
    open_docs = cut(narrow.mapInArrow(open_texts, f"__id {kind}, text string")
                    .select(F.monotonically_increasing_id().alias("key"), "__id", "text"), "runs-open")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))   # a fixed number: little data, much work
    tiles = explode_tiles(open_docs, exponent, shortest).repartition(spread, "key", "scale", "start")
    runs = (stitch(solve_tiles(tiles), exponent, shortest).groupBy("key")
            .agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
            .select("key", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs")))
    no_runs = F.expr(f"cast(array() as {RUNS.split(' ', 1)[1]})")
    solved = open_docs.join(runs, "key", "left").select("__id", "text", F.coalesce("runs", no_runs).alias("runs"))
    plain = narrow.mapInArrow(finish_plain, f"__id {kind}, n_words long, {RUNS}, collapsed string")
    return collapse(solved).unionByName(plain).withColumnRenamed("__id", id_col)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The stated input of the query: of documents whose id's crc32 ends in 0, the words from a place on
    repeat with a period, both given by the crc32; all other texts are as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    at = "int(g % size(w))"
    planted = F.expr(f"""
        CASE WHEN size(w) > 0 THEN array_join(concat(slice(w, 1, {at}), transform(sequence({at}, size(w) - 1),
            i -> w[{at} + (i - {at}) % (1 + int(floor((size(w) - {at}) / (3 + g % 8))))])), ' ')
        ELSE text END""")
    return (docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), words.alias("w"))
            .select("doc_id", planted.alias("text")))


def op13_tiled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all ``documents`` with the stated repeats: their number, the run of greatest exponent (exact;
    ties: smallest start, then period), digests of all runs and of the collapsed text."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    better = ("CASE WHEN a.length IS NULL OR b.length * a.period > a.length * b.period THEN b "
              "WHEN b.length * a.period < a.length * b.period THEN a "
              "WHEN (b.start, b.period) < (a.start, a.period) THEN b ELSE a END")
    best = F.expr(f"aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (a, b) -> {better})")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return (found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("r"),
                         F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", "r.start", "r.length", "r.period",
                    F.expr("(1000 * r.length) div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))
