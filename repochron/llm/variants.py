"""Spelling variants: a variable-length gram index over the corpus's words, one edit apart."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.common import U64, cut, mix64, table

LENGTH = 5          # code points of a word at least
COUNT = 3           # occurrences at least
QMIN, QMAX = 2, 8   # code points of a gram (at most 8 fit one 64-bit number)
LIST = 64           # words of a gram's list beyond which the gram is extended
GRAMS = 1 << 15     # extended grams per class and length at most
CLASSES = 16        # words that are longer share one gram dictionary
SKETCH = 1 << 18    # counters that order grams by the length of their lists
DISTINCT = 300_000  # different words that a task holds while counting
START, END = 1, 2   # stand before and after each word


def count_words(docs: DataFrame, id_col: str, text_col: str, pattern: str,
                edit: Callable[[str, bytes], str] | None = None, min_length: int = LENGTH) -> DataFrame:
    """``word``, ``n``: occurrences of the runs of ``pattern`` in all texts, A-Z lower-cased. Counted per text, then per
    task, then after one shuffle. ``edit(run, id)`` may change a run of a text."""
    word = re.compile(pattern)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])

        total: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = Counter(word.findall(text.encode().lower().decode()))
                prefix = (key or "").encode()
                for run, n in runs.items():
                    done = run if edit is None else edit(run, prefix)
                    if len(done) >= min_length:
                        total[done] += n
                if len(total) > DISTINCT:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    return (docs.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
            .mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def folded(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of one byte per code point, between START and END. Code points beyond
    0xFF share bytes, which can only add candidates."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
    out = np.empty((len(words), length + 2), np.uint64)
    out[:, 1:-1] = np.where((points > END) & (points <= 0xFF), points, 3 + points % 253)
    out[:, 0], out[:, -1] = START, END
    return out


def longest_gram(m: int) -> int:
    """Longest gram between words of m and of m or m + 1 code points: an edit touches at most so many
    of a word's m + 1 grams or more, and at least two stay."""
    return min(QMAX, max(QMIN, m - 1))


def gram_class(m: int) -> int:
    return min(m, CLASSES)


def grams_at(points: np.ndarray, q: int) -> np.ndarray:
    """The grams of q code points at each place of each word, packed into 64 bits."""
    width = points.shape[1] - q + 1
    out = np.zeros((len(points), max(0, width)), U64)
    for k in range(q):
        out = (out << U64(8)) | points[:, k: k + width]
    return out


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(values.shape, bool)
    at = np.searchsorted(sorted_set, values)
    return sorted_set[np.minimum(at, len(sorted_set) - 1)] == values


def decompose(points: np.ndarray, m: int, frequent: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Variable grams: at each place the shortest gram that is not frequent (or the longest allowed, or
    what is left of the word). Returns the grams and their lengths, one column per place. A gram
    depends on its own code points alone, so an edit changes only the grams that hold its place."""
    places = points.shape[1] - QMIN + 1
    gram, size = grams_at(points, QMIN), np.full((len(points), places), QMIN, np.int64)
    going = member(gram, frequent.get((gram_class(m), QMIN), np.empty(0, U64)))
    for q in range(QMIN + 1, longest_gram(m) + 1):
        longer = grams_at(points, q)
        width = longer.shape[1]
        if not width or not going.any():
            break
        grow = going[:, :width]
        gram[:, :width] = np.where(grow, longer, gram[:, :width])
        size[:, :width] += grow
        going = np.zeros_like(going)
        going[:, :width] = grow & member(longer, frequent.get((gram_class(m), q), np.empty(0, U64)))
    return gram, size


def affected(size: np.ndarray) -> np.ndarray:
    """Per word the most grams that one edit can touch: those over the place that most grams hold."""
    rows, places = size.shape
    edge = np.zeros((rows, places + QMIN + QMAX), np.int64)
    at = np.broadcast_to(np.arange(places), size.shape)
    row = np.broadcast_to(np.arange(rows)[:, None], size.shape)
    np.add.at(edge, (row, at), 1)
    np.add.at(edge, (row, at + size), -1)
    cover = np.cumsum(edge, axis=1)[:, 1: places + QMIN - 2]   # the places between START and END
    return cover.max(axis=1)


def elements(gram: np.ndarray, m: int) -> np.ndarray:
    """Grams as elements of a set: the k-th equal gram of a word is an element of its own; equal elements of
    words that are compared (class m) have equal numbers."""
    order = np.argsort(gram, axis=1, kind="stable")
    ordered = np.take_along_axis(gram, order, axis=1)
    nth = np.zeros(gram.shape, np.int64)
    for k in range(1, gram.shape[1]):
        nth[:, k] = np.where(ordered[:, k] == ordered[:, k - 1], nth[:, k - 1] + 1, 0)
    rank = np.empty_like(nth)
    np.put_along_axis(rank, order, nth, axis=1)
    return mix64(mix64(gram) + U64(m) * U64(0x9E3779B97F4A7C15) + rank.astype(U64))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words of equal length together: length, their places in the list, their matrix."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, (1 << 20) // (length + 2))
        for k in range(0, len(at), step):
            part = at[k: k + step]
            yield length, part, folded([words[i] for i in part.tolist()], length)


def roles(length: int, shortest: int) -> list[tuple[int, int]]:
    """(m, role): a word meets words of its own length and longer ones at its length, shorter ones at theirs."""
    return [(length, 0)] + ([(length - 1, 1)] if length > shortest else [])


def gram_dictionary(words: DataFrame, shortest: int, long_list: int = LIST, most: int = GRAMS) -> dict[tuple[int, int], np.ndarray]:
    """Frequent grams by (class, length): those in over ``long_list`` words, or, in large corpora, in over
    1 / ``most`` of all places, so that the driver and each task hold at most ``most`` of them per class and length
    (fewer than ``CLASSES * QMAX * most`` numbers in all)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], list[np.ndarray]] = {}
            for length, _, points in by_length(batch.column(0).to_pylist()):
                for m, _ in roles(length, shortest):
                    for q in range(QMIN, longest_gram(m)):
                        found.setdefault((gram_class(m), q), []).append(grams_at(points, q).ravel())
            for (c, q), parts in found.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), c)), pa.array(np.full(len(gram), q)),
                                                  pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["c", "q", "gram", "n"])

    lengths = F.least(F.length("word"), F.lit(CLASSES + 1)).alias("l")
    total: Counter[tuple[int, int]] = Counter()
    for r in words.groupBy(lengths).agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("word")).alias("s")).collect():
        for m, _ in roles(r["l"], shortest):
            for q in range(QMIN, longest_gram(m)):
                total[gram_class(m), q] += r["s"] + r["k"] * (3 - q)
    bound = [F.when((F.col("c") == c) & (F.col("q") == q), max(long_list, n // most)) for (c, q), n in total.items()]
    if not bound:
        return {}
    kept = (words.select("word").mapInArrow(count, "c long, q long, gram long, n long")
            .groupBy("c", "q", "gram").agg(F.sum("n").alias("n")).where(F.col("n") > F.coalesce(*bound)).drop("n"))
    out: dict[tuple[int, int], list[int]] = {}
    for r in kept.collect():
        out.setdefault((r["c"], r["q"]), []).append(r["gram"])
    return {k: np.sort(np.array(v, np.int64).view(U64)) for k, v in out.items()}


def list_lengths(words: DataFrame, frequent: dict, shortest: int, size: int = SKETCH) -> np.ndarray:
    """Counters (``size`` of them) over hashed elements: upper bounds of list lengths."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for length, _, points in by_length(batch.column(0).to_pylist()):
                for m, _ in roles(length, shortest):
                    hashed = elements(decompose(points, m, frequent)[0], m) % U64(size)
                    total += np.bincount(hashed.ravel().astype(np.int64), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    out = np.zeros(size, np.int64)
    rows = (words.select("word").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow())
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def list_keys(words: DataFrame, frequent: dict, lists: np.ndarray, shortest: int, long_list: int = LIST) -> DataFrame:
    """The lists in which a word is entered: ``key``, ``role``, ``word``, ``n``.

    A word of g grams, of which one edit touches at most a, shares g - a or more (two at least) with a word one edit
    away. So their first common gram, rarest first, is among its a + 1 rarest grams, and the second one
    among its a + 2 rarest. It is entered in the lists of its a + 1 rarest grams; where such a list is long,
    in those of that gram together with each rarer-to-commoner follower up to place a + 2 instead.
    """
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_pylist()
            for length, at, points in by_length(every):
                for m, role in roles(length, shortest):
                    gram, size = decompose(points, m, frequent)
                    bound = affected(size)[:, None]
                    element = elements(gram, m)
                    n = lists[(element % U64(len(lists))).astype(np.int64)]
                    order = np.lexsort((element, n), axis=1)
                    element, n = np.take_along_axis(element, order, axis=1), np.take_along_axis(n, order, axis=1)
                    column = np.arange(element.shape[1])
                    first, long_ = column <= bound, n > long_list
                    picked = [(*np.nonzero(first & ~long_), None)]
                    for k in range(int(bound.max()) + 1):
                        hot = (first & long_)[:, k][:, None] & (column > k) & (column <= bound + 1)
                        picked.append((*np.nonzero(hot), k))
                    row = np.concatenate([p[0] for p in picked])
                    key = np.concatenate([element[r, c] if k is None else mix64(element[r, k] + U64(3) * element[r, c])
                                          for r, c, k in picked])
                    source = pa.array(at[row])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(row), role, np.int32)),
                         batch.column(0).take(source), batch.column(1).take(source)], names=["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(enter, "key long, role int, word string, n long")


def near_words(words: DataFrame, shortest: int = LENGTH, long_list: int = LIST) -> DataFrame:
    """All pairs ``a``, ``a_n``, ``b``, ``b_n`` of the distinct words of ``words`` (``word``, ``n``; each of
    ``shortest`` or more code points) that differ by exactly one inserted, deleted or replaced code point. Each pair
    once."""
    frequent = gram_dictionary(words, shortest, long_list)
    lists = list_lengths(words, frequent, shortest)
    entered = list_keys(words, frequent, lists, shortest, long_list)

    def side(x: str) -> DataFrame:
        return entered.select("key", F.col("role").alias(f"{x}_role"), F.col("word").alias(x), F.col("n").alias(f"{x}_n"))

    # one condition over both sides: nothing is filtered before the shuffle, so that both sides read the same one
    met = side("a").hint("merge").join(side("b"), "key").where(
        "(a_role < b_role or (a_role + b_role = 0 and a < b)) and levenshtein(a, b, 1) = 1")
    return met.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``form`` -> ``word``, ``root``: forms followed to the last, by pointer doubling (rounds
    grow with the logarithm of the longest chain, and a chain at least doubles its count at each step).
    Words without a form are their own root and aren't returned."""
    at = cut(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(ahead, "root", "left")
        step = cut(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def spelling_variants(words: DataFrame, min_length: int = LENGTH, factor: int = 2, long_list: int = LIST) -> DataFrame:
    """Groups the spellings of ``words`` (``word``, ``n``), any table of words and their counts.

    Variable-length gram index: grams that stand in many words are extended (``gram_dictionary``), words are cut
    into the shortest grams that aren't frequent (``decompose``), a bound on the grams that one edit touches says
    which few lists of each word are merged (``list_keys``), and every pair that meets is verified.
    Nothing of the words comes to the driver but the dictionary and the list counters, both of bounded size.

    Returns ``word``, ``n``, ``form`` (its near word of largest n, ties by code points, if that is at least
    ``factor`` times its own n; else null), ``form_n``, ``n_near`` (words exactly one edit away) and ``root`` (forms
    followed to the last). Repeated words count together; null words, null counts and words shorter than
    ``min_length`` are left out; an empty table gives no rows; other columns don't matter.
    """
    words = cut(words.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n"))
                .where("n is not null"), "words")
    pairs = cut(near_words(words, min_length, long_list), "near")
    both = (pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
            .unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    size = -F.col("best.col1")
    formed = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(size >= factor * F.col("n"), F.col("best.near")).alias("form"),
        F.when(size >= factor * F.col("n"), size).alias("form_n")), "forms")
    return (formed.join(roots(formed), "word", "left")
            .select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root")))


def planted_slip(run: str, key: bytes) -> str:
    """The stated slips of the query: where 97 divides the crc32 of ``id:run``, one code point is missing."""
    h = zlib.crc32(key + b":" + run.encode())
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def op12_vgram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all ``documents``, with the stated slips."""
    counted = count_words(table(spark, sf_dir, "documents"), "doc_id", "text", r"[a-zÀ-ÿ]+", planted_slip)
    found = spelling_variants(counted.where(F.col("n") >= COUNT))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
