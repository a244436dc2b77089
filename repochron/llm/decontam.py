"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into overlapping pieces; TF-IDF vectors of the pieces (document frequencies from the
whole corpus) are reduced by a distributed randomised SVD. Every passage of every document is
folded into that latent space, pieces with a high cosine are its candidates (pieces that the space
holds badly are also compared by their exact TF-IDF vectors), and a candidate
counts if the longest common subsequence covers most of the piece and, where the benchmark has an
answer column, the answer is there too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.common import U64, cut, mix64, table

PIECE_WORDS = 64          # words of a benchmark piece at most
PIECE_STEP = 32           # words from one piece of a long item to the next
PASSAGE = 96              # words of a corpus passage
STRIDE = 32               # any 64 words in a row lie in one passage
RANK = 256                # dimensions of the latent space at most
KEPT = 0.95               # pieces that keep less of their norm there are compared by exact TF-IDF too
COSINE = 0.4
LCS = 0.7
ANSWER = 0.6              # of an answer's words; without an answer column the LCS decides alone
BLOCK = 256               # pieces searched in one pass over the corpus; not above RANK, so that the space holds them
BUFFER = 1 << 18         # bytes of text that are taken apart at once
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD[_c] = True
_MULT = U64(0x9E3779B97F4A7C15)
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))     # of each byte


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, byte offset) of each word of lower-cased UTF-8 bytes; words are runs of
    a-z, 0-9 and bytes above 127."""
    edge = np.diff(_WORD[data].astype(np.int8), prepend=0, append=0)
    at, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(at):
        return np.zeros(0, np.uint64), at
    # prefix sums of byte * m^i modulo 2^64; a word's value is a difference, scaled to its start
    up, down = _powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up, dtype=np.uint64)))
    return mix64((total[end] - total[at]) * down[at]), at


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """m^i and m^-i modulo 2^64 for i < n; those of a usual buffer are kept, those of a longer text are not."""
    if not _POWERS:
        _POWERS[:] = _powers_of(2 * BUFFER)
    return [p[:n] for p in _POWERS] if n <= 2 * BUFFER else _powers_of(n)


def _powers_of(n: int) -> list[np.ndarray]:
    inverse = U64(pow(int(_MULT), -1, 1 << 64))
    return [np.cumprod(np.concatenate(([U64(1)], np.full(n - 1, m, np.uint64)))) for m in (_MULT, inverse)]


def word_lists(texts: list[str | None]):
    """Buffers of texts: (rows, word hashes, first word of each text)."""
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        rows.append(i)
        held.append((t or "").lower().encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= BUFFER:
            yield _listed(rows, held)
            rows, held, size = [], [], 0
    if rows:
        yield _listed(rows, held)


def _listed(rows, held):
    h, at = words(np.frombuffer(b"\n".join(held) + b"\n", np.uint8))
    first = np.concatenate(([0], np.cumsum([len(x) + 1 for x in held])))
    return rows, h, np.searchsorted(at, first)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel over ``a``)."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Index:
    """What a pass over the corpus needs of one block of pieces."""
    vocabulary: np.ndarray            # sorted word hashes
    idf: np.ndarray
    item: list[int]                   # item of each piece
    pieces: list[list[int]]           # word hashes
    answers: list[list[int]]          # of each piece's item; empty without an answer
    basis: np.ndarray | None = None   # words x rank
    latent: np.ndarray | None = None  # unit rows
    weak: np.ndarray | None = None    # pieces that lose too much of their norm in the latent space
    exact: np.ndarray | None = None   # words x weak pieces, unit columns
    least: float = 0.0                # smallest weight of the wanted share of a piece's words
    flat: np.ndarray | None = None    # vocabulary indices of all pieces' words
    at: np.ndarray | None = None      # where each piece starts in ``flat``
    known: np.ndarray | None = None   # low bits of the vocabulary's hashes

    def lay_out(self) -> None:
        self.flat = self.features(np.array([w for p in self.pieces for w in p], np.uint64)).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum([len(p) for p in self.pieces]))).astype(np.int64)

    def lightest(self, share: float) -> float:
        """No passage with a common subsequence of ``share`` of some piece has less squared weight."""
        def light(words: list[int]) -> float:
            weight = np.sort(self.idf[self.features(np.array(words, np.uint64))] ** 2)
            return float(weight[: int(np.ceil(share * len(words) - 1e-9))].sum())

        return min(light(p) for p in self.pieces)

    def features(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word, or -1."""
        if self.known is None:
            self.known = np.zeros(1 << 20, bool)
            self.known[(self.vocabulary & U64((1 << 20) - 1)).astype(np.int64)] = True
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.known[(h & U64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.vocabulary, h[maybe])
            at[at == len(self.vocabulary)] = 0
            out[maybe] = np.where(self.vocabulary[at] == h[maybe], at, -1)
        return out

    def matrix(self, rows: list[int]) -> np.ndarray:
        """TF-IDF of pieces (dense; a block is small)."""
        a = np.zeros((len(rows), len(self.vocabulary)), np.float32)
        for k, r in enumerate(rows):
            f = np.unique(self.features(np.array(self.pieces[r], np.uint64)))
            a[k, f] = self.idf[f]
        return a


def make_pieces(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> DataFrame:
    """Rows (item, piece number, words, answer words) of the benchmark; the last piece ends with the item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            texts, answers = b.column(1).to_pylist(), b.column(2).to_pylist()
            for item, text, answer in zip(b.column(0).to_pylist(), texts, answers):
                w = next(word_lists([text]))[1].tolist()
                said = next(word_lists([answer]))[1].tolist() if answer else []
                for k, at in enumerate(range(0, max(1, len(w) - PIECE_WORDS + PIECE_STEP) if w else 0, PIECE_STEP)):
                    at = max(0, min(at, len(w) - PIECE_WORDS))
                    for o, v in zip(out, (item, k, w[at: at + PIECE_WORDS], said)):
                        o.append(v)
            signed = [[np.array(x, np.uint64).view(np.int64).tolist() for x in o] for o in out[2:]]
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                    *[pa.array(o, pa.list_(pa.int64())) for o in signed]]
            yield pa.RecordBatch.from_arrays(cols, ["item", "k", "w", "a"])

    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    src = benchmark.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("t"), answer.alias("a"))
    return src.dropDuplicates().mapInArrow(run, "item long, k int, w array<long>, a array<long>")


def document_frequency(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each word occurs (all documents, whole texts)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, np.zeros(0), [], [], [])
        total, n = np.zeros(len(shared.value), np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for rows, h, first in word_lists(b.slice(at, 256).column(0).to_pylist()):
                    n += len(rows)
                    f = index.features(h)
                    own = np.repeat(np.arange(len(rows)), np.diff(first))
                    hit = f >= 0
                    pair = np.unique(own[hit] * len(total) + f[hit])
                    total += np.bincount(pair % max(1, len(total)), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(total)), -1)), pa.array(np.append(total, n))], ["f", "n"])

    got = docs.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    count = dict(zip(got["f"].to_pylist(), got["n"].to_pylist()))
    return count.get(-1, 0), np.array([count.get(i, 0) for i in range(len(vocabulary))], float)


def randomised_svd(spark: SparkSession, index: Index, rank: int, seed: int = 5) -> np.ndarray:
    """Right factors (words x rank) of the TF-IDF matrix, its rows dealt over tasks.

    Range finder ``A'A(A'A O)`` with a Gaussian start, each product a distributed sum of the
    tasks' rows; then the small Gram matrix of ``A Q`` gives the factors. What reaches the
    driver is words x (rank + 16) numbers and a square matrix, for one block of pieces.
    """
    n, width = len(index.pieces), min(rank + 16, len(index.pieces), len(index.vocabulary))
    shared = spark.sparkContext.broadcast(index)
    rows = spark.range(n).repartition(max(1, min(n // 64, 64)))

    def product(right: np.ndarray, gram: bool) -> np.ndarray:
        """A'(A right), or (A right)'(A right)."""
        given = spark.sparkContext.broadcast(right.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if not b.num_rows:
                    continue
                a = shared.value.matrix(b.column(0).to_pylist())
                y = a @ given.value
                part = (y.T @ y if gram else a.T @ y).astype(float)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

        def add(key, part):
            v = part["v"].combine_chunks().flatten().to_numpy().reshape(len(part), -1).sum(axis=0)
            return pa.table({"i": pa.array([key[0].as_py()]), "v": pa.array([v], pa.list_(pa.float64()))})

        got = (rows.mapInArrow(run, "i long, v array<double>").groupBy("i")
               .applyInArrow(add, "i long, v array<double>").toArrow().sort_by("i"))
        return got["v"].combine_chunks().flatten().to_numpy().reshape(len(got), -1)

    z = np.random.default_rng(seed).standard_normal((len(index.vocabulary), width))
    for _ in range(2):
        z, _r = np.linalg.qr(product(z, False))
    value, turn = np.linalg.eigh(product(z, True))
    order = np.argsort(-value)[:rank]
    order = order[value[order] > 1e-6 * max(value.max(), 1e-12)]
    return (z @ turn[:, order]).astype(np.float32)


def search(index: Index, h: np.ndarray, first: np.ndarray, cosine: float, share: float, answer: float):
    """Matches (text of the buffer, piece, cosine, lcs share) in one buffer of word lists."""
    f = index.features(h)
    weight = np.where(f >= 0, index.idf[f], 0.0) ** 2
    upto = np.concatenate(([0.0], np.cumsum(weight)))
    count = np.diff(first)
    n_pass = np.maximum(1, -(-(count - PASSAGE) // STRIDE) + 1) * (count > 0)
    own = np.repeat(np.arange(len(count)), n_pass)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)
    start = first[own] + k * STRIDE
    end = np.minimum(start + PASSAGE, first[own + 1])
    open_ = np.flatnonzero(upto[end] - upto[start] >= index.least - 1e-6)
    out = []
    for at in range(0, len(open_), 512):
        these = open_[at: at + 512]
        size = end[these] - start[these]
        pos = np.repeat(start[these] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row = np.repeat(np.arange(len(these)), size)
        seen = f[pos] >= 0
        pair = np.unique(row[seen] * len(index.vocabulary) + f[pos[seen]])      # presence, not counts
        row, word = pair // len(index.vocabulary), pair % len(index.vocabulary)
        if not len(row):
            continue
        cuts = np.flatnonzero(np.diff(row, prepend=-1))
        folded = np.add.reduceat(index.basis[word] * index.idf[word, None].astype(np.float32), cuts, axis=0)
        norm = np.linalg.norm(folded, axis=1)
        sims = (folded / np.maximum(norm, 1e-9)[:, None]) @ index.latent.T
        if len(index.weak):
            whole = np.sqrt(np.add.reduceat(index.idf[word] ** 2, cuts))
            exact = np.add.reduceat(index.exact[word] * index.idf[word, None].astype(np.float32), cuts, axis=0)
            sims[:, index.weak] = np.maximum(sims[:, index.weak], exact / whole[:, None])
        r, piece = np.nonzero(sims >= cosine)
        # a common subsequence has at most the piece's words that the passage holds at all
        inside = np.zeros((len(cuts), len(index.vocabulary)), bool)
        inside[np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(row)))), word] = True
        size = index.at[piece + 1] - index.at[piece]
        ends = np.cumsum(size)
        place = np.repeat(index.at[piece] - (ends - size), size) + np.arange(size.sum())
        held = np.concatenate(([0], np.cumsum(inside[np.repeat(r, size), index.flat[place]])))
        enough = held[ends] - held[ends - size] >= share * size
        for r, piece in zip(r[enough].tolist(), piece[enough].tolist()):
            p = these[row[cuts[r]]]
            passage = h[start[p]: end[p]].tolist()
            want = index.pieces[piece]
            part = lcs(want, passage) / len(want)
            if part >= share and lcs(index.answers[piece], passage) >= answer * len(index.answers[piece]):
                out.append((int(own[p]), int(piece), float(sims[r, piece]), part))
            elif part >= share:
                # the answer may lie outside the passage (an answer column, or another piece)
                whole = h[first[own[p]]: first[own[p] + 1]].tolist()
                if answered(index.answers[piece], whole, answer):
                    out.append((int(own[p]), int(piece), float(sims[r, piece]), part))
    return out


def answered(want: list[int], text: list[int], share: float) -> bool:
    """Whether some stretch of the text of twice the answer's length holds ``share`` of it in order."""
    size = max(2 * len(want), 1)
    return any(lcs(want, text[at: at + size]) >= share * len(want) for at in range(0, max(1, len(text)), max(1, size // 2)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, rank: int = RANK,
          cosine: float = COSINE, share: float = LCS, answer: float = ANSWER, block: int = BLOCK) -> DataFrame:
    """Benchmark items found in documents: ``doc_id``, ``item_id``, ``cosine``, ``lcs`` (best piece).

    Items of over 64 words are cut into pieces that overlap by half. An item is found in a document if one of its pieces is,
    so an excerpt of a long item is found too: a piece counts in a
    passage if their latent cosine (or the exact one, for pieces that the ``rank`` dimensions hold
    badly) reaches ``cosine``, their longest common subsequence of
    words reaches ``share`` of the piece, and, if the item has an answer (``answer_col``), the share
    ``answer`` of it is there in order. The benchmark is the query set: ``block`` pieces at a
    time are searched in one pass over all documents, each document where it lies (no
    shuffle of texts). Rows with a null id, null and empty texts and items without a word
    find nothing; repeated rows each give their row; empty tables give no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id")
                      ).where(F.col("doc_id").isNotNull())
    found = spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double")
    for index in _indexes(src, benchmark, item_col, item_text, answer_col, rank, share, block):
        found = found.unionByName(_found(src, index, cosine, share, answer))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", answer_col: str | None = None, rank: int = RANK, cosine: float = COSINE,
                  share: float = LCS, answer: float = ANSWER, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` (all columns) in which ``leaks`` finds no item; ids are not used.

    Each row is judged where it lies: no shuffle."""
    names = docs.columns
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    for index in _indexes(rows, benchmark, item_col, item_text, answer_col, rank, share, block):
        rows = _clean(rows, index, cosine, share, answer)
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _indexes(src: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, answer_col: str | None, rank: int,
             share: float, block: int) -> Iterator[Index]:
    """The index of each block of whole items (about ``block`` pieces)."""
    spark = src.sparkSession
    pieces = cut(make_pieces(benchmark, item_col, item_text, answer_col), "benchmark")
    n_blocks = max(1, -(-pieces.count() // block))
    for b in range(n_blocks):
        got = pieces.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).toArrow()
        if not got.num_rows:
            continue
        got = got.sort_by([("item", "ascending"), ("k", "ascending")])
        said, asked = ([np.array(x, np.int64).view(np.uint64).tolist() for x in got[c].to_pylist()] for c in ("w", "a"))
        index = Index(np.zeros(0, np.uint64), np.zeros(0), got["item"].to_pylist(), said, asked)
        index.vocabulary = np.unique(np.array([w for p in index.pieces for w in p], np.uint64))
        n, df = document_frequency(src, index.vocabulary)
        index.idf = np.log((n + 1.0) / (df + 1.0)) + 0.05
        index.basis = randomised_svd(spark, index, rank)
        rows = index.matrix(list(range(len(index.pieces))))
        index.least = index.lightest(share)
        norm, latent = np.linalg.norm(rows, axis=1), rows @ index.basis
        held = np.linalg.norm(latent, axis=1)
        index.latent = latent / np.maximum(held, 1e-9)[:, None]
        index.weak = np.flatnonzero(held < KEPT * norm)
        index.exact = np.ascontiguousarray((rows[index.weak] / norm[index.weak, None]).T)
        index.lay_out()
        yield index


def _items(idx: Index, texts: list[str | None], cosine: float, share: float, answer: float) -> Iterator[tuple]:
    """(text number, item, cosine, lcs share) of the items found."""
    for rows, h, first in word_lists(texts):
        best: dict[tuple[int, int], dict[int, tuple]] = {}
        for row, piece, cos, part in search(idx, h, first, cosine, share, answer):
            seen = best.setdefault((rows[row], idx.item[piece]), {})
            seen[piece] = max(seen.get(piece, (0.0, 0.0)), (part, cos))
        for (row, item), seen in sorted(best.items()):
            part, cos = max(seen.values())
            yield row, item, cos, part


def _found(src: DataFrame, index: Index, cosine: float, share: float, answer: float) -> DataFrame:
    shared = src.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = part.column(1).to_pylist()
                out = [(ids[row], *rest) for row, *rest in
                       _items(shared.value, part.column(0).to_pylist(), cosine, share, answer)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                                                     ["doc_id", "item_id", "cosine", "lcs"])

    return src.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs double")


def _clean(rows: DataFrame, index: Index, cosine: float, share: float, answer: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hit = {row for row, *_ in _items(shared.value, part.column(0).to_pylist(), cosine, share, answer)}
                yield part.filter(pa.array([i not in hit for i in range(part.num_rows)]))

    return rows.mapInArrow(run, rows.schema)


def op8_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in any document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
