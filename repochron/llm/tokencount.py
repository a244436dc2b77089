"""Token counts that follow edits.

A text is cut into segments at places where a pre-token always ends: between a letter and a
blank that a letter follows. Token counts of segments add up, so a binary tree over the
segments (characters and tokens of each subtree) gives the count of the whole text. An edit
finds its segments by the character sums, takes in a neighbour only if it touches the
characters that make the boundary, encodes that region anew and updates the sums above it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.common import table
from repochron.llm.tokens import default_path, encoder

SEGMENT = 512
_CUT = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Segments of ``size`` characters or more (as far as a safe boundary needs)."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None or m.start() >= len(text):
            break
        out.append(text[at: m.start()])
        at = m.start()
    if at < len(text) or not out:
        out.append(text[at:])
    return out


class CountTree:
    """Segments of one text with subtree sums of characters and tokens."""

    def __init__(self, text: str, count: Callable[[str], int], size: int = SEGMENT):
        self.count, self.size, self.encoded = count, size, 0
        parts = segments(text, size)
        self._build(parts, [self._encode(p) for p in parts])

    def _encode(self, part: str) -> int:
        self.encoded += len(part)
        return self.count(part) if part else 0

    def _build(self, parts: list[str], tokens: list[int]) -> None:
        width = 1
        while width < len(parts):
            width *= 2
        self.width, self.parts = width, parts + [""] * (width - len(parts))
        self.chars = [0] * width + [len(p) for p in self.parts]
        self.tokens = [0] * width + tokens + [0] * (width - len(tokens))
        for i in range(width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.parts)

    def _find(self, at: int) -> tuple[int, int]:
        """(segment, offset in it) of a character place; the end belongs to the last segment with text."""
        at = max(0, min(at, self.n_chars - 1))
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def _near(self, i: int, step: int) -> int | None:
        """Next segment with text in one direction."""
        i += step
        while 0 <= i < self.width:
            if self.parts[i]:
                return i
            i += step
        return None

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replace ``remove`` characters from ``at`` (both held to the text) by ``insert``."""
        at = max(0, min(at, self.n_chars))
        remove = max(0, min(remove, self.n_chars - at))
        if not remove and not insert:
            return
        if not self.n_chars:
            parts = segments(insert, self.size)
            self._build(parts, [self._encode(p) for p in parts])
            return
        lo, off = self._find(at)
        if at == self.n_chars:
            off += 1
        hi, end = self._find(at + remove - 1) if remove else (lo, off - 1)
        # the left boundary needs the region's first two characters, the right one its last
        while off < 2 and (left := self._near(lo, -1)) is not None:
            off += len(self.parts[left])
            lo = left
        while end >= len(self.parts[hi]) - 1 and (right := self._near(hi, 1)) is not None:
            hi, end = right, -1
        region = "".join(self.parts[lo: hi + 1])
        region = region[:off] + insert + region[off + remove:]
        fresh = segments(region, self.size) if region else [""]
        slots = hi - lo + 1
        if len(fresh) > slots:
            tokens = self.tokens[self.width:]
            parts = self.parts[:lo] + fresh + self.parts[hi + 1:]
            counts = tokens[:lo] + [self._encode(p) for p in fresh] + tokens[hi + 1:]
            kept = [(p, c) for p, c in zip(parts, counts) if p] or [("", 0)]
            self._build([p for p, _ in kept], [c for _, c in kept])
            return
        for i, part in enumerate(fresh + [""] * (slots - len(fresh)), lo):
            self.parts[i] = part
            node = self.width + i
            self.chars[node], self.tokens[node] = len(part), self._encode(part)
        above = range((self.width + lo) // 2, (self.width + hi) // 2 + 1)
        while above.start:
            for node in above:
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            above = range(above.start // 2, (above.stop - 1) // 2 + 1)


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with an array column ``edits`` from rows (id, ``seq``, ``at``, ``remove``, ``insert``), in ``seq`` order.

    Edits of unknown or null ids are left out; every row with an id gets that id's edits."""
    logs = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seq", "at", "remove", "insert"))).alias("log"))
    logs = logs.select(F.col(id_col), F.transform("log", lambda x: F.struct(x["at"], x["remove"], x["insert"])).alias("edits"))
    return docs.drop("edits").join(logs, id_col, "left")


def edited_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits",
                  path: str | None = None, size: int = SEGMENT, with_text: bool = False) -> DataFrame:
    """Token counts before and after each row's edits, applied in order.

    ``edits_col``: array of (``at``, ``remove``, ``insert``), places counted in characters of the text as
    edited so far and held to it; null fields count as 0 or nothing, a null array as no edit.
    Returns ``doc_id``, ``tokens_before``, ``tokens_after``, ``chars_after``, ``n_edits``,
    ``reencoded_chars`` (what the edits made necessary) and, with ``with_text``, ``text_after``. Null
    and empty texts have no token; null ids and repeated rows are counted like any other; an
    empty table gives no rows; other columns are ignored. Each row is done where it lies.
    """
    path = path or default_path()
    edit = "array<struct<at:bigint,remove:bigint,insert:string>>"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.transform(edits_col, lambda x: F.struct(
                          F.coalesce(x["at"].cast("long"), F.lit(0)).alias("at"),
                          F.coalesce(x["remove"].cast("long"), F.lit(0)).alias("remove"),
                          F.coalesce(x["insert"].cast("string"), F.lit("")).alias("insert"))).cast(edit).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for text, edits in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    tree = CountTree(text or "", lambda s: len(enc.ids(s)), size)
                    before, tree.encoded = tree.n_tokens, 0
                    for e in edits or ():
                        tree.edit(e["at"], e["remove"], e["insert"])
                    for o, v in zip(out, (before, tree.n_tokens, tree.n_chars, len(edits or ()), tree.encoded,
                                          tree.text() if with_text else None)):
                        o.append(v)
                cols = [part.column(0), *[pa.array(o, pa.int64()) for o in out[:5]]]
                if with_text:
                    cols.append(pa.array(out[5], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "tokens_before", "tokens_after", "chars_after", "n_edits", "reencoded_chars"]
    names += ["text_after"] if with_text else []
    kinds = {"text_after": "string"}
    return src.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under three edits made from their own columns: seven characters at a hashed
    place become the language, the source goes into the middle, the first three characters go."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")

    def edit(at, remove, insert):
        return F.struct(at.cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), insert.alias("insert"))

    made = F.array(edit(F.pmod(F.xxhash64("doc_id"), n + 1), 7, F.col("lang")),
                   edit(F.floor(n / 2), 0, F.concat(F.lit(" "), F.col("source"), F.lit(" "))),
                   edit(F.lit(0), 3, F.lit("")))
    return edited_counts(table(spark, sf_dir, "documents").withColumn("edits", made))
