"""Split reading of large JSON documents.

A landed document is one JSON list or one JSON object, often on a single line. Spark's text
reader cuts it at every ``},`` into short pieces and deals byte ranges of the file to many tasks,
on any file system that Spark reads. A task walks the pieces of its range with a small state (inside a
string or not, nesting depth) and cuts the document at its top-level entries. Only the first range of a file knows
its state from the start, so files of several ranges are walked twice: the first walk notes what each
range does to the state in either case (outside or inside a string), those notes are chained per file, and the second walk
starts every range right. Entries that cross ranges are joined from their parts.

No value is ever larger than one top-level entry. The walk that cuts a document also judges it: a
document that doesn't end as it began is a fault, with its reason.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repochron.session import write_through

BREAK = "},"
EMPTY = "empty"
ROW_GROUP = 8 << 20         # bytes; Spark reads up to 4096 values of a row group at once, and a value may be a whole entry
#: In a piece: a whole string, one that the piece doesn't end, a bracket or a comma.
TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+"|"|[{}\[\],]', re.S)
STRING_END = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.S)
KEYED = re.compile(rb'\s*("(?:[^"\\]++|\\.)*+")\s*:', re.S)
STATE = "offset long, in_string boolean, depth long, root string"
#: kind ``entry``: a whole entry; ``part``: what a range has of one that crosses ranges; ``end``: the end of a range, with
#: the verdict (empty: none found) where the file ends.
PART = "kind string, path string, at long, no long, opens boolean, closes boolean, text binary, key string, value string, fault string"
ENTRY = "path string, at long, no long, key string, value string, fault string"


class Walk:
    """Walks the pieces of one byte range; ``cut`` is called at each top-level boundary."""

    def __init__(self, in_string: bool = False, depth: int = 0, root: str | None = None):
        self.in_string, self.depth, self.root = in_string, depth, root
        self.fault: str | None = None
        self.parts: list[bytes] = []            # of the entry under way
        self.done: list[tuple[bool, bool, bytes]] = []
        self.opens = depth == 0                 # whether the entry under way began in this range
        self.ended = False                      # the root is closed
        self.any = depth > 0

    def _outside(self, text: bytes) -> None:
        if text.strip():
            self.fault = self.fault or "text outside of the document"

    def _cut(self, last: bool = False) -> None:
        self.done.append((self.opens, True, b"".join(self.parts)))
        self.parts, self.opens = [], True
        self.ended = self.ended or last

    def feed(self, text: bytes, start: int = 0) -> None:
        at = begin = start
        if self.in_string:
            end = STRING_END.match(text, at)
            if not end:
                if self.depth:
                    self.parts.append(text[begin:])
                return
            self.in_string, at = False, end.end()
        for token in TOKEN.finditer(text, at):
            c = token.group()
            if c == b'"':
                self.in_string = True
                break
            if c in b"{[":
                if self.depth == 0:
                    self._outside(text[begin: token.start()])
                    if self.ended:
                        self.fault = self.fault or "text outside of the document"
                    self.root, begin = c.decode(), token.end()
                self.depth += 1
            elif c in b"}]":
                self.depth -= 1
                if self.depth <= 0:
                    if self.depth < 0 or (self.root is not None and self.root + c.decode() not in ("{}", "[]")):
                        self.fault = self.fault or "brackets do not match"
                    self.depth = 0
                    self.parts.append(text[begin: token.start()])
                    self._cut(last=True)
                    begin = token.end()
            elif c == b"," and self.depth == 1:
                self.parts.append(text[begin: token.start()])
                self._cut()
                begin = token.end()
        if self.depth:
            self.parts.append(text[begin:])
        elif self.in_string:
            self._outside(b'"')
        else:
            self._outside(text[begin:])

    def finish(self) -> None:
        """The document ends here."""
        if not self.fault and (self.depth or self.in_string or not self.ended):
            self.fault = "the document does not end"


class _Effect:
    """What a range does to the state, if it begins outside or inside a string."""

    def __init__(self, in_string: bool):
        self.in_string, self.depth = in_string, 0

    def feed(self, text: bytes) -> None:
        at = 0
        if self.in_string:
            end = STRING_END.match(text)
            if not end:
                return
            self.in_string, at = False, end.end()
        for token in TOKEN.finditer(text, at):
            c = token.group()
            if c == b'"':
                self.in_string = True
                break
            if c in b"{[":
                self.depth += 1
            elif c in b"}]":
                self.depth -= 1


def _pieces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, size, at, span, value``: the pieces in the order of the file; each but the last of a file ended with ``BREAK``."""
    m = F.col("_metadata")
    return (spark.read.option("lineSep", BREAK).text(paths)
            .select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_block_start"].alias("at"),
                    m["file_block_length"].alias("span"), F.col("value").cast("binary").alias("value")))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes]]]:
    """Neighbouring pieces of one range, batch by batch: (path, size, at, ...), values."""
    for batch in batches:
        heads = list(zip(*(c.to_pylist() for c in batch.columns[:-1])))
        values, k = batch.columns[-1].to_pylist(), 0
        while k < len(heads):
            end = k
            while end < len(heads) and heads[end] == heads[k]:
                end += 1
            yield heads[k], values[k:end]
            k = end


def _note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    last, effects, n, first = None, (), 0, b""

    def close():
        if last is not None:
            rows.append({"path": last[0], "at": last[2], "bytes": n, "first": first.decode(errors="replace") or None,
                         **{f"{k}{i}": v for i, e in enumerate(effects) for k, v in (("in", e.in_string), ("depth", e.depth))}})

    for head, values in _ranges(batches):
        if head != last:
            close()
            last, effects, n, first = head, (_Effect(False), _Effect(True)), 0, b""
        for value in values:
            n += len(value) + len(BREAK)
            first = first or value.strip()[:1]
            for e in effects:
                e.feed(value)
                if not e.in_string:
                    e.depth -= 1           # the brace of BREAK
    close()
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
        [("path", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("first", pa.string()), ("in0", pa.bool_()),
         ("depth0", pa.int64()), ("in1", pa.bool_()), ("depth1", pa.int64())]))


def range_states(pieces: DataFrame) -> DataFrame:
    """``path, at`` and the state (``offset, in_string, depth, root``) in which each range of a file begins.
    The list of a file's ranges grows with its size over the split size alone."""
    notes = (pieces.select("path", "size", "at", "span", "value")
             .mapInArrow(_note, "path string, at long, bytes long, first string, in0 boolean, depth0 long, in1 boolean, depth1 long"))
    chained = notes.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("at", "bytes", "first", "in0", "depth0", "in1", "depth1"))).alias("r"))
    step = """transform(sequence(0, size(r) - 1), k -> aggregate(slice(r, 1, k),
        named_struct('offset', 0L, 'in_string', false, 'depth', 0L),
        (s, x) -> named_struct('offset', s.offset + x.bytes, 'in_string', if(s.in_string, x.in1, x.in0),
                               'depth', s.depth + if(s.in_string, x.depth1, x.depth0))))"""
    states = F.arrays_zip(F.col("r.at").alias("at"), F.expr(step).alias("s"))
    return (chained.select("path", F.col("r")[0]["first"].alias("root"), F.explode(states).alias("z"))
            .select("path", F.col("z.at").alias("at"), "z.s.offset", "z.s.in_string", "z.s.depth", "root"))


def _key_and_value(text: bytes) -> tuple[str | None, str | None, str | None]:
    """Key, value and fault of an entry's text."""
    key = None
    try:
        found = KEYED.match(text)
        if found:
            key, text = json.loads(found[1]), text[found.end():]
        value = text.decode().strip()
    except ValueError:
        return None, None, "an entry is not UTF-8 text with a valid key"
    return key, value, None if value else EMPTY if key is None else "an entry is empty"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, at, span, offset, in_string, depth, root, value) -> rows of ``PART``."""
    names = [f.split()[0] for f in PART.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.string(), pa.string(), pa.string()]
    last, walk, read, no, out, held = None, None, 0, 0, [], 0

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)

    def drain():
        nonlocal no, held
        for opens, closes, text in walk.done:
            if opens and closes:
                out.append(("entry", last[0], last[2], no, None, None, None, *_key_and_value(text)))
            else:
                out.append(("part", last[0], last[2], no, opens, closes, text, None, None, None))
            no, held = no + 1, held + len(text)
        walk.done.clear()

    def close():
        if last is None:
            return
        if read >= last[1]:
            walk.finish()
        if walk.parts and not walk.ended:
            walk.done.append((walk.opens, False, b"".join(walk.parts)))
        drain()
        verdict = walk.fault or ("" if read >= last[1] else None)
        out.append(("end", last[0], last[2], no, None, None, None, walk.root, None, verdict))

    for head, values in _ranges(batches):
        if head != last:
            close()
            last, no = head, 0
            read, depth, root = head[4] or 0, head[6] or 0, head[7]
            walk = Walk(bool(head[5]), depth, root if depth else None)
        for value in values:
            read += len(value) + len(BREAK)
            # all pieces ended with BREAK, but the last of a file that doesn't end with it
            walk.feed(value + BREAK.encode() if read <= last[1] else value)
            drain()
            if held > 1 << 22:
                yield batch_of(out)
                out, held = [], 0
    close()
    yield batch_of(out)


class Documents(NamedTuple):
    """``entries``: ``path, at, no, key, value``; ``faults``: ``path, reason``; ``files``: ``path, root`` (``[`` or ``{``) of
    every file without a fault."""

    entries: DataFrame
    faults: DataFrame
    files: DataFrame


def json_entries(spark: SparkSession, paths: str | Sequence[str]) -> Documents:
    """Top-level entries of JSON documents.

    ``entries`` has one row per element of a list (``key`` null) or entry of an object (``key`` and the text of its
    value); ``at, no`` give their order in the file. ``faults`` are files that aren't one JSON list or object as far as
    strings, brackets and commas tell; none of their entries is returned. Empty lists and objects have no entries and
    no fault; files of no bytes are in none of Spark's scans and so nowhere. What an entry holds is judged by whoever
    parses it.
    """
    whole = _pieces(spark, paths)
    narrow = ["path", "size", "at", "span"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in STATE.split(", "))]
    several = whole.where("span < size")
    states = write_through(range_states(several), "json-states")
    # within the files of several ranges, pieces keep their order whichever way the join is done
    numbered = several.withColumn("nth", F.monotonically_increasing_id())
    begun = (numbered.join(states, ["path", "at"], "left").sortWithinPartitions("path", "at", "nth")
             .select(*narrow, "offset", "in_string", "depth", "root", "value"))
    single = whole.where("span >= size").select(*narrow, *none, "value").mapInArrow(_cut, PART)
    parts = write_through(single.unionByName(begun.mapInArrow(_cut, PART)), "json-parts", ROW_GROUP)

    order = Window.partitionBy("path").orderBy("at", "no")
    crossing = (parts.where("kind = 'part'").withColumn("entry", F.sum(F.col("opens").cast("long")).over(order))
                .groupBy("path", "entry").agg(F.array_sort(F.collect_list(F.struct("at", "no", "text"))).alias("p"))
                .select("path", F.col("p")[0]["at"].alias("at"), F.col("p")[0]["no"].alias("no"),
                        F.expr("aggregate(p, cast('' as binary), (s, x) -> s || x.text)").alias("text"))
                .mapInArrow(_joined, ENTRY))
    texts = parts.where("kind = 'entry'").select("path", "at", "no", "key", "value", "fault").unionByName(crossing)
    ends = parts.where("kind = 'end'")
    # the one entry of an empty document is empty; any other empty entry is a fault
    empty = (texts.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("fault") != EMPTY, F.col("fault"))).alias("reason"),
                                       F.count_if(F.col("fault") == EMPTY).alias("blank"))
             .select("path", F.coalesce("reason", F.when((F.col("blank") > 0) & (F.col("n") > 1), "an entry is empty")).alias("reason")))
    faults = ends.where("fault <> ''").select("path", F.col("fault").alias("reason")).unionByName(empty.where("reason is not null"))
    faults = write_through(faults.groupBy("path").agg(F.min("reason").alias("reason")), "json-faults")
    entries = texts.where("fault is null").drop("fault").join(faults.select("path"), "path", "left_anti")
    files = (ends.groupBy("path").agg(F.max("key").alias("root"))
             .join(faults.select("path"), "path", "left_anti"))
    return Documents(entries, faults, files)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(zip(*(_key_and_value(t) for t in batch.column(3).to_pylist()))) or [()] * 3
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.string()) for c in found)],
                                         names=["path", "at", "no", "key", "value", "fault"])
