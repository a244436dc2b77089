"""Legacy archives: ARC files read by their declared lengths and converted to WARC.

An ARC file starts with a version block (``filedesc://``) that says how header lines look:
version 1 has ``URL IP date type length``, version 2 ``URL IP date type status checksum
location offset filename length``. Records follow each other by declared length, never by
searching the bytes. The converter gives each record a WARC identifier, ISO timestamp,
type and SHA-256 digests; equal payloads become revisits.

Files are written by Spark's text writer (raw bytes, the record separator as line
separator) and read by its ``binaryFile`` reader, so any Hadoop path works; a file holds at
most ``RECORDS_PER_FILE`` records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.common import cut, table, text_bytes
from repochron.session import ensure_checkpoint_dir

RECORDS_PER_FILE = 4096
MIN_REVISIT = 100
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")     # RFC 4122: URL
_V1 = ("url", "ip", "date", "mime", "length")
_V2 = ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")


def arc_header(version: int, url: str, date: str, mime: str, length: int, ip: str = "0.0.0.0",
               status: str = "200", checksum: str = "-", location: str = "-", offset: int = 0,
               filename: str = "-") -> bytes:
    """One header line; blanks inside a field would break the line and become %20."""
    values = {"url": url or "-", "ip": ip, "date": date, "mime": mime, "status": status, "checksum": checksum,
              "location": location, "offset": offset, "filename": filename, "length": length}
    fields = _V1 if version == 1 else _V2
    return " ".join("".join("%20" if x.isspace() else x for x in str(values[k])) or "-" for k in fields).encode() + b"\n"


def version_block(version: int, name: str, date: str) -> bytes:
    """The first record of an ARC file."""
    v1 = "URL IP-address Archive-date Content-type Archive-length"
    v2 = ("URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
          "Filename Archive-length")
    body = f"{version} 0 converter\n{v1 if version == 1 else v2}\n".encode()
    return arc_header(version, f"filedesc://{name}", date, "text/plain", len(body)) + body


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: header fields, ``offset`` and ``block``; the version block is read,
    not returned. A file without one is told by the number of header fields. Raises on a
    header or length that does not fit the bytes."""
    at, version = 0, None
    while at < len(data):
        if data[at: at + 1] in (b"\n", b"\r"):                     # separators between records
            at += 1
            continue
        end = data.find(b"\n", at)
        parts = data[at: end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").split(" ")
        names = {1: _V1, 2: _V2}.get(version) or (_V2 if len(parts) == len(_V2) else _V1)
        if end < 0 or len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        record = dict(zip(names, parts))
        record["record_offset"] = at
        size = int(record["length"])
        block = data[end + 1: end + 1 + size]
        if len(block) != size:
            raise ValueError(f"ARC record at byte {at} is shorter than it declares")
        at = end + 1 + size
        if record["url"].startswith("filedesc:"):
            head = block.split(b" ", 1)[0]
            version = int(head) if head.isdigit() else None
            continue
        yield {**record, "block": block}


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(header bytes, payload, header fields in lower case) of an HTTP response; other blocks are all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return block, b"", {}
    head = block[: end + 4]
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ": " in line)
    return head, block[end + 4:], {k.lower(): v for k, v in fields.items()}


def warc_date(date14: str) -> str:
    """ISO timestamp of a 14-digit (or 12-digit) ARC date; the epoch if it has another form."""
    d = date14 + "00" if len(date14) == 12 else date14
    if len(d) != 14 or not d.isdigit():
        return "1970-01-01T00:00:00Z"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(name: str, offset: int) -> str:
    """WARC-Record-ID of the ARC record at a place of an archive: the same at each conversion."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{name}#{offset}')}>"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """Header and block; the two line ends that close a record are the writer's separator."""
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields],
             f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at: at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at: at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines if ": " in x)}
        size = int(fields["content-length"])
        block = data[end + 4: end + 4 + size]
        if len(block) != size:
            raise ValueError(f"WARC record at byte {at} is shorter than it declares")
        at = end + 4 + size
        yield fields, block


def _plain(content: bytes) -> bytes:
    """Unpacked bytes; gzip files may have several members."""
    out = []
    while content[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(content) + d.flush())
        content = d.unused_data
    return b"".join(out) if out else content


def _write(rows: DataFrame, path: str, separator: str) -> None:
    (rows.select(F.col("value").cast("string").alias("value")).write.mode("overwrite")
     .option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
     .text(path))


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              version: int | None = None, date: str = "20200101000000") -> None:
    """Pages as ARC files of HTTP responses. ``version`` None alternates 1 and 2 by partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        v = version or 1 + part % 2
        first = [version_block(v, f"part-{part}.arc", date)]
        for b in batches:
            for at in range(0, b.num_rows, 128):
                s = b.slice(at, 128)
                out, first = first, []
                for pid, url, html in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), text_bytes(s.column(2))):
                    own = "" if pid is None else f"X-Page-Id: {pid}\r\n"
                    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}"
                             f"Content-Length: {len(html)}\r\n\r\n").encode() + html
                    out.append(arc_header(v, url, date, "text/html", len(block)) + block)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    src = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"),
                       F.col(html_col).cast("string").alias("h"))
    _write(src.mapInArrow(run, "value binary"), path, "\n")


ARC_SCHEMA = ("page_id long, url string, ip string, date string, mime string, record_id string, place string, "
              "payload_bytes long, payload_digest string, http binary, payload binary")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the ARC files under ``path`` with synthesised identifiers and digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for r in parse_arc(_plain(content.as_py())):
                    head, payload, http = split_http(r["block"])
                    pid = http.get("x-page-id")
                    place = f"{name.rsplit('/', 1)[-1]}#{r['record_offset']}"
                    rows.append((int(pid) if pid is not None else None, r["url"], r["ip"], warc_date(r["date"]), r["mime"],
                                 record_id(*place.rsplit("#", 1)), place, len(payload),
                                 hashlib.sha256(payload).hexdigest(), head, payload))
                    if len(rows) == 256:
                        yield _batch(rows, arc_schema)
                        rows = []
                if rows:
                    yield _batch(rows, arc_schema)

    arc_schema = _arrow(ARC_SCHEMA)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ARC_SCHEMA)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def convert(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """WARC records (``value``) of ARC records: of equal payloads of ``min_revisit`` bytes or more the
    one with the smallest page id (then place) is a response, the others revisit it.

    Leaders are found on narrow columns (minimum per digest, combined before the shuffle);
    records without a page id never lead unless no equal record has one.
    """
    rank = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("p"), F.col("place").alias("l"),
                    F.col("record_id").alias("r"), F.col("url").alias("u"), F.col("date").alias("d"))
    leaders = (records.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
               .agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("lead")).where("n > 1")
               .select("payload_digest", "lead.*"))
    rows = (records.alias("a").join(leaders.alias("b"), F.col("a.payload_digest") == F.col("b.payload_digest"), "left")
            .select("a.*", F.when(F.col("b.r") != F.col("a.record_id"), F.col("b.r")).alias("lead_id"),
                    F.col("b.u").alias("lead_url"), F.col("b.d").alias("lead_date")))
    names = [x.split(" ")[0] for x in ARC_SCHEMA.split(", ")] + ["lead_id", "lead_url", "lead_date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                cols = [b.slice(at, 128).column(i).to_pylist() for i in range(len(names))]
                out = []
                for values in zip(*cols):
                    r = dict(zip(names, values))
                    http = bool(r["http"])
                    fields = [("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]),
                              ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
                              ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"),
                              ("WARC-Payload-Length", str(r["payload_bytes"])),
                              ("Content-Type", "application/http; msgtype=response" if http else r["mime"])]
                    if r["lead_id"]:
                        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                   ("WARC-Refers-To", r["lead_id"]), ("WARC-Refers-To-Target-URI", r["lead_url"]),
                                   ("WARC-Refers-To-Date", r["lead_date"])]
                        out.append(warc_record("revisit", fields, r["http"]))
                    else:
                        out.append(warc_record("response" if http else "resource", fields, r["http"] + r["payload"]))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return rows.mapInArrow(run, "value binary")


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files (gzip) of the column ``value``."""
    _write(records, path, "\r\n\r\n")


WARC_SCHEMA = ("page_id long, url string, date string, record_type string, record_id string, refers_id string, "
               "payload_bytes long, payload_digest string, payload binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response, resource and revisit records of the WARC files under ``path``.

    Length and digest of a response are taken from its payload and must agree with the header
    (else the read fails); those of a revisit are what its header says of the full payload.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(WARC_SCHEMA)
        for b in batches:
            for content in b.column(0):
                rows = []
                for f, block in parse_warc(_plain(content.as_py())):
                    if f["warc-type"] not in ("response", "resource", "revisit"):
                        continue
                    _, payload, http = split_http(block)
                    pid, digest = http.get("x-page-id"), f["warc-payload-digest"].removeprefix("sha256:")
                    size = int(f["warc-payload-length"])
                    if f["warc-type"] != "revisit" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                    rows.append((int(pid) if pid is not None else None, f["warc-target-uri"], f["warc-date"],
                                 f["warc-type"], f["warc-record-id"], f.get("warc-refers-to"), size, digest, payload))
                    if len(rows) == 256:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, WARC_SCHEMA)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit: int = MIN_REVISIT) -> str:
    """Write pages as ARC, convert the archives to WARC, and return the path of the WARC files."""
    spark = pages.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/repochron-archive-{uuid.uuid4().hex}"
    write_arc(pages, f"{base}/arc", id_col, url_col, html_col)
    write_warc(convert(read_arc(spark, f"{base}/arc"), min_revisit), f"{base}/warc")
    return f"{base}/warc"


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC and WARC files, read back.

    Null html is an empty payload, a null url becomes ``-``; null page ids stay null; repeated
    rows each have a record (equal payloads: one response, the rest revisits); an empty table
    gives no rows; other columns are ignored.
    """
    path = archive_pages(table(spark, sf_dir, "pages"))
    rows = cut(read_warc(spark, path).drop("payload", "url", "date"), "warc-rows")
    lead = rows.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_id"),
                                                         F.col("page_id").alias("refers_to"))
    return rows.join(lead, "refers_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
