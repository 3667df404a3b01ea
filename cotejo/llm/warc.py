"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own. The reader deals archives out in byte ranges: a task
looks for gzip magic from the start of its range, decodes a candidate until its WARC header is
whole and its checksum holds, and from there walks from member to member. It owns the records
that start inside its range, wherever they end, so each record is read once.

Defined results: a null html is an empty payload; a null url is the empty target. Of records
with equal payloads of at least ``least`` bytes the one with the largest page_id is a
response and the others are revisits of it; rows that share that page_id are all responses, as
are rows without an id if no row of the group has one. An empty table makes no archive.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import open_fs, shared_folder
from cotejo.session import stage

MAGIC = b"\x1f\x8b\x08"
LEAST = 1000
SPLIT = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FILE_SCHEMA = "path string, n_bytes long, records long"
RECORD_SCHEMA = ("path string, offset long, record_id string, type string, target string, digest string, "
                 "refers_to string, declared long, payload binary")


# --- writing ------------------------------------------------------------------------------

def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP header and leaves the payload out."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    url = re.sub(r"[\r\n]", " ", url)
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_warc(pages: DataFrame, folder: str | None = None, least: int = LEAST,
               date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages``; one row per archive.

    The rows name the archives that count: a repeated task writes under another name.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")) \
        .withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.length("payload") >= least).groupBy("digest").agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    placed = rows.join(groups, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, written, records = None, 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for k in range(batch.num_rows):
                if out is None:
                    fs, base = open_fs(folder)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(*(c[k].as_py() for c in columns), date))
                out.write(data)
                written += len(data)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_bytes": [written], "records": [records]})

    return stage(placed.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, FILE_SCHEMA))


# --- reading ------------------------------------------------------------------------------

class Window:
    """A growing view of a file from some offset on; what lies before is dropped."""

    def __init__(self, source, size: int, at: int, step: int = 1 << 20):
        self.source, self.size, self.step = source, size, step
        self.at, self.data = at, b""

    def more(self) -> bool:
        end = self.at + len(self.data)
        if end >= self.size:
            return False
        self.source.seek(end)
        self.data += self.source.read(min(self.step, self.size - end))
        return True

    def drop(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def parse_head(text: bytes) -> dict[str, str] | None:
    """The header fields of a record that starts with ``text``, or None."""
    if not text.startswith(b"WARC/"):
        return None
    head, gap, _ = text.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    ok = fields.get("warc-type") and fields.get("warc-record-id") and fields.get("content-length", "").isdigit()
    return fields if ok else None


def inflate(view: Window) -> tuple[bytes, int] | None:
    """The member at the start of the view, whole, and its length; None if there is none.

    A candidate that does not begin with a WARC header is given up after its first bytes.
    """
    unpack, out, used = zlib.decompressobj(31), [], 0
    checked = b""
    try:
        while not unpack.eof:
            if used == len(view.data) and not view.more():
                return None
            piece = view.data[used:used + (1 << 16)]
            used += len(piece)
            out.append(unpack.decompress(piece))
            if len(checked) < 5:
                checked += out[-1][:5]
                if not b"WARC/".startswith(checked[:5]):
                    return None
    except zlib.error:
        return None
    return b"".join(out), used - len(unpack.unused_data)


def read_range(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of the records that start in [start, end)."""
    view = Window(source, size, start)
    walking = start == 0
    while view.at < end:
        if not walking:  # the next magic that starts inside the range
            while (k := view.data.find(MAGIC)) < 0:
                view.drop(max(0, len(view.data) - 2))
                if view.at >= end or not view.more():
                    return
            view.drop(k)
            if view.at >= end:
                return
        found = inflate(view)
        fields = parse_head(found[0]) if found else None
        if fields is None:
            if view.at >= size:
                return
            walking = False
            if not view.data and not view.more():
                return
            view.drop(1)
            continue
        data, length = found
        body = data.index(b"\r\n\r\n") + 4
        yield view.at, fields, data[body:body + int(fields["content-length"])]
        view.drop(length)
        walking = True


def read_warc(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """All records of the archives named by ``path`` and ``n_bytes``, read by byte ranges.

    ``declared`` is the payload's length by its HTTP header; ``payload`` is null for revisits.
    """
    ranges = archives.select("path", "n_bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)),
                                                                     F.lit(split))).alias("start"))
    tasks = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "n_bytes", "start")), strict=True):
                fs, name = open_fs(path)
                rows, held = [], 0
                with fs.open_input_file(name) as source:
                    for offset, fields, block in read_range(source, size, start, min(size, start + split)):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                        revisit = fields["warc-type"] == "revisit"
                        rows.append((path, offset, fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"),
                                     fields.get("warc-payload-digest"), fields.get("warc-refers-to"),
                                     int(length[1]) if length else None, None if revisit else payload))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        names = ["path", "offset", "record_id", "type", "target", "digest", "refers_to", "declared", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return ranges.repartition(tasks, "path", "start").mapInArrow(read, RECORD_SCHEMA)


def page_records(records: DataFrame) -> DataFrame:
    """Per page its payload's size and digest, the record type and the page it refers to."""
    def page(column: str):
        return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    own = F.col("payload").isNotNull()
    return records.select(page("record_id").alias("page_id"),
                          F.when(own, F.length("payload")).otherwise(F.col("declared")).cast("long").alias("payload_bytes"),
                          F.when(own, F.sha1("payload")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
                          F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
