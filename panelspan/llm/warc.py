"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes its rows as one archive of single-record gzip members in the shared
folder, under a name of its own attempt, and emits an index row per record: file,
offset, length, URL and digest. The index is stored as a table; only what it names is
ever read, so a lost or repeated attempt leaves an unused file and nothing else.
Readers take the selected index rows by file stretch, sorted by offset, merge
neighbouring ranges into reads of bounded size, and parse the members.

Of records with equal payloads of at least LEAST_SHARED bytes the one with the smallest
page_id is a response and the others revisit it; a revisit repeats the HTTP head, which
has the payload's length, but no payload.

Defined results: a null html is an empty payload; a null url leaves out the target
header; rows that repeat the smallest page_id of their payload are all responses; a
null page_id is never referred to; a payload is one record and one gzip member whatever
its length, so a task holds one at a time besides the read around it; columns other than
page_id, url and html are not looked at.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm.common import cut, fresh_path, ship

LEAST_SHARED = 100
#: Bytes between selected records that are read along rather than skipped, and the most in one read.
GAP, READ = 1 << 16, 8 << 20
#: Bytes of a file that go to one task together, and bytes that a task reads in all.
STRETCH, STRETCH_OF_A_TASK = 1 << 20, 8 << 20
#: Archives are reproducible, so their date is a parameter.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3

_INDEX = "page_id long, url string, file string, offset long, length long, record_type string, payload_digest string"
_READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def file_system(uri: str):
    """(file system, path) of a folder that every executor reaches: local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://|file:/", uri) else f"file://{uri}")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda s: None if s is None or s == "<urn:page:none>" else int(s[10:-1])
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
        "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload_bytes": told, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, level: int) -> Iterator[pa.RecordBatch]:
    out, name, offset = None, f"part-{uuid.uuid4().hex}.warc.gz", 0
    for batch in batches:
        if out is None and batch.num_rows:
            system, path = file_system(folder)
            system.create_dir(path, recursive=True)
            out = system.open_output_stream(f"{path}/{name}", compression=None)
        rows: list[tuple] = []
        for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
            pack = zlib.compressobj(level, zlib.DEFLATED, 31)
            raw = record(page_id, url, (html or "").encode(), digest, refers_to, date)
            member = pack.compress(raw) + pack.flush()
            out.write(member)
            rows.append((page_id, url, name, offset, len(member), "response" if refers_to is None else "revisit", digest))
            offset += len(member)
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            held = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _INDEX.split(", ")])
            yield held
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str | None = None, least_shared: int = LEAST_SHARED, date: str = DATE, level: int = LEVEL) -> tuple[DataFrame, str]:
    """Write pages (page_id, url, html) to archives; (the stored index, their folder)."""
    ship(pages.sparkSession)
    folder = folder or fresh_path(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("size"))
    shared = base.filter(F.col("size") >= least_shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    marked = base.join(shared.select("digest", "first"), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    index = marked.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(lambda it: _write(it, folder, date, level), _INDEX)
    return cut(index, "warc-index"), folder


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int, int]]:
    """(first, last + 1, begin, end): runs of records, sorted by offset, that one read fetches."""
    out: list[tuple[int, int, int, int]] = []
    for i, (o, n) in enumerate(zip(offsets, lengths, strict=True)):
        if out and o - out[-1][3] <= gap and max(o + n, out[-1][3]) - out[-1][2] <= most:
            first, _, begin, end = out[-1]
            out[-1] = (first, i + 1, begin, max(end, o + n))
        else:
            out.append((i, i + 1, o, o + n))
    return out


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, path = file_system(folder)
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in _READ.split(", "))])
    for batch in batches:
        files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
        i = 0
        while i < len(files):
            j = i
            while j < len(files) and files[j] == files[i]:
                j += 1
            with system.open_input_file(f"{path}/{files[i]}") as f:
                for lo, hi, begin, end in ranges(offsets[i:j], lengths[i:j]):
                    data = f.read_at(end - begin, begin)
                    rows = [parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for o, n in zip(offsets[i + lo : i + hi], lengths[i + lo : i + hi], strict=True)]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
            i = j


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows given (all, or any selection), parsed from the archives."""
    # as many tasks as there are stretches to read: by the index's own size, adaptive execution would make one of many
    n, size = index.agg(F.count("*"), F.sum("length")).first()
    spots = index.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / STRETCH))
    tasks = max(1, min(n, -(-(size or 0) // STRETCH_OF_A_TASK)))
    dealt = spots.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(lambda it: _read(it, folder), _READ)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read all records back; the digest and size of a response are those of the payload read."""
    index, folder = write_archives(pages, folder)
    got = read_records(index, folder)
    there = F.col("payload").isNotNull()
    return got.select(
        "page_id", F.when(there, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(there, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


ORACLE = """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.digest = p.digest
"""
