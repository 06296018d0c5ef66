"""WARC archives, index first: every record's file, offset, length, URL and digest go to an index as it is
written, and records are read back by coalesced byte ranges of the index rows that are selected.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import bounded, cut, join_with_hot, new_path, open_fs, tasks, trimmed

#: Payloads of fewer bytes are always stored themselves.
MIN_REVISIT = 1000
#: Bytes after which a writer begins another archive.
FILE_BYTES = 256 << 20
#: Ranges of a file no further apart than GAP are read at once, up to MOST_READ bytes.
GAP, MOST_READ = 64 << 10, 8 << 20
#: Bytes of an archive that one reading task takes, about.
READ_TASK = 32 << 20
#: Most digests of repeated payloads that are broadcast (about 100 bytes each); beyond it the join is shuffled.
BROADCAST_DIGESTS = 200_000
#: Fixed value: the profile of a revisit of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: the date of every record where the input has none.
DATE = "1970-01-01T00:00:00Z"

_INDEX = "page_id long, file string, offset long, length long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ARROW = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def warcinfo(file: str) -> bytes:
    """The record that an archive begins with."""
    body = b"software: larkspur\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {file.rpartition('/')[2]}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record(place: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_to_url: str | None = None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without. Header values lose line ends.

    place: the record's own, in all archives, from which its id is made, so that repeated rows have ids of their own. A revisit names
    the response by address and date, as the standard recommends, and by page id.
    """
    one_line = " ".join((url or "").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Target-URI: {one_line}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page is None else page}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {' '.join((refers_to_url or '').split())}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
        body = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record that record() made."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else b""


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, file, at, files = TaskContext.get().partitionId(), None, "", 0, 0
        for batch in batches:
            rows = []
            for page, url, html, first, first_url in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    # another attempt of this task writes files of other names, which no index row names if it fails
                    file, at, files = f"{folder}/{part:06d}-{files:04d}-{uuid.uuid4().hex}.warc.gz", 0, files + 1
                    out = open_fs(file, "w")
                    info = gzip.compress(warcinfo(file), 5, mtime=0)
                    out.write(info)
                    at = len(info)
                payload = (html or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                refers_to = first if first is not None and first != page else None
                data = gzip.compress(record(f"{file}#{at}", page, url, payload, digest, refers_to, first_url), 5, mtime=0)
                out.write(data)
                rows.append((page, file, at, len(data), url, len(payload), digest, "response" if refers_to is None else "revisit", refers_to))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", folder: str | None = None) -> DataFrame:
    """Writes a gzipped record per row of pages and returns the index, one row per record:

    page_id, file, offset, length, url, payload_bytes, payload_digest (bare lower-case hex SHA-1), record_type, refers_to.

    Of records with equal payloads of MIN_REVISIT bytes or more, that of the greatest id is a response and
    the others revisit it; all smaller ones are responses. A null html is an empty payload, a null URL an empty
    one; a row without an id never is referred to, and rows that share the greatest id, also repeated rows, are all responses. A very
    long payload is one record as any other. Other columns are not used. An empty table gives no file. folder must be one
    that all machines share.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    open_fs(folder, "mkdir")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    large = F.octet_length("html") >= MIN_REVISIT
    # digests of repeated payloads only: each task adds up its own, so one payload on many pages is a row a task
    firsts = rows.where(large).select(F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("bytes"), F.struct("page_id", "url").alias("page"))
    firsts = firsts.groupBy("digest", "bytes").agg(F.max("page").alias("page"), F.count("*").alias("n")).where("n > 1 and page.page_id is not null")
    firsts = cut(firsts.select("digest", "bytes", F.col("page.page_id").alias("first"), F.col("page.url").alias("first_url"), "n"), "repeated-payloads")
    keyed = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    if firsts.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        keyed = keyed.withColumn("digest", F.when(F.col("bytes") >= MIN_REVISIT, F.col("digest")))
        placed = keyed.join(F.broadcast(firsts), ["digest", "bytes"], "left")
    else:  # small pages meet nothing, and popular payloads meet their first one where they are
        none = keyed.where(F.col("bytes") < MIN_REVISIT).withColumns({"first": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")})
        met = join_with_hot(keyed.where(F.col("bytes") >= MIN_REVISIT), firsts, ["digest", "bytes"], "n", firsts.agg(F.sum("n")).first()[0], "left")
        placed = met.unionByName(none)
    return cut(bounded(placed).select("page_id", "url", "html", "first", "first_url").mapInArrow(trimmed(_write(folder)), _INDEX), "warc-index")


def _read(with_html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("html", pa.string())] * with_html)
        source, name = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            low, out, held = 0, [], 0
            while low < len(files):
                high, end = low + 1, offsets[low] + lengths[low]
                while high < len(files) and files[high] == files[low] and offsets[high] - end <= GAP and offsets[high] + lengths[high] - offsets[low] <= MOST_READ:
                    end, high = max(end, offsets[high] + lengths[high]), high + 1
                if name != files[low]:
                    if source is not None:
                        source.close()
                    source, name = open_fs(files[low], "r"), files[low]
                data = memoryview(source.read_at(end - offsets[low], offsets[low]))
                for k in range(low, high):
                    at = offsets[k] - offsets[low]
                    headers, payload = parse(gzip.decompress(data[at : at + lengths[k]]))
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: the payload at {offsets[k]} doesn't match its digest")
                    page, first = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                    out.append((int(page) if page else None, headers["WARC-Target-URI"], int(headers["X-Payload-Length"]), digest, kind, int(first) if first else None, payload.decode())[: len(schema)])
                    held += len(payload)
                if held >= MOST_READ:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, held = [], 0
                low = high
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        if source is not None:
            source.close()

    return run


def read_archives(index: DataFrame, with_html: bool = False) -> DataFrame:
    """The records that the index rows name, from the archives: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and html if asked for (empty for a revisit). Payloads are checked against their digests.

    A page without an id, an address or a payload comes back without it, but for the payload, which is empty; records that the index names
    twice come back twice, and a very long payload in one row. An empty index gives an empty result. Stretches of READ_TASK bytes of a file are
    dealt to tasks and each sorted by offset, so that neighbours are read at once.
    """
    stretch = (F.col("offset") / F.lit(READ_TASK)).cast("long")
    n = tasks(index.agg(F.sum("length")).first()[0] or 0, READ_TASK)
    rows = index.select("file", "offset", "length").repartition(n, F.col("file"), stretch).sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * with_html
    return bounded(rows).mapInArrow(trimmed(_read(with_html)), schema)


#: DuckDB SQL for the rows of read_archives(write_archives(pages)) without the url
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND first != page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND first != page_id THEN first END AS refers_to
FROM f
"""
