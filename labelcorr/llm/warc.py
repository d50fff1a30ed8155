"""WARC archives: written with an index, read back by sorted and coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import arrow_rows, utf8, written
from labelcorr.session import scratch_path

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 256 * 1024 * 1024
READ_BYTES = 8 * 1024 * 1024
MAX_GAP = 64 * 1024
CRAWL_DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "id long, url string, digest string, record_type string, file string, offset long, length long"


def record_types(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """``(_row, _response)``: which rows are revisits, and the id of the response they refer to.

    Only digests move; the aggregate folds a group of copies before the shuffle.
    """
    payload = utf8(payload_col)
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).cast("long").alias("id"),
        F.octet_length(payload).alias("bytes"),
        F.sha1(payload).alias("digest"),
    )
    rows = written(rows.filter(F.col("bytes") >= min_bytes), "digests")
    groups = (
        rows.groupBy("digest", "bytes")
        .agg(F.max(F.struct("id", "_row")).alias("last"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    found = rows.join(written(groups, "groups"), ["digest", "bytes"])
    revisits = found.filter(F.col("_row") != F.col("last._row"))
    return revisits.select("_row", F.col("last.id").alias("_response"))


def _record(page_id, url, payload: bytes, digest: str, revisit: bool, response) -> bytes:
    name = "none" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {CRAWL_DATE}"]
    if url is not None:
        clean = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    coded = base64.b32encode(bytes.fromhex(digest)).decode()
    head += [f"WARC-Payload-Digest: sha1:{coded}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        other = "none" if response is None else response
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{other}>"]
    block = HTTP_HEAD.format(len(payload)).encode() + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_archives(
    pages: DataFrame,
    root: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row under ``root``; the index ``INDEX`` of what was written.

    Each record is a gzip member of its own, so a range of bytes can be read
    alone. Each task attempt writes files of its own, and the index names only
    the files of the attempts that counted: a lost executor leaves files nobody
    reads. Of rows with equal payloads of at least ``min_bytes`` the one with the
    largest id holds the payload, the others refer to it. A null payload is
    empty; null ids and urls stay null; rows that repeat an id are records of
    their own, the last of equal ones being the response; ``pages`` has to give its
    rows in the same order each time, as a table does. Control characters of
    a url are percent-encoded. An empty table gives an empty index.
    """
    types = record_types(pages, id_col, payload_col, min_bytes)
    rows = pages.select(
        F.monotonically_increasing_id().alias("_at"),
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        utf8(payload_col).alias("payload"),
    )
    rows = rows.join(types, F.col("_at") == F.col("_row"), "left").select(
        "id", "url", "payload", F.col("_row").isNotNull().alias("revisit"), "_response"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            found = []
            for page_id, url, payload, revisit, response in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                digest = hashlib.sha1(payload).hexdigest()
                member = _member(_record(page_id, url, payload, digest, revisit, response))
                out.write(member)
                kind = "revisit" if revisit else "response"
                found.append((page_id, url, digest, kind, name, at, len(member)))
                at += len(member)
            yield _index_batch(found)
        if out is not None:
            out.close()

    return written(arrow_rows(rows, run, INDEX), "warc-index")


def _index_batch(found: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in INDEX.split(", ")]
    columns = list(zip(*found)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def parse_record(record: bytes) -> dict:
    """The fields of one record; the digest of a payload that is there is checked."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": len(payload) if kind == "response" else int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def read_archives(index: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` select, read by byte range.

    Ranges are dealt by file and block of the file and sorted by offset; ranges
    closer than ``MAX_GAP`` are one read of at most about ``READ_BYTES``. Columns
    ``id, url, payload_bytes, payload_digest, record_type, refers_to``, and
    ``payload`` (null in a revisit) unless left out.
    """
    wanted = index.select("file", "offset", "length", F.expr(f"offset div {4 * READ_BYTES}").alias("block"))
    # A small index can select much to read: as many tasks as there are shuffle partitions.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = wanted.repartition(tasks, "file", "block").sortWithinPartitions("file", "offset")
    fields = [("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("record_type", pa.string()),
              ("refers_to", pa.int64()), ("payload", pa.binary())]
    fields = fields if payloads else fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        name, source = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            i = 0
            while i < len(rows):
                j, end = i + 1, rows[i][1] + rows[i][2]
                while (
                    j < len(rows)
                    and rows[j][0] == rows[i][0]
                    and rows[j][1] - end <= MAX_GAP
                    and rows[j][1] + rows[j][2] - rows[i][1] <= READ_BYTES
                ):
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                if name != rows[i][0]:
                    if source is not None:
                        source.close()
                    name = rows[i][0]
                    source = fs.open_input_file(f"{folder}/{name}")
                start = rows[i][1]
                data = source.read_at(end - start, start)
                found = [
                    parse_record(zlib.decompress(data[at - start : at - start + length], 31))
                    for _, at, length in rows[i:j]
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in found], k) for n, k in fields], [n for n, _ in fields]
                )
                i = j
        if source is not None:
            source.close()

    schema = """id long, url string, payload_bytes long, payload_digest string,
                record_type string, refers_to long"""
    return arrow_rows(wanted, run, schema + (", payload binary" if payloads else ""))


def archive_folder(pages: DataFrame) -> str:
    """A fresh folder for archives, in the shared folder, as a URI."""
    path = scratch_path(pages.sparkSession, "warc")
    return path if "://" in path else f"file://{path}"
