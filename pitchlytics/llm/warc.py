"""WARC archives with an index: written by tasks, read back by coalesced byte ranges.

Each record is a gzip member of its own. The index, a written table, has a row per record with
archive, offset, length, URL and payload digest, and is made before anything is read: readers
select rows of it, and ``read_records`` sorts them by place and reads neighbours in one request.

Of records with equal payloads of at least ``least`` bytes those with the smallest id are
responses, the others revisit them; smaller payloads are all responses. Null payloads are
empty. Null ids come after all others and refer to as such; rows tied on the smallest id are
all responses. A null URL gives no target header, control characters and blanks in URLs are
percent-encoded. An empty table gives no archive and an empty index. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlytics.llm.helpers import filesystem, write_file
from pitchlytics.storage import new_folder, settle

#: Bytes at which an archive is closed: what a writing task holds.
ARCHIVE_BYTES = 32 << 20
#: Reading: records closer than this are read in one request, up to this many bytes.
GAP_BYTES, REQUEST_BYTES = 64 << 10, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("record_id long, url string, payload_digest string, payload_bytes long, record_type string, "
         "refers_to long, path string, offset long, length long")
RECORD = ("record_id long, url string, payload_digest string, payload_bytes long, record_type string, "
          "refers_to long, payload binary")
NAMES = {field.split()[0]: field.split()[1] for field in (INDEX + ", payload binary").split(", ")}
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(record_id: int | None) -> str:
    return f"<urn:record:{'none' if record_id is None else record_id}>"


def _of_urn(urn: str) -> int | None:
    found = urn[len("<urn:record:"):-1]
    return None if found == "none" else int(found)


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", url)


def encode_record(record_id: int | None, url: str | None, payload: bytes, refers: tuple[int | None] | None,
                  date: str) -> bytes:
    """One gzip member. ``refers``: the id that a revisit refers to, in a tuple, else None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_urn(record_id)}",
        f"WARC-Date: {date}", *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([f"WARC-Refers-To: {_urn(refers[0])}", f"WARC-Profile: {PROFILE}"] if refers else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def decode_record(member: bytes) -> dict:
    """Fields of one gzip member; a response's payload is checked against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and payload_digest(payload) != said:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "record_id": _of_urn(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_digest": said,
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "record_type": fields["WARC-Type"],
        "refers_to": None if response else _of_urn(fields["WARC-Refers-To"]), "payload": payload if response else None,
    }


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], ARROW[NAMES[n]]) for n in names], names)


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write all rows as WARC records and return the index, a written table.

    Repeated payloads are found on their digests alone, added up before they are shuffled, so
    a payload that a third of all pages share is one row; the join back splits its rows."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).alias("url"),
                        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    first = settle(
        rows.where(F.octet_length("payload") >= least).groupBy("key")
        .agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"),
        "first")
    revisit = F.col("f.key").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))
    marked = rows.alias("r").join(first.alias("f"), "key", "left").select("record_id", "url", "payload", revisit.alias("revisit"), "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, size, index = TaskContext.get(), 0, [], 0, []
        # A repeated task, whose rows may come in another order, never writes over files of an index.
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"

        def close() -> pa.RecordBatch:
            write_file(index[0]["path"], b"".join(held))
            return _batch(index, _columns(INDEX))

        for batch in batches:
            for record_id, url, payload, again, at in zip(*batch.columns, strict=True):
                record_id, url, payload, at = record_id.as_py(), url.as_py(), payload.as_py(), at.as_py()
                member = encode_record(record_id, url, payload, (at,) if again.as_py() else None, date)
                index.append({
                    "record_id": record_id, "url": url, "payload_digest": payload_digest(payload), "payload_bytes": len(payload),
                    "record_type": "revisit" if again.as_py() else "response", "refers_to": at if again.as_py() else None,
                    "path": f"{folder}/{name}-{seq:05d}.warc.gz", "offset": size, "length": len(member),
                })
                held.append(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, index, seq = [], 0, [], seq + 1
        if index:
            yield close()

    return settle(marked.mapInArrow(write, INDEX), "index")


def ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Records (path, offset, length) sorted by place as requests (path, start, stop, records)."""
    path, start, stop, held = None, 0, 0, []
    for p, offset, length in rows:
        if held and (p != path or offset > stop + GAP_BYTES or offset + length > start + REQUEST_BYTES):
            yield path, start, stop, held
            held = []
        if not held:
            path, start, stop = p, offset, offset
        held.append((offset, length))
        stop = max(stop, offset + length)
    if held:
        yield path, start, stop, held


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that rows of the index name, parsed from the archives. An archive's
    selected records go to one task in order of offset."""
    schema = RECORD if with_payload else RECORD.replace(", payload binary", "")
    parts = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = selected.select("path", "offset", "length").repartition(parts, "path").sortWithinPartitions("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for path, start, stop, records in ranges(rows):
            store, inner = filesystem(path)
            with store.open_input_file(inner) as f:
                f.seek(start)
                data = f.read(stop - start)
            for i in range(0, len(records), 1024):
                yield _batch([decode_record(data[o - start:o - start + n]) for o, n in records[i:i + 1024]], _columns(schema))

    return placed.mapInArrow(read, schema)
