"""WARC archives read by index: offset, length, URL and digest per record, then coalesced byte-range reads."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded, parallelism, scratch, small_batches, table, written

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 100
#: Bytes of an archive that one task row covers, and the largest gap that a coalesced read runs over.
RANGE_BYTES, GAP_BYTES = 4 << 20, 64 << 10

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_bytes(place: str, page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member; a revisit carries the headers of the full payload but not the payload. place: file and offset, which give its id."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> dict:
    """The fields of a record, and its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    ident = lambda name: int(fields[name]) if name in fields else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": ident("Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "record_type": fields["WARC-Type"], "refers_to": ident("Refers-To-Page-ID"),
        "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of (page_id, url, html) below ``folder``; the index table, written as Parquet.

    Equal payloads of at least LEAST_REVISIT bytes: the row of the smallest page_id is the response and the others
    revisit it. A null html is an empty payload, a null url leaves the header out, rows of null page_id are always
    responses, fully repeated rows of the smallest page_id are all responses, an empty table gives an empty index.
    Every task attempt writes a file of its own name, and the index names the file of the attempt that counted.
    """
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    narrow = pages.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    narrow = written(narrow, "warc-digests")
    groups = written(narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last"), "warc-groups")
    revisits = written(narrow.join(groups, "digest").where("page_id > refers_to").distinct(), "warc-revisits")
    rows = pages.join(bounded(revisits), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            index = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, html, digest, refers_to = row
                if out is None:
                    store, path = _open(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)  # the members are compressed already
                data = record_bytes(f"{name}:{at}", page_id, url, html.encode(), digest, refers_to)
                out.write(data)
                index.append((page_id, url, digest, "response" if refers_to is None else "revisit", refers_to, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), _INDEX)] if index else [pa.array([], f.type) for f in _INDEX], schema=_INDEX)
        if out is not None:
            out.close()

    return written(rows.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of an index name, read by few sorted byte ranges; payloads are checked against their digests.

    Null ids and urls come back null; a revisit has no payload, nor has any record without ``with_payload``; rows of the
    index that stand there twice are read twice; long payloads come whole; an empty index gives no records; other columns
    of the index are left out.
    """
    ranges = index.groupBy("file", F.floor(F.col("offset") / F.lit(RANGE_BYTES)).alias("part")).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("spans"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, spans in zip(batch.column("file").to_pylist(), batch.column("spans").to_pylist()):
                store, path = _open(file)
                found = []
                with store.open_input_file(path) as source:
                    first = 0
                    for k in range(1, len(spans) + 1):
                        end = spans[k - 1]["offset"] + spans[k - 1]["length"]
                        if k < len(spans) and spans[k]["offset"] - end <= GAP_BYTES:
                            continue
                        start = spans[first]["offset"]
                        data = source.read_at(end - start, start)
                        for s in spans[first:k]:
                            at = s["offset"] - start
                            r = parse_record(zlib.decompress(data[at : at + s["length"]], 31))
                            p = r["payload"]
                            if p is not None and (len(p) != r["payload_bytes"] or hashlib.sha256(p).hexdigest() != r["payload_digest"]):
                                raise ValueError(f"damaged record at {file}:{s['offset']}")
                            if not with_payload:
                                r["payload"] = None
                            found.append(r)
                        first = k
                yield pa.RecordBatch.from_pylist(found, schema=_RECORD)

    # a range is few bytes here but many to read: dealt out by number, as the planner would put them all in one task
    ranges = ranges.select("file", "spans").repartition(parallelism(index.sparkSession))
    return ranges.mapInArrow(read, RECORD)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
