"""WARC records in ZIP archives: written with an index, read by ranges without extraction.

An archive is a ZIP file of stored (not compressed) members: `archive/data.warc.gz`, where every record is a gzip member of
its own, and `indexes/index.jsonl`, a line per record with its offset and length in that member. The reader parses the end
record, the ZIP64 locator and end record if there, and the central directory; finds each member's data behind its local
header; reads the index; and range-reads the records it names. Nothing is unpacked to disk and no archive is read whole.

Records whose payload occurred before are revisits: they carry the HTTP header with the full length, the payload's digest
and what they refer to, and no payload. Which record is the response is decided on (page_id, digest) rows before writing.

Tasks write archives under names of their own into the shared folder and return manifest rows, so a task that runs twice
leaves an unused file; the saved manifest names the archives that count.

Defined cases: a null html is an empty payload, and all empty payloads are one group; null page_ids come first and such a
group has a response with a null id; rows that repeat the largest page_id of a group are all responses; a null url is an
empty target; an empty table writes nothing and gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, saved, shared_path, shipped, text_or_empty
from .records import opened

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Fixed values of the ZIP format: signatures of its records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # a header value holds no line break
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Target-URI: {target}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> dict:
    """Header fields and payload of a record; the payload's digest is verified where the record holds it."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != sha1):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda x: int(x[10:-1]) if len(x) > 11 else None
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": sha1,
            "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To", "")),
            "url": fields.get("WARC-Target-URI", ""), "payload": payload}


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (local header's offset, stored size, method), from the central directory; read(offset, length) -> bytes."""
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, _, count, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    locator = tail_at + at - 20
    if 0xFFFFFFFF in (length, start) or count == 0xFFFF:
        signature, _, end64, _ = struct.unpack("<IIQI", read(locator, 20))
        if signature != LOCATOR64:
            raise ValueError("no ZIP64 locator before the end record")
        record = struct.unpack("<IQHHIIQQQQ", read(end64, 56))
        if record[0] != END64:
            raise ValueError("no ZIP64 end record where the locator says")
        count, length, start = record[7:10]
    directory, found, at = read(start, length), {}, 0
    for _ in range(count):
        (signature, _, _, _, method, _, _, _, stored, full, names, extras, comments, _, _, _, offset) = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if signature != CENTRAL:
            raise ValueError("broken central directory")
        at += 46
        name = directory[at : at + names].decode()
        extra = directory[at + names : at + names + extras]
        at += names + extras + comments
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        found[name] = (offset, stored, method)
    return found


def data_start(read, offset: int) -> int:
    """Where a member's data begin: behind its local header, whose name and extra field have lengths of their own."""
    header = struct.unpack("<IHHHHHIIIHH", read(offset, 30))
    if header[0] != LOCAL:
        raise ValueError("no local header where the directory says")
    return offset + 30 + header[9] + header[10]


def deduplicated(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html and refers_to: the group's response for a revisit, else null, with revisit true or false."""
    rows = pages.select("page_id", text_or_empty("url").alias("url"), text_or_empty("html").cast("binary").alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    groups = saved(rows.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
                   .where("n > 1").select("sha1", "keeper", F.lit(True).alias("again")), "groups")
    # which records are revisits is decided without their payloads, and told to them by page and digest, so a payload that a
    # third of the pages share is no hot key
    again = rows.select("page_id", "sha1").join(groups, "sha1").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).distinct()
    again = few(saved(again.select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "keeper", "again"), "revisits"), 200_000)
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left")
    revisit = F.coalesce(F.col("again"), F.lit(False))
    return rows.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write archives of about `archive_bytes` at most; return the saved manifest (path, size, records)."""
    folder = shared_path(shipped(pages.sparkSession), "warc")
    kinds = pa.schema({"path": pa.string(), "size": pa.int64(), "records": pa.int64()})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)

        def archives() -> Iterator[dict]:
            rows = (r for b in batches for r in zip(*(b[c] for c in ("page_id", "url", "html", "revisit", "refers_to"))))
            row = next(rows, None)
            while row is not None:
                name, index, offset = f"{uuid.uuid4().hex}.wacz", [], 0
                with fs.open_output_stream(f"{at}/{name}") as out:
                    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                            while row is not None and offset < archive_bytes:
                                page_id, url, html, revisit, refers_to = (x.as_py() for x in row)
                                packed = gzip.compress(warc_record(page_id, url, html, refers_to, revisit), 4, mtime=0)
                                data.write(packed)
                                index.append(json.dumps({"page": page_id, "offset": offset, "length": len(packed)}))
                                offset += len(packed)
                                row = next(rows, None)
                        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
                    size = out.tell()
                yield {"path": f"{folder}/{name}", "size": size, "records": len(index)}

        for archive in archives():
            yield pa.RecordBatch.from_pylist([archive], kinds)

    return saved(deduplicated(pages, least_bytes).mapInArrow(write, "path string, size long, records long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True, block: int = 8 << 20) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url and, unless
    with_payload is off, payload (empty for a revisit). Neighbouring records are fetched in ranges of about `block` bytes."""
    shipped(manifest.sparkSession)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
             "refers_to": pa.int64(), "url": pa.string()} | ({"payload": pa.binary()} if with_payload else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, size in (r.values() for b in batches for r in b.select(["path", "size"]).to_pylist()):
            fs, at = opened(path)
            with fs.open_input_file(at) as f:
                fetch = lambda offset, length: f.read_at(length, offset)
                found = members(fetch, size)
                if any(found[m][2] for m in (DATA, INDEX)):
                    raise ValueError(f"a member of {path} is not stored")
                start = data_start(fetch, found[DATA][0])
                lines = fetch(data_start(fetch, found[INDEX][0]), found[INDEX][1]).decode().split("\n")
                index = [(x["offset"], x["length"]) for x in map(json.loads, filter(None, lines))]
                i = 0
                while i < len(index):
                    low, j = index[i][0], i
                    while j < len(index) and sum(index[j]) - low <= max(block, index[i][1]):
                        j += 1
                    data = fetch(start + low, sum(index[j - 1]) - low)
                    rows = [parsed(zlib.decompress(data[o - low : o - low + n], 31)) for o, n in index[i:j]]
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in kinds} for r in rows], pa.schema(kinds))
                    i = j

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    # a task per archive: the manifest is small and would be read as one partition
    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, schema + ", payload binary" * with_payload)
