"""Token ids as length-delimited binary records, with an index of offsets for shuffled reads.

A record file holds, per document in ascending doc_id: the payload's length (8 bytes), the masked checksum of those 8
bytes, the payload, and the payload's masked checksum (4 bytes each, all little-endian). A payload is one byte of flags
(bit 0: it has an id), the 8-byte doc_id and the ids, 2 or 4 bytes each as the file's manifest says. The index file holds
the offset and the payload length of each record (8 bytes each), so any record is one range read. The checksum is CRC-32,
rotated by 15 bits plus a constant so that a checksum of data that holds checksums stays useful.

Texts move once, to ranges of doc_id; each task encodes its range in order and streams it to a file of its own name, so a
task that runs twice leaves an unused file and nothing else. The manifest, saved when all are written, names the files
that count. A file's first position is the sum of the ids of the files before it.

Defined cases: a null text is empty and gives the end id alone; null doc_ids come first; rows with one doc_id follow each
other, in the order they are read; an empty table gives no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, shared_path, shipped, text_or_empty
from .tokens import encoder

MASK_DELTA = 0xA282EAD8
MANIFEST = pa.schema({"part": pa.int32(), "path": pa.string(), "index_path": pa.string(), "records": pa.int64(),
                      "ids": pa.int64(), "id_bytes": pa.int32()})


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> bytes:
    """The payload of the record at `at`; raises ValueError if a checksum does not hold."""
    length = data[at : at + 8]
    (size,), (check,) = struct.unpack("<Q", length), struct.unpack_from("<I", data, at + 8)
    if masked(length) != check:
        raise ValueError(f"length checksum of the record at {at}")
    payload = data[at + 12 : at + 12 + size]
    if len(payload) != size or masked(payload) != struct.unpack_from("<I", data, at + 12 + size)[0]:
        raise ValueError(f"payload checksum of the record at {at}")
    return payload


def opened(path: str):
    """A file system and the path in it, for local paths and URIs."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def write_token_records(
    docs: DataFrame, tokenizer_path: str, layout: str, end_id: int, text: str = "text", id_bytes: int = 2, file_bytes: int = 32 << 20
) -> DataFrame:
    """Write the record files and their indexes to the shared folder; return their manifest, a row per file. Files hold about
    `file_bytes` of text. ValueError if an id does not fit `id_bytes`."""
    spark = shipped(docs.sparkSession)
    folder = shared_path(spark, "records")
    rows = docs.select("doc_id", text_or_empty(text).alias("text"))
    # an estimate of the bytes, which decides the number of files only: a reading of all texts for it would cost more
    average = rows.select(F.octet_length("text").alias("n")).limit(1000).agg(F.avg("n")).first()[0] or 0
    files = max(4 * spark.sparkContext.defaultParallelism, int(rows.count() * average) // file_bytes + 1)
    # rows of one doc_id spread over files too
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(files, "doc_id", "rid").sortWithinPartitions("doc_id", "rid").select("doc_id", "text")
    kind, end = f"<u{id_bytes}", np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path, layout).ids, TaskContext.get().partitionId()
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)
        name, out, index, offset, ids = f"part-{part:06d}-{uuid.uuid4().hex}", None, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(f"{at}/{name}.rec")
            for doc_id, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                found = np.frombuffer(encode(t.as_py()) + end, "<u4")
                if int(found.max()) >> 8 * id_bytes:
                    raise ValueError(f"id {found.max()} does not fit {id_bytes} bytes")
                payload = struct.pack("<Bq", doc_id is not None, doc_id or 0) + found.astype(kind).tobytes()
                out.write(frame(payload))
                index.append((offset, len(payload)))
                offset, ids = offset + len(payload) + 16, ids + len(found)
        if out:
            out.close()
            with fs.open_output_stream(f"{at}/{name}.idx") as f:
                f.write(np.array(index, "<u8").tobytes())
            row = (part, f"{folder}/{name}.rec", f"{folder}/{name}.idx", len(index), ids, id_bytes)
            yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, row))], MANIFEST)

    schema = "part int, path string, index_path string, records long, ids long, id_bytes int"
    return saved(rows.mapInArrow(write, schema), "manifest")


def read_token_records(manifest: DataFrame, with_ids: bool = True, block: int = 8 << 20) -> DataFrame:
    """Every record, in file order within a file: doc_id, start (ids before it in all files), n_tokens, ids_crc32 and,
    unless with_ids is off, ids (binary, 4 little-endian bytes each; ids_crc32 is theirs). Files are read in ranges of
    whole records of about `block` bytes; checksums are verified."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    # a task per file: the manifest itself is small and would be read as one partition
    files = saved(files, "files").repartition(max(1, manifest.count()))

    shipped(manifest.sparkSession)
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    kinds |= {"ids": pa.binary()} if with_ids else {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                fs, path = opened(f["path"])
                with fs.open_input_file(opened(f["index_path"])[1]) as g:
                    index = np.frombuffer(g.read(), "<u8").reshape(-1, 2).astype(np.int64)
                start, kind = f["first"], f"<u{f['id_bytes']}"
                with fs.open_input_file(path) as g:
                    i = 0
                    while i < len(index):
                        j = max(i + 1, int(np.searchsorted(index[:, 0], index[i, 0] + block)))
                        low, high = int(index[i, 0]), int(index[j - 1].sum()) + 16
                        data, out = g.read_at(high - low, low), []
                        for at in (index[i:j, 0] - low).tolist():
                            payload = unframe(data, at)
                            has_id, doc_id = struct.unpack_from("<Bq", payload)
                            ids = np.frombuffer(payload, kind, offset=9).astype("<u4").tobytes()
                            out.append((doc_id if has_id else None, start, len(ids) // 4, zlib.crc32(ids), ids)[: len(kinds)])
                            start += len(ids) // 4
                        columns = map(pa.array, zip(*out), kinds.values())
                        yield pa.RecordBatch.from_arrays(list(columns), names=list(kinds))
                        i = j

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files.mapInArrow(read, schema)
