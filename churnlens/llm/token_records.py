"""Token-id output as length-delimited binary records.

A record is ``length`` (u64 little-endian), masked checksum of those 8 bytes
(u32), the payload, masked checksum of the payload (u32).  The checksum is
CRC-32 (zlib), masked as in the common record format: rotated right by 15 bits
plus 0xA282EAD8.  The payload is ``doc_id`` (i64), a byte that is 1 if the
doc_id is null, then the ids, as unsigned 16-bit integers where the vocabulary
has at most 65,536 ids and else as unsigned 32-bit ones.

Documents are range-partitioned by doc_id, so a file holds a run of documents in
ascending order and the files ascend too.  A task encodes its run and writes one
file under a temporary name, renamed when complete: a task that is repeated after
a lost executor writes the same file again.  The index (a Parquet table: doc_id,
file, byte offset, length, ids, ids before it in the file) is the same job's
output.  A reader can take records in any order from it.

Any input gives a defined result: null and empty texts are records of the end id
alone; a null doc_id comes first; rows with equal doc_id are ordered by a hash of the text;
an empty table gives no files and an empty index; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import shared_path
from churnlens.llm.tokens import encode_column

INDEX = "doc_id long, file int, offset long, length long, n_tokens long, before long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of records that one reading step takes from a file.
SEGMENT_BYTES = 8 << 20
_HEAD, _SUM = struct.Struct("<Q"), struct.Struct("<I")


def masked(data) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload at ``at`` and where the next record begins; raises on a damaged record."""
    head = data[at:at + 8]
    if len(head) < 8 or _SUM.unpack_from(data, at + 8)[0] != masked(head):
        raise ValueError(f"damaged length at byte {at}")
    n = _HEAD.unpack(head)[0]
    payload = data[at + 12:at + 12 + n]
    if len(payload) < n or _SUM.unpack_from(data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + n


def filesystem(path: str):
    """File system and path of a Hadoop-style URI or plain path."""
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), u.path
    return fs.FileSystem.from_uri(path)


def _file(folder: str, number: int) -> str:
    return f"{folder}/records/part-{number:06d}.rec"


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocab_size: int,
                  id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write the record files and the
    index below ``folder``; returns the index.  ``files``: number of files
    (default: the session's shuffle partitions)."""
    spark = docs.sparkSession
    wide = "<u2" if max(vocab_size, end_id + 1) <= 65536 else "<u4"
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
            .repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, where, before, out, name = TaskContext.get().partitionId(), 0, 0, None, ""
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                system, final = filesystem(_file(folder, number))
                system.create_dir(final.rpartition("/")[0], recursive=True)
                name = f"{final}.{TaskContext.get().taskAttemptId()}.tmp"
                out = system.open_output_stream(name)
            index = []
            for doc, ids in zip(b.column(0).to_pylist(), encode_column(tokenizer, b.column(1)), strict=True):
                ids = np.append(ids, end_id).astype(wide)
                record = frame(struct.pack("<qB", doc or 0, doc is None) + ids.tobytes())
                out.write(record)
                index.append((doc, number, where, len(record), len(ids), before))
                where += len(record)
                before += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*index, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)],
                names=["doc_id", "file", "offset", "length", "n_tokens", "before"])
        if out is not None:
            out.close()
            system.move(name, final)

    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, wide: str = "<u2") -> DataFrame:
    """Every record of the files: doc_id, start (ids of all records before it),
    n_tokens and the CRC-32 of its ids as little-endian unsigned 32-bit integers.

    The index gives byte ranges of about 8 MB (whole records); each is read and
    checked by itself.  Ids before a file: a running sum over one row a file."""
    sizes = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranges = (index.groupBy("file", F.floor(F.col("offset") / SEGMENT_BYTES).alias("segment"))
              .agg(F.min("offset").alias("at"), F.max(F.col("offset") + F.col("length")).alias("to"), F.min("before").alias("before"))
              .join(base, "file").select("file", "at", "to", (F.col("base") + F.col("before")).alias("start")))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, path = filesystem(_file(folder, r["file"]))
                with system.open_input_file(path) as f:
                    f.seek(r["at"])
                    data = memoryview(f.read(r["to"] - r["at"]))
                at, start, rows = 0, r["start"], []
                while at < len(data):
                    payload, at = unframe(data, at)
                    doc, null = struct.unpack_from("<qB", payload)
                    ids = np.frombuffer(payload[9:], dtype=wide).astype("<u4")
                    rows.append((None if null else doc, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return ranges.repartition(n, "file", "at").mapInArrow(read, READ)


def token_records(docs: DataFrame, tokenizer: str, end_id: int, vocab_size: int) -> DataFrame:
    """Write the documents' records to a new shared folder and read all of them back."""
    folder = shared_path(docs.sparkSession, "token-records")
    index = write_records(docs, folder, tokenizer, end_id, vocab_size)
    return read_records(index, folder, "<u2" if max(vocab_size, end_id + 1) <= 65536 else "<u4")
