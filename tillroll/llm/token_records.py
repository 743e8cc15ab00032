"""Token ids in files of length-delimited binary records.

A file is a run of records, each

    8 bytes   length of the payload, little-endian
    4 bytes   masked CRC-32 of those 8 bytes
    payload   1 byte flags (1: the id is null; 2: ids are 2 bytes wide),
              8 bytes doc_id, then the ids, little-endian, 4 or 2 bytes each
    4 bytes   masked CRC-32 of the payload
    1 byte    newline, so that Spark's own writer can lay the records out

with mask(c) = rotate_right(c, 15) + 0xa282ead8 (mod 2**32), so that a checksum
of data that itself holds checksums stays useful.  Records are in ascending
doc_id order within a file and from file to file (part number, then file
number).  Spark's writer commits the files: a retried or speculative task
leaves no second copy, and any file system that Spark writes to will do.

``write_records`` writes the files, ``read_records`` checks every length and
checksum and gives the ids back, ``offset_index`` is the separate index (file,
byte offset, size, ids before) for shuffled reads, ``record_at`` reads one
record by it.

Defined cases: a null text counts as empty (its end id alone is written); null
ids come first; rows that repeat an id are ordered by their text's hash, then by text; an empty table
writes no record; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from tillroll.llm.arrow import pieces
from tillroll.llm.encoding import encoder
from tillroll.llm.tables import scratch_folder, small_batches, written

HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
DOC = struct.Struct("<Bq")
NULL_ID, NARROW = 1, 2
#: Records are written in blocks of about this many bytes (one longer record is
#: a block), a file holds at most so many blocks: it can be read in one piece.
BLOCK_BYTES, BLOCKS_PER_FILE = 4 << 20, 8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload)), b"\n"))


def frames(data: bytes):
    """(offset, size, payload) of each record of a file; raises on damage."""
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"cut off in the head of the record at byte {at}")
        n, check = HEAD.unpack_from(data, at)
        if check != masked(data[at : at + 8]):
            raise ValueError(f"length checksum is wrong at byte {at}")
        end = at + HEAD.size + n + TAIL.size + 1
        if end > len(data):
            raise ValueError(f"cut off in the record at byte {at}")
        payload = data[at + HEAD.size : at + HEAD.size + n]
        if TAIL.unpack_from(data, at + HEAD.size + n)[0] != masked(payload) or data[end - 1] != 10:
            raise ValueError(f"payload checksum is wrong at byte {at}")
        yield at, end - at, payload
        at = end


def serialized(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    flags = NULL_ID * (doc_id is None) | NARROW * narrow
    if narrow:
        wide = np.frombuffer(ids, dtype="<u4")
        if len(wide) and wide.max() >= 1 << 16:
            raise OverflowError(f"id {wide.max()} doesn't fit two bytes")
        ids = wide.astype("<u2").tobytes()
    return DOC.pack(flags, doc_id or 0) + ids


def parsed(payload: bytes) -> tuple[int | None, bytes]:
    """doc_id and the ids as packed little-endian unsigned 32-bit integers."""
    flags, doc = DOC.unpack_from(payload)
    body = payload[DOC.size :]
    ids = np.frombuffer(body, dtype="<u2").astype("<u4").tobytes() if flags & NARROW else body
    return (None if flags & NULL_ID else doc), ids


def fits_two_bytes(tokenizer_path: str, end_id: int) -> bool:
    return max(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 > end_id


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, narrow: bool | None = None) -> None:
    """Encode every document, add the end id and write the record files.

    ``narrow`` halves the files; where it isn't given, the vocabulary's largest
    id decides.  An id that doesn't fit stops the job.
    """
    end = int(end_id).to_bytes(4, "little")
    if narrow is None:
        narrow = fits_two_bytes(tokenizer_path, end_id)

    def block(records: list[bytes]) -> pa.RecordBatch:
        # the newline that closes the last record is the writer's line end
        return pa.RecordBatch.from_arrays([pa.array([b"".join(records)[:-1]], pa.binary())], ["block"])

    def blocks(batches):
        enc = encoder(tokenizer_path)
        held, size = [], 0
        for batch in pieces(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = framed(serialized(doc, enc.ids(text or "") + end, narrow))
                if held and size + len(record) > BLOCK_BYTES:
                    yield block(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield block(held)

    # rows of one id may be many: they are spread by their texts' hash
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("said", F.xxhash64("text"))
        .repartitionByRange("doc_id", "said")
        .sortWithinPartitions("doc_id", "said", "text")
        .select("doc_id", "text")
    )
    lines = ordered.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value"))
    with small_batches(docs.sparkSession):
        lines.write.option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files, checked: ``file, part, number, offset,
    size, doc_id, n_tokens, local_start, ids`` (ids packed, 4 bytes each)."""
    schema = "file string, offset long, size long, doc_id long, n_tokens long, local_start long, ids binary"

    def unpack(batches):
        names = ["file", "offset", "size", "doc_id", "n_tokens", "local_start", "ids"]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, start = [], 0
                for at, size, payload in frames(content.as_py()):
                    doc, ids = parsed(payload)
                    rows.append((file.as_py(), at, size, doc, len(ids) // 4, start, ids))
                    start += len(ids) // 4
                for i in range(0, len(rows), 1000):
                    columns = zip(*rows[i : i + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    part = F.regexp_extract("file", r"part-(\d+)-", 1).cast("long").alias("part")
    number = F.regexp_extract("file", r"-c(\d+)\.[^/]*$", 1).cast("long").alias("number")
    return files.mapInArrow(unpack, schema).select("file", part, number, "offset", "size", "doc_id", "n_tokens", "local_start", "ids")


def offset_index(records: DataFrame) -> DataFrame:
    """The index of written files, without the ids: where each record lies and
    how many ids come before it in all files (``start``).  Only one row per
    file meets in one task."""
    files = records.groupBy("part", "number").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.select("part", "number", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return records.join(totals, ["part", "number"]).withColumn("start", F.col("_before") + F.col("local_start")).drop("_before", "ids")


def record_at(spark: SparkSession, file: str, offset: int, size: int) -> tuple[int | None, list[int]]:
    """One record by its index entry, read through Spark's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        ((_, _, payload),) = frames(bytes(stream.readNBytes(size)))
    finally:
        stream.close()
    doc, ids = parsed(payload)
    return doc, np.frombuffer(ids, dtype="<u4").tolist()


def encode_to_records(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the record files and the index beside them, read the files back:
    ``doc_id, start, n_tokens, ids_crc32, file, offset, size``."""
    spark = docs.sparkSession
    path = path or scratch_folder(spark, "token-records")
    write_records(docs, f"{path}/records", tokenizer_path, end_id)
    crc = F.crc32("ids").alias("ids_crc32")
    read = written(read_records(spark, f"{path}/records").select("*", crc).drop("ids"), "records-read")
    offset_index(read).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index").select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "size")
