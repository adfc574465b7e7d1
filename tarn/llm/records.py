"""Token-id output: length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A shard is a file of records in ascending document order. A record::

    int9 bytes of the body | int5 masked crc of those 9 bytes | body | int5 masked crc of the body | 0x0A
    payload: u8 0 or 1 (document id present) | i64 document id | u64 ids of the shard before it | ids, u16 each; little-endian

``int9`` and ``int5`` are integers in 9 and 5 bytes, 7 bits a byte from the lowest on, with the top bit set; the body is the payload with
0x1B as 1B 01 and 0x0A as 1B 02. So 0x0A stands at the end of a record and nowhere else: a reader that knows the lengths skips
from record to record, and a task that starts anywhere in a file finds the next record by itself. Shards are therefore read by
ranges of ``spark.sql.files.maxPartitionBytes``, however large they are.

The masked checksum of bytes b is ``rotate_right(crc32(b), 15) + 0xA282EAD8`` modulo 2**32. Beside each data file lies an
index file, with an entry of 38 bytes for each record: int10 document id (modulo 2**64) | int9 offset | int9 bytes of the record |
int9 its ids | 0x0A, so entry k is at 38k and one ranged read gets any record. Both are written by Spark's own committed writer to any
file system that Spark knows; a lost task leaves nothing half written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm import tokens
from tarn.llm.common import fresh_path, small_batches, texts

PAYLOAD = struct.Struct("<BqQ")
MASK_DELTA = 0xA282EAD8
#: Bytes of a record besides its body, the record end included; bytes of an entry of the index without its end.
FRAME, ENTRY = 9 + 5 + 5 + 1, 10 + 9 + 9 + 9


def masked(data: bytes) -> int:
    """The masked checksum of ``data``."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def packed_int(n: int, width: int) -> bytes:
    """``n`` in ``width`` bytes of 7 bits, the top bit of each set."""
    return bytes([n >> 7 * k & 127 | 128 for k in range(width)])


def unpacked_int(data: bytes) -> int:
    return sum((b & 127) << 7 * k for k, b in enumerate(data))


def framed(doc_id: int | None, before: int, ids: bytes) -> bytes:
    """One record without its end; ``before`` counts the ids of its shard before it."""
    payload = PAYLOAD.pack(doc_id is not None, doc_id or 0, before) + ids
    body = payload.replace(b"\x1b", b"\x1b\x01").replace(b"\n", b"\x1b\x02")
    size = packed_int(len(body), 9)
    return b"".join((size, packed_int(masked(size), 5), body, packed_int(masked(body), 5)))


def entry(doc_id: int | None, offset: int, n_bytes: int, n_tokens: int) -> bytes:
    """One entry of the index without its end."""
    return packed_int((doc_id or 0) % (1 << 64), 10) + packed_int(offset, 9) + packed_int(n_bytes, 9) + packed_int(n_tokens, 9)


def unframed(data: bytes) -> tuple[int | None, int, bytes]:
    """(document id, ids before it in the shard, ids) of one record without its end; a wrong checksum or length raises."""
    if len(data) < FRAME - 1 or masked(data[:9]) != unpacked_int(data[9:14]):
        raise ValueError("a record has a wrong checksum of its length")
    body = data[14:-5]
    if len(body) != unpacked_int(data[:9]) or masked(body) != unpacked_int(data[-5:]):
        raise ValueError("a record has a wrong checksum of its payload, or is cut short")
    payload = body.replace(b"\x1b\x02", b"\n").replace(b"\x1b\x01", b"\x1b")
    there, doc_id, before = PAYLOAD.unpack_from(payload)
    return doc_id if there else None, before, payload[PAYLOAD.size :]


def scanned(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record without its end) of a whole shard in memory, going from record to record by their lengths."""
    at = 0
    while at < len(data):
        end = at + FRAME + unpacked_int(data[at : at + 9])
        if data[end - 1 : end] != b"\n":
            raise ValueError(f"record at byte {at}: no end where its length says")
        yield at, data[at : end - 1]
        at = end


def record_at(file: BinaryIO, offset: int, n_bytes: int) -> tuple[int | None, int, bytes]:
    """The record of an index entry, by one ranged read of an open shard."""
    file.seek(offset)
    return unframed(file.read(n_bytes - 1))


def write_records(docs: DataFrame, path: str, *, vocabulary: str, end_id: int | None = 0) -> None:
    """Encode every whole text of ``docs`` (null: empty), append ``end_id``, and write shards in ascending ``doc_id`` order.

    Rows of one ``doc_id`` lie in the order of the 64-bit hashes of their texts, then of the texts; rows without a ``doc_id`` come
    first. So a ``doc_id`` that many rows have, or lack, is dealt out over many shards like any other range. An empty table gives
    no record. Other columns of ``docs`` are not used. Shards follow ``spark.sql.shuffle.partitions``, by sampled ranges;
    the name of a file sorts as its documents do.
    """
    tail = b"" if end_id is None else end_id.to_bytes(2, "little")

    def encode(batches):
        encoder, offset, before = tokens.library_encoder(vocabulary), 0, 0
        for batch in small_batches(batches):
            data, index = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + tail
                data.append(framed(doc_id, before, ids))
                n = len(data[-1]) + 1
                index.append(entry(doc_id, offset, n, len(ids) // 2))
                offset, before = offset + n, before + len(ids) // 2
            n = len(data)
            yield pa.RecordBatch.from_arrays([pa.array(["data"] * n), pa.array(data, pa.binary())], ["kind", "value"])
            yield pa.RecordBatch.from_arrays([pa.array(["index"] * n), pa.array(index, pa.binary())], ["kind", "value"])

    keys = ["doc_id", "__hash"]
    dealt = texts(docs).withColumn("__hash", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    rows = dealt.select("doc_id", "text").mapInArrow(encode, "kind string, value binary")
    # With two files open, one for each kind, the writer takes rows in their order and sorts nothing. Spark has no option of one
    # write for that; for any other write at the same time it only means fewer sorts.
    spark, name = docs.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        rows.select("kind", F.col("value").cast("string")).write.partitionBy("kind").option("maxRecordsPerFile", 0).text(path)
    finally:
        spark.conf.set(name, before)


def _lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``shard`` (number in the file's name) and ``line``, the bytes between two ends, read by ranges; none if nothing was written."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path")
    if there.isEmpty():
        return spark.createDataFrame([], "shard long, line binary")
    lines = spark.read.option("lineSep", "\n").text(f"{path}/kind={kind}")
    return lines.select(F.regexp_extract("_metadata.file_path", r"part-(\d+)", 1).cast("long").alias("shard"), F.col("value").cast("binary").alias("line"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index: ``shard, doc_id, offset, n_bytes, n_tokens``. A record without a document id has 0 here."""
    widths = np.array([10, 9, 9, 9])
    edges = np.concatenate(([0], np.cumsum(widths)))

    def parse(batches):
        for batch in batches:
            digits = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, ENTRY) & 127
            columns = [pa.array(batch.column(0))]
            for a, b in zip(edges, edges[1:], strict=False):
                shifts = np.uint64(7) * np.arange(b - a, dtype=np.uint64)
                columns.append(pa.array((digits[:, a:b].astype(np.uint64) << shifts).sum(1, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "offset", "n_bytes", "n_tokens"])

    return _lines(spark, path, "index").mapInArrow(parse, "shard long, doc_id long, offset long, n_bytes long, n_tokens long")


def read_order(spark: SparkSession, path: str, *, seed: int) -> DataFrame:
    """The index with ``place``, a pseudo-random key of ``seed`` for each record: sorted by it, it is the order of a shuffled pass."""
    return read_index(spark, path).withColumn("place", F.xxhash64("shard", "offset", F.lit(seed)))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records, checksums verified: ``shard, doc_id, before`` (ids of the shard before it)``, n_tokens, ids`` (u16 little-endian), ``ids_crc32`` (of the ids as u32)."""

    def parse(batches):
        names = ["shard", "doc_id", "before", "n_tokens", "ids", "ids_crc32"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for batch in small_batches(batches):
            rows = []
            for line in batch.column(1).to_pylist():
                doc_id, before, ids = unframed(line)
                rows.append((doc_id, before, len(ids) // 2, ids, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4"))))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return _lines(spark, path, "data").mapInArrow(parse, "shard long, doc_id long, before long, n_tokens long, ids binary, ids_crc32 long")


def record_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, base``: the ids in all shards before this one, from the index alone. One row a shard."""
    totals = read_index(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    return totals.select("shard", F.coalesce(F.sum("held").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def token_records(docs: DataFrame, *, vocabulary: str, end_id: int | None = 0, path: str | None = None) -> DataFrame:
    """Write the records of ``docs`` and read them back: ``doc_id, start, n_tokens, ids_crc32, ids, shard, before``.

    ``start`` counts the ids of all documents before, in the order of the files: those before it in its shard, which the record
    says, and those of all shards before, from the index (one row a shard). See ``write_records`` for nulls, repeated ids and
    empty tables.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "records")
    write_records(docs, path, vocabulary=vocabulary, end_id=end_id)
    rows = read_records(spark, path).join(record_starts(spark, path), "shard")
    return rows.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids", "shard", "before")
