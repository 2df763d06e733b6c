"""Token-id output: directly addressable codes.

A segment file stores the ids of many documents.  An id is cut into 8-bit
chunks.  Level 0 has the lowest chunk of every id; level k has chunk k of the
ids that need it, in order.  A bitmap a level tells which ids go on to the next
level, and a rank directory (set bits before each 512-bit block) leads from an
id's place in one level to its place in the next.  Any id, or any run of ids,
is read without decoding what stands before it.

Cases: a null text counts as empty, so such a document has only the end id; a
null doc_id sorts first and stays null; documents with the same doc_id keep one
entry each, in order of their text; an empty table gives no segments.  Columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, in_chunks
from .common import new_path, shuffle_partitions, table

MAGIC = b"DACT\x01"
BLOCK_BITS = 512
#: A segment is closed when it holds this many ids; it always holds whole documents.
SEGMENT_IDS = 1 << 20

_HEAD = struct.Struct("<5sBQQ")
_LEVEL = struct.Struct("<Q")


def _rank_directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each block."""
    blocks = -(-len(bits) // BLOCK_BITS) if len(bits) else 0
    padded = np.zeros(blocks * BLOCK_BITS, dtype=np.uint8)
    padded[: len(bits)] = bits
    counts = padded.reshape(blocks, BLOCK_BITS).sum(axis=1, dtype=np.uint64)
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if blocks else np.zeros(0, "<u4")


def pack_segment(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """``starts`` has one entry more than ``doc_ids``: the place of each document's first id."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest > 0xFF
        levels.append((rest & 0xFF, more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [_HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids))]
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    out += [np.packbits(known).tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.asarray(starts, dtype="<u8").tobytes()]
    for chunk, more in levels:
        bits = more.astype(np.uint8)
        out += [_LEVEL.pack(len(chunk)), chunk.astype(np.uint8).tobytes(), np.packbits(bits, bitorder="little").tobytes(), _rank_directory(bits).tobytes()]
    return b"".join(out)


class Segment:
    """Reads a segment; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes) -> None:
        magic, n_levels, n_docs, self.n_ids = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        known = np.unpackbits(take("u1", -(-n_docs // 8)))[:n_docs]
        self.doc_ids = [int(d) if k else None for d, k in zip(take("<i8", n_docs), known, strict=True)]
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self._levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self._levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", -(-n // BLOCK_BITS))))

    def _rank(self, level: int, place: int) -> int:
        """How many of the first ``place`` ids of a level go on to the next."""
        chunks, bitmap, directory = self._levels[level]
        if place >= len(chunks):
            return len(self._levels[level + 1][0]) if level + 1 < len(self._levels) else 0
        block = place // BLOCK_BITS
        part = np.unpackbits(bitmap[block * BLOCK_BITS // 8 : -(-place // 8)], bitorder="little")[: place - block * BLOCK_BITS]
        return int(directory[block]) + int(part.sum())

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < self.n_ids:
            raise IndexError(place)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self._levels):
            value |= int(chunks[place]) << (8 * level)
            if not bitmap[place // 8] >> (place % 8) & 1:
                break
            place = self._rank(level, place)
        return value

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids from place ``low`` to before place ``high``."""
        out = np.zeros(max(0, high - low), dtype="<u4")
        at = np.arange(len(out))
        for level, (chunks, bitmap, _) in enumerate(self._levels):
            if not len(at):
                break
            out[at] |= chunks[low:high].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[low // 8 : -(-high // 8)], bitorder="little")[low % 8 : low % 8 + high - low]
            at = at[bits == 1]
            low = self._rank(level, low) if len(at) else 0
            high = low + len(at)
        return out

    def document(self, index: int) -> np.ndarray:
        return self.ids(int(self.starts[index]), int(self.starts[index + 1]))


_FILE_SCHEMA = "shard int, segment int, first_in_shard long, n_docs long, n_ids long, data binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, segment_ids: int = SEGMENT_IDS) -> str:
    """Encode every text, write segments in ascending doc_id order, return their folder."""
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .repartitionByRange(shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, tool = TaskContext.get().partitionId(), encoder(tokenizer_path)
        number = before = held = 0
        doc_ids: list[int | None] = []
        raw: list[bytes] = []

        def close() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.uint64)
            data = pack_segment(doc_ids, starts, np.frombuffer(b"".join(raw), dtype="<u4"))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()), "first_in_shard": [before], "n_docs": [len(doc_ids)], "n_ids": [held], "data": pa.array([data], pa.binary())})

        for batch in batches:
            encoded = (ids for run in in_chunks(batch.column(1).to_pylist()) for ids in tool.encode_many(run))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                doc_ids.append(doc_id)
                raw.append(ids + end)
                held += len(raw[-1]) // 4
                if held >= segment_ids:
                    yield close()
                    number, before, held, doc_ids, raw = number + 1, before + held, 0, [], []
        if doc_ids:
            yield close()

    path = new_path(spark, "tokens")
    ordered.mapInArrow(segments, _FILE_SCHEMA).write.option("compression", "none").parquet(path)
    return path


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row a segment with ``start``, the number of ids in all segments before it.

    The running sum is over one row a shard; a shard is one task of the writer.
    """
    files = spark.read.schema(_FILE_SCHEMA).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(shards), "shard").select((F.col("base") + F.col("first_in_shard")).alias("start"), "data")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens and the crc32 of its ids."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = Segment(data.as_py())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(segment.doc_ids, pa.int64()),
                        "start": base + segment.starts[:-1],
                        "n_tokens": np.diff(segment.starts),
                        "ids_crc32": pa.array([zlib.crc32(segment.document(i).tobytes()) for i in range(len(segment.doc_ids))], pa.int64()),
                    }
                )

    return read_segments(spark, path).mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start and its ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = Segment(data.as_py())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(segment.doc_ids, pa.int64()), "start": base + segment.starts[:-1], "ids": pa.array([segment.document(i).astype(np.int64) for i in range(len(segment.doc_ids))], pa.list_(pa.int64()))})

    return read_segments(spark, path).mapInArrow(documents, "doc_id long, start long, ids array<long>")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, path)


__all__ = ["Segment", "op2_token_files", "pack_segment", "read_documents", "token_digests", "write_token_files"]
