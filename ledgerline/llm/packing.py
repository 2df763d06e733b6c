"""Best-fit packing by exact-complement hashing.

Only the histogram of piece lengths (at most ``capacity`` entries) reaches the
driver.  From the longest length down, the plan looks up the open gap in an
index of single, pair and triple length sums and takes a combination that fills
it exactly, as often as the counts of its lengths allow.  What is left goes by
best fit: a length joins the fullest sequences that still have room.  The plan
is a list of patterns (lengths, how many sequences), and the k-th piece of a
length, in any fixed order, takes the k-th place that the plan has for it.

Cases: null and empty texts have only the end id; repeated documents and
doc_ids are packed once a row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, in_chunks
from .common import stage, table

CAPACITY = 2048

Pattern = tuple[tuple[int, ...], int]


def _complement(counts: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that add up to ``gap``, longest first."""
    if gap < len(counts) and counts[gap]:
        return (gap,)

    def pair(total: int, highest: int) -> tuple[int, int] | None:
        a = np.arange((total + 1) // 2, min(highest, total - 1) + 1)
        b = total - a
        fits = (counts[a] > 0) & (counts[b] > 0) & ((a != b) | (counts[a] > 1))
        hits = np.flatnonzero(fits)
        return (int(a[hits[-1]]), int(b[hits[-1]])) if len(hits) else None

    if gap >= 2 and (found := pair(gap, gap - 1)):
        return found
    for first in range(gap - 2, (gap + 2) // 3 - 1, -1):
        if counts[first]:
            counts[first] -= 1
            found = pair(gap - first, first)
            counts[first] += 1
            if found:
                return (first, *found)
    return None


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that place every piece of the histogram; the sum of each is at most ``capacity``."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    patterns: list[Pattern] = []
    if counts[capacity]:
        patterns.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    left: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            counts[length] -= 1
            found = _complement(counts, capacity - length)
            counts[length] += 1
            if not found:
                left[length] = int(counts[length])
                counts[length] = 0
                break
            members = (length, *found)
            times = min(int(counts[x]) // members.count(x) for x in set(members))
            for x in members:
                counts[x] -= times
            patterns.append((members, times))
    return patterns + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, over groups of equal sequences."""
    open_by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def add(room: int, members: tuple[int, ...], times: int) -> None:
        if not open_by_room[room]:
            bisect.insort(rooms, room)
        open_by_room[room].append([members, times])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = min(n, capacity // length)
                add(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    add(capacity - n % each * length, (length,) * (n % each), 1)
                break
            room = rooms[i]
            members, times = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop(i)
            each = min(n, room // length)
            used = min(times, n // each)
            if used < times:
                add(room, members, times - used)
            add(room - each * length, members + (length,) * each, used)
            n -= used * each
    return [(tuple(m), t) for groups in open_by_room.values() for m, t in groups]


def plan_slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, number of ranks, first sequence, offset in the sequence)."""
    slots, used, sequence = [], defaultdict(int), 0
    for members, times in patterns:
        offset = 0
        for length in members:
            slots.append((length, used[length], times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return slots


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode every text and cut it into pieces of at most ``capacity`` ids.

    ``part`` and ``local_rank`` number the pieces of a length within the task
    that made them; the caller writes the table before it uses them.
    """
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tool, seen = TaskContext.get().partitionId(), encoder(tokenizer_path), defaultdict(int)
        for batch in batches:
            rows: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            encoded = (ids for run in in_chunks(batch.column(1).to_pylist()) for ids in tool.encode_many(run))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                raw = ids + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[at : at + 4 * capacity]
                    length = len(cut) // 4
                    for name, value in zip(rows, (doc_id, k, at // 4, length, zlib.crc32(cut), part, seen[length], *([np.frombuffer(cut, "<u4").tolist()] if with_ids else ())), strict=True):
                        rows[name].append(value)
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=False)], names=list(rows))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(pieces, schema)


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a staged table of ``cut_pieces``.

    The ranks of a length run over the parts in order.  The plan is broadcast:
    it has at most a few slots for each of ``capacity`` lengths, however many
    rows there are.
    """
    spark = pieces.sparkSession
    tallies = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan_slots(plan_patterns(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tallies.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    kept = [c for c in pieces.columns if c not in ("part", "local_rank")]
    ranked = pieces.join(bases, ["part", "length"]).select(*kept, (F.col("base") + F.col("local_rank")).alias("_rank"))
    plan = spark.sparkContext.broadcast(np.array(sorted(slots), dtype=np.int64).reshape(-1, 5))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        # Slots are sorted by length and first rank, so one search finds the slot.
        edges = slots[:, 0] * (1 << 50) + slots[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            at = np.searchsorted(edges, length * (1 << 50) + rank, side="right") - 1
            own = pa.RecordBatch.from_arrays([batch.column(c) for c in kept], names=kept)
            yield own.append_column("sequence_id", pa.array(slots[at, 3] + rank - slots[at, 1])).append_column("offset", pa.array(slots[at, 4]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return assign_sequences(stage(cut_pieces(docs, tokenizer_path, capacity=capacity, with_ids=with_ids), "pieces"), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
