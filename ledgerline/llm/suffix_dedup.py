"""Exact repeated-passage removal: depth-limited, most-significant-digit-first radix sorting of suffixes.

Every position of a text starts a suffix that matters only through its first
``depth`` bytes (a window).  Windows are ordered by their own bytes, eight at a
time from the front; after each digit the windows that are alone in their group
are dropped, and the groups that are left after the last digit are exactly the
repeated windows.

Before the digits the windows are dealt to tasks by an anchor: the ``gram`` of a
window with the least hash in it.  Equal windows have the same anchor at the same
place, so a group never spans two tasks.  Neighbouring windows with the same
anchor form a run, and a run travels once, as the bytes under it.  Within a
bucket the digits go

  over the anchors of the runs (a run whose anchor nobody else has is settled),
  over the windows of the runs that share an anchor, a few places of the anchor
  within the window at a time, as windows that differ in it are never equal.

The hash only chooses anchors and buckets; what counts as equal is decided on
bytes.  A chunk of texts sends equal runs once, with the least doc_id, and a
bucket keeps equal runs of all chunks once, so a passage that a third of all
documents share costs an entry a chunk.  The number of buckets grows with the
text, so that a bucket's size does not.

Cases: a null text counts as empty; texts shorter than ``depth`` lose nothing;
only a strictly smaller doc_id counts, so rows that repeat a doc_id leave each
other alone; a null doc_id counts as smaller than any other; very long texts are
worked on in blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import memory
from .common import shuffle_partitions, stage, table

DEPTH = 50
GRAM = 16
CHUNK_BYTES = 1 << 22
BLOCK = 1 << 18
#: Text whose runs a bucket should get, and windows that are sorted at a time.
BUCKET_BYTES = 1 << 22
SORTED_WINDOWS = 1 << 21
NO_ID = -(1 << 63)

_U = np.uint64
_PLACE_BITS = _U(24)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _U(0xD6E8FEB86659FD93) + (right ^ (right >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(31))


def _grams(data: np.ndarray, want: int) -> np.ndarray:
    """64-bit hashes of all substrings of a length, by doubling."""
    now = (data.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    now ^= now >> _U(32)
    n = 1
    while n * 2 <= want:
        now = _join(now[:-n], now[n:])
        n *= 2
    shift = want - n
    return _join(now[: len(now) - shift], now[shift:]) if shift else now


def _slide_min(values: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    shift = width - n
    return np.minimum(values[: len(values) - shift], values[shift:]) if shift else values


class Runs:
    """The runs of a chunk's windows: first window, number of windows, document, and the anchor's place and hash."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, depth: int, gram: int) -> None:
        ends = np.cumsum(lengths)
        starts, counts, docs, places, hashes = [], [], [], [], []
        for at in range(0, len(data) - depth + 1, BLOCK):
            small = _grams(data[at : at + BLOCK + depth - 1], gram)
            packed = (small >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(small), dtype=_U)
            place = (_slide_min(packed, depth - gram + 1) & ((_U(1) << _PLACE_BITS) - _U(1))).astype(np.int64)
            window = at + np.arange(len(place))
            doc = np.searchsorted(ends, window, side="right")
            inside = np.flatnonzero(window + depth <= ends[doc])
            if not len(inside):
                continue
            place, doc = place[inside], doc[inside]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(doc) != 0) | (np.diff(inside) != 1)]))
            starts.append(at + inside[first])
            counts.append(np.diff(np.append(first, len(inside))))
            docs.append(doc[first])
            places.append(at + place[first])
            hashes.append(small[place[first]])
        joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.start, self.count, self.doc, self.place, self.gram = joined(starts, np.int64), joined(counts, np.int64), joined(docs, np.int64), joined(places, np.int64), joined(hashes, _U)

    def entries(self, raw: bytes, depth: int, buckets: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Bucket, bytes and anchor's place of each distinct run, by bucket; and the entry of every run."""
        seen: dict[bytes, int] = {}
        stop = self.start + self.count + (depth - 1)
        number = np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(self.start.tolist(), stop.tolist(), strict=True)], np.int64)
        first = np.full(len(seen), len(number))
        np.minimum.at(first, number, np.arange(len(number)))
        bucket = ((self.gram[first] >> _U(32)) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        entry = np.empty(len(order), np.int64)
        entry[order] = np.arange(len(order))
        covers = list(seen)
        return bucket[order], [covers[k] for k in order.tolist()], (self.place - self.start)[first][order], entry[number]


def _chunks(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Texts in chunks, as they come.  ``rest`` has the carried columns as Arrow data."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.claim("suffix")
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        tool = zstandard.ZstdCompressor(level=3)
        ids: list[int] = []
        texts: list[bytes] = []
        rest: list[pa.RecordBatch] = []
        held = 0

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            if rest and carry:
                with pa.ipc.new_stream(sink, rest[0].schema) as out:
                    for part in rest:
                        out.write_batch(part)
            columns = [pa.array([number], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([tool.compress(b"".join(texts))], pa.binary()), pa.array([tool.compress(sink.getvalue().to_pybytes())], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "n_bytes", "ids", "lengths", "data", "rest"])

        for batch in batches:
            others, begun = batch.select(list(range(2, batch.num_columns))), 0
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                if held >= CHUNK_BYTES:
                    rest.append(others.slice(begun, k - begun))
                    yield close()
                    number, ids, texts, rest, held, begun = number + 1, [], [], [], 0, k
                ids.append(doc_id)
                texts.append(text.as_py())
                held += len(texts[-1])
            rest.append(others.slice(begun))
        if ids:
            yield close()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(carry)])
    return rows.mapInArrow(chunks, "chunk long, n_bytes long, ids array<long>, lengths array<long>, data binary, rest binary")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: each holds a chunk."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]
        memory.trim()


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    import zstandard

    return np.array(row["ids"], np.int64), np.array(row["lengths"], np.int64), zstandard.ZstdDecompressor().decompress(row["data"])


def _least(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, of, values)
    return least


def _expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count`` members its owner and its number there."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - (np.cumsum(count) - count)[of]


def _digit(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Up to eight bytes from each place, as a number that orders as they do; ``data`` has eight bytes more than places."""
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    return words[at].astype(_U) >> _U(8 * (8 - width))


def _pass(members: np.ndarray, group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One digit: the members in its order within their groups, the refined groups; without those that are alone."""
    order = np.lexsort((digit, group))
    g, d = group[order], digit[order]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    shared = ~(new[:-1] & new[1:])
    return members[order[shared]], (np.cumsum(new[:-1]) - 1)[shared]


def sort_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, groups) of the places ``at`` whose ``depth`` bytes and group another one shares.

    Equal numbers in groups mean equal bytes, and members stand in the order of their bytes within a first group.
    """
    members = np.arange(len(at))
    for begin in range(0, depth, 8):
        if len(members):
            members, group = _pass(members, group, _digit(data, at[members] + begin, min(8, depth - begin)))
    return members, group


def _earlier(covers: list[bytes], anchor: np.ndarray, least: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the distinct runs of a bucket whether a run with a smaller doc_id has it; and where each run's windows begin."""
    data = np.frombuffer(b"".join(covers) + bytes(8), np.uint8)
    length = np.array([len(c) for c in covers], np.int64)
    start = np.cumsum(length) - length
    count = length - (depth - 1)
    first = np.cumsum(count) - count
    hit = np.zeros(int(count.sum()), bool)
    runs, anchors = sort_groups(data, start + anchor, np.zeros(len(covers), np.int64), gram)
    if not len(runs):
        return hit, first
    # Windows with the anchor at different places are never equal: those places are taken a few at a time.
    low, high = anchor[runs] - count[runs] + 1, anchor[runs]
    opens = np.bincount(low - low.min(), minlength=high.max() - low.min() + 2) - np.bincount(high + 1 - low.min(), minlength=high.max() - low.min() + 2)
    at_place = np.cumsum(opens)
    begin = 0
    while begin < len(at_place):
        end, held = begin + 1, at_place[begin]
        while end < len(at_place) and held + at_place[end] <= SORTED_WINDOWS:
            held += at_place[end]
            end += 1
        lowest, highest = begin + low.min(), end - 1 + low.min()
        these = np.flatnonzero((low <= highest) & (high >= lowest))
        from_, to = np.maximum(low[these], lowest), np.minimum(high[these], highest)
        of, k = _expand(to - from_ + 1)
        run, place = runs[these][of], from_[of] + k
        window = anchor[run] - place  # the window's number in its run
        members, groups = sort_groups(data, start[run] + window, anchors[these][of] * depth + place, depth)
        if len(members):
            own = least[run[members]]
            hit[first[run[members]] + window[members]] = own > _least(own, groups, int(groups.max()) + 1)[groups]
        begin = end
    return hit, first


def _planes(values: np.ndarray) -> bytes:
    """Differences of integers, byte by byte of all: the upper bytes pack well."""
    return np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T.copy().view("<i8").ravel())


_BLOBS = "bucket int, chunk long, entries int, blob binary"
_ANSWERS = "chunk long, bucket int, flags binary"


def _answered(blobs: DataFrame, depth: int, gram: int) -> DataFrame:
    """For the entries of each chunk and bucket: 0 (no window is earlier elsewhere), 1 (all are) or 2, and a bit for each window of the last kind."""

    def answer(bucket: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        import zstandard

        seen: dict[bytes, int] = {}
        tool, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        places, docs, numbers = [], [], []
        for _, n, blob in rows:
            raw = tool.decompress(blob)
            docs.append(_unplaned(raw, n, 0))
            places.append(_unplaned(raw, n, 8 * n))
            edges = (np.cumsum(_unplaned(raw, n, 16 * n)) + 24 * n).tolist()
            numbers.append(np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip([24 * n, *edges], edges)], np.int64))
        number, doc = np.concatenate(numbers), np.concatenate(docs)
        anchor = np.zeros(len(seen), np.int64)
        anchor[number] = np.concatenate(places)
        least = _least(doc, number, len(seen))
        hit, first = _earlier(list(seen), anchor, least, depth, gram)
        some = np.logical_or.reduceat(hit, first) if len(hit) else np.zeros(0, bool)
        count = np.diff(np.append(first, len(hit)))
        kind = np.where(doc > least[number], 1, np.where(some[number], 2, 0)).astype(np.uint8)
        flags, at = [], 0
        for _, n, _ in rows:
            mine, own = kind[at : at + n], number[at : at + n]
            mixed = own[mine == 2]
            of, k = _expand(count[mixed])
            flags.append(packer.compress(mine.tobytes() + np.packbits(hit[first[mixed][of] + k]).tobytes()))
            at += n
        return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(flags, pa.binary())], names=["chunk", "bucket", "flags"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.claim("suffix")
        now, rows = None, []
        for batch in batches:
            for bucket, chunk, n, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if bucket != now and rows:
                    yield answer(now, rows)
                    rows = []
                    memory.trim()
                now = bucket
                rows.append((chunk, n, blob.as_py()))
        if rows:
            yield answer(now, rows)

    return blobs.repartition(shuffle_partitions(blobs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, _ANSWERS)


def _covered(runs: Runs, entry: np.ndarray, own: np.ndarray, kinds: np.ndarray, bits: np.ndarray, n_bytes: int, depth: int) -> np.ndarray:
    """Which bytes of a chunk lie under a window that a smaller doc_id has.

    ``kinds`` and ``bits`` are the answers to the entries; ``own`` is the doc_id of each run.
    """
    count = np.zeros(len(kinds), np.int64)
    count[entry] = runs.count
    mixed = np.where(kinds == 2, count, 0)
    first = np.cumsum(mixed) - mixed
    kind = np.where(own > _least(own, entry, len(kinds))[entry], 1, kinds[entry])
    gone = kind == 1
    some = np.flatnonzero(kind == 2)
    of, k = _expand(runs.count[some])
    place = (runs.start[some][of] + k)[bits[first[entry[some]][of] + k] == 1]
    begins = np.concatenate([runs.start[gone], place])
    ends = np.concatenate([(runs.start + runs.count)[gone] + (depth - 1), place + depth])
    return np.cumsum(np.bincount(begins, minlength=n_bytes + 1) - np.bincount(ends, minlength=n_bytes + 1))[:-1] > 0


_RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, carry: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, the removed spans, the bytes that are kept (``as_text``: whole characters of UTF-8), and the columns to carry along as carry_0, carry_1, ..."""
    spark = docs.sparkSession
    chunks = stage(_chunks(docs, carry), "suffix-chunks")
    n_bytes = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-n_bytes // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.claim("suffix")
        import zstandard

        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in _rows(batch):
                ids, lengths, raw = _open(row)
                runs = Runs(np.frombuffer(raw, np.uint8), lengths, depth, gram)
                bucket, covers, anchor, entry = runs.entries(raw, depth, buckets)
                least = _least(ids[runs.doc], entry, len(covers))
                sizes = np.array([len(c) for c in covers], np.int64)
                names, at = np.unique(bucket, return_index=True)
                edges = [*at.tolist(), len(bucket)]
                blobs = [tool.compress(b"".join([_planes(least[i:j]), _planes(anchor[i:j]), _planes(sizes[i:j]), *covers[i:j]])) for i, j in zip(edges, edges[1:])]
                if blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([row["chunk"]] * len(names), pa.int64()), pa.array(np.diff(edges), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "entries", "blob"])

    flags = stage(_answered(chunks.select("chunk", "ids", "lengths", "data").mapInArrow(send, _BLOBS), depth, gram), "suffix-flags")

    carried = [f"carry_{k}" for k in range(len(carry))]
    schema = ", ".join([_RESULT, *[f"{name} {docs.schema[c].dataType.simpleString()}" for name, c in zip(carried, carry, strict=True)]])

    def gone_of(row: dict, ids: np.ndarray, lengths: np.ndarray, raw: bytes) -> np.ndarray:
        import zstandard

        runs = Runs(np.frombuffer(raw, np.uint8), lengths, depth, gram)
        bucket, _, _, entry = runs.entries(raw, depth, buckets)
        tool, kinds, bits = zstandard.ZstdDecompressor(), [], []
        answers = {x["bucket"]: x["flags"] for x in row["found"] or []}
        names, at = np.unique(bucket, return_index=True)
        counts = np.zeros(len(bucket), np.int64)
        counts[entry] = runs.count
        edges = [*at.tolist(), len(bucket)]
        for name, i, j in zip(names.tolist(), edges, edges[1:]):
            found = np.frombuffer(tool.decompress(answers[name]), np.uint8)
            kinds.append(found[: j - i])
            bits.append(np.unpackbits(found[j - i :], count=int(counts[i:j][kinds[-1] == 2].sum())))
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return _covered(runs, entry, ids[runs.doc], joined(kinds), joined(bits), len(raw), depth)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.claim("suffix")
        import zstandard

        for batch in batches:
            for row in _rows(batch):
                ids, lengths, raw = _open(row)
                gone = gone_of(row, ids, lengths, raw)
                data = np.frombuffer(raw, np.uint8)
                out: list[tuple] = []
                at = 0
                for doc_id, n in zip(ids.tolist(), lengths.tolist(), strict=True):
                    mine = gone[at : at + n]
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                    spans = [{"start": i, "stop": j} for i, j in turns.reshape(-1, 2).tolist()]
                    kept = data[at : at + n][~mine].tobytes() if spans else raw[at : at + n]
                    if as_text:
                        # A character that was cut through goes whole.
                        kept = kept.decode("utf-8", "ignore").encode()
                    out.append((None if doc_id == NO_ID else doc_id, n, int(mine.sum()), spans, kept))
                    at += n
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
                made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                if carry:
                    rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all()
                    for field, column in zip(carried, rest.columns, strict=True):
                        made = made.append_column(field, pa.concat_arrays(column.chunks))
                yield made

    answers = flags.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags")).alias("found"))
    return (chunks if carry else chunks.drop("rest")).join(answers, "chunk", "left").mapInArrow(cut, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
