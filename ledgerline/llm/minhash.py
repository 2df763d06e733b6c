"""MinHash near-duplicates with tensored banding and exact confirmation.

Two collections of ``groups`` small min-hash groups are computed for each set of
shingles.  Every pair (one group of the first, one of the second) is the key of
a table, so groups * groups tables need only 2 * groups * width min-hashes.  Sets
that meet in a table are candidates; a link is confirmed on the full sets.

Documents with equal sets are one class with one representative.  A class that
shares no first or no second group with another one meets nobody and is dropped
before the tables are formed.  Within a bucket not all pairs are looked at:

  1. Every class is compared with the nearest, by a 256-bit sketch, of the
     first members of its buckets.  Links are joined to components.
  2. In buckets whose members are in several components, one member of each
     component is drawn and compared with the first; of the pairs between two
     components only the nearest is.  This repeats while it finds links.
  3. In the buckets that are still mixed, all members outside the bucket's largest
     component are compared with all members of other components.  So no link of a
     bucket is lost.

Pairs whose sizes or sketches rule the similarity out are left out.  A size does so
with certainty.  So does a sketch for sets of up to some 270 shingles, as a shingle
that only one set has changes at most one range; for larger sets the limit lies
seven deviations beyond what a similarity of 0.8 leads to.

A pair that is similar at exactly the threshold 0.8 meets in some table with
probability 0.997 at the default 9 groups of 3; at 0.85 it is 0.9996.

Cases: a text without words has an empty set, no links and is kept; null texts
count as empty; a null doc_id has no links, a null component and is kept; rows
that repeat a doc_id are one document; equal texts, ties and very long texts
need no special care; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import memory
from .common import attach_by_key, stage, table, unstage
from .components import connect

GROUPS = 9
WIDTH = 3
THRESHOLD = 80
DRAW_YIELD = 0.05
MOST_DRAWS = 4

_MEMO_WORDS = 300_000
_WORDS: dict[bytes, int] = {}
memory.register("minhash", _WORDS.clear)
#: Odd multipliers that mix a word's hash by its place in the shingle (drawn once from a fixed seed).
_PLACES = np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``words`` make one shingle."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > _MEMO_WORDS:
        _WORDS.clear()
    for w in set(parts).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    codes = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), 1)], np.uint64)
    total = np.zeros(len(parts) - words + 1, np.uint64)
    for k in range(words):
        total += _mix(codes[k : len(codes) - words + 1 + k] + _PLACES[k]) * _PLACES[k + 32]
    return np.unique(_mix(total))


def _multipliers(groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(1729)
    n = 2 * groups * width
    return draw.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(hashes: np.ndarray, groups: int, width: int) -> np.ndarray:
    """The 2 * groups group hashes of a set: each mixes ``width`` min-hashes."""
    a, b = _multipliers(groups, width)
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP]
        least = np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(axis=1))
    least = least.reshape(2 * groups, width)
    out = np.zeros(2 * groups, np.uint64)
    for k in range(width):
        out = _mix(out + least[:, k] * _PLACES[k])
    return out.view(np.int64)


#: A narrow sketch travels with every member of a bucket, a wide one with those that stay unsettled.
#: Each is (ranges of hashes, bits kept of the least hash in a range).
NARROW, WIDE = (256, 1), (512, 4)


def bit_sketch(hashes: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """The last bits of the least hash in each of equal ranges (0 for an empty one), bit by bit in 64-bit integers."""
    shift = np.uint64(64 - ranges.bit_length() + 1)
    own = np.arange(ranges, dtype=np.uint64)
    at = np.searchsorted(hashes, own << shift)
    padded = np.append(hashes, np.uint64(0))
    there = (at < len(hashes)) & ((padded[at] >> shift) == own)
    return np.concatenate([np.packbits(((padded[at] >> np.uint64(k)) & np.uint64(1)).astype(np.uint8) * there).view(np.int64) for k in range(bits)])


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))


def sketch(docs: DataFrame, words: int, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set and its group hashes."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.claim("minhash")
        for batch in batches:
            n, first, second, groups_of, bits = [], [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                halves = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                first.append(halves[0])
                second.append(halves[1])
                groups_of.append(signature(s, groups, width) if len(s) else np.zeros(0, np.int64))
                bits.append(np.concatenate([bit_sketch(s, *NARROW), bit_sketch(s, *WIDE)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(groups_of, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "bits"])

    return _texts(docs).mapInArrow(sketches, "doc_id long, n_shingles long, set_a long, set_b long, sig array<long>, bits array<long>")


def _meeting(classes: DataFrame, groups: int) -> DataFrame:
    """Classes that share a first group and a second group with another class."""
    slots = classes.select("rep", F.posexplode("sig").alias("slot", "h"))
    shared = stage(slots.groupBy("slot", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "minhash-shared")
    halves = slots.join(shared, ["slot", "h"]).groupBy("rep").agg(F.max(F.col("slot") < groups).alias("one"), F.max(F.col("slot") >= groups).alias("two"))
    return classes.join(halves.where("one and two").select("rep"), "rep", "left_semi")


def _longs(kind: tuple[int, int]) -> int:
    return kind[0] * kind[1] // 64


_NARROW = [f"b{k}" for k in range(_longs(NARROW))]
_WIDE = [f"w{k}" for k in range(_longs(WIDE))]


def _tables(classes: DataFrame, groups: int) -> DataFrame:
    """(key, rep) for each class and table."""
    keys = F.expr(f"flatten(transform(slice(sig, 1, {groups}), (x, i) -> transform(slice(sig, {groups + 1}, {groups}), (y, j) -> xxhash64(i, j, x, y))))")
    return classes.select("rep", F.explode(keys).alias("key"))


def _distance(a: str, b: str, letter: str = "b", kind: tuple[int, int] = NARROW) -> F.Column:
    """Ranges in which two sketches differ."""
    words = kind[0] // 64
    total = F.lit(0)
    for k in range(words):
        apart = [F.col(f"{a}{letter}{k + words * p}").bitwiseXOR(F.col(f"{b}{letter}{k + words * p}")) for p in range(kind[1])]
        any_bit = apart[0]
        for x in apart[1:]:
            any_bit = any_bit.bitwiseOR(x)
        total = total + F.bit_count(any_bit)
    return total


def _plausible(a: str, b: str, threshold: int, letter: str = "b", kind: tuple[int, int] = NARROW) -> F.Column:
    """Neither sizes nor sketches rule the similarity out."""
    sizes = 100 * F.least(f"{a}n", f"{b}n") >= threshold * F.greatest(f"{a}n", f"{b}n")
    # Sets with similarity t differ in at most (1 - t) / (1 + t) of the sum of their sizes.
    apart = (F.col(f"{a}n") + F.col(f"{b}n")) * (100 - threshold) / (100 + threshold)
    share = (1 - threshold / 100) * (1 - 0.5 ** kind[1])
    most = kind[0] * share + 7.2 * (kind[0] * share * (1 - share)) ** 0.5
    return sizes & (_distance(a, b, letter, kind) <= F.least(apart, F.lit(most)))


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar.  Many pairs may share x; AQE splits its rows."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.claim("minhash")
        last, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            xs, ys, hits = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, (x, tx, ty) in enumerate(zip(xs, batch.column(2), batch.column(3), strict=True)):
                tx = tx.as_py()
                if last != (x, tx):
                    last, known = (x, tx), shingles(tx, words)
                if similar(known, shingles(ty.as_py(), words), threshold):
                    hits.append(k)
            yield pa.RecordBatch.from_pydict({"x": pa.array([xs[k] for k in hits], pa.int64()), "y": pa.array([ys[k] for k in hits], pa.int64())})

    second = pairs.join(texts.select(F.col("rep").alias("y"), F.col("text").alias("ty")), "y")
    both = second.join(texts.select(F.col("rep").alias("x"), F.col("text").alias("tx")), "x")
    return both.select("x", "y", "tx", "ty").mapInArrow(confirm, "x long, y long")


def _turn(rep: str = "rep", draw: int = 0) -> F.Column:
    """A class's place in a random order of all classes."""
    return F.xxhash64(F.lit(draw), rep)


def _judged(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (rep, c_rep, ...) that are plausible, with the distance ``d`` of their sketches."""
    own = classes.select("rep", F.col("n_shingles").alias("n"), *[F.col("bits")[k].alias(b) for k, b in enumerate(_NARROW)])
    other = own.select(*[F.col(c).alias(f"c_{c}") for c in own.columns])
    both = pairs.join(own, "rep").join(other, "c_rep").where(_plausible("", "c_", threshold))
    return both.select(*pairs.columns, _distance("", "c_").alias("d"))


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (x, y, lo, hi); x is the centre, which many pairs share."""
    return met.groupBy(F.least("rep", "c_rep").alias("lo"), F.greatest("rep", "c_rep").alias("hi")).agg(F.min("c_rep").alias("x")).select("x", F.when(F.col("x") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("y"), "lo", "hi")


def _shared_buckets(tables: DataFrame) -> DataFrame:
    """(key, rep, c_rep) of the buckets with two members or more; c_rep is the first member."""
    firsts = tables.groupBy("key").agg(F.min(F.struct(_turn().alias("turn"), "rep")).alias("c"), F.count("*").alias("size")).where("size > 1")
    return tables.join(stage(firsts.select("key", F.col("c.rep").alias("c_rep")), "minhash-firsts"), "key")


def _first_pairs(buckets: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Every class and the nearest of its buckets' first members."""
    met = _judged(buckets.where("rep <> c_rep").select("rep", "c_rep").distinct(), classes, threshold)
    return _pairs(met.groupBy("rep").agg(F.min(F.struct("d", "c_rep")).alias("best")).select("rep", F.col("best.c_rep").alias("c_rep")))


def _drawn_pairs(open_rows: DataFrame, classes: DataFrame, draw: int, threshold: int) -> DataFrame:
    """One member of each component of a bucket against that of the first; the nearest pair of two components."""
    drawn = open_rows.groupBy("key", "comp").agg(F.min(F.struct(_turn("rep", draw).alias("turn"), "rep")).alias("m"))
    drawn = stage(drawn.select("key", "comp", "m"), "minhash-drawn")
    firsts = drawn.groupBy("key").agg(F.min(F.struct("m.turn", F.col("m.rep").alias("rep"), "comp")).alias("c"))
    met = drawn.join(stage(firsts, "minhash-firsts"), "key").where("comp <> c.comp").select(F.col("m.rep").alias("rep"), F.col("c.rep").alias("c_rep"), F.least("comp", "c.comp").alias("p"), F.greatest("comp", "c.comp").alias("q")).distinct()
    nearest = _judged(met, classes, threshold).groupBy("p", "q").agg(F.min(F.struct("d", "c_rep", "rep")).alias("best"))
    return _pairs(nearest.select("best.c_rep", "best.rep"))


def _all_pairs_left(open_rows: DataFrame, classes: DataFrame, groups: int, threshold: int) -> DataFrame:
    """The plausible pairs across components of the buckets that are still mixed.

    All members outside a bucket's largest component are centres.  A pair that
    meets in several tables is taken in the first: that of its first equal groups.
    """
    sig = [F.col("sig")[k].alias(f"g{k}") for k in range(2 * groups)]
    wide = classes.select("rep", F.col("n_shingles").alias("n"), *sig, *[F.col("bits")[_longs(NARROW) + k].alias(w) for k, w in enumerate(_WIDE)])
    shares = open_rows.groupBy("key", "comp").agg(F.count("*").alias("share"))
    largest = shares.groupBy("key").agg(F.max(F.struct("share", "comp")).alias("top")).select("key", F.col("top.comp").alias("top"))
    rows = stage(open_rows.join(largest, "key").join(wide, "rep"), "minhash-wide")
    centres = rows.where("comp <> top")
    centres = centres.select("key", *[F.col(c).alias(f"c_{c}") for c in centres.columns if c not in ("key", "top")])

    def first_equal(start: int) -> F.Column:
        chain = F.when(F.col(f"g{start}") == F.col(f"c_g{start}"), 0)
        for k in range(1, groups):
            chain = chain.when(F.col(f"g{start + k}") == F.col(f"c_g{start + k}"), k)
        return chain

    i, j = first_equal(0), first_equal(groups)
    value = lambda index, start: F.element_at(F.array(*[F.col(f"g{start + k}") for k in range(groups)]), index + 1)
    first_table = F.col("key") == F.xxhash64(i, j, value(i, 0), value(j, groups))
    once = (F.col("comp") == F.col("top")) | (F.col("rep") > F.col("c_rep"))
    met = rows.join(centres, "key").where((F.col("comp") != F.col("c_comp")) & once & _plausible("", "c_", threshold, "w", WIDE) & first_table)
    return _pairs(met.select("rep", "c_rep"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links between the components."""
    root = lambda name: labels.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
    between = links.join(root("x"), "x", "left").join(root("y"), "y", "left").select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))
    up = connect(between)
    known = labels.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = up.join(labels.select("node"), "node", "left_anti").select("node", "root")
    return stage(known.unionByName(fresh), "minhash-labels")


def _open_rows(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, comp) of the buckets with several components."""
    comps = buckets.select("key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    comps = stage(comps, "minhash-comps")
    mixed = comps.groupBy("key").agg(F.min("comp").alias("one"), F.max("comp").alias("two")).where("one <> two").select("key")
    return stage(comps.join(stage(mixed, "minhash-mixed"), "key"), "minhash-open")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) and kept (it is its own)."""
    sketched = stage(sketch(docs, words, groups, width), "minhash-sketch")
    filled = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    classes = stage(classes, "minhash-classes")
    meeting = stage(_meeting(classes, groups), "minhash-meeting")
    texts = stage(_texts(docs).join(meeting.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").withColumnRenamed("doc_id", "rep"), "minhash-texts")
    buckets = stage(_shared_buckets(_tables(meeting, groups)), "minhash-tables")

    def links_of(pairs: DataFrame) -> DataFrame:
        return stage(_confirmed(pairs.select("x", "y"), texts, words, threshold), "minhash-links")

    tested = stage(_first_pairs(buckets, meeting, threshold), "minhash-pairs")
    labels = connect(links_of(tested))
    open_rows = _open_rows(buckets, labels)
    draw = 0
    while open_rows.limit(1).count():
        draw += 1
        last = draw > MOST_DRAWS
        found = _all_pairs_left(open_rows, meeting, groups, threshold) if last else _drawn_pairs(open_rows, meeting, draw, threshold)
        pairs = stage(found.join(tested, ["lo", "hi"], "left_anti"), "minhash-pairs")
        tested = tested.unionByName(pairs)
        links = links_of(pairs)
        merged = links.count()
        if merged:
            labels = _joined(labels, links)
        if last:
            break
        if merged:
            open_rows = _open_rows(open_rows, labels)
        if merged < DRAW_YIELD * pairs.count():
            draw = MOST_DRAWS  # draws no longer pay: all that is left comes next

    roots = labels.select(F.col("node").alias("rep"), "root")
    heads = classes.select("set_a", "set_b", "rep", "copies").join(roots, "rep", "left").where("copies > 1 or root is not null")
    heads = stage(heads.select("set_a", "set_b", "copies", F.coalesce("root", "rep").alias("component_id")), "minhash-heads")
    rows = sketched.select("doc_id", "n_shingles", "set_a", "set_b")
    out = attach_by_key(rows, heads, ["set_a", "set_b"], "copies", max(1, sketched.count()), F.col("doc_id"))
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    out = out.select("doc_id", "n_shingles", F.coalesce(linked, F.col("doc_id")).alias("component_id"))
    unstage(texts, buckets)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
