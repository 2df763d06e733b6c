"""Quality classifier: importance resampling with hashed n-gram generative models.

Target text is what the labels call good (quality 1, not toxic); raw text is the
corpus.  Both models count hashed unigrams and bigrams, each as often as it occurs.
A third part counts the distinct tokens once a document, for rejection only.  The
log-ratio of a gram is smoothed towards "as frequent as expected", so that a rare
gram says little.

A document's importance is what its text has against it: the log-ratios of its grams
that fall below a cut are summed to an evidence, that of its distinct tokens and that
of its bigrams, and the importance is what the two lack to a threshold each; ratios
above the cut count as zero, so that length and subject weigh nothing.  Cuts and
thresholds are those with the least cost on labelled documents that the target model
has not seen; those of the bigrams are fitted on what the tokens accept.  Among the
distinct tokens is an echo mark of texts in which many tokens repeat the one before:
the bigrams of such texts differ by their word, so the bigrams of one text say little
about the next.  All are fitted on at most ``LABELLED_ROWS`` rows, taken in the order
of a hash of their doc_id; the raw model and the scores cover all documents.

Documents are resampled without replacement by a Gumbel top-k: the key of a document
is ``SHARPNESS`` times its importance and a Gumbel draw of its doc_id, and the k
largest keys are accepted.  As many are as lack nothing to a threshold, or the share
that is asked for.

Cases: a null or empty text has no grams and importance 0; a doc_id that has several
labels counts by the worst; without labels every ratio is 0 and all documents are
accepted; repeated rows are scored alike (they share a Gumbel draw, and ties at the
k-th key are all accepted); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import memory
from .common import shuffle_partitions, stage, table

BITS = 20
SLICES = 256
#: Parts of the count arrays, of 2 ** BITS entries each; the last two are the n-gram models.
DISTINCT, UNIGRAMS, BIGRAMS = range(3)
PARTS = 3
#: The parts whose evidence can reject a document.
JUDGES = (DISTINCT, BIGRAMS)
LABELLED_ROWS = 50_000
CUTS = (-0.7, -1.0, -1.5, -2.0, -2.5, -3.0)
#: A clean document that is lost costs as much as this many bad ones that stay.
CLEAN_COST = 2.0
SEED = 7
#: How many units of a Gumbel draw a unit of importance is worth.
SHARPNESS = 32.0

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MEMO_WORDS = 300_000
_WORDS: dict[str, int] = {}
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Grams that are held before they are added to the counts.
_HELD = 1 << 20
memory.register("quality", _WORDS.clear)


def grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed grams of a text: distinct tokens with the echo mark, tokens and bigrams as often as they occur.  Each part has entries of its own."""
    import xxhash

    tokens = _TOKEN.findall(text.lower())
    if len(_WORDS) > _MEMO_WORDS:
        _WORDS.clear()
    for w in set(tokens).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    codes = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = (hashes[:-1] * _MIX[0] + hashes[1:]) * _MIX[1]
    pairs = (pairs ^ pairs >> np.uint64(32)) * _MIX[0]
    found = np.unique(codes)
    if len(codes) >= 10:
        echo = np.count_nonzero(codes[1:] == codes[:-1]) / len(codes)
        if echo >= 0.2:
            found = np.append(found, xxhash.xxh3_64_intdigest(f"<echo {min(2, int(echo * 5))}>") >> (64 - BITS))
    return found, codes + (UNIGRAMS << BITS), (pairs >> np.uint64(64 - BITS)).astype(np.int64) + (BIGRAMS << BITS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _counts(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often the corpus, and how often the target, has each gram.  Two arrays of PARTS * 2 ** BITS entries."""
    size = PARTS << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.claim("quality")
        totals = np.zeros((2, size), np.uint32)
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        n = 0

        def flush() -> None:
            for total, found in zip(totals, held, strict=True):
                if found:
                    np.add(total, np.bincount(np.concatenate(found), minlength=size), out=total, casting="unsafe")
                found.clear()

        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = grams(text.as_py())
                held[0].extend(found)
                if target:
                    held[1].extend(found)
                n += sum(map(len, found))
                if n >= _HELD:
                    flush()
                    n = 0
        flush()
        cut = totals.reshape(2, SLICES, -1)
        used = [s for s in range(SLICES) if cut[0, s].any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(used, pa.int32()), "counts": pa.array([cut[:, s].tobytes() for s in used], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(blob.as_py(), np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    parts = marked.mapInArrow(count, "slice int, counts binary")
    summed = parts.repartition(min(SLICES, shuffle_partitions(marked.sparkSession)), "slice").mapInArrow(add, "slice int, counts binary")
    out = np.zeros((2, SLICES, size // SLICES), np.uint64)
    for row in summed.collect():
        out[:, row["slice"]] = np.frombuffer(row["counts"], np.uint64).reshape(2, -1)
    raw, target = out.reshape(2, size).astype(np.float64)
    return raw, target


def _ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.any():
        return np.zeros(len(raw), np.float32)
    raw, target = raw.reshape(PARTS, -1), target.reshape(PARTS, -1)
    expected = raw * (target.sum(1, keepdims=True) / np.maximum(1.0, raw.sum(1, keepdims=True)))
    return (np.log(target + 1) - np.log(expected + 1)).astype(np.float32).ravel()


def _evidence(known: np.ndarray, found: tuple[np.ndarray, ...], cuts: tuple[tuple[int, float], ...]) -> list[float]:
    """For each (part, cut) the sum of the part's log-ratios under the cut."""
    w = {part: known[found[part]].astype(np.float64) for part, _ in cuts}
    return [float(w[part][w[part] < cut].sum()) for part, cut in cuts]


def _scored(rows: DataFrame, ratios: np.ndarray, cuts: tuple[tuple[int, float], ...], keep: str) -> DataFrame:
    """The column ``keep``, the number of unigrams and bigrams, the weight, and the evidence of each (part, cut)."""
    known = rows.sparkSession.sparkContext.broadcast(ratios)
    kind = rows.schema[keep].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.claim("quality")
        for batch in batches:
            n, weight, evidence = [], [], []
            for text in batch.column(1):
                found = grams(text.as_py())
                n.append(len(found[UNIGRAMS]) + len(found[BIGRAMS]))
                weight.append(float(sum(known.value[found[part]].sum(dtype=np.float64) for part in (UNIGRAMS, BIGRAMS))))
                evidence.append(_evidence(known.value, found, cuts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array(evidence, pa.list_(pa.float64()))], names=[keep, "n_grams", "log_weight", "evidence"])

    return rows.select(keep, "text").mapInArrow(score, f"{keep} {kind}, n_grams long, log_weight double, evidence array<double>")


def _threshold(evidence: np.ndarray, good: np.ndarray) -> tuple[int, float]:
    """The cut and threshold with the least cost; of thresholds as good, the middle of the widest gap."""
    best = (np.inf, 0, -np.inf)
    for c in range(evidence.shape[1]):
        values = np.unique(evidence[:, c])
        middles = np.append((values[1:] + values[:-1]) / 2, -np.inf)
        clean, bad = np.sort(evidence[good, c]), np.sort(evidence[~good, c])
        cost = CLEAN_COST * np.searchsorted(clean, middles) + (len(bad) - np.searchsorted(bad, middles))
        at = int(np.argmin(cost))
        if cost[at] < best[0]:
            best = (float(cost[at]), c, float(middles[at]))
    return best[1], best[2]


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by histograms of 4096 bins that close in on it."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or n == 0:
        return float("inf")
    if k >= n:
        return float("-inf")
    above, inside = 0, df.select(column)
    while n > 20_000 and low < high:
        width = (high - low) / 4096
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(4095).cast("long"))
        bins = inside.where(F.col(column).between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for row in sorted(bins, key=lambda r: -r["b"]):
            if above + row["n"] >= k:
                low, high, n = row["lo"], row["hi"], row["n"]
                break
            above += row["n"]
    values = inside.where(F.col(column).between(low, high)).orderBy(F.desc(column)).limit(k - above)
    return float(values.agg(F.min(column)).first()[0])


@dataclass
class Classifier:
    """Log-ratios of the grams, and for each of JUDGES the (part, cut) and threshold of its evidence."""

    ratios: np.ndarray
    cuts: tuple[tuple[int, float], ...]
    thresholds: tuple[float, ...]

    def importance(self, evidence: list[float]) -> float:
        """0, or what the evidences lack to their thresholds."""
        return sum(min(0.0, e - t) for e, t in zip(evidence, self.thresholds, strict=True) if e < t)


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Classifier:
    texts = _texts(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).dropna()
    known = known.groupBy("doc_id").agg(F.min("good").alias("good"))
    # At most labelled_rows rows; a quarter of them is held out for the threshold.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows).withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4)) == 0)
    sample = F.broadcast(stage(sample, "quality-labels"))
    marked = texts.join(sample, "doc_id", "left")
    raw, target = _counts(marked.select("text", (F.col("good") & ~F.col("held_out")).alias("target")))
    ratios = _ratios(raw, target)
    tried = tuple((part, cut) for part in JUDGES for cut in CUTS)
    held = _scored(texts.join(sample.where("held_out"), "doc_id").select("good", "text"), ratios, tried, "good").select("good", "evidence").collect()
    evidence = np.array([r["evidence"] for r in held], np.float64).reshape(-1, len(JUDGES), len(CUTS))
    good = np.array([r["good"] for r in held], bool)
    cuts, thresholds = [], []
    for k, part in enumerate(JUDGES):
        at, threshold = _threshold(evidence[:, k], good) if len(good) else (0, float("-inf"))
        cuts.append((part, CUTS[at]))
        thresholds.append(threshold)
        accepted = evidence[:, k, at] >= threshold
        evidence, good = evidence[accepted], good[accepted]
    return Classifier(ratios, tuple(cuts), tuple(thresholds))


def gumbel_key(importance: F.Column, doc_id: F.Column) -> F.Column:
    uniform = (F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.lit(SHARPNESS) * importance - F.log(-F.log(uniform))


def _last_key(keyed: DataFrame, importance: str, key: str, share: float | None) -> float:
    """The least key that is accepted."""
    k = keyed.where(F.col(importance) == 0).count() if share is None else round(share * keyed.count())
    return kth_largest(keyed, key, k)


def keep_accepted(docs: DataFrame, model: Classifier, share: float | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the resampling accepts."""
    known = docs.sparkSession.sparkContext.broadcast(model.ratios)
    at, judge = docs.columns.index("text"), Classifier(np.zeros(0, np.float32), model.cuts, model.thresholds)
    importance, key = "_importance", "_gumbel_key"
    while {importance, key} & set(docs.columns):
        importance, key = importance + "_", key + "_"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.claim("quality")
        for batch in batches:
            weights = [judge.importance(_evidence(known.value, grams(t.as_py() or ""), judge.cuts)) for t in batch.column(at)]
            yield batch.append_column(importance, pa.array(weights, pa.float64()))

    weighed = docs.mapInArrow(weigh, T.StructType([*docs.schema.fields, T.StructField(importance, T.DoubleType())]))
    keyed = stage(weighed.withColumn(key, gumbel_key(F.col(importance), F.col("doc_id").cast("long"))), "quality-keys")
    return keyed.where(F.col(key) >= F.lit(_last_key(keyed, importance, key, share))).select(docs.columns)


def classify(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, share: float | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight (of all unigrams and bigrams), evidence, bigram_evidence, importance, gumbel_key and accepted."""
    model = fit(docs, labels, labelled_rows)
    scores = _scored(_texts(docs), model.ratios, model.cuts, "doc_id")
    lacks = [F.least(F.col("evidence")[k] - F.lit(t), F.lit(0.0)) for k, t in enumerate(model.thresholds)]
    scores = scores.select("doc_id", "n_grams", "log_weight", F.col("evidence")[0].alias("evidence"), F.col("evidence")[1].alias("bigram_evidence"), sum(lacks[1:], lacks[0]).alias("importance"))
    scores = stage(scores.withColumn("gumbel_key", gumbel_key(F.col("importance"), F.col("doc_id"))), "quality-scores")
    return scores.withColumn("accepted", F.col("gumbel_key") >= F.lit(_last_key(scores, "importance", "gumbel_key", share)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
