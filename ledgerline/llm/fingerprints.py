"""Canonical exact document fingerprints, in DataFrame functions only.

A text is brought to NFKC, case-folded, brought to NFKC again where folding
left the ASCII range, and its runs of white space become one space.  Two chained
xxhash64 values of that form make a 128-bit fingerprint.  Documents with equal
fingerprints are then compared byte by byte with the one of smallest doc_id; a
text that differs (a collision) gets its SHA-256 appended, so in the result
fingerprints are equal exactly where canonical texts are.

Cases: a null text counts as empty; equal doc_ids are ordered by the hash of their
text, then by their text; a null doc_id sorts before the others; a single document is its own successor; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, stage, table

#: Documents that one range of doc_ids should get, and the most ranges.
RANGE_ROWS = 4096
MOST_RANGES = 16384
NO_ID = -(1 << 63)


def _nfkc(text: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def canonical(text: Column) -> Column:
    """Unicode form, case and white space folded; ASCII texts skip the Unicode steps."""
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(text), F.lit(True))
    full = F.when(_ascii(text), F.lower(text)).otherwise(_nfkc(folded))
    return F.trim(F.regexp_replace(full, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    halves = [F.xxhash64(canon), F.xxhash64(F.lit("second half"), canon)]
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def _below(bounds: list[int], value: Column, strictly: bool) -> Column:
    """How many of the ascending bounds are less than (or equal to) a value, by halving."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    known = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<long>")

    def step(found: Column, size: Column) -> Column:
        bound = F.get(known, found + size - 1)
        return found + F.when(bound < value if strictly else bound <= value, size).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) if steps else F.lit(0)


def with_successor(docs: DataFrame) -> DataFrame:
    """Add next_text, the text of the next document by doc_id (after the last: the first).

    doc_ids are cut into ranges of similar numbers of rows at approximate quantiles,
    wherever the ids lie.  A doc_id that holds several quantiles, and rows without
    one, are divided by the hash of their text, which is the order among equal ids.
    Every range also gets a copy of the row that opens the next range, so one window a
    range is enough.
    """
    n, n_null = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    shares = [k / parts for k in range(1, parts)]
    bounds = list(docs.agg(F.percentile_approx("doc_id", shares, max(1000, min(200_000, 20 * parts)))).first()[0] or []) if shares else []
    null_parts = max(1, min(MOST_RANGES, -(-n_null // RANGE_ROWS)))

    rows = docs.withColumn("_hash", F.xxhash64("text"))
    spread = F.col("_hash") / F.lit(2.0**64) + F.lit(0.5)
    rows = rows.withColumns({"_low": _below(bounds, F.col("doc_id"), True), "_high": _below(bounds, F.col("doc_id"), False)})
    among = lambda size: F.least(F.floor(spread * size), size - 1).cast("int")
    own = F.col("_low") + among(F.col("_high") - F.col("_low") + 1)
    rows = rows.withColumn("_bucket", F.when(F.col("doc_id").isNull(), among(F.lit(null_parts)) - F.lit(null_parts)).otherwise(own)).drop("_low", "_high")

    # A row a range, of which there are at most 2 * MOST_RANGES.
    opens = rows.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_hash")).alias("_opens"))
    order = Window.orderBy("_bucket")
    opens = opens.select("_bucket", "_opens", F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(Window.partitionBy())).alias("_before"))
    rows = rows.join(F.broadcast(opens), "_bucket")
    is_open = F.struct("doc_id", "_hash").eqNullSafe(F.col("_opens"))
    places = F.array_compact(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("copy")), F.when(is_open, F.struct(F.col("_before").alias("b"), F.lit(1).alias("copy")))))
    rows = rows.select("doc_id", "_hash", "text", F.explode(places).alias("_at"))
    follow = Window.partitionBy("_at.b").orderBy("_at.copy", "doc_id", "_hash", "text")
    return rows.select("doc_id", "text", "_at", F.lead("text").over(follow).alias("next_text")).where("_at.copy = 0").drop("_at")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text, canon and fingerprint, without the byte comparison."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return out.withColumn("canon", canonical(F.col("text"))).withColumn("fingerprint", digest(F.col("canon")))


def collisions(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(fingerprint, canon_sha256) of texts whose bytes differ from those of their group's first document.

    ``prints`` has doc_id and fingerprint.  Only groups of two or more are compared.
    """
    known = lambda df: df.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    groups = known(prints).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")
    groups = stage(groups, "fingerprint-groups")
    # A group that holds HEAVY_SHARE of the rows is compared in parts; there are at most 1 / HEAVY_SHARE such groups.
    least = max(1000, int(prints.count() * HEAVY_SHARE))
    parts = F.ceil(F.col("copies") / F.lit(least)).cast("int")
    heavy = groups.where(F.col("copies") >= least).select("fingerprint", parts.alias("parts"))
    texts = known(fingerprint(docs)).select("doc_id", "fingerprint", "canon")
    firsts = texts.join(groups.drop("copies"), ["fingerprint", "doc_id"]).groupBy("fingerprint").agg(F.min("canon").alias("first_canon"))
    firsts = stage(firsts, "fingerprint-texts")
    each = firsts.join(F.broadcast(heavy), "fingerprint", "left").select("fingerprint", "first_canon", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    dealt = texts.join(F.broadcast(heavy), "fingerprint", "left").select("fingerprint", "canon", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts"))).otherwise(0).cast("int").alias("part"))
    differ = dealt.join(each, ["fingerprint", "part"]).where(F.col("canon") != F.col("first_canon"))
    return differ.select("fingerprint", F.sha2("canon", 256).alias("canon_sha256")).distinct()


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness (1 where equal, else 0)."""
    rows = with_successor(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")))
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_cut", F.floor(n / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - F.col("_cut")), F.substring(F.col("next_text"), F.lit(1), F.col("_cut"))))
    rows = rows.withColumn("canon", canonical(F.col("text"))).withColumn("edited_canon", canonical(F.col("edited"))).withColumn("next_canon", canonical(F.col("next_text")))
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    prints = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("canon")).alias("fingerprint"),
        digest(F.col("edited_canon")).alias("edited_fingerprint"),
        same("canon", "edited_canon").alias("near_edited"),
        same("canon", "next_canon").alias("near_next"),
        F.sha2("canon", 256).alias("_own"),
        F.sha2("edited_canon", 256).alias("_edited"),
    )
    prints = stage(prints, "fingerprints")
    odd = stage(collisions(docs, prints.select("doc_id", "fingerprint")), "fingerprint-collisions")
    for name, own in (("fingerprint", "_own"), ("edited_fingerprint", "_edited")):
        mark = odd.select(F.col("fingerprint").alias(name), F.col("canon_sha256").alias(own), F.lit(True).alias("_odd"))
        prints = prints.join(mark, [name, own], "left").withColumn(name, F.when(F.col("_odd"), F.concat_ws("-", name, own)).otherwise(F.col(name))).drop("_odd")
    return prints.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
