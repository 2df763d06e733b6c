"""A training corpus from ``documents``: filter, drop near copies, cut repeated passages, pack.

Every stage works on what the one before it kept and is written and read again
between stages.  All but the last return the columns of ``documents``, extra ones
included, with their types.

Cases: null and empty texts pass the filter unless the classifier's draw says
otherwise, are near copies of nothing, stay empty and are packed as an end id alone
(a null text is empty after ``passages``); a null doc_id is never a near copy of
another document and counts as smaller than the others when passages are cut; of rows
with equal doc_id (or none) and equal text one stays; an empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import stage, table
from ledgerline.llm.minhash import near_duplicates
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.quality import fit, keep_accepted
from ledgerline.llm.suffix_dedup import remove_repeats

#: Repeats of this many bytes are cut.  Passages of more than 50 words are longer, unless their words have
#: hardly two letters on average; shorter repeats occur by chance.
PASSAGE_BYTES = 160
PASSAGE_GRAM = 32


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier's resampling does not accept go."""
    return keep_accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id.

    Rows that repeat a doc_id are one document: all its texts stay or go, equal ones
    once.  Of rows without a doc_id those with equal texts stay once.
    """
    kept = near_duplicates(docs, words=5).where("kept").select("doc_id")
    known = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return known.unionByName(docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"]))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a character that is cut through goes whole."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = remove_repeats(docs, PASSAGE_BYTES, PASSAGE_GRAM, carry=others, as_text=True)
    kept = F.decode("kept", "UTF-8")
    known = {c: F.col(f"carry_{k}") for k, c in enumerate(others)}
    known |= {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": kept, "n_chars": F.char_length(kept).cast("long")}
    return cut.select(*[known[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("packing", packing)]

#: The stages are not SQL-expressible; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
