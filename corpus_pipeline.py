"""From raw documents to packed training sequences: five stages, each a written table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import bag_minhash, language, line_dedup, mixing, packing
from surveyloom.llm.common import table, written
from surveyloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# A text whose best language holds for a third of its words or less is no text in any.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents in no language go (no letters, or no language holds for enough words).

    The model learns from a bounded sample of the labelled rows; ``lang`` becomes
    what it finds. Null texts go.
    """
    found = language.identify(docs.select(*COLUMNS), language.train(docs))
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: repeated lines go; so do documents that lose all their lines."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    return out.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each class of near copies the document with the smallest id stays, one row of it.

    Rows without an id, and rows of an id with several texts, go by a number of id
    and text above all other ids: equal ones are one document.
    """
    text = F.xxhash64(F.col("text").isNull(), "text")
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.min(text) != F.max(text)).alias("_several"))
    again = again.where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("_twice"), "_several")
    keyed = docs.select(*COLUMNS).join(again, docs["doc_id"] == F.col("_twice"), "left")
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), text), 3)
    keyed = keyed.withColumn("_key", F.when(F.coalesce("_several", F.col("doc_id").isNull()), own).otherwise(F.col("doc_id")))
    kept = bag_minhash.near_classes(keyed, id_col="_key").where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    stay = keyed.join(kept, F.col("_key") == F.col("_kept"), "left_semi")
    once = F.col("doc_id").isNotNull() & F.col("_twice").isNull()
    return stay.where(once).unionByName(stay.where(~once).dropDuplicates(["_key"])).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every document as often as the mix takes it, from not at all to twice; each source's words meet its target."""
    return mixing.repeated(docs.select(*COLUMNS), mixing.mix(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of sequences with their ids and the columns of the packing query."""
    pieces = packing.pack(docs, tokenizer_path())
    return packing.digest(pieces, "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", one_of_near_copies),
    ("source_mixing", mixed_sources),
    ("packing", packed_sequences),
]

# The trained language model, signatures and the tokenizer have no SQL form; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
