"""Corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; its result is written as Parquet and read again as the next one's input.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiccases.llm import decontaminate, jaccard_join, language_id, packing, suffix_dedup
from civiccases.llm.common import saved, table
from civiccases.session import ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"
#: words of a passage that counts as repeated
PASSAGE_WORDS = 50


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty and letterless texts, and margins about chance.

    Chance follows from the languages learned; with less than two of them only
    texts without a letter are dropped.
    """
    ensure_checkpoint_dir(spark)
    model = language_id.fit(language_id.training_rows(docs))
    flagged = docs.withColumns({"_row": F.struct(*docs.columns)}).select("_row", "text")
    judged = language_id.identify(flagged, model, ["_row"])
    return judged.where("clear").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of the n-gram Jaccard join.

    Documents without shingles or without doc_id are components of their own;
    rows that repeat a kept doc_id with the same text become one.
    """
    ensure_checkpoint_dir(spark)
    grouped = saved(jaccard_join.linked_documents(docs).where("doc_id != component_id")
                    .select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    left = docs.join(grouped, docs["doc_id"] == grouped["_gone"], "left_anti")
    repeated = saved(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).count()
                     .where("count > 1").select("_twice"), "repeated")
    again = left["doc_id"] == repeated["_twice"]
    return (left.join(repeated, again, "left_anti")
            .unionByName(left.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"])))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that occur earlier in the corpus; the first copy stays.

    ``n_chars`` follows the text.  A document of which nothing but white space
    is left goes; one that loses nothing stays as it is.
    """
    ensure_checkpoint_dir(spark)
    lost = saved(suffix_dedup.passage_removals(docs, PASSAGE_WORDS), "removals")
    marked = suffix_dedup.with_identity(docs)
    kept = marked.join(lost, ["id", "key"], "left")
    changed = F.col("kept_text").isNotNull()
    return (kept.where(~changed | (F.trim(F.regexp_replace("kept_text", r"\s+", " ")) != ""))
            .withColumns({"text": F.coalesce("kept_text", "text"),
                          "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars"))})
            .select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    ensure_checkpoint_dir(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in the training sequences."""
    ensure_checkpoint_dir(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontaminated", decontaminated), ("packed", packed)]

#: no SQL: tokenizer, classifier and suffix arrays; tests/llm/test_pipeline_by_hand.py compares run() with plain stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
