"""The corpus pipeline: language ID, quality classifier, MinHash near-duplicates, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; docs has the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm import decontamination, near_duplicates, packing, quality
from prismark.llm.common import apart, materialise, scratch, scratch_of, table, tuned, without
from prismark.llm.queries import TOKENIZER, identified, page_metadata
from prismark.llm.tokenizing import public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What a row is known by in a stage, whatever its doc_id: two hashes of all that it holds, 128 bits.
KEY = ("stage_key_1", "stage_key_2")


def _keyed(docs: DataFrame) -> DataFrame:
    said = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    return docs.withColumns({k: F.xxhash64(F.lit(i), *said) for i, k in enumerate(KEY)})


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs but those that are not kept (decided: KEY, kept); of the others only few are shuffled."""
    gone = materialise(decided.where("not kept").select(*KEY).distinct(), "rejected")
    return without(docs, gone, KEY).drop(*KEY)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in none of the languages, or without any letter."""
    docs = _keyed(docs)
    return _without(docs, identified(tuned(spark), docs, sf_dir, keep=KEY))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the co-trained classifier scores as bad."""
    docs = _keyed(docs)
    return _without(docs, quality.score(docs, table(tuned(spark), sf_dir, "labels"), evidence=page_metadata(table(spark, sf_dir, "pages")), keep=KEY, few_rows=quality.FEW_ROWS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8): that with the smallest doc_id. Rows of one doc_id are a group only if their texts are alike."""
    tuned(spark)
    docs = _keyed(docs)
    found = near_duplicates.near_duplicates(docs, percent=80, by_row=True, keep=KEY)
    # Equal rows have one key: kept once if one of them is.
    decided = found.groupBy(*KEY).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    decided = materialise(decided, "decided")
    again = materialise(decided.where("kept").select(*KEY), "repeated")
    _, maybe = apart(docs, again, KEY)
    once = maybe.join(again, [*KEY], "left_semi").select(*docs.columns).dropDuplicates([*KEY])
    return without(docs, decided, KEY).unionByName(once).drop(*KEY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    docs = _keyed(docs)
    found = decontamination.decontaminate(docs, table(tuned(spark), sf_dir, "benchmark"), keep=KEY)
    return _without(docs, found.withColumn("kept", ~F.col("contaminated")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens at most: one row per piece of a document with its sequence and offset."""
    tuned(spark)
    return packing.pack(docs, public_path(TOKENIZER))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Token ids and a trained classifier are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage writes for itself is removed when its result is written."""
    docs = table(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        label = name.replace(" ", "-")
        kept = scratch(spark, label)
        with scratch_of(spark, label):
            docs = materialise(stage(spark, docs, sf_dir), label, kept)
    return STAGES[-1][1](spark, docs, sf_dir)
