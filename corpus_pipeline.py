"""A corpus pipeline of five stages: toxicity, quality rules, near duplicates, mixing, packing.

Every stage takes all documents that the one before kept, and writes what it
keeps to the shared folder.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import jaccard, mixing, packing, quality_rules, queries, toxicity
from emberframe.llm.common import read_table, stash


#: Rows that go to Python in one batch.  They are whole texts, so short batches keep the workers' memory low.
ROWS_PER_BATCH = 1024


def _short_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from ``labels`` without the held-out third."""
    _short_batches(spark)
    model = toxicity.train(docs, queries.learnable(read_table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity of 0.8 or more."""
    _short_batches(spark)
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and as often as its rate says: languages that are short of their share repeat."""
    _short_batches(spark)
    model = queries.mix_model(spark, docs, sf_dir)
    members = stash(mixing.membership(docs, model), "members")
    _, steps = mixing.fit_rates(members, model.domains, queries.MIX)
    return mixing.mixed(docs, model, steps, least=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    packed = packing.pack_documents(docs, queries.tokenizer_file("byte_bpe_50k.json"), queries.CAPACITY)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages train models and run local searches; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
