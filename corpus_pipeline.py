"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; all but the
last return the columns of ``documents``.  Between stages the documents are written as Parquet and
read again.

Defined results: a row is known by its ``doc_id`` and its text, so rows with a null or a repeated id are
judged each on their own; equal rows are near duplicates of each other; null and empty texts are one group of near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.llm import decontam, line_dedup, packing, simhash, toxicity
from hearth.llm.common import DOCUMENT_COLUMNS, load, staged, text_hash

#: SQL cannot express the stages (trained models, a tokenizer); tests hold each against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return toxicity.flag(docs, model).where("predicted = 0").select(*DOCUMENT_COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier one go; every document stays."""
    out = line_dedup.line_dedup(docs.select(*DOCUMENT_COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("bigint"))).select(*DOCUMENT_COLUMNS)


def _keyed(rows: DataFrame) -> DataFrame:
    """What tells a row apart, under names of its own: its id (0 for none), whether it has one, its text's hash."""
    return rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).withColumn("__null", F.col("doc_id").isNull())


_KEY = ["__id", "__null", "__hash"]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest id that is not null, then of the smallest text
    hash; of rows equal in both the first by source, language and length."""
    kept = _keyed(simhash.representatives(simhash.near_duplicates(docs))).withColumnRenamed("text_hash", "__hash").select(*_KEY)
    one = Window.partitionBy(*_KEY).orderBy("source", "lang", "n_chars")
    rows = _keyed(docs).withColumn("__hash", text_hash()).join(kept, _KEY, "left_semi")
    return rows.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*DOCUMENT_COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go, each row judged on its own text, with an id or without."""
    gone = _keyed(decontam.contaminated_rows(docs, load(spark, sf_dir, "benchmark"))).withColumnRenamed("text_hash", "__hash").select(*_KEY)
    return _keyed(docs).withColumn("__hash", text_hash()).join(gone, _KEY, "left_anti").select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
