"""The corpus pipeline: documents through five text operators, each stage written and read again.

Stages, in order: toxic documents go; later copies of line runs are deleted, and documents that this empties go; one
document of each near-duplicate group stays; documents that hold a benchmark item go; the texts are encoded into
sampled pieces, and decoded to prove it. All but the last return the columns of documents.

Edge cases of every stage: columns of any name are carried as they are, beside ``doc_id`` and ``text``, which must be
there (``n_chars`` is kept up to date where it is); null and empty texts stay, except repeated rows as the operators
state; null ids stay; an empty table gives an empty one. What each operator does with ties and repeated rows stands in
its own module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import fresh_name, stage_table, table
from ferrule.llm.decontaminate import drop_contaminated
from ferrule.llm.line_dedup import drop_repeated_lines
from ferrule.llm.near_dup import drop_near_duplicates
from ferrule.llm.pieces import round_trip
from ferrule.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = fresh_name("n_deleted", docs.columns)
    kept = drop_repeated_lines(docs, counted=gone)
    emptied = (F.col(gone) > 0) & (F.col("text") == "")
    kept = kept.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col(gone) > 0, length).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece_ids, n_pieces and lossless; columns of these names in ``docs`` get an underscore."""
    outputs = ("piece_ids", "n_pieces", "lossless")
    taken = [*docs.columns, *outputs]
    renamed = {c: fresh_name(f"{c}_", taken) for c in docs.columns if c.lower() in outputs}
    docs = docs.withColumnsRenamed(renamed)
    decoded = fresh_name("decoded", docs.columns)
    both = round_trip(docs, names=("piece_ids", decoded))
    return both.select(
        *docs.columns,
        "piece_ids",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        (F.col(decoded) == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: Toxicity and piece sampling are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage_table(docs, name)
    return docs
