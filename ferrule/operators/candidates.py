"""Function start candidates: merging evidence, scores, ranks, alignment and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLAGS = ("is_symbol", "is_exception", "is_stub", "is_language")

#: Fixed values of the score, by kind of evidence.
SCORE_SYMBOL, SCORE_EXCEPTION, SCORE_STUB, SCORE_LANGUAGE, SCORE_ALIGNED = 10_000, 5_000, 1_000, 100, 1

#: Fixed confidences: upper bounds of tf-idf (exclusive), then by no prologue, prologue, initial without and with one.
CONFIDENCE = (
    (-8, 0.691, 0.989, 0.845, 0.994),
    (-4, 0.666, 0.964, 0.833, 0.982),
    (-2, 0.546, 0.844, 0.773, 0.922),
    (-1, 0.422, 0.72, 0.711, 0.86),
    (0, 0.321, 0.619, 0.66, 0.809),
    (None, 0.0, 0.298, 0.5, 0.649),
)


def merge_candidates(evidence: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per address from tables of evidence: flags by or, ``refs`` by sum. Tables may lack columns."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), evidence)
    every = reduce(lambda d, f: d if f in d.columns else d.withColumn(f, F.lit(None).cast("boolean")), FLAGS, every)
    every = every if "refs" in every.columns else every.withColumn("refs", F.lit(0))
    return every.groupBy(*keys).agg(
        *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in FLAGS], F.coalesce(F.sum("refs"), F.lit(0)).alias("refs")
    )


def alignment(address: Column) -> Column:
    return F.when(address % 16 == 0, 16).when(address % 4 == 0, 4).otherwise(0)


def call_score(refs: Column) -> Column:
    """Ten a reference; from ten references on the count starts at ten and grows by one in ten."""
    return (10 * F.when(refs < 10, refs).otherwise(10 + F.floor(refs / 10))).cast("long")


def score(refs: Column, aligned: Column, start_score: Column, flags: dict[str, Column]) -> Column:
    weights = {"is_symbol": SCORE_SYMBOL, "is_exception": SCORE_EXCEPTION, "is_stub": SCORE_STUB, "is_language": SCORE_LANGUAGE}
    parts = [F.when(flag, weights[name]).otherwise(0) for name, flag in flags.items()]
    return (sum(parts, F.lit(0)) + start_score + call_score(refs) + F.when(aligned > 0, SCORE_ALIGNED).otherwise(0)).cast("long")


def rank(candidates: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """``place`` of each candidate of a binary, from 1."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def bracket(refs: Column) -> Column:
    return F.least(F.lit(2), refs)


def identified_alignment(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Alignment that at most 5 % of the candidates with several references break, if there are over 20 of those."""
    several = candidates.where("refs > 1")
    n = F.count("*")
    off4, off16 = F.count_if(F.col("addr") % 4 != 0), F.count_if(F.col("addr") % 16 != 0)
    found = F.when(n <= 20, 0).when(off16 * 20 <= n, 16).when(off4 * 20 <= n, 4).otherwise(0)
    return several.groupBy(*keys).agg(found.cast("int").alias("alignment"), n.alias("n_candidates"))


def confidence(tfidf: Column, prologue: Column, initial: Column, refs: Column) -> Column:
    """From a table of fixed values: rounding them anew would differ in the last digit."""
    out = None
    for bound, plain, with_prologue, first, both in CONFIDENCE:
        value = F.when(initial & prologue, both).when(initial, first).when(prologue, with_prologue).otherwise(plain)
        if bound is None:
            out = out.otherwise(value)
        else:
            out = F.when(tfidf < bound, value) if out is None else out.when(tfidf < bound, value)
    return F.when(refs > 1, 1.0).otherwise(out)


def characteristics(flags: list[tuple[str, Column]]) -> Column:
    """A letter per flag that is set, a dash per one that is not."""
    return F.concat(*[F.when(F.coalesce(flag, F.lit(False)), letter).otherwise("-") for letter, flag in flags])


def cap_references(refs: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` references of each candidate: the cap is the semantics of the operator."""
    return rank(refs, keys, [F.col(c) for c in order]).where(F.col("place") <= cap)


def dequeued(ranked: DataFrame, aligned: int = 0, language_only: bool = False) -> DataFrame:
    """The ranked candidates that are worked on: not finished, with a score, aligned enough, of a language if only such count."""
    kept = ranked.where("NOT finished AND score <> 0")
    kept = kept.where(F.col("is_language")) if language_only else kept
    return kept.where(F.col("aligned") >= aligned) if aligned else kept


def at_least(functions: DataFrame, least: float) -> DataFrame:
    """Functions of enough confidence."""
    return functions.where(F.col("confidence") >= least)
