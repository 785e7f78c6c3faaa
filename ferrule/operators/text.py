"""Strings in images, term statistics and language scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def printable_strings(text: Column, least: int = 6, most: int = 128) -> Column:
    """Runs of printable ASCII of the given lengths."""
    return F.regexp_extract_all(text, F.lit(f"[ -~]{{{least},{most}}}"), F.lit(0))


def image_text(image: Column) -> Column:
    """Bytes as characters of the same number, for patterns over binaries."""
    return F.decode(image, "ISO-8859-1")


def term_counts(rows: DataFrame, doc: str, terms: Column) -> DataFrame:
    return rows.select(doc, F.explode(terms).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, doc: str, n_docs: Column, df: DataFrame) -> DataFrame:
    """Sum over terms of tf * ln((n - df) / df), n being one more than the documents so that no logarithm fails.

    ``df``: term and df; documents without terms have 0.
    """
    weight = F.ln((n_docs - F.col("df")) / F.col("df"))
    return counts.join(df, "term").groupBy(doc).agg(F.sum(F.col("tf") * weight).alias("tfidf"))


def language_score(evidence: dict[str, Column]) -> Column:
    """The language with the highest score; on ties the later one in the dictionary."""
    best = F.array_max(F.array(*[F.struct(score.alias("s"), F.lit(i).alias("i")) for i, score in enumerate(evidence.values())]))
    return F.element_at(F.array(*map(F.lit, evidence)), best["i"] + 1)


#: Fixed aliases of language names.
LANGUAGE_ALIASES = {"cil": ".net", "delphi_kb_file": "delphi"}


def canonical_language(name: Column) -> Column:
    low = F.lower(F.trim(name))
    out = low
    for alias, plain in LANGUAGE_ALIASES.items():
        out = F.when(low == alias, plain).otherwise(out)
    return out
