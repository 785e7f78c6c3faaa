"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models, toxic and ordinary, give P(word | word before). Their counts are continuation counts over
labelled rows: a pair counts its distinct words before it, a word its distinct two-word histories, so copies and lines
that many texts share count once. The larger class's counts are scaled to the smaller one's. A count is discounted
absolutely, by ``discount`` and by what both classes together let expect (with a share of ``MARGIN`` on top): a model
keeps only what is its own. The discounted mass of a pair goes to the word's model, that of a word to one backoff both
models share: in how many texts of the whole table a word occurs, whatever their label, itself discounted and evened out
over all words. Rare expressions thus get nearly equal odds from both models, and a language or a source that is
commoner in one class tells nothing.

A text's score compares its two log-likelihoods per word, on a scale fitted to labelled rows that the counts left out;
the discount is the one of ``DISCOUNTS`` with the least balanced error there.

The classifier is fitted on a bounded sample: the ``SAMPLE_ROWS`` labelled rows that come first by a seeded hash of
their id. Kept words and pairs exceed the discount, so they are fewer than (words of the sample) / discount and are sent
to the tasks. The backoff's counts and the scoring read every row and every whole text.

Edge cases: null and empty texts have no words and score 0; a null id or label is no training row; of several rows or
labels of one id the smallest text and the highest label train; without rows of both classes every score is 0; repeated
rows are scored each; an empty table gives an empty result; columns named score or predicted give way to the outputs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import bounded_batches, fresh_name, stage_table, table

#: Bound of the training sample; every fourth of its rows sets scale and discount instead of being counted.
SAMPLE_ROWS = 12_000
SCALE_PART = 4
#: Discounts to choose from, in contexts of the smaller class, and the margin over the expected count.
DISCOUNTS = (1.0, 2.0, 4.0, 8.0)
MARGIN = 0.2
SHARED_DISCOUNT = 0.75
WORD = re.compile(r"[^\W_]+")
START = "<s>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def words_in(text: Column) -> Column:
    """The same words, in the JVM."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def kept(own: float, other: float, discount: float) -> float:
    """What a model keeps of its count beside the other class's scaled one."""
    return max(own - (own + other) / 2 * (1 + MARGIN) - discount, 0.0)


class Model:
    """Evidence, as log ratios beyond ``base``: of words, of histories, and of pairs beyond those two."""

    def __init__(self, base: float, word: dict[str, float], history: dict[str, float], pair: dict[tuple[str, str], float]):
        self.base, self.word, self.history, self.pair = base, word, history, pair
        self.threshold, self.width = 0.0, 1.0

    def log_ratio(self, text: str | None) -> float | None:
        """log P(text | toxic) - log P(text | ordinary) per word; None without words."""
        words = words_of(text)
        if not words:
            return None
        found = sum([self.word[w] for w in words if w in self.word])
        for at in [i for i, h in enumerate(words[:-1], 1) if h in self.history]:
            found += self.history[words[at - 1]] + self.pair.get((words[at - 1], words[at]), 0.0)
        return self.base + found / len(words)

    def score(self, text: str | None) -> float:
        ratio = self.log_ratio(text)
        return 0.0 if ratio is None else 1 / (1 + math.exp(-max(-60.0, min(60.0, (ratio - self.threshold) / self.width))))


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample: doc_id, text, toxic and whether the row sets the scale."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    order = F.xxhash64(F.lit(17), "doc_id")
    sample = known.orderBy(order, "doc_id").limit(SAMPLE_ROWS)
    # at most SAMPLE_ROWS ids: a bound that holds at any input size
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .withColumn("scales", F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(SCALE_PART)) == 0)
    )


def _class_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Continuation counts of both classes (n0, n1): of words (w), pairs (h, w) and histories (h)."""
    words = rows.select("toxic", words_in(F.col("text")).alias("ws"))
    padded = F.concat(F.array(F.lit(START)), "ws")
    before = F.concat(F.array(F.lit(START), F.lit(START)), "ws")
    n = F.size("ws")
    each = words.where(n > 0).select(
        "toxic", F.explode(F.arrays_zip(F.slice(before, F.lit(1), n).alias("h2"), F.slice(padded, F.lit(1), n).alias("h"), F.col("ws").alias("w"))).alias("c")
    )
    contexts = each.select("toxic", F.xxhash64("c.h2").alias("h2"), F.col("c.h").alias("h"), F.col("c.w").alias("w")).distinct()
    both = [F.count_if(F.col("toxic") == k).alias(f"n{k}") for k in (0, 1)]
    pairs = stage_table(contexts.groupBy("h", "w").agg(*both), "toxicity-pairs")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in (0, 1)]
    # a pair's row holds its histories of two words, so words and histories are sums over pairs
    return pairs.groupBy("w").agg(*sums), pairs, pairs.groupBy("h").agg(*sums)


def shared_counts(docs: DataFrame) -> DataFrame:
    """(w, n): in how many texts of the whole table each word occurs."""
    return docs.select(F.explode(F.array_distinct(words_in(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = stage_table(_training_rows(docs, labels), "toxicity-sample")
    words, pairs, histories = _class_counts(rows.where("not scales").select("toxic", "text"))
    words = stage_table(words, "toxicity-words")
    n0, n1 = words.agg(F.sum("n0"), F.sum("n1")).first()
    if not n0 or not n1:
        return None
    ratio = n0 / n1  # scales the ordinary counts to the toxic ones' sum
    small, big = F.col("n1").cast("double"), F.col("n0") / F.lit(ratio)
    own = F.greatest(small, big) - (small + big) / 2 * (1 + MARGIN)
    found = {r["w"]: (r["n0"] / ratio, float(r["n1"])) for r in words.where(own > DISCOUNTS[0]).collect()}
    # of a history that one class lacks, that class's model says nothing, and neither does the pair
    rated = pairs.join(histories.select("h", F.col("n0").alias("h0"), F.col("n1").alias("h1")).where("h0 > 0 AND h1 > 0"), "h")
    big = F.col("n0") / F.col("h0") * F.col("h1")
    own = F.greatest(small, big) - (small + big) / 2 * (1 + MARGIN)
    links = rated.where(own > DISCOUNTS[0]).select("h", "w", big.alias("o"), small.alias("t"), F.col("h1").cast("double").alias("of")).collect()
    shared = stage_table(shared_counts(docs), "toxicity-shared")
    n_words, n_shared = shared.agg(F.count("*"), F.sum("n")).first()
    wanted = sorted({*found, *(r["w"] for r in links)})
    named = docs.sparkSession.createDataFrame([(w,) for w in wanted], "w string")  # bounded by the sample, as stated above
    seen = {r["w"]: r["n"] for r in shared.join(F.broadcast(named), "w").collect()}
    spread = SHARED_DISCOUNT * n_words / (n_words + 1)  # goes evenly to all words and one unseen

    def backoff(w: str) -> float:
        return (max(seen.get(w, 0) - SHARED_DISCOUNT, 0) + spread) / n_shared

    models = [_model(d, n1, found, links, backoff) for d in DISCOUNTS]
    return _with_scale(models, rows.where("scales").select("toxic", "text"))


def _model(discount: float, total: int, found: dict, links: list, backoff) -> Model:
    """The log ratios at one discount; ``found`` and ``links`` hold scaled counts (ordinary, toxic)."""
    own = {w: (kept(o, t, discount), kept(t, o, discount)) for w, (o, t) in found.items()}
    own = {w: k for w, k in own.items() if k[0] or k[1]}
    left = [1 - sum(k[c] for k in own.values()) / total for c in (0, 1)]
    chance = lambda w, c: own.get(w, (0.0, 0.0))[c] / total + left[c] * backoff(w)
    base = math.log(left[1] / left[0])
    word = {w: math.log(chance(w, 1) / chance(w, 0)) - base for w in own}
    held: dict[str, list] = {}
    for r in links:
        pair = (kept(r["o"], r["t"], discount) / r["of"], kept(r["t"], r["o"], discount) / r["of"])
        if pair[0] or pair[1]:
            held.setdefault(r["h"], []).append((r["w"], pair))
    history, pair = {}, {}
    for h, follow in held.items():
        rest = [1 - sum(k[c] for _, k in follow) for c in (0, 1)]
        history[h] = math.log(rest[1] / rest[0])
        for w, k in follow:
            full = math.log((k[1] + rest[1] * chance(w, 1)) / (k[0] + rest[0] * chance(w, 0)))
            pair[h, w] = full - base - word.get(w, 0.0) - history[h]
    return Model(base, word, history, pair)


def _with_scale(models: list[Model], rows: DataFrame) -> Model:
    """The model with the least balanced error on the rows kept for it, its threshold, and the ordinary rows' spread."""
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), *[T.StructField(f"x{i}", T.DoubleType()) for i in range(len(models))]])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ratios = [pa.array([m.log_ratio(t) for t in texts], pa.float64()) for m in models]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *ratios], schema.names)

    got = rows.mapInArrow(measure, schema).toPandas()
    best = None
    for i, model in enumerate(models):
        part = got[["toxic", f"x{i}"]].dropna().sort_values([f"x{i}", "toxic"])
        y, x = part["toxic"].to_numpy(), part[f"x{i}"].to_numpy()
        # toxic rows up to a cut, and ordinary ones beyond it, are the errors; a cut lies between different values
        cuts = np.flatnonzero(np.diff(x) > 1e-9) + 1
        if not len(cuts) or not y.any() or y.all():
            continue
        missed = np.cumsum(y)[cuts - 1] / y.sum()
        alarms = 1 - np.cumsum(1 - y)[cuts - 1] / (1 - y).sum()
        errors = missed + alarms
        at = np.flatnonzero(errors == errors.min())
        cut = cuts[at[len(at) // 2]]
        low, high = np.quantile(x[y == 0], [0.05, 0.95])
        if best is None or errors.min() < best[0]:
            model.threshold, model.width = float(x[cut - 1] + x[cut]) / 2, max(float(high - low) / 2, 1e-4)
            best = (errors.min(), model)
    if best is None:  # no row of one class was left for the scale: evidence of any size counts
        models[0].threshold, models[0].width = models[0].base + 1e-4, 1e-3
    return best[1] if best else models[0]


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on); only the text decides."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*names)
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    return _scored(docs, model, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    schema = T.StructType([*docs.schema, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array((model.score(t) for t in batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns of any name, without the rows that are predicted toxic."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels)
    if model is None:
        return docs
    name = fresh_name("score", docs.columns)
    return _scored(docs, model, name).where(F.col(name) < 0.5).drop(name)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``; ``labels`` teaches from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
