"""Line dedup over sequences of line IDs, with DataFrame functions only.

A run of consecutive lines counts as a copy if it weighs ``MIN_WEIGHT`` or more (code points, and one per line break)
and also starts earlier: in a document of a smaller id, or higher up in the same one. Every line inside a copy is
deleted; the first occurrence stays.

Lines become IDs; IDs that occur once end runs, so only repeated lines go on. Distributed prefix doubling then names
the suffixes' prefixes: the name of the 2h lines from a line on is made of the names of two halves. The suffixes that
agree in a prefix are an interval of common prefixes; its least position is the first occurrence. Names are hashes
instead of ranks: intervals need equality and depth only, and ranks would cost a global sort each round. Each line
asks for two intervals, those of the shortest runs of enough weight that start with it and that end with it: whatever
copy a line lies in, one of those runs covers it, so their union is exactly the maximal repeated runs.

Edge cases: null and empty texts stay as they are; a text without line breaks is one line; rows that agree in id and
text are one document and share its result; of one id with several texts each is a document, ordered by a hash of
the text; a null id sorts first; empty tables give empty results; further columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import stage_table, table

#: Least weight of a run that is deleted where it is repeated.
MIN_WEIGHT = 40


def _lines(docs: DataFrame) -> DataFrame:
    split = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.select(
        "doc_id",
        "tid",
        "pos",
        F.xxhash64("line").alias("a"),
        F.xxhash64(F.lit(1), "line").alias("b"),
        (F.length("line") + 1).alias("weight"),
    )


def _repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines whose ID occurs more than once, with their island of neighbours and the weight before them in it."""
    lines = _lines(docs).distinct()  # rows that agree in id and text are one document
    repeated = lines.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    live = lines.join(repeated, "a")
    in_doc = Window.partitionBy("doc_id", "tid").orderBy("pos")
    live = live.withColumn("island", F.col("pos") - F.row_number().over(in_doc))
    before = Window.partitionBy("doc_id", "tid", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return live.withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0)).cast("long"))


def repeated_runs(docs: DataFrame, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """(doc_id, tid, start, size): later copies of runs of lines."""
    live = _repeated_lines(docs)
    island = Window.partitionBy("doc_id", "tid", "island")
    ahead = island.orderBy("before").rangeBetween(0, min_weight - 1)
    behind = island.orderBy("after").rangeBetween(1 - min_weight, 0)
    live = live.withColumn("after", F.col("before") + F.col("weight"))
    live = live.withColumns(
        {
            "ahead": F.when(F.sum("weight").over(ahead) >= min_weight, F.count("*").over(ahead)).cast("int"),
            "behind": F.when(F.sum("weight").over(behind) >= min_weight, F.count("*").over(behind)).cast("int"),
        }
    )
    named = stage_table(live.select("doc_id", "tid", "island", "pos", "a", "b", "ahead", "behind"), "lines")
    longest = named.agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 0
    order = island.orderBy("pos")
    names = {0: (F.col("a"), F.col("b"))}
    level = 0
    while 2 << level <= longest:  # doubling: names of 2, 4, ... lines; none where an island ends before
        half = 1 << level
        a, b = names[level]
        level += 1
        named = named.withColumns(
            {
                f"a{level}": _pair(a, F.lead(a, half).over(order), 2 * level),
                f"b{level}": _pair(b, F.lead(b, half).over(order), 2 * level + 1),
            }
        )
        names[level] = (F.col(f"a{level}"), F.col(f"b{level}"))
    runs = None
    for column in ("ahead", "behind"):
        key = F.lit(None).cast("struct<a:bigint,b:bigint,c:bigint,d:bigint>")
        for size in range(1, longest + 1):
            # a run is told by its size and the names of its first and its last 2 ** k lines
            a, b = names[size.bit_length() - 1]
            first = 0 if column == "ahead" else 1 - size
            last = first + size - (1 << size.bit_length() - 1)
            ends = [_at(a, first, order), _at(b, first, order), _at(a, last, order), _at(b, last, order)]
            named_run = F.struct(*[c.alias(n) for c, n in zip(ends, "abcd", strict=True)])
            key = F.when(F.col(column) == size, named_run).otherwise(key)
        start = F.col("pos") if column == "ahead" else F.col("pos") - F.col("behind") + 1
        found = named.select("doc_id", "tid", start.alias("start"), F.col(column).alias("size"), key.alias("k"))
        found = found.where("size is not null")
        runs = found if runs is None else runs.unionByName(found)
    runs = runs.select("doc_id", "tid", "start", "size", "k.*").distinct()
    where = F.struct("doc_id", "tid", "start")
    interval = ["size", "a", "b", "c", "d"]
    firsts = runs.groupBy(*interval).agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1")
    return runs.join(firsts, interval).where(where != F.col("first")).select("doc_id", "tid", "start", "size")


def _pair(left: Column, right: Column, seed: int) -> Column:
    return F.when(right.isNotNull(), F.xxhash64(F.lit(seed), left, right))


def _at(name: Column, places: int, order) -> Column:
    """The name that many places further on (or back)."""
    return name if places == 0 else F.lead(name, places).over(order) if places > 0 else F.lag(name, -places).over(order)


def deleted_lines(docs: DataFrame, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """(doc_id, tid, gone): per document that loses lines, their sorted numbers."""
    runs = repeated_runs(docs.select("doc_id", "text"), min_weight)
    lines = runs.select("doc_id", "tid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos"))
    return lines.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def drop_repeated_lines(docs: DataFrame, min_weight: int = MIN_WEIGHT, counted: str = "n_deleted") -> DataFrame:
    """``docs`` with the later copies of runs of lines deleted from text, and how many lines went (``counted``)."""
    own = docs.select(F.struct(*docs.columns).alias("row"))  # no column of docs can clash with those of the join
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("tid"))
    joined = own.join(deleted_lines(docs, min_weight), same, "left")
    # a column of its own, so that the slices below do not split the text again
    joined = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("row.text", "\n")))
    lines = F.col("lines")
    # what lies between deleted lines is kept, in slices
    fences = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(lines)))
    kept = F.transform(
        F.sequence(F.lit(1), F.size("gone") + 1),
        lambda i: F.slice(lines, F.element_at(fences, i) + 2, F.element_at(fences, i + 1) - F.element_at(fences, i) - 1),
    )
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.flatten(kept), "\n"))
    out = {c: F.col("row").getField(c) for c in docs.columns} | {"text": text, counted: F.coalesce(F.array_size("gone"), F.lit(0))}
    return joined.select(*[value.alias(c) for c, value in out.items()])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Delete later copies of line runs from all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_lines", F.size(F.split("text", "\n")))
    out = drop_repeated_lines(docs)
    return out.select(
        "doc_id",
        F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.col("n_deleted").cast("long").alias("n_deleted"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


OP9_SQL = """
WITH t AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t
), p AS (
  SELECT doc_id, ls, i, sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS after, length(ls[i]) + 1 AS w FROM l
), f AS (
  SELECT doc_id, ls, i AS s, i + count(*) OVER x - 1 AS e, sum(w) OVER x AS total FROM p
  WINDOW x AS (PARTITION BY doc_id ORDER BY after - w RANGE BETWEEN CURRENT ROW AND 39 FOLLOWING)
  UNION ALL
  SELECT doc_id, ls, i - count(*) OVER y + 1 AS s, i AS e, sum(w) OVER y AS total FROM p
  WINDOW y AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN 39 PRECEDING AND CURRENT ROW)
), r AS (
  SELECT DISTINCT doc_id, s, e, sha256(array_to_string(ls[s:e], chr(10))) || (e - s) AS run FROM f WHERE total >= 40
), c AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM r
), g AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM c WHERE k > 1
), o AS (
  SELECT p.doc_id, count(*) AS n_lines, count(g.i) AS n_deleted,
         coalesce(string_agg(p.ls[p.i], chr(10) ORDER BY p.i) FILTER (g.i IS NULL), '') AS kept
  FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
)
SELECT doc_id, n_lines, n_deleted, length(kept) AS n_chars, sha256(kept) AS text_sha256 FROM o
UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
"""
