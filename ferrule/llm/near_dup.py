"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds the hashes of its word shingles; its sketch keeps the ``SKETCH`` smallest. Documents of equal
sets form one class and go on as one. Inverted lists of the retained values generate the overlaps: two sets at or
above the threshold share at least ``SHARED`` of the smaller sketch (at 0.8 and 48 values fewer than 20 shared ones
have odds below 1e-8), so they meet in a list of one of the rarest retained values, and only those lists are kept.
The sketch of the union estimates a candidate's similarity and filters; the exact Jaccard of the full sets decides.

Lists are worked off without writing all their pairs: first every member meets the list's first member; confirmed
links give components; those outside a list's main component meet a few members inside; then only members of
components that are still different meet, all of them. Long lists that stay split are cut anew: their members' full sets
are ordered, what a reference set holds last, and partners meet in one of the first fifth of their shingles, which leaves
out what a common passage shares. What is long even then is compared in blocks.

Edge cases: null and empty texts have no set, no links, and are kept; shorter texts are one shingle; repeated rows and
equal texts are one class, the smallest id names it; rows without an id are compared like all others, the least id of
their group names them, and of a group without any id the text with the least hash stays; different texts of one id are
one document, linked with what either is linked with; ids are carried as they are, up to 64 bits; empty tables give
empty results; further columns are carried by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import bounded_batches, stage_table, table
from ferrule.llm.graphs import components
from ferrule.llm.hashing import mix, shingle_set

#: Retained values; of these the least share that similar sets have in common.
SKETCH = 48
SHARED = 20 / 48
#: The estimate may fall short of the threshold by six standard deviations of a sketch.
SLACK = 6 * (0.8 * 0.2 / SKETCH) ** 0.5
#: Rows of sets that go back at a time; pairs of one representative that a copy of its set serves.
ROWS, SPLIT = 256, 1024


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64), pa.int64()))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key is the id, and for rows without one a hash of the text."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, key, n (set size), two fingerprints of the set and its sketch, smallest unsigned values first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            # two fingerprints of the whole set: equal sets are one class
            f1 = [np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64) for s in sets]
            f2 = [s.sum(dtype=np.uint64).astype(np.int64) for s in sets]
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _lists([s[:SKETCH] for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *made], ["doc_id", "key", "n", "f1", "f2", "sketch"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n long, f1 long, f2 long, sketch array<long>"
    return _keyed(docs).mapInArrow(run, schema)


def prefix_postings(members: DataFrame) -> DataFrame:
    """(value, node, n): per node, its rarest retained values that other nodes hold too.

    ``members``: node, n, vals. Partners have ``SHARED`` of a node's values in common, so they meet in one of its
    rarest (1 - SHARED); a node whose own values make up more than that has no partner and drops out.
    """
    postings = members.select("node", "n", F.size("vals").alias("s"), F.explode("vals").alias("value"))
    repeated = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = postings.join(repeated, "value").groupBy("node", "n", "s").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs")
    )
    prefix = F.col("s") - F.ceil(F.col("s") * F.lit(SHARED) - 1e-9) + 1 - (F.col("s") - F.size("vs"))
    return (
        held.withColumn("p", prefix.cast("int"))
        .where("p > 0")
        .select("node", "n", F.explode(F.slice("vs", F.lit(1), F.col("p"))).alias("v"))
        .select(F.col("v.value").alias("value"), "node", "n")
    )


def full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, vals): the whole shingle sets of the nodes, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):  # sets take more room than texts: hand them on in small parts
                part = batch.slice(at, ROWS)
                sets = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), _lists(sets)], ["node", "vals"])

    texts = _keyed(docs).select(F.col("key").alias("node"), "text").join(nodes, "node")
    return texts.mapInArrow(run, "node long, vals array<long>")


def _numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, unsigned, and where each list starts (and the last one ends)."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy().view(np.uint64), ends


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, x, y): the pairs with the full sets of both.

    Many pairs may share one b: its set is sent once per ``SPLIT`` of them, so that no task gets them all.
    """
    pairs = stage_table(pairs.select("a", "b"), "pairs")  # counted and dealt: two reads of what is found once
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPLIT).alias("parts"))
    left = sets.select(F.col("node").alias("a"), F.col("vals").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("vals").alias("y")).join(parts, "b")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    return dealt.join(left, "a").join(right, ["b", "part"]).select("a", "b", "x", "y")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; the union's sketch filters before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs, xe), (ys, ye) = _numbers(batch.column("x")), _numbers(batch.column("y"))
            keep = []
            for i in range(len(batch)):
                x, y = xs[xe[i] : xe[i + 1]], ys[ye[i] : ye[i + 1]]
                union = np.union1d(x[:SKETCH], y[:SKETCH])[:SKETCH]
                both = np.intersect1d(x[:SKETCH], y[:SKETCH], assume_unique=True)
                if np.isin(both, union, assume_unique=True).sum() < (percent / 100 - SLACK) * len(union):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def _tagged(postings: DataFrame, comps: DataFrame) -> DataFrame:
    return postings.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _across(tagged: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list's members in different components: those outside its largest one meet all others."""
    parts = tagged.groupBy("value", "component").agg(F.count("*").alias("m"))
    main = parts.groupBy("value").agg(
        F.max(F.struct(F.col("m"), F.col("component"))).alias("top"), F.count("*").alias("parts")
    ).where("parts > 1").select("value", F.col("top.component").alias("main"))
    split = tagged.join(main, "value")
    cols = lambda p: [F.col(c).alias(p + c) for c in ("node", "n", "component")]
    out, every = split.where("component <> main").select("value", *cols("a_")), split.select("value", *cols("b_"))
    fits = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (F.col("a_component") != F.col("b_component"))
    met = out.join(every, "value").where(fits)
    return met.select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b")).distinct()


#: Members of a list's main component that those outside it meet before they meet all.
PROBES = 8


def _probes(tagged: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members outside a list's main component with ``PROBES`` members inside, the same for all lists."""
    parts = tagged.groupBy("value", "component").agg(
        F.count("*").alias("m"),
        *[F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node", "n")).alias(f"p{i}") for i in range(PROBES)],
    )
    picked = F.array_distinct(F.array(*[F.struct(f"p{i}.node", f"p{i}.n") for i in range(PROBES)]))
    main = parts.groupBy("value").agg(
        F.max(F.struct(F.col("m"), F.col("component"), picked.alias("probes"))).alias("top"), F.count("*").alias("parts")
    ).where("parts > 1")
    out = tagged.join(main.select("value", "top"), "value").where("component <> top.component")
    # lists of one component name the same members: each is met once, however many lists name it
    named = out.groupBy("node", "n").agg(F.array_distinct(F.flatten(F.collect_set("top.probes"))).alias("probes"))
    fits = lambda p: 100 * F.least(F.col("n"), p["n"]) >= percent * F.greatest(F.col("n"), p["n"])
    met = named.select(F.col("node").alias("a"), F.explode(F.filter("probes", fits)).alias("p"))
    return met.select("a", F.col("p.node").alias("b"))


#: A list whose members outside its main component could meet in more pairs than this is a long one.
LONG = 1 << 12
#: Members of a block; two blocks are compared in one task.
BLOCK = 128


def _split_lists(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of lists that hold several components: of those that are not long, and of the long ones."""
    sizes = tagged.groupBy("value", "component").agg(F.count("*").alias("c")).groupBy("value").agg(
        F.sum("c").alias("m"), F.max("c").alias("top")
    )
    apart = sizes.where("m > top").select("value", ((F.col("m") - F.col("top")) * F.col("m") > LONG).alias("long"))
    rows = stage_table(tagged.join(apart, "value"), "split-lists")
    return rows.where(~F.col("long")).drop("long"), rows.where("long").drop("long")


def split_postings(tagged: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(value, node, n): long lists cut into shorter ones, in which partners of one list still meet.

    Lists get a reference, a node that most of their members agree on. A member's shingles are ordered, those outside the
    reference's set first, then by value: for members of one reference that is one order, and sets that share ``percent``
    of either's shingles share one of the first 100 - ``percent`` in the hundred of each. A passage that the list's members
    have in common with the reference comes last, so it brings together only those that hold little else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs, xe), (ys, ye) = _numbers(batch.column("x")), _numbers(batch.column("y"))
            names = mix(batch.column("b").to_numpy().view(np.uint64))
            sizes, lists = np.diff(xe), []
            for i, n in enumerate(sizes.tolist()):
                x = xs[xe[i] : xe[i + 1]]
                held = np.isin(x, ys[ye[i] : ye[i + 1]], assume_unique=True)
                prefix = np.concatenate([x[~held], x[held]])[: n + percent * -n // 100 + 1]
                lists.append(mix(prefix ^ names[i]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(sizes, pa.int64()), _lists(lists)], ["node", "n", "vals"])

    firsts = tagged.groupBy("value").agg(F.min("node").alias("first"))
    chosen = tagged.join(firsts, "value").groupBy("node").agg(F.min("first").alias("b"))
    votes = tagged.join(chosen, "node").groupBy("value", "b").agg(F.count("*").alias("votes"))
    references = votes.groupBy("value").agg(F.max(F.struct("votes", "b")).alias("top")).select("value", "top.b")
    pairs = tagged.join(references, "value").select(F.col("node").alias("a"), "b").distinct()
    made = _with_sets(pairs, sets).mapInArrow(run, "node long, n long, vals array<long>")
    postings = stage_table(made.select("node", "n", F.explode("vals").alias("value")), "split")
    shared = postings.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    return postings.join(shared, "value")


def _linked_in_blocks(tagged: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links among members of long lists, compared block by block; only links that join components leave.

    Lists that share members form a cluster. A member's block is a hash; every two blocks of a cluster are a task's
    work, so a task holds 2 * ``BLOCK`` sets at any cluster size, and a member is sent once per block.
    """
    firsts = tagged.groupBy("value").agg(F.min("node").alias("b"))
    clusters = components(tagged.join(firsts, "value").select(F.col("node").alias("a"), "b")).select(
        "node", F.col("component").alias("cluster")
    )
    placed = clusters.join(clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "cluster")
    own = placed.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.join(tagged.select("node", "component").distinct(), "node").join(sets, "node")
    work = sent.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "vals")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["vals"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(rows)), sizes)
        _, column, seen = np.unique(np.concatenate(list(rows["vals"])), return_inverse=True, return_counts=True)
        shared = seen[column] > 1
        _, column = np.unique(column[shared], return_inverse=True)
        common = np.zeros((len(rows), len(rows)), np.float32)
        for lo in range(0, int(column.max(initial=-1)) + 1, 4096):  # a slice of the shingles at a time
            part = (column >= lo) & (column < lo + 4096)
            held = np.zeros((len(rows), 4096), np.float32)
            held[owner[shared][part], column[part] - lo] = 1
            common += held @ held.T
        x, y = np.nonzero(np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1))
        nodes, group = rows["node"].to_numpy(), rows["component"].to_numpy().copy()
        links = []
        for a, b in zip(x, y, strict=True):
            if group[a] != group[b]:
                links.append((nodes[a], nodes[b]))
                group[group == group[a]] = group[b]
        return pd.DataFrame(links, columns=["a", "b"])

    return work.groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    return _grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, chosen): ``chosen`` is the key of the one document that stands for its group."""
    bounded_batches(docs.sparkSession)
    sketched = stage_table(sketches(docs, words), "sketches")
    classes = (
        sketched.where("n > 0")
        .groupBy("f1", "f2", "n")
        .agg(F.min("doc_id").alias("least"), F.coalesce(F.min("doc_id").cast("long"), F.min("key")).alias("node"), F.first("sketch").alias("vals"))
    )
    postings = stage_table(prefix_postings(classes), "postings")
    lists = postings.groupBy("value").agg(F.min("node").alias("b"), F.count("*").alias("m")).where("m > 1")
    postings = stage_table(postings.join(lists, "value"), "lists")
    sets = stage_table(full_sets(docs, postings.select("node").distinct(), words), "sets")
    star = postings.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    links = stage_table(confirmed(star, sets, percent), "links")
    comps = components(links)
    members = postings.select("value", "node", "n")
    # a second try, before all that are still apart meet: most copies know some member of the main component
    links = stage_table(links.unionByName(confirmed(_probes(stage_table(_tagged(members, comps), "tagged"), percent), sets, percent)), "links")
    comps = stage_table(components(links), "components")
    short, long = _split_lists(stage_table(_tagged(members, comps), "tagged"))
    found = [confirmed(_across(short, percent), sets, percent)]
    if not long.isEmpty():
        split = split_postings(long, sets, percent)
        short, long = _split_lists(stage_table(_tagged(split, comps), "tagged"))
        found.append(confirmed(_across(short, percent), sets, percent))
        if not long.isEmpty():
            found.append(_linked_in_blocks(long, sets, percent))
    for more in found:
        links = links.unionByName(more)
    final = components(links)
    named = classes.select("f1", "f2", "n", "least", "node").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # only components of several classes need their least id looked up; a class that stands alone has it
    joint = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("node").alias("first"))
    named = named.select("f1", "f2", "n", "component").join(joint, "component")
    named = named.select("f1", "f2", "n", "component_id", F.coalesce(F.col("component_id").cast("long"), "first").alias("chosen"))
    rows = sketched.select("doc_id", "key", F.col("n").alias("n_shingles"), "f1", "f2")
    found = rows.where("n_shingles > 0").join(named.withColumnRenamed("n", "n_shingles"), ["f1", "f2", "n_shingles"])
    alone = rows.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), F.col("key").alias("chosen"))
    return found.select(*alone.columns).unionByName(alone)


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays, the one with the smallest id; columns of any name are carried."""
    gone = _grouped(docs.select("doc_id", "text"), words, percent).where("key <> chosen").select("key").distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"))
    return own.join(gone, "key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles of ``documents``, linked from 80 % similarity on, exactly."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w
), h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, b AS reach FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach),
m AS (SELECT doc_id, min(reach) AS reach FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.reach, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.reach, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
