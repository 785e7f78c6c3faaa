"""Conversations rebuilt on shared openings, and the trie of their prefixes, built as a z-fast trie.

A conversation is a string of turns. A turn is told by its role and the SHA-256 of its text; a prefix by its depth and two
64-bit sums of its turns' hashes, each hashed with its depth, so the hashes of all prefixes are running sums. Conversations
of equal turns are one string with a count.

The compacted trie is a table: a node covers the depths (a, b] that end at it, and is found by the hash of its prefix at
its handle, the 2-fattest number in (a, b]. Strings are inserted in batches, each a few times as large as all before it. A
batch is located first by fat binary search: every round looks one depth of every string up, the 2-fattest in what is left
of its interval, by an equi-join on (depth, hash); as many rounds as the longest string's length has binary digits end it,
and a last look at the child that goes on with the next turn. A string leaves the trie inside an edge, or at a node. What
leaves at one place is compacted together with the edge that it splits and takes that edge's place; a place where more
than ``TOGETHER`` strings of a batch leave takes a share of them, and the others are located anew. Since edges keep the
hash of every depth on them, the trie's own nodes, one per distinct prefix, are the edges exploded.

Counts go along the strings: each is dealt to the compacted nodes on its way, a string's nodes are summed by a window from
its end, and nodes add up their strings. The longest group that goes through one task is the list of the ids that end at
one node, which SHA-256 has to read in order; it is streamed, sorted, and never held. A string's hashes (24 bytes a turn,
no texts) are one row.

Edge cases: null roles and texts are empty; rows without conv_id belong to no conversation and are left out; turns of one
number are ordered by role, then SHA-256 of the text, so ties and repeated rows have one order, and each counts; texts are
read whole once, and only their digest and count of words go on; an empty table gives no node, not even a root; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import bounded_batches, stage_table, table, text_or_empty

#: Ids of one block share the opening of the block's first conversation.
FAMILY, OPENINGS = 20, 4
#: Strings of the first batch, and how much larger all inserted so far are after a batch; strings compacted in one task.
FIRST, GROWTH, TOGETHER = 512, 8, 4096
#: SHA-256 of nothing.
NONE = hashlib.sha256(b"").hexdigest()
TRIE = "f int, h1 long, h2 long, a int, b int, a1 long, a2 long, a_words long, e1 array<long>, e2 array<long>, words array<long>"
_EDGE = ("a", "a1", "a2", "a_words", "e1", "e2", "words")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation with its own opening replaced by that of its family's first conversation.

    A turn is (role, digest, words). The opening's length is a hash of the id.
    """
    text = text_or_empty("text")
    turn = F.struct("turn", text_or_empty("role").alias("role"), F.sha2(text, 256).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    own = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    own = stage_table(own, "turns")
    heads = own.select(F.col("conv_id").alias("first"), F.slice("ts", 1, OPENINGS - 1).alias("head"))
    length = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).cast("int")
    both = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "first", "left").withColumn("h", length)
    head = F.slice(F.coalesce("head", F.array().cast(own.schema["ts"].dataType)), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(head, F.slice("ts", F.col("h") + 1, F.size("ts"))).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """(conv_id, size, p1, p2, words): the hashes of each prefix and the words up to there; hashes of the whole: q1, q2."""
    # digests of role and text tell a turn; its place is hashed with it, so that sums tell the order
    told = lambda k: F.transform("turns", lambda t, i: F.xxhash64(F.lit(k), i, t["role"], t["digest"]))
    hashed = convs.select("conv_id", told(1).alias("p1"), told(2).alias("p2"), F.transform("turns", lambda t: t["words"]).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("p1").offsets.to_numpy()
            sizes, made, last = np.diff(ends).astype(np.int32), [], []
            for name in ("p1", "p2", "words"):
                total = np.concatenate([[0], np.cumsum(batch.column(name).flatten().to_numpy().astype(np.int64))])  # wraps
                before = total[ends[:-1] - ends[0]]
                made.append(pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(total[1:] - np.repeat(before, sizes))))
                last.append(pa.array(total[ends[1:] - ends[0]] - before))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(sizes), *made, *last[:2]], ["conv_id", "size", "p1", "p2", "words", "q1", "q2"])

    return hashed.mapInArrow(run, "conv_id long, size int, p1 array<long>, p2 array<long>, words array<long>, q1 long, q2 long")


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    mask = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftright", high, mask).cast("int") * F.pow(F.lit(2), mask).cast("int")


def locate(batch: DataFrame, trie: DataFrame, rounds: int) -> DataFrame:
    """``batch`` with where its strings leave the trie: ``l``, the deepest node passed; f, h1, h2 and a of the edge, or null."""
    nodes = trie.select(
        F.col("f").alias("_f"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("a").alias("_a"), F.col("b").alias("_b"),
        F.element_at("e1", -1).alias("_b1"), F.element_at("e2", -1).alias("_b2"),
    )
    state = batch.select(
        "sid", "size", "p1", "p2", "words", F.lit(0).alias("l"), F.col("size").alias("r"), *[F.lit(None).cast(k).alias(c) for c, k in (("f", "int"), ("h1", "long"), ("h2", "long"), ("a", "int"))]
    )
    for _ in range(rounds):
        asks = F.col("f").isNull() & (F.col("l") < F.col("r"))
        # strings that are done ask for a depth that no node has, each with a hash of its own
        state = state.withColumn("_f", F.when(asks, fattest(F.col("l"), F.col("r"))).otherwise(-1))
        state = state.withColumns({f"_h{k}": F.coalesce(F.get(f"p{k}", F.col("_f") - 1), F.col("sid")) for k in (1, 2)})
        met = state.join(nodes, ["_f", "_h1", "_h2"], "left")
        hit, at = F.col("_b").isNotNull(), F.col("_b") - 1
        through = hit & F.coalesce((F.get("p1", at) == F.col("_b1")) & (F.get("p2", at) == F.col("_b2")), F.lit(False))
        leaves = hit & ~through
        state = met.select(
            "sid", "size", "p1", "p2", "words",
            F.when(through, F.col("_b")).otherwise(F.col("l")).alias("l"),
            F.when(asks & ~hit, F.col("_f") - 1).otherwise(F.col("r")).alias("r"),
            *[F.when(leaves, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("f", "h1", "h2", "a")],
        )
    # a string that parts from an edge above its handle has not met it: the child that goes on with its next turn
    child = trie.select((F.col("a") + 1).alias("_d"), F.get("e1", F.lit(0)).alias("_k1"), F.get("e2", F.lit(0)).alias("_k2"), *[F.col(c).alias(f"_{c}") for c in ("f", "h1", "h2", "a")])
    asks = F.col("f").isNull() & (F.col("l") < F.col("size"))
    state = state.withColumn("_d", F.when(asks, F.col("l") + 1).otherwise(-1))
    state = state.withColumns({f"_k{k}": F.coalesce(F.get(f"p{k}", F.col("_d") - 1), F.col("sid")) for k in (1, 2)})
    met = state.join(child, ["_d", "_k1", "_k2"], "left")
    return met.select("sid", "size", "p1", "p2", "words", "l", *[F.coalesce(c, f"_{c}").alias(c) for c in ("f", "h1", "h2", "a")])


def compacted(members: list[dict]) -> list[tuple]:
    """The nodes below one place: strings and perhaps an edge, all from the same depth on, become edges between the depths
    where strings end or part."""
    a, a1, a2, a_words = (members[0][c] for c in ("a", "a1", "a2", "a_words"))
    strings = sorted((list(zip(m["e1"], m["e2"], strict=True)), m["words"]) for m in members)
    stops: dict[tuple[int, tuple[int, int]], int] = {}
    for i, (s, _) in enumerate(strings):
        stops.setdefault((len(s), s[-1]), i)
        if i:
            before, low, high = strings[i - 1][0], 0, min(len(s), len(strings[i - 1][0]))
            while low < high:  # prefixes that differ once differ from there on
                mid = (low + high + 1) // 2
                low, high = (mid, high) if s[mid - 1] == before[mid - 1] else (low, mid - 1)
            if low:
                stops.setdefault((low, s[low - 1]), i)
    nodes = []
    for (depth, _), i in stops.items():
        s, w = strings[i]
        top = depth - 1
        while top and (top, s[top - 1]) not in stops:
            top -= 1
        low, high = a + top, a + depth
        shift = (low ^ high).bit_length() - 1
        f = high >> shift << shift
        up = (low, *(s[top - 1] if top else (a1, a2)), w[top - 1] if top else a_words)
        nodes.append((f, *s[f - a - 1], low, high, *up[1:], [x for x, _ in s[top:depth]], [y for _, y in s[top:depth]], w[top:depth]))
    return nodes


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3]
    names = [c.split()[0] for c in TRIE.split(", ")]
    for batch in batches:
        nodes = [n for members in batch.column("members").to_pylist() for n in compacted(members)]
        columns = list(zip(*nodes, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def inserted(trie: DataFrame | None, batch: DataFrame, rounds: int, together: int = TOGETHER) -> DataFrame:
    """The trie with the strings of the batch (sid, size, p1, p2, words) in it."""
    spark = batch.sparkSession
    empty = spark.createDataFrame([], TRIE)
    while True:
        found = stage_table(locate(batch, empty if trie is None else trie, 0 if trie is None else rounds), "located")
        found = found.where(F.col("f").isNotNull() | (F.col("l") < F.col("size")))  # the others are nodes already
        inside, top = F.col("f").isNotNull(), F.coalesce("a", "l")
        cut = lambda c: F.slice(c, top + 1, F.col("size") - top)
        above = lambda c: F.coalesce(F.get(c, top - 1), F.lit(0).cast("long"))
        leaving = found.select(
            "sid", inside.alias("inside"), F.coalesce("f", F.col("l") + 1).alias("g"), *[F.when(inside, F.col(f"h{k}")).otherwise(F.get(f"p{k}", "l")).alias(f"g{k}") for k in (1, 2)],
            top.alias("a"), above("p1").alias("a1"), above("p2").alias("a2"), above("words").alias("a_words"), cut("p1").alias("e1"), cut("p2").alias("e2"), cut("words").alias("words"),
        )
        place = ["inside", "g", "g1", "g2"]
        crowded = leaving.groupBy(*place).agg(F.count("*").alias("m"), F.min("sid").alias("least")).where(F.col("m") > together)
        later = None
        if not crowded.isEmpty():
            dealt = leaving.join(crowded, place, "left")
            now = F.col("m").isNull() | (F.col("sid") == F.col("least")) | (F.pmod(F.xxhash64(F.lit(3), "sid"), F.ceil(2 * F.col("m") / together)) == 0)
            dealt = stage_table(dealt.withColumn("now", now), "dealt")
            leaving, later = dealt.where("now").select(*leaving.columns), dealt.where("NOT now").select("sid")
        splits = leaving.where("inside").select(F.col("g").alias("f"), F.col("g1").alias("h1"), F.col("g2").alias("h2")).distinct()
        rows = leaving.select(*place, *_EDGE)
        if trie is not None:
            edges = trie.join(splits, ["f", "h1", "h2"]).select(F.lit(True).alias("inside"), F.col("f").alias("g"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), *_EDGE)
            rows = rows.unionByName(edges)
        gathered = rows.groupBy(*place).agg(F.collect_list(F.struct(*_EDGE)).alias("members"))  # few: see ``together``
        new = gathered.select("members").mapInArrow(_compacted, TRIE)
        trie = stage_table(new if trie is None else trie.join(splits, ["f", "h1", "h2"], "left_anti").select(*empty.columns).unionByName(new.select(*empty.columns)), "trie")
        if later is None:
            return trie
        batch = batch.join(later, "sid", "left_semi")


def zfast_trie(strings: DataFrame, first: int = FIRST, growth: int = GROWTH, together: int = TOGETHER) -> DataFrame:
    """The compacted trie of distinct strings (sid, size, p1, p2, words), none of them empty, inserted in batches."""
    n, longest = strings.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    rank = F.pmod(F.xxhash64(F.lit(5), "sid"), F.lit(1 << 40)) / float(1 << 40) * n
    batches = 1 + max(0, math.ceil(math.log(max(n, 1) / first, growth)))
    number = F.least(F.greatest(F.ceil(F.log(rank / first) / math.log(growth)), F.lit(0)), F.lit(batches - 1))
    dealt = strings.withColumn("_batch", F.coalesce(number, F.lit(0)))
    trie = None
    for k in range(batches):
        trie = inserted(trie, dealt.where(F.col("_batch") == k).drop("_batch"), longest.bit_length(), together)
    return trie


def ends_digest(members: DataFrame) -> DataFrame:
    """(size, q1, q2, ends): SHA-256 of the ids that end at one node, streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["size", "q1", "q2", "ends"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
        at, digest = None, None
        for batch in batches:
            size, q1, q2, ids = (batch.column(c).to_numpy() for c in ("size", "q1", "q2", "conv_id"))
            if not len(ids):
                continue
            turns = np.flatnonzero((np.diff(size) != 0) | (np.diff(q1) != 0) | (np.diff(q2) != 0)) + 1
            done = []
            for s, e in zip([0, *turns.tolist()], [*turns.tolist(), len(ids)], strict=True):
                key = (int(size[s]), int(q1[s]), int(q2[s]))
                said = ",".join(map(str, ids[s:e].tolist()))
                if key == at:
                    digest.update(f",{said}".encode())
                    continue
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(said.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*at, digest.hexdigest()), kinds, strict=True)], names)

    key = ["size", "q1", "q2"]
    ordered = members.select(*key, "conv_id").repartition(*key).sortWithinPartitions(*key, "conv_id")
    return ordered.mapInArrow(run, "size int, q1 long, q2 long, ends string")


def prefix_nodes(conversations: DataFrame, first: int = FIRST, together: int = TOGETHER) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (conv_id, turn, role, text)."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    whole = stage_table(paths(rebuilt(conversations)), "paths")
    n, least = whole.agg(F.count("*"), F.min("conv_id")).first()
    if not n:
        return spark.createDataFrame([], kinds)
    distinct = whole.groupBy("size", "q1", "q2").agg(F.count("*").alias("n"), F.min("conv_id").alias("sid"))
    strings = stage_table(whole.withColumnRenamed("conv_id", "sid").join(distinct.where("size > 0").select("sid", "n"), "sid"), "strings")
    trie = zfast_trie(strings, first, together=together)

    # each string meets the nodes on its way; a node is named by its depth and hashes
    name, node = ["b", "b1", "b2"], trie.withColumns({"b1": F.element_at("e1", -1), "b2": F.element_at("e2", -1)})
    steps = strings.select("sid", "n", "size", F.posexplode(F.arrays_zip("p1", "p2")).alias("i", "p")).select("sid", "n", "size", (F.col("i") + 1).alias("b"), F.col("p.p1").alias("b1"), F.col("p.p2").alias("b2"))
    steps = stage_table(steps.join(node.select(*name), name), "steps")
    counts = steps.groupBy(*name).agg(F.sum("n").alias("n_convs"), F.min("sid").alias("conv_id"))
    children = node.groupBy(F.col("a").alias("b"), F.col("a1").alias("b1"), F.col("a2").alias("b2")).agg(F.count("*").alias("n_children"))
    own = node.join(counts, name).join(children, name, "left").na.fill(0, ["n_children"])
    own = stage_table(own.withColumn("spared", (F.col("n_convs") - 1) * (F.element_at("words", -1) - F.col("a_words"))), "nodes")
    marks = own.select(*name, "spared", F.col("conv_id").alias("least"), (F.col("n_children") == 0).alias("leaf"))
    below = Window.partitionBy("sid").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    # a node's edge is counted along its least string alone, and a leaf along the string that ends there
    counted = steps.join(marks, name).select(
        *name,
        F.coalesce(F.sum(F.when(F.col("least") == F.col("sid"), F.col("spared"))).over(below), F.lit(0)).alias("below"),
        F.max((F.col("leaf") & (F.col("b") == F.col("size"))).cast("long")).over(Window.partitionBy("sid")).alias("leaf"),
    )
    summed = counted.groupBy(*name).agg(F.sum("below").alias("below"), F.sum("leaf").alias("n_leaves"))
    ends = stage_table(ends_digest(whole), "ends")
    ended = ends.select(F.col("size").alias("b"), F.col("q1").alias("b1"), F.col("q2").alias("b2"), "ends")
    parents = own.select(F.col("b").alias("a"), F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("conv_id").alias("parent"))
    full = own.join(summed, name).join(ended, name, "left").join(parents, ["a", "a1", "a2"], "left")

    last, i = F.col("depth") == F.col("b"), F.col("i")
    depths = full.select("*", F.posexplode("words").alias("i", "through")).withColumn("depth", F.col("a") + i + 1)
    before = F.when(i == 0, F.col("a_words")).otherwise(F.get("words", i - 1))
    nodes = depths.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(i > 0, F.col("conv_id")).otherwise(F.coalesce("parent", F.lit(least))).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.element_at("words", -1) - before)).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NONE))).otherwise(F.lit(NONE)).alias("ends_sha256"),
    )
    tops = own.agg(F.coalesce(F.sum((F.col("a") == 0).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("n_children") == 0).cast("long")), F.lit(0)), F.coalesce(F.sum("spared"), F.lit(0))).first()
    bare = ends.where("size = 0").first()
    root = spark.createDataFrame([(least, 0, None, n, tops[0], max(tops[1], 1), tops[2], bare.ends if bare else NONE)], kinds)
    return nodes.unionByName(root)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """All distinct prefixes of the rebuilt ``conversations``."""
    return prefix_nodes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP12_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS first,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.first AND o.i <= c.h
  UNION ALL SELECT c.conv_id, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
d AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(role) || sha256(text), '') OVER w AS path,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
p AS (SELECT conv_id, depth, md5(path) AS node, lag(md5(path), 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent, words FROM d
  UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
n AS (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY node, depth),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT p.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM n LEFT JOIN k ON k.node = n.node JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node),
z AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT p.node, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends FROM p JOIN z USING (conv_id, depth) GROUP BY p.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN e ON e.node = n.node LEFT JOIN n up ON up.node = n.parent
"""
