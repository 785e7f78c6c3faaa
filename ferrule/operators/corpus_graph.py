"""Graphs of a whole corpus, such as call graphs: strongly connected components and closures by joins, to their fix-points.

No node, component or closure is gathered anywhere. Rounds end in a table in the shared folder; none has a limit.

Components: what cannot lie on a cycle is trimmed, chains of nodes with one way in and one way out are contracted by pointer
doubling, so that a cycle of any length takes its logarithm in rounds, and what is left is coloured. A node's colour is the
greatest node that reaches it; the nodes of a colour that reach back to its namesake are a component; edges between colours
join no component and go. The rest is worked off in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import staged


def _staged(df: DataFrame) -> DataFrame:
    """A table in the shared folder instead of checkpoint(), whose plan carries along what the optimizer has inferred about
    the columns: that grows from round to round until planning takes longer than the work."""
    return staged(df, "graph")


def _least_and_most(edges: DataFrame) -> DataFrame:
    """Nodes with exactly one way in and one way out: (node, fro, to)."""
    ways_in = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("fro")).where("n = 1")
    ways_out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1")
    return ways_in.select("node", "fro").join(ways_out.select("node", "to"), "node")


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Chains taken out: the edges without them, each chain's nodes with where it comes from and goes to (node, fro, to), and
    the nodes of cycles that are nothing but a chain (node, component). None where there is no chain."""
    inner = _staged(_least_and_most(edges))
    n = inner.count()
    if not n:
        return None
    # pointers double: ``to`` jumps along the chain until it leaves it, ``fro`` back; ``least`` is over the nodes jumped
    ends = inner.select(F.col("node").alias("end"))
    mark = lambda df, c: df.join(ends.withColumnsRenamed({"end": c}).withColumn(f"{c}_in", F.lit(True)), c, "left").na.fill(False, [f"{c}_in"])
    state = _staged(mark(mark(inner.withColumn("least", F.col("node")), "to"), "fro").withColumn("opens", ~F.col("fro_in")))
    jumped = 1
    while jumped < 2 * n:
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("to_in").alias("to2_in"), F.col("least").alias("least2"))
        back = state.select(F.col("node").alias("fro"), F.col("fro").alias("fro2"), F.col("fro_in").alias("fro2_in"))
        met = state.join(ahead, "to", "left").join(back, "fro", "left")
        moved = met.select(
            "node", "opens", F.least("least", "least2").alias("least"),
            F.when(F.col("to_in"), F.col("to2")).otherwise(F.col("to")).alias("to"), F.when(F.col("to_in"), F.col("to2_in")).otherwise(False).alias("to_in"),
            F.when(F.col("fro_in"), F.col("fro2")).otherwise(F.col("fro")).alias("fro"), F.when(F.col("fro_in"), F.col("fro2_in")).otherwise(False).alias("fro_in"),
        )
        state = _staged(moved)
        jumped *= 2
        if state.where("to_in AND fro_in OR to_in <> fro_in").isEmpty():
            break
    chains = state.where("NOT to_in").select("node", "fro", "to", "opens")
    cycles = state.where("to_in").select("node", F.col("least").alias("component"))
    inside = inner.select("node")
    kept = edges.join(inside, edges.src == inside.node, "left_anti").join(inside, edges.dst == inside.node, "left_anti")
    links = chains.where("opens AND fro <> to").select(F.col("fro").alias("src"), F.col("to").alias("dst"))
    return _staged(kept.unionByName(links).distinct()), chains.select("node", "fro", "to"), cycles


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges whose source has a way in and whose target has a way out."""
    ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return _staged(edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))


def spread_most(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node from which each node is reached, itself included."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    state = _staged(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")))
    while True:
        sent = edges.join(state.where("new").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("told"))
        met = state.drop("new").join(sent, "node", "left")
        state = _staged(met.select("node", F.greatest("colour", "told").alias("colour"), F.coalesce(F.col("told") > F.col("colour"), F.lit(False)).alias("new")))
        if state.where("new").isEmpty():
            return state.select("node", "colour")


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components that hold their colour's namesake (node, component), and the edges that may hold others."""
    colours = spread_most(edges)
    named = edges.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("colour")), "src")
    own = _staged(named.join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other").select("src", "dst", "colour"))
    reached = front = _staged(colours.where("node = colour").select("node", F.col("colour").alias("component")))
    while not front.isEmpty():
        back = own.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), F.col("colour").alias("component")).distinct()
        front = _staged(back.join(reached, "node", "left_anti"))
        reached = reached.unionByName(front)
    reached = _staged(reached)
    gone = reached.select("node")
    rest = own.join(gone, own.src == gone.node, "left_anti").join(gone, own.dst == gone.node, "left_anti")
    return reached, _staged(rest.select("src", "dst"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst): strongly connected components, named by their least node."""
    every = _staged(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    nodes = every.select(F.col("src").alias("node")).unionByName(every.select(F.col("dst").alias("node"))).distinct()
    rest, found, levels = every.where("src <> dst"), [], []
    while True:
        before = -1
        while (size := rest.count()) != before:
            before = size
            if (out := contracted(rest)) is not None:
                rest, chains, cycles = out
                levels.append(chains)
                found.append(cycles)
            rest = trimmed(rest)
        if not size:
            break
        marked, rest = _coloured(rest)
        found.append(marked)
    known = nodes.select("node", F.lit(None).cast(nodes.schema["node"].dataType).alias("component"))
    for part in found:
        known = known.unionByName(part.select("node", "component"))
    known = _staged(known.groupBy("node").agg(F.coalesce(F.max("component"), F.col("node")).alias("component")))
    for chains in reversed(levels):  # what a chain leads from and to was left in the graph when the chain went
        ends = known.select(F.col("node").alias("fro"), F.col("component").alias("one"))
        others = known.select(F.col("node").alias("to"), F.col("component").alias("other"))
        joined = chains.join(ends, "fro").join(others, "to").where("one = other").select("node", F.col("one").alias("joined"))
        known = _staged(known.join(joined, "node", "left").select("node", F.coalesce("joined", "component").alias("component")))
    names = known.groupBy("component").agg(F.min("node").alias("name"))
    return known.join(names, "component").select("node", F.col("name").alias("component"))


def reachability(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): every node reached from every node in one step or more, with the least number of steps.

    Squaring: a round joins the pairs that the round before found with all pairs so far, so paths double, and a path of any
    length takes its logarithm in rounds. A pair is found with its least number of steps at once.
    """
    steps = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    front = found = _staged(steps.withColumn("depth", F.lit(1).cast("long")))
    while not front.isEmpty():
        first = front.select("src", F.col("dst").alias("via"), F.col("depth").alias("one"))
        second = found.select(F.col("src").alias("via"), "dst", F.col("depth").alias("other"))
        pairs = first.join(second, "via").groupBy("src", "dst").agg(F.min(F.col("one") + F.col("other")).alias("depth"))
        front = _staged(pairs.join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
        found = found.unionByName(front)
    return found
