"""Control-flow graphs as edge tables.

Function graphs are small; per function, components and dominators are near-linear passes in a grouped Pandas function,
whose groups hold distinct edges only.
Corpus graphs, such as call graphs, go by joins whose rounds are staged in the checkpoint folder.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.session import checkpoint_dir


def _adjacency(rows: pd.DataFrame) -> dict:
    out = defaultdict(set)
    for a, b in zip(rows["src"], rows["dst"], strict=True):
        out[a].add(b)
    return out


def components_of(forward: dict, nodes: list) -> dict:
    """Per node the least node of its strongly connected component, in time linear in the edges (Tarjan, without recursion)."""
    index, low, named, stack = {}, {}, {}, []
    for start in nodes:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        todo = [(start, iter(forward.get(start, ())))]
        while todo:
            node, follow = todo[-1]
            nxt = next(follow, None)
            if nxt is None:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == index[node]:
                    own = [stack.pop()]
                    while own[-1] != node:
                        own.append(stack.pop())
                    named.update(dict.fromkeys(own, min(own)))
            elif nxt not in index:
                index[nxt] = low[nxt] = len(index)
                stack.append(nxt)
                todo.append((nxt, iter(forward.get(nxt, ()))))
            elif nxt not in named:
                low[node] = min(low[node], index[nxt])
    return named


def scc(edges: DataFrame, fn: str) -> DataFrame:
    """(fn, node, component): strongly connected components of each function, named by their least node."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(rows["src"]) | set(rows["dst"]))
        named = components_of(_adjacency(rows), nodes)
        out = pd.DataFrame([(n, named[n]) for n in nodes], columns=["node", "component"])
        out.insert(0, fn, rows[fn].iloc[0])
        return out

    kind, node = edges.schema[fn].dataType.simpleString(), edges.schema["src"].dataType.simpleString()
    return edges.select(fn, "src", "dst").distinct().groupBy(fn).applyInPandas(run, f"{fn} {kind}, node {node}, component {node}")


def dominator_tree(adjacency: dict, root) -> dict:
    """Per node that the root reaches its immediate dominator (None for the root): fixpoint over the reverse postorder."""
    order, seen, todo = [], {root}, [(root, iter(sorted(adjacency.get(root, ()))))]
    while todo:
        node, follow = todo[-1]
        nxt = next(follow, None)
        if nxt is None:
            order.append(node)
            todo.pop()
        elif nxt not in seen:
            seen.add(nxt)
            todo.append((nxt, iter(sorted(adjacency.get(nxt, ())))))
    order.reverse()
    place = {n: i for i, n in enumerate(order)}
    before = defaultdict(list)
    for n in order:
        for m in adjacency.get(n, ()):
            before[m].append(n)
    parent, changed = {root: root}, True
    while changed:
        changed = False
        for n in order[1:]:
            known = [m for m in before[n] if m in parent]
            best = known[0]
            for m in known[1:]:
                while best != m:
                    if place[m] > place[best]:
                        m = parent[m]
                    else:
                        best = parent[best]
            if parent.get(n) != best:
                parent[n], changed = best, True
    return parent | {root: None}


def dominators(edges: DataFrame, roots: DataFrame, fn: str) -> DataFrame:
    """(fn, node, parent): the dominator tree of each function; the root's parent is null, unreached nodes are left out."""
    node = edges.schema["src"].dataType.simpleString()

    def run(key, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        tree = {} if starts.empty else dominator_tree(_adjacency(rows), starts["root"].iloc[0])
        out = pd.DataFrame(list(tree.items()), columns=["node", "parent"], dtype=object)
        out.insert(0, fn, key[0])
        return out

    kind = edges.schema[fn].dataType.simpleString()
    left, right = edges.select(fn, "src", "dst").distinct().groupBy(fn), roots.select(fn, "root").groupBy(fn)
    return left.cogroup(right).applyInPandas(run, f"{fn} {kind}, node {node}, parent {node}")


def nesting(edges: DataFrame, roots: DataFrame, fn: str) -> DataFrame:
    """(fn, nesting_depth): most successors of branching nodes on a path of the dominator tree."""

    def run(key, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if starts.empty:
            return pd.DataFrame({fn: [], "nesting_depth": []})
        forward = _adjacency(rows)
        branched = {s for n, out in forward.items() if len(out) > 1 for s in out}
        tree, depth = dominator_tree(forward, starts["root"].iloc[0]), {None: 0}
        for node in tree:
            path = []
            while node not in depth:
                path.append(node)
                node = tree[node]
            for n in reversed(path):
                depth[n] = depth[tree[n]] + (n in branched)
        return pd.DataFrame({fn: [key[0]], "nesting_depth": [max(depth.values())]})

    kind = edges.schema[fn].dataType.simpleString()
    left, right = edges.select(fn, "src", "dst").distinct().groupBy(fn), roots.select(fn, "root").groupBy(fn)
    return left.cogroup(right).applyInPandas(run, f"{fn} {kind}, nesting_depth long")


#: Blocks that a task is given at most, as far as no function is larger.
BLOCKS = 250_000


def dealt(rows: DataFrame, blocks: DataFrame, fn: str) -> DataFrame:
    """``rows`` dealt by function, into parts as leave ``BLOCKS`` of the blocks for a task to sort."""
    return rows.repartition(1 + blocks.count() // BLOCKS, fn)


def containing(points: DataFrame, blocks: DataFrame, at: str, fn: str) -> DataFrame:
    """``points`` (fn, at) with ``block``, the start of the function's block that holds them, or null.

    Points and blocks are merged in order, and the last block carries forward. Blocks are counted too, so they should be stored.
    """
    starts = blocks.where(F.col(fn).isNotNull() & F.col("start").isNotNull())
    starts = starts.select(fn, F.col("start").alias("_at"), F.struct("start", "end").alias("_block"))
    merged = points.withColumn("_at", F.col(at)).withColumn("_point", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy(fn).orderBy("_at", F.col("_point").asc_nulls_first(), "_block").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt(merged, blocks, fn).withColumn("_block", F.last("_block", True).over(order)).where("_point = 1")
    return found.withColumn("block", F.when(F.col(at) < F.col("_block")["end"], F.col("_block")["start"])).drop("_at", "_point", "_block")


def normalised_cfg(blocks: DataFrame, edges: DataFrame, handlers: DataFrame, fn: str) -> DataFrame:
    """(fn, src, dst), dst null for nodes without successors: ordinary edges of blocks and those to exception handlers.

    ``handlers``: fn, start, end of the guarded range, target. A target inside a block counts as that block; a target in
    none is a node of its own. Blocks are counted and read several times, so they should be stored.
    """
    aimed = containing(handlers.withColumnsRenamed({"start": "lo", "end": "hi"}), blocks, "target", fn)
    aimed = aimed.select(fn, "lo", "hi", F.coalesce("block", "target").alias("dst"))
    guarded = dealt(blocks.select(fn, "start", "end"), blocks, fn).join(aimed.hint("merge"), fn).where("lo < end AND start < hi")

    def told(rows: DataFrame, src: str, dst: str | None, kind: str) -> DataFrame:
        return rows.select(fn, F.col(src).alias("src"), (F.col(dst) if dst else F.lit(None).cast(edges.schema["dst"].dataType)).alias("dst"), F.lit(kind).alias("kind"))

    own = edges.where(F.col(fn).isNotNull() & F.col("src").isNotNull())
    every = told(blocks, "start", None, "block").unionByName(told(aimed, "dst", None, "node")).unionByName(told(own, "src", "dst", "own")).unionByName(told(guarded, "start", "dst", "guarded"))
    is_any = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    every = dealt(every, blocks, fn).groupBy(fn, "src", "dst").agg(is_any("block", "node").alias("node"), is_any("block").alias("block"), is_any("own").alias("own"), is_any("guarded").alias("guarded"))
    of_node = Window.partitionBy(fn, "src")
    every = every.withColumn("edge", F.col("guarded") | (F.col("own") & F.bool_or("block").over(of_node)))
    every = every.withColumn("leaf", F.col("node") & ~F.bool_or("edge").over(of_node))
    return every.where("edge OR leaf").select(fn, "src", "dst")


def cfg_roots(functions: DataFrame, blocks: DataFrame, fn: str) -> DataFrame:
    """(fn, root): the block at a function's address, or else the one that holds it; none, no row. Blocks should be stored."""
    found = containing(functions.select(fn, F.col(fn).alias("entry")), blocks, "entry", fn)
    return found.where("block is not null").select(fn, F.col("block").alias("root"))


def closure(edges: DataFrame, rounds: int) -> DataFrame:
    """(src, dst, depth): nodes reached in at most ``rounds`` steps, with the least number of steps."""
    checkpoint_dir(edges.sparkSession)
    steps = edges.select("src", "dst").distinct()
    found = steps.withColumn("depth", F.lit(1))
    front = found
    for depth in range(2, rounds + 1):
        onward = front.select("src", F.col("dst").alias("via")).join(steps.withColumnsRenamed({"src": "via", "dst": "to"}), "via")
        new = onward.select("src", F.col("to").alias("dst")).distinct().join(found.select("src", "dst"), ["src", "dst"], "left_anti")
        front = new.withColumn("depth", F.lit(depth)).checkpoint()
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found
