"""References between instructions, functions and named APIs. One edge table serves both directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed mnemonics by instruction set: what calls, what returns, and what a thunk's only instruction may be.
CALLS = {"intel": ("call",), "aarch64": ("bl", "blr", "blraa", "blrab"), "cil": ("call", "calli", "callvirt", "newobj")}
RETURNS = {"intel": ("ret", "retn", "retf", "iret"), "aarch64": ("ret", "retaa", "retab"), "cil": ("ret",)}
THUNKS = {"intel": ("jmp", "call"), "cil": ("call", "calli", "callvirt", "jmp")}


def base_mnemonic(mnemonic: Column) -> Column:
    """The last word of a mnemonic, prefixes such as ``rep`` left out."""
    return F.element_at(F.split(mnemonic, " "), -1)


def fallthrough_edges(instructions: DataFrame, fn: str, order: list[str], value: str) -> DataFrame:
    """(fn, src, dst): each instruction and the one that follows it in its function."""
    following = F.lead(value).over(Window.partitionBy(fn).orderBy(*order))
    return instructions.withColumn("dst", following).where("dst is not null").select(fn, F.col(value).alias("src"), "dst")


def predecessors(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reverse adjacency: per node the sorted, distinct sources of its edges."""
    return edges.groupBy(*keys, "dst").agg(F.array_sort(F.collect_set("src")).alias("sources"))


def resolve_by_priority(providers: list[DataFrame], key: str, name: str) -> DataFrame:
    """First provider in the list that has a non-empty name for a key: (key, name, provider)."""
    ranked = [p.select(key, F.col(name).alias("name"), F.lit(i).alias("provider")) for i, p in enumerate(providers)]
    every = reduce(DataFrame.unionByName, ranked).where("name is not null and name <> ''")
    best = every.groupBy(key).agg(F.min(F.struct("provider", "name")).alias("best"))
    return best.select(key, F.col("best.name").alias("name"), F.col("best.provider").alias("provider"))


def unreferenced(functions: DataFrame, refs: DataFrame, fn: str) -> DataFrame:
    """Functions without outgoing references."""
    return functions.join(refs.select(fn).distinct(), fn, "left_anti")


def outgoing(refs: DataFrame, own: DataFrame, fn: str) -> DataFrame:
    """References that leave a function; its own start stays, as recursion."""
    inner = own.where("addr <> start").select(fn, F.col("addr").alias("dst"))
    return refs.join(inner, [fn, "dst"], "left_anti")


def thunks(instructions: DataFrame, api_refs: DataFrame, fn: str, mnemonics: tuple[str, ...]) -> DataFrame:
    """Functions of one instruction, of a thunk's kind, that refers to an API."""
    single = instructions.groupBy(fn).agg(F.count("*").alias("n"), F.min(base_mnemonic(F.col("mnemonic"))).alias("m"))
    return single.where((F.col("n") == 1) & F.col("m").isin(*mnemonics)).select(fn).join(api_refs.select(fn), fn, "left_semi")


def tailcalls(jumps: DataFrame, extents: DataFrame, bucket: int) -> DataFrame:
    """Jumps into the middle of another function: (src, dst, fn), the target not being the function's start."""
    from ferrule.operators.ranges import range_join

    entered = range_join(jumps, extents, "dst", bucket).where("dst <> start")
    return entered.where("src < start or src >= end").select("src", "dst", "fn")


def reference_counts(refs: DataFrame, fn: str, kind: str, kinds: list[str]) -> DataFrame:
    """References of each kind per function, a column per kind; the kinds are stated, so no extra pass finds them."""
    return refs.groupBy(fn).pivot(kind, kinds).count().na.fill(0, kinds)


def without_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges less those listed as (src, dst)."""
    return edges.join(removed.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def all_successors(normal: DataFrame, exceptional: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, src, successors): sorted, distinct targets of ordinary and exceptional edges."""
    every = normal.select(*keys, "src", "dst").unionByName(exceptional.select(*keys, "src", "dst"))
    return every.groupBy(*keys, "src").agg(F.array_sort(F.collect_set("dst")).alias("successors"))


def call_conflicts(calls: DataFrame, instructions: DataFrame, bucket: int = 64) -> DataFrame:
    """Calls (src, dst) into the inside of an instruction (start, end): (src, dst, start)."""
    from ferrule.operators.ranges import range_join

    return range_join(calls, instructions, "dst", bucket).where("dst <> start").select("src", "dst", "start")


def is_code(points: DataFrame, instructions: DataFrame, at: str, bucket: int = 64) -> DataFrame:
    """The points that lie on a byte of an instruction (start, end)."""
    from ferrule.operators.ranges import range_join

    held = range_join(points.select(at).distinct(), instructions, at, bucket).select(at).distinct()
    return points.join(held, at, "left_semi")


def data_refs(instructions: DataFrame, base: Column, size: Column, *keep: str) -> DataFrame:
    """(binary_id, src, dst, and the columns ``keep``): hexadecimal operands of instructions that name an address of the image, calls and jumps left out.

    Operands of up to 16 digits are compared whole; ``dst`` has the type of ``base``, a decimal for addresses beyond a long.
    """
    from ferrule.operators.escapes import CALL_JUMP

    found = F.regexp_extract_all("operands", F.lit("0x([0-9a-fA-F]{1,16})"), F.lit(1))
    rows = instructions.where(~base_mnemonic(F.col("mnemonic")).rlike(CALL_JUMP)).select(
        "binary_id", *keep, F.col("addr").alias("src"), base.alias("_b"), size.alias("_n"), F.explode(F.array_distinct(found)).alias("d")
    )
    kind = "long" if rows.schema["_b"].dataType.typeName() in ("integer", "long") else "decimal(20,0)"
    rows = rows.withColumn("_d", F.conv("d", 16, 10).cast("decimal(20,0)")).where("_d >= _b AND _d < _b + _n")
    return rows.select("binary_id", *keep, "src", F.col("_d").cast(kind).alias("dst")).distinct()


def split_at_entries(instructions: DataFrame, entries: DataFrame, fn: str) -> DataFrame:
    """``instructions`` with ``part``, the start of the piece of their function: stated entries (addr) open a new one."""
    known = entries.select("addr", F.lit(True).alias("_entry")).distinct()
    order = Window.partitionBy(fn).orderBy("addr")
    rows = instructions.join(known, "addr", "left")
    return rows.withColumn("part", F.coalesce(F.max(F.when(F.col("_entry"), F.col("addr"))).over(order), F.first("addr").over(order))).drop("_entry")
