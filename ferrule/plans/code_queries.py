"""More queries over the standard tables: blocks, function parts, boundaries and names.

Orders stand for functions and their lines, four bytes apart, for instructions; a returned line is a branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import scalars
from ferrule.operators import blocks
from ferrule.plans.queries import BANDS, micros
from ferrule.plans.registry import query, table

CODE_SQL = """i AS (SELECT l_orderkey AS fn, CAST(l_linenumber AS BIGINT) * 4 AS addr, bool_or(l_returnflag = 'A') AS ends,
  (min(l_partkey % 7) + 1) * 4 AS dst FROM lineitem GROUP BY ALL)"""


#: Lines that a task is given at most, as far as no order is larger.
LINES = 250_000


def _code(spark, sf_dir) -> DataFrame:
    """Instructions, dealt by function into parts whose number grows with the lines; what goes by function needs no further shuffle."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.repartition(1 + lines.count() // LINES, "l_orderkey").groupBy(F.col("l_orderkey").alias("fn"), (F.col("l_linenumber").cast("long") * 4).alias("addr"))
    return lines.agg(F.bool_or(F.col("l_returnflag") == "A").alias("ends"), ((F.min(F.col("l_partkey") % 7) + 1) * 4).alias("dst")).withColumn("size", F.lit(4))


@query(
    "block_derivation",
    f"""WITH {CODE_SQL}, t AS (SELECT DISTINCT fn, dst FROM i WHERE ends),
      l AS (SELECT i.fn, i.addr, t.dst IS NOT NULL OR coalesce(lag(ends) OVER (PARTITION BY i.fn ORDER BY i.addr), true) AS leads
            FROM i LEFT JOIN t ON t.fn = i.fn AND t.dst = i.addr),
      b AS (SELECT *, sum(CASE WHEN leads THEN 1 ELSE 0 END) OVER (PARTITION BY fn ORDER BY addr) AS k FROM l)
      SELECT fn, min(addr) AS start, max(addr) + 4 AS "end", CAST(count(*) AS BIGINT) AS n_instructions FROM b GROUP BY fn, k""",
)
def block_derivation(spark, sf_dir):
    code = _code(spark, sf_dir)
    return blocks.block_table(blocks.derive_blocks(code, code.where("ends"), "fn", F.col("ends")), "fn")


@query("function_extents", f"WITH {CODE_SQL} SELECT fn, min(addr) AS start, max(addr) + 4 AS \"end\" FROM i GROUP BY fn")
def function_extents(spark, sf_dir):
    return blocks.function_extents(_code(spark, sf_dir), "fn")


@query(
    "function_intervals",
    f"""WITH {CODE_SQL}, r AS (SELECT fn, addr, addr - 4 * row_number() OVER (PARTITION BY fn ORDER BY addr) AS island FROM i)
      SELECT fn, min(addr) AS start, max(addr) + 4 AS "end" FROM r GROUP BY fn, island""",
)
def function_intervals(spark, sf_dir):
    return blocks.function_intervals(_code(spark, sf_dir), "fn")


@query(
    "backtrack",
    """SELECT user_id, event_id, concat_ws('>', lag(event_type, 3) OVER w, lag(event_type, 2) OVER w, lag(event_type, 1) OVER w) AS before
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def backtrack(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    found = blocks.backtrack(events, "user_id", ["ts", "event_id"], F.col("event_type"), 3)
    return found.select("user_id", "event_id", F.array_join("before", ">").alias("before"))


@query(
    "split_functions",
    """SELECT user_id, part, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, CAST(count(*) FILTER (event_type = 'error') OVER
       (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM events) GROUP BY ALL""",
)
def split_functions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return blocks.split_at(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").groupBy("user_id", "part").agg(F.count("*").alias("n"))


@query(
    "next_boundary",
    """WITH s AS (SELECT DISTINCT epoch_us(o_orderdate) AS start FROM orders),
            e AS (SELECT event_id, epoch_us(ts) - 757382400000000 AS addr FROM events)
       SELECT event_id, addr, s.start AS following FROM e ASOF LEFT JOIN s ON e.addr < s.start""",
)
def next_boundary(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("event_id", (micros("ts") - 757382400000000).alias("addr"))
    starts = table(spark, sf_dir, "orders").select(micros("o_orderdate").alias("start")).distinct()
    found = blocks.next_boundary(points, starts, "addr", "start", bucket=86_400_000_000 * 30)
    return found.select("event_id", "addr", "following")


@query(
    "section_of",
    f"""SELECT o_orderkey, coalesce(arg_min(band, lo), -1) AS section FROM orders LEFT JOIN {BANDS} ON o_totalprice >= lo AND o_totalprice < hi GROUP BY o_orderkey""",
)
def section_of(spark, sf_dir):
    bands = spark.createDataFrame([(0, 1000, 50000), (1, 40000, 90000), (2, 90000, 200000), (3, 250000, 250000)], "name int, start long, end long")
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("at"))
    found = blocks.section_of(points, bands, "at", 16384)
    return found.select("o_orderkey", F.coalesce("section", F.lit(-1)).alias("section"))


@query(
    "names_first_and_last",
    """SELECT l_partkey AS addr, first(l_suppkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS first_name,
       last(l_suppkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS last_name FROM lineitem GROUP BY l_partkey""",
)
def names_first_and_last(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("addr"), *order)
    first = blocks.first_wins(rows, ["addr"], order, "l_suppkey").withColumnRenamed("l_suppkey", "first_name")
    return first.join(blocks.last_wins(rows, ["addr"], order, "l_suppkey").withColumnRenamed("l_suppkey", "last_name"), "addr")


@query(
    "calls_through_stubs",
    """SELECT s_name AS name, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size < 10
       JOIN supplier ON s_suppkey = p_partkey % 7 + 1 GROUP BY s_name""",
)
def calls_through_stubs(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("dst"))
    stubs = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("stub"), (F.col("p_partkey") % 7 + 1).alias("slot"))
    slots = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slot"), F.col("s_name").alias("name"))
    return blocks.through_stubs(calls, stubs, slots).groupBy("name").agg(F.count("*").alias("n"))


@query(
    "exports_normalised",
    """SELECT o_orderkey, CASE WHEN max(o_orderkey) OVER (PARTITION BY o_custkey) >= 900 THEN o_orderkey ELSE o_orderkey + 900 END AS addr FROM orders""",
)
def exports_normalised(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("addr"))
    return blocks.normalised_exports(rows, ["o_custkey"], F.lit(900)).select("o_orderkey", "addr")


@query("version_gate", "SELECT p_partkey FROM part WHERE p_size > 10 OR p_size = 10 AND p_partkey % 100 >= 50")
def version_gate(spark, sf_dir):
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 100).cast("string"))
    return table(spark, sf_dir, "part").where(scalars.version_key(version) >= scalars.version_key(F.lit("10.50"))).select("p_partkey")


@query(
    "access_flags",
    """SELECT p_partkey, concat_ws(' ', CASE WHEN p_size & 1 > 0 THEN 'public' END, CASE WHEN p_size & 2 > 0 THEN 'private' END,
       CASE WHEN p_size & 4 > 0 THEN 'protected' END, CASE WHEN p_size & 8 > 0 THEN 'static' END, CASE WHEN p_size & 16 > 0 THEN 'final' END,
       CASE WHEN p_size & 32 > 0 THEN 'synchronized' END) AS flags FROM part""",
)
def access_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.flag_names(F.col("p_size")).alias("flags"))


@query("status_counts", "SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
