"""Queries on escapes, control-flow graphs, set operations and instructions; rows of the tables stand for instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators import candidates, escapes, graph, hashes, refs
from ferrule.plans.code_queries import CODE_SQL, _code
from ferrule.plans.queries import EDGES_SQL, _edges, _roots
from ferrule.plans.registry import query, table
from ferrule.session import staged

le = escapes.little_endian


def _lines(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 5).alias("way"))


def _x86(spark, sf_dir: str) -> DataFrame:
    """Five kinds of x86 instructions: call, jump over an import, read of a fixed address, an immediate, registers only."""
    way, low = F.col("way"), le(F.col("l_partkey") + 0x401000, 4)
    hex_of = F.lower(F.hex(F.col("l_partkey") + 0x401000))

    def pick(*values: Column | str) -> Column:
        out = F.lit(values[-1]) if isinstance(values[-1], str) else values[-1]
        for i, v in reversed([*enumerate(values[:-1])]):
            out = F.when(way == i, F.lit(v) if isinstance(v, str) else v).otherwise(out)
        return out

    code = pick(F.concat(F.lit("e8"), low), F.concat(F.lit("ff25"), low), F.concat(F.lit("a1"), low), F.concat(F.lit("b8"), low), "89d8")
    mnemonic = pick("call", "bnd jmp", "mov", "mov", "mov")
    operands = pick(
        F.concat(F.lit("0x"), hex_of), F.concat(F.lit("dword ptr [0x"), hex_of, F.lit("]")),
        F.concat(F.lit("eax, dword ptr [0x"), hex_of, F.lit("]")), F.concat(F.lit("eax, 0x"), hex_of), "eax, ebx",
    )
    return _lines(spark, sf_dir).withColumns({"bytes": code, "mnemonic": mnemonic, "operands": operands})


ESCAPED_SQL = "CASE l_partkey % 5 WHEN 0 THEN 'e8????????' WHEN 1 THEN 'ff25????????' WHEN 2 THEN 'a1????????' WHEN 3 THEN 'b8????????' ELSE '89d8' END"


@query("x86_binary_escape", f"SELECT l_orderkey, l_linenumber, {ESCAPED_SQL} AS escaped FROM lineitem")
def x86_binary_escape(spark, sf_dir):
    rows = _x86(spark, sf_dir)
    out = escapes.x86_binary(F.col("bytes"), F.col("mnemonic"), F.col("operands"), F.lit(0x400000), F.lit(1 << 31))
    return rows.select("l_orderkey", "l_linenumber", out.alias("escaped"))


@query(
    "x86_operand_escape",
    """SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'CONST' WHEN 1 THEN 'PTR' WHEN 2 THEN 'REG, PTR' WHEN 3 THEN 'REG, CONST' ELSE 'REG, REG' END
       AS operands, CASE WHEN l_partkey % 5 < 2 THEN 'OFFSET' WHEN l_partkey % 5 = 2 THEN 'eax, PTR' WHEN l_partkey % 5 = 3
       THEN 'eax, 0x' || lower(to_hex(l_partkey + 4198400)) ELSE 'eax, ebx' END AS masked FROM lineitem""",
)
def x86_operand_escape(spark, sf_dir):
    rows, ops, name = _x86(spark, sf_dir), F.col("operands"), F.col("mnemonic")
    return rows.select("l_orderkey", "l_linenumber", escapes.x86_operands(ops, name).alias("operands"), escapes.x86_operands(ops, name, True).alias("masked"))


@query("mnemonic_groups", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 < 2 THEN 'C' ELSE 'M' END AS grp FROM lineitem")
def mnemonic_groups(spark, sf_dir):
    groups = spark.createDataFrame([("call", "C"), ("jmp", "C"), ("mov", "M"), ("mov", "S"), ("add", "A")], "name string, grp string")
    return escapes.mnemonic_groups(_x86(spark, sf_dir), groups).select("l_orderkey", "l_linenumber", "grp")


@query(
    "x86_pic_hash",
    f"""SELECT l_orderkey AS fn, substring(sha256(string_agg({ESCAPED_SQL}, '' ORDER BY l_linenumber, {ESCAPED_SQL})), 1, 16) AS pic_hash,
        CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey""",
)
def x86_pic_hash(spark, sf_dir):
    rows = escapes.with_escapes(
        _x86(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("form", "kind", "mask")}), F.lit("intel"), low=F.lit(0x400000), high=F.lit(1 << 31)
    ).select(F.col("l_orderkey").alias("fn"), "l_linenumber", "escaped")
    found = hashes.sequence_hash(rows, ["fn"], ["l_linenumber"], F.col("escaped"))
    sizes = rows.groupBy("fn").agg(F.count("*").alias("n"))
    return found.join(sizes, "fn").select("fn", hashes.hex_of_u64(F.col("sha256")).alias("pic_hash"), "n")


@query(
    "pic_hash_long",
    """SELECT o_orderkey, CAST(list_reduce([CAST(('0x' || substring(h, 2 * i + 1, 2)) AS HUGEINT) for i in [7, 6, 5, 4, 3, 2, 1, 0]], lambda a, b: a * 256 + b) AS VARCHAR) AS value
       FROM (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)""",
)
def pic_hash_long(spark, sf_dir):
    value = hashes.u64_of(F.sha2(F.col("o_orderkey").cast("string"), 256))
    return table(spark, sf_dir, "orders").select("o_orderkey", value.cast("string").alias("value"))


@query(
    "opcode_hash",
    """SELECT l_orderkey AS fn, sha256(string_agg(CASE WHEN l_partkey % 2 = 0 THEN 'fe01' || '????????' ELSE '28' || '????????' END, '' ORDER BY l_linenumber, l_partkey % 2 DESC))
       AS sha256 FROM lineitem GROUP BY l_orderkey""",
)
def opcode_hash(spark, sf_dir):
    code = F.concat(F.when(F.col("l_partkey") % 2 == 0, "fe01").otherwise("28"), le(F.col("l_partkey"), 4))
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("fn"), "l_linenumber", (F.col("l_partkey") % 2 * -1).alias("odd"), code.alias("bytes"))
    return hashes.sequence_hash(rows, ["fn"], ["l_linenumber", "odd"], escapes.cil_opcode_only(F.col("bytes")))


@query(
    "cil_escape",
    """SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN '28??????06' WHEN 1 THEN 'fe06??????0a' WHEN 2 THEN '2b??' WHEN 3 THEN '1f' || lower(printf('%02x', l_partkey % 256))
       ELSE '2a' END AS escaped FROM lineitem""",
)
def cil_escape(spark, sf_dir):
    way, low = F.col("way"), le(F.col("l_partkey"), 3)
    byte = le(F.col("l_partkey") % 256, 1)
    code = F.when(way == 0, F.concat(F.lit("28"), low, F.lit("06"))).when(way == 1, F.concat(F.lit("fe06"), low, F.lit("0a"))).when(way == 2, F.concat(F.lit("2b"), byte))
    code = code.when(way == 3, F.concat(F.lit("1f"), byte)).otherwise("2a")
    kind = F.when(way < 2, "token").when(way == 2, "branch").otherwise("plain")
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", escapes.cil_binary(code, kind, inner=True).alias("escaped"))


@query(
    "dalvik_escape",
    """SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN '1a' || b || '????' WHEN 1 THEN '28??' WHEN 2 THEN '6e' || b || '????' || '1032' WHEN 3 THEN '18' || b || repeat('?', 16)
       ELSE 'ff????' END AS escaped FROM (SELECT *, lower(printf('%02x', l_suppkey % 256)) AS b FROM lineitem)""",
)
def dalvik_escape(spark, sf_dir):
    way, b, low = F.col("way"), le(F.col("l_suppkey") % 256, 1), le(F.col("l_partkey"), 2)
    code = F.when(way == 0, F.concat(F.lit("1a"), b, low)).when(way == 1, F.concat(F.lit("28"), b)).when(way == 2, F.concat(F.lit("6e"), b, low, F.lit("1032")))
    code = code.when(way == 3, F.concat(F.lit("18"), b, le(F.col("l_partkey"), 8))).otherwise(F.concat(F.lit("ff"), low))
    form = F.when(way == 0, "21c").when(way == 1, "10t").when(way == 2, "35c").when(way == 3, "51l").otherwise("unknown")
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", escapes.dalvik_binary(code, form).alias("escaped"))


@query("a64_escape", "SELECT l_orderkey, l_linenumber, '94' || '??????' AS call, lower(printf('%08x', l_partkey % 65536))[1:5] || '???' AS add FROM lineitem")
def a64_escape(spark, sf_dir):
    word = F.lower(F.lpad(F.hex(F.col("l_partkey") % 65536), 8, "0"))
    call = F.concat(F.lit("94"), F.substring(word, 3, 6))
    rows = _lines(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", escapes.a64_binary(call, F.lit("ff000000")).alias("call"), escapes.a64_binary(word, F.lit("fffff000")).alias("add"))


@query(
    "escaper_selection",
    """SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'e8????????' WHEN 1 THEN 'e800????' WHEN 2 THEN 'e800????00' WHEN 3 THEN 'e8????????' ELSE 'e800000000' END
       AS escaped FROM lineitem""",
)
def escaper_selection(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("intel", "aarch64", "dalvik", "cil", "unknown"))), (F.col("way") + 1).cast("int"))
    code = F.when(F.col("way") == 1, "e8001122").otherwise("e800000000")
    rows = _lines(spark, sf_dir).withColumns(
        {"bytes": code, "mnemonic": F.lit("call"), "operands": F.lit("0x5"), "form": F.lit("21c"), "kind": F.lit("branch"), "mask": F.lit("ffff0000")}
    )
    rows = rows.withColumn("bytes", F.when(F.col("way") == 3, "e8????????").otherwise(F.col("bytes")))
    return escapes.with_escapes(rows, names).select("l_orderkey", "l_linenumber", "escaped")


# --- graphs

WHOLE_SQL = f"e AS (SELECT DISTINCT user_id, src, dst FROM ({EDGES_SQL}) WHERE dst IS NOT NULL), n AS (SELECT user_id, src AS v FROM e UNION SELECT user_id, dst FROM e)"


@query(
    "dominator_tree",
    f"""WITH RECURSIVE {WHOLE_SQL},
          q AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS root FROM events GROUP BY user_id),
          d AS (SELECT n.user_id, n.v AS cut, q.root AS node FROM n JOIN q USING (user_id) WHERE n.v <> q.root UNION
                SELECT d.user_id, d.cut, e.dst FROM d JOIN e ON e.user_id = d.user_id AND e.src = d.node AND e.dst <> d.cut),
          p AS (SELECT n.user_id, n.v, c.v AS dom FROM n JOIN n c ON c.user_id = n.user_id
                WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = n.user_id AND d.cut = c.v AND d.node = n.v)),
          k AS (SELECT user_id, v, count(*) AS n FROM p GROUP BY user_id, v)
       SELECT k.user_id, k.v AS node, coalesce(arg_max(p.dom, o.n) FILTER (p.dom <> k.v), '-') AS parent FROM k JOIN p ON p.user_id = k.user_id AND p.v = k.v
       JOIN k o ON o.user_id = p.user_id AND o.v = p.dom GROUP BY k.user_id, k.v""",
)
def dominator_tree(spark, sf_dir):
    found = graph.dominators(_edges(spark, sf_dir), _roots(spark, sf_dir), "user_id")
    return found.select("user_id", "node", F.coalesce("parent", F.lit("-")).alias("parent"))


CFG_SQL = f"""{CODE_SQL}, t AS (SELECT DISTINCT fn, dst FROM i WHERE ends),
  l AS (SELECT i.fn, i.addr, i.ends, i.dst, t.dst IS NOT NULL OR coalesce(lag(ends) OVER (PARTITION BY i.fn ORDER BY i.addr), true) AS leads
        FROM i LEFT JOIN t ON t.fn = i.fn AND t.dst = i.addr),
  b AS (SELECT *, sum(CASE WHEN leads THEN 1 ELSE 0 END) OVER (PARTITION BY fn ORDER BY addr) AS k FROM l),
  blocks AS (SELECT fn, min(addr) AS s, max(addr) + 4 AS e, bool_or(ends) AS ends, max(dst) FILTER (ends) AS dst FROM b GROUP BY fn, k)"""


def _blocks(spark, sf_dir) -> DataFrame:
    """Blocks with their last instruction's target, staged: the graph's steps read them several times."""
    from ferrule.operators import blocks

    code = _code(spark, sf_dir)
    rows = blocks.derive_blocks(code, code.where("ends"), "fn", F.col("ends"))
    found = rows.groupBy("fn", F.col("block").alias("start")).agg(
        F.max(F.col("addr") + F.col("size")).alias("end"), F.bool_or("ends").alias("ends"), F.max(F.when(F.col("ends"), F.col("dst"))).alias("dst")
    )
    return staged(found, "blocks")


def _functions(found: DataFrame) -> DataFrame:
    return graph.dealt(found.select("fn"), found, "fn").distinct()


@query(
    "normalised_cfg",
    f"""WITH {CFG_SQL},
          h AS (SELECT fn, coalesce((SELECT max(s) FROM blocks x WHERE x.fn = r.fn AND x.s <= r.target AND x.e > r.target), r.target) AS dst
                FROM (SELECT DISTINCT fn, CAST(fn % 40 AS BIGINT) AS target FROM blocks) r),
          m AS (SELECT fn, s AS src, dst FROM blocks WHERE ends UNION SELECT b.fn, b.s, h.dst FROM blocks b JOIN h ON h.fn = b.fn WHERE b.s < 12),
          n AS (SELECT fn, s AS src FROM blocks UNION SELECT fn, dst FROM h)
       SELECT n.fn, n.src, coalesce(m.dst, -1) AS dst FROM n LEFT JOIN m ON m.fn = n.fn AND m.src = n.src""",
)
def normalised_cfg(spark, sf_dir):
    """Bytes 0 to 11 of each function are guarded; the handler's address is told by the function's number."""
    found = _blocks(spark, sf_dir)
    edges = found.where("ends").select("fn", F.col("start").alias("src"), "dst")
    handlers = _functions(found).select("fn", F.lit(0).cast("long").alias("start"), F.lit(12).cast("long").alias("end"), (F.col("fn") % 40).alias("target"))
    cfg = graph.normalised_cfg(found.select("fn", "start", "end"), edges, handlers, "fn")
    return cfg.select("fn", "src", F.coalesce("dst", F.lit(-1).cast("long")).alias("dst"))


@query("cfg_roots", f"WITH {CFG_SQL} SELECT fn, max(s) AS root FROM blocks WHERE s <= fn AND e > fn GROUP BY fn")
def cfg_roots(spark, sf_dir):
    found = _blocks(spark, sf_dir).select("fn", "start", "end")
    return graph.cfg_roots(_functions(found), found, "fn")


# --- sets of edges and instructions

REFS_SQL = "r AS (SELECT l_orderkey * 100 + l_linenumber AS src, l_partkey * 10 + l_suppkey % 7 AS dst FROM lineitem), i AS (SELECT p_partkey * 10 AS s, p_partkey * 10 + 4 AS e FROM part)"


def _refs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("src"), (F.col("l_partkey") * 10 + F.col("l_suppkey") % 7).alias("dst"))


def _instructions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + 4).alias("end"))


@query("call_conflicts", f"WITH {REFS_SQL} SELECT src, dst, s AS start FROM r JOIN i ON dst > s AND dst < e")
def call_conflicts(spark, sf_dir):
    return refs.call_conflicts(_refs(spark, sf_dir), _instructions(spark, sf_dir))


@query("is_code", f"WITH {REFS_SQL} SELECT dst, CAST(count(*) AS BIGINT) AS n FROM r WHERE EXISTS (SELECT 1 FROM i WHERE dst >= s AND dst < e) GROUP BY dst")
def is_code(spark, sf_dir):
    return refs.is_code(_refs(spark, sf_dir), _instructions(spark, sf_dir), "dst").groupBy("dst").agg(F.count("*").alias("n"))


@query("edge_removal", f"WITH {REFS_SQL} SELECT src, dst FROM r WHERE (src, dst) NOT IN (SELECT (src, dst) FROM r WHERE dst % 3 = 0)")
def edge_removal(spark, sf_dir):
    edges = _refs(spark, sf_dir)
    return refs.without_edges(edges, edges.where("dst % 3 = 0")).select("src", "dst")


@query(
    "all_successors",
    """SELECT l_orderkey AS src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS successors FROM (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem
       UNION ALL SELECT l_orderkey, 'x' || l_linenumber FROM lineitem WHERE l_partkey % 2 = 0) GROUP BY l_orderkey""",
)
def all_successors(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("src", F.col("l_orderkey"))
    normal = lines.select("src", F.col("l_suppkey").cast("string").alias("dst"))
    other = lines.where("l_partkey % 2 = 0").select("src", F.concat(F.lit("x"), F.col("l_linenumber").cast("string")).alias("dst"))
    return refs.all_successors(normal, other).select("src", F.array_join("successors", ",").alias("successors"))


@query(
    "data_refs",
    "SELECT DISTINCT l_orderkey AS binary_id, CAST(l_linenumber AS BIGINT) AS src, l_partkey + 4198400 AS dst FROM lineitem WHERE l_partkey % 5 IN (2, 3) AND l_partkey < 150",
)
def data_refs(spark, sf_dir):
    rows = _x86(spark, sf_dir).select(F.col("l_orderkey").alias("binary_id"), F.col("l_linenumber").cast("long").alias("addr"), "mnemonic", "operands")
    return refs.data_refs(rows, F.lit(0x401000), F.lit(150))


@query(
    "split_at_entries",
    f"""WITH {CODE_SQL}, p AS (SELECT fn, addr, coalesce(max(CASE WHEN addr % 12 = 0 THEN addr END) OVER w, first(addr) OVER w) AS part
        FROM i WINDOW w AS (PARTITION BY fn ORDER BY addr)) SELECT fn, part, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY fn, part""",
)
def split_at_entries(spark, sf_dir):
    code = _code(spark, sf_dir)
    entries = code.where("addr % 12 = 0").select("addr").distinct()
    return refs.split_at_entries(code.select("fn", "addr"), entries, "fn").groupBy("fn", "part").agg(F.count("*").alias("n"))


@query(
    "dequeue_filter",
    """SELECT p_partkey AS addr FROM part WHERE p_size % 7 <> 0 AND p_partkey % 2 = 1 AND p_partkey % 3 = 0 AND p_size >= 4""",
)
def dequeue_filter(spark, sf_dir):
    ranked = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("addr"), (F.col("p_partkey") % 2 == 0).alias("finished"), (F.col("p_size") % 7).alias("score"),
        F.col("p_size").alias("aligned"), (F.col("p_partkey") % 3 == 0).alias("is_language"),
    )
    return candidates.dequeued(ranked, 4, True).select("addr")


@query("confidence_filter", "SELECT o_orderkey AS fn FROM orders WHERE o_totalprice >= 100000")
def confidence_filter(spark, sf_dir):
    functions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fn"), F.col("o_totalprice").alias("confidence"))
    return candidates.at_least(functions, 100_000).select("fn")


@query("base_mnemonics", "SELECT p_partkey, list_extract(string_split(p_name, ' '), -1) AS mnemonic FROM part")
def base_mnemonics(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", refs.base_mnemonic(F.col("p_name")).alias("mnemonic"))


@query(
    "outgoing_refs",
    """SELECT l_orderkey AS fn, l_linenumber AS src, l_partkey % 9 AS dst FROM lineitem r WHERE NOT EXISTS
       (SELECT 1 FROM lineitem x WHERE x.l_orderkey = r.l_orderkey AND x.l_linenumber = r.l_partkey % 9 AND x.l_linenumber <> 1)""",
)
def outgoing_refs(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    found = lines.select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("src"), (F.col("l_partkey") % 9).alias("dst"))
    own = lines.select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").cast("long").alias("addr"), F.lit(1).cast("long").alias("start"))
    return refs.outgoing(found, own, "fn").select("fn", "src", "dst")


@query("tag_counts", "SELECT event_type AS tag, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def tag_counts(spark, sf_dir):
    """Heuristic tags of each function as an array, counted over all."""
    tags = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("tags"))
    return tags.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
