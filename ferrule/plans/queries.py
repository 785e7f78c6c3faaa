"""Queries over the standard tables: each applies an operator of the engine to a table that stands in for its input.

Users stand for functions, their events for instructions, event types for mnemonics; orders stand for intervals and
line items for references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import candidates, graph, hashes, ranges, refs, text
from ferrule.plans.registry import query, table
from ferrule.sources import sinks


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")


def _edges(spark, sf_dir: str) -> DataFrame:
    return refs.fallthrough_edges(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


EDGES_SQL = """
  SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events
"""


@query(
    "stats_merge",
    """SELECT event_type, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS most, CAST(count(*) AS BIGINT) AS users
       FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type""",
)
def stats_merge(spark, sf_dir):
    each = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return each.groupBy("event_type").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.count("*").alias("users"))


@query(
    "fallthrough_edges",
    f"SELECT user_id, src, dst, CAST(count(*) AS BIGINT) AS n FROM ({EDGES_SQL}) WHERE dst IS NOT NULL GROUP BY ALL",
)
def fallthrough_edges(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("user_id", "src", "dst").agg(F.count("*").alias("n"))


@query(
    "predecessors",
    f"""SELECT user_id, dst, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM ({EDGES_SQL})
        WHERE dst IS NOT NULL GROUP BY user_id, dst""",
)
def predecessors(spark, sf_dir):
    found = refs.predecessors(_edges(spark, sf_dir), ("user_id",))
    return found.select("user_id", "dst", F.array_join("sources", ",").alias("sources"))


@query(
    "inrefs_outrefs",
    """SELECT p_partkey AS part, CAST(coalesce(i.n, 0) AS BIGINT) AS inrefs, CAST(coalesce(i.sources, 0) AS BIGINT) AS sources
       FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(DISTINCT l_orderkey) AS sources FROM lineitem GROUP BY 1) i
       ON l_partkey = p_partkey""",
)
def inrefs_outrefs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey")
    found = lines.groupBy("part").agg(F.count("*").alias("inrefs"), F.countDistinct("l_orderkey").alias("sources"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    return parts.join(found, "part", "left").na.fill(0)


@query(
    "leaf_functions",
    "SELECT o_orderkey AS fn FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def leaf_functions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fn"))
    return refs.unreferenced(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fn")), "fn")


@query("recursive_functions", f"SELECT DISTINCT user_id FROM ({EDGES_SQL}) WHERE src = dst")
def recursive_functions(spark, sf_dir):
    return _edges(spark, sf_dir).where("src = dst").select("user_id").distinct()


@query(
    "thunk_functions",
    """SELECT l_orderkey AS fn FROM lineitem GROUP BY 1 HAVING count(*) = 1 AND min(l_returnflag) = 'R'
       AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def thunk_functions(spark, sf_dir):
    code = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_returnflag").alias("mnemonic"))
    apis = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("fn"))
    return refs.thunks(code, apis, "fn", ("R",))


@query(
    "api_resolve_priority",
    """SELECT k, arg_min(name, p) AS name, CAST(min(p) AS INTEGER) AS provider FROM (
         SELECT s_suppkey AS k, s_name AS name, 0 AS p FROM supplier UNION ALL
         SELECT c_custkey, c_name, 1 FROM customer UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, 2 FROM nation)
       WHERE name IS NOT NULL AND name <> '' GROUP BY k""",
)
def api_resolve_priority(spark, sf_dir):
    named = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).cast("long").alias("k"), F.col(n).alias("name"))
    providers = [named("supplier", "s_suppkey", "s_name"), named("customer", "c_custkey", "c_name"), named("nation", "n_nationkey", "n_name")]
    return refs.resolve_by_priority(providers, "k", "name")


@query(
    "xref_names",
    """SELECT p_name, s_name, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON p_partkey = l_partkey
       JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""",
)
def xref_names(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("m"))
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    named = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    return named.groupBy("p_name", "s_name").agg(F.sum("m").alias("n"))


@query(
    "block_locator",
    """WITH s AS (SELECT DISTINCT epoch_us(o_orderdate) AS start FROM orders),
            e AS (SELECT event_id, epoch_us(ts) - 757382400000000 AS addr FROM events)
       SELECT event_id, addr, s.start AS located FROM e ASOF LEFT JOIN s ON e.addr >= s.start""",
)
def block_locator(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("event_id", (micros("ts") - 757382400000000).alias("addr"))
    starts = table(spark, sf_dir, "orders").select(micros("o_orderdate").alias("start")).distinct()
    return ranges.locate(points, starts, "addr", "start", bucket=86_400_000_000 * 30).select("event_id", "addr", "located")


BANDS = "(VALUES (0, 1000, 50000), (1, 40000, 90000), (2, 90000, 200000), (3, 250000, 250000)) AS b(band, lo, hi)"


@query(
    "range_join_areas",
    f"""SELECT band, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys
        FROM orders JOIN {BANDS} ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band""",
)
def range_join_areas(spark, sf_dir):
    bands = spark.createDataFrame([(0, 1000, 50000), (1, 40000, 90000), (2, 90000, 200000), (3, 250000, 250000)], "band int, start long, end long")
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("at"))
    found = ranges.range_join(points, bands, "at", 16384)
    return found.groupBy("band").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "interval_overlap",
    """WITH o AS (SELECT o_custkey AS k, o_orderkey AS a, epoch_us(o_orderdate) // 86400000000 AS s FROM orders)
       SELECT x.k, x.a AS l, y.a AS r FROM o x JOIN o y ON x.k = y.k AND x.a < y.a AND x.s < y.s + 30 AND y.s < x.s + 30""",
)
def interval_overlap(spark, sf_dir):
    day = F.floor(micros("o_orderdate") / 86_400_000_000).cast("long")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("a"), day.alias("s"))
    side = lambda p, n: o.select("k", F.col("a").alias(n), F.col("s").alias(f"{p}_start"), (F.col("s") + 30).alias(f"{p}_end"))
    return ranges.overlap_join(side("l", "l"), side("r", "r"), 30, ("k",)).where("l < r").select("k", "l", "r")


AREAS_SQL = """
  a AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 21600000000 AS e FROM events),
  m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e
        ROWS UNBOUNDED PRECEDING) AS island FROM m),
  g AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, island)
"""


def _areas(spark, sf_dir) -> DataFrame:
    start = micros("ts")
    return table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + 21_600_000_000).alias("end"))


@query("merge_areas", f'WITH {AREAS_SQL} SELECT user_id, s AS "start", e AS "end" FROM g')
def merge_areas(spark, sf_dir):
    return ranges.merge_areas(_areas(spark, sf_dir), ("user_id",))


@query(
    "gaps",
    f"""WITH {AREAS_SQL}, n AS (SELECT user_id, e, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nxt FROM g)
        SELECT user_id, e AS gap_start, nxt AS gap_end, nxt - e AS gap_size FROM n WHERE nxt - e >= 86400000000""",
)
def gaps(spark, sf_dir):
    return ranges.gaps(_areas(spark, sf_dir), ("user_id",), 86_400_000_000)


@query(
    "function_overlap",
    f"""WITH {AREAS_SQL} SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(least(reach, e) - s) AS BIGINT) AS overlap
        FROM m WHERE reach > s GROUP BY user_id""",
)
def function_overlap(spark, sf_dir):
    found = ranges.overlaps_previous(_areas(spark, sf_dir), ("user_id",))
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("overlap").alias("overlap"))


@query(
    "in_code_areas",
    """SELECT CAST(count(*) FILTER (o_totalprice >= 1000 AND o_totalprice < 50000 OR o_totalprice >= 90000 AND o_totalprice < 120000) AS BIGINT)
       AS listed, CAST(count(*) FILTER (o_totalprice >= 1000 AND o_totalprice <= 51000) AS BIGINT) AS whole FROM orders""",
)
def in_code_areas(spark, sf_dir):
    area = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    listed, none = F.array(area(1000, 50000), area(90000, 120000)), F.array().cast("array<struct<start:int,end:int>>")
    at, base, size = F.col("o_totalprice"), F.lit(1000), F.lit(50000)
    return table(spark, sf_dir, "orders").agg(
        F.count_if(ranges.in_code_areas(at, listed, base, size)).alias("listed"),
        F.count_if(ranges.in_code_areas(at, none, base, size)).alias("whole"),
    )


@query(
    "tailcalls",
    """WITH x AS (SELECT o_orderkey AS fn, o_orderkey * 10 AS s, o_orderkey * 10 + 8 AS e FROM orders),
            j AS (SELECT l_orderkey * 10 + l_linenumber AS src, l_orderkey * 10 + l_quantity % 20 AS dst FROM lineitem)
       SELECT fn, CAST(count(*) AS BIGINT) AS n FROM j JOIN x ON dst > s AND dst < e WHERE src < s OR src >= e GROUP BY fn""",
)
def tailcalls(spark, sf_dir):
    at = F.col("o_orderkey") * 10
    extents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fn"), at.alias("start"), (at + 8).alias("end"))
    base = F.col("l_orderkey") * 10
    jumps = table(spark, sf_dir, "lineitem").select((base + F.col("l_linenumber")).alias("src"), (base + F.col("l_quantity") % 20).alias("dst"))
    return refs.tailcalls(jumps, extents, 64).groupBy("fn").agg(F.count("*").alias("n"))


CANDIDATES_SQL = """
  c AS (SELECT p_partkey AS addr, count(l_partkey) AS refs, p_type LIKE 'PROMO%' AS is_symbol, p_brand = 'Brand#13' AS is_stub
        FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
  s AS (SELECT *, CASE WHEN addr % 16 = 0 THEN 16 WHEN addr % 4 = 0 THEN 4 ELSE 0 END AS aligned FROM c),
  r AS (SELECT *, CAST((CASE WHEN is_symbol THEN 10000 ELSE 0 END) + (CASE WHEN is_stub THEN 1000 ELSE 0 END)
        + 10 * (CASE WHEN refs < 10 THEN refs ELSE 10 + refs // 10 END) + (CASE WHEN aligned > 0 THEN 1 ELSE 0 END) AS BIGINT) AS score FROM s)
"""


def _candidates(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("addr"), F.col("p_type").startswith("PROMO").alias("is_symbol"), (F.col("p_brand") == "Brand#13").alias("is_stub")
    )
    called = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("addr")).agg(F.count("*").alias("refs"))
    return candidates.merge_candidates([parts, called], ["addr"])


@query("candidate_merge", f"WITH {CANDIDATES_SQL} SELECT addr, refs, is_symbol, is_stub FROM c")
def candidate_merge(spark, sf_dir):
    return _candidates(spark, sf_dir).select("addr", F.col("refs").cast("long").alias("refs"), "is_symbol", "is_stub")


def _scored(spark, sf_dir) -> DataFrame:
    found = _candidates(spark, sf_dir).withColumn("aligned", candidates.alignment(F.col("addr")))
    flags = {"is_symbol": F.col("is_symbol"), "is_stub": F.col("is_stub")}
    return found.withColumn("score", candidates.score(F.col("refs"), F.col("aligned"), F.lit(0), flags))


@query("candidate_score", f"WITH {CANDIDATES_SQL} SELECT addr, score FROM r")
def candidate_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("addr", "score")


@query(
    "candidate_rank",
    f"WITH {CANDIDATES_SQL} SELECT addr, CAST(row_number() OVER (PARTITION BY aligned ORDER BY score DESC, addr) AS INTEGER) AS place FROM r",
)
def candidate_rank(spark, sf_dir):
    return candidates.rank(_scored(spark, sf_dir), ["aligned"], [F.desc("score"), F.asc("addr")]).select("addr", "place")


@query(
    "bracket_rank",
    f"""WITH {CANDIDATES_SQL} SELECT addr, CAST(row_number() OVER (PARTITION BY aligned ORDER BY least(2, refs) DESC, score DESC, addr)
        AS INTEGER) AS place FROM r""",
)
def bracket_rank(spark, sf_dir):
    by = [candidates.bracket(F.col("refs")).desc(), F.desc("score"), F.asc("addr")]
    return candidates.rank(_scored(spark, sf_dir), ["aligned"], by).select("addr", "place")


@query(
    "alignment_inference",
    f"""WITH {CANDIDATES_SQL} SELECT is_stub, CAST(CASE WHEN count(*) <= 20 THEN 0 WHEN count(*) FILTER (addr * 4 % 16 <> 0) * 20 <= count(*) THEN 16
        WHEN count(*) FILTER (addr * 4 % 4 <> 0) * 20 <= count(*) THEN 4 ELSE 0 END AS INTEGER) AS alignment, CAST(count(*) AS BIGINT) AS n_candidates
        FROM r WHERE refs > 1 GROUP BY is_stub""",
)
def alignment_inference(spark, sf_dir):
    scaled = _candidates(spark, sf_dir).withColumn("addr", F.col("addr") * 4)
    return candidates.identified_alignment(scaled, ["is_stub"])


@query(
    "confidence",
    f"""WITH {CANDIDATES_SQL}, t AS (SELECT addr, CASE WHEN refs > 30 THEN 2 ELSE 1 END AS refs, is_symbol AS initial, is_stub AS prologue,
             addr % 13 - 10 AS tfidf FROM r)
        SELECT addr, CAST(CASE WHEN refs > 1 THEN 1.0
          WHEN tfidf < -8 THEN CASE WHEN initial AND prologue THEN 0.994 WHEN initial THEN 0.845 WHEN prologue THEN 0.989 ELSE 0.691 END
          WHEN tfidf < -4 THEN CASE WHEN initial AND prologue THEN 0.982 WHEN initial THEN 0.833 WHEN prologue THEN 0.964 ELSE 0.666 END
          WHEN tfidf < -2 THEN CASE WHEN initial AND prologue THEN 0.922 WHEN initial THEN 0.773 WHEN prologue THEN 0.844 ELSE 0.546 END
          WHEN tfidf < -1 THEN CASE WHEN initial AND prologue THEN 0.86 WHEN initial THEN 0.711 WHEN prologue THEN 0.72 ELSE 0.422 END
          WHEN tfidf < 0 THEN CASE WHEN initial AND prologue THEN 0.809 WHEN initial THEN 0.66 WHEN prologue THEN 0.619 ELSE 0.321 END
          ELSE CASE WHEN initial AND prologue THEN 0.649 WHEN initial THEN 0.5 WHEN prologue THEN 0.298 ELSE 0.0 END END AS DOUBLE) AS confidence FROM t""",
)
def confidence(spark, sf_dir):
    refs_ = F.when(F.col("refs") > 30, 2).otherwise(1)
    value = candidates.confidence(F.col("addr") % 13 - 10, F.col("is_stub"), F.col("is_symbol"), refs_)
    return _candidates(spark, sf_dir).select("addr", value.alias("confidence"))


@query(
    "characteristics",
    f"WITH {CANDIDATES_SQL} SELECT addr, (CASE WHEN is_symbol THEN 's' ELSE '-' END) || (CASE WHEN is_stub THEN 'u' ELSE '-' END) || "
    "(CASE WHEN refs > 0 THEN 'r' ELSE '-' END) || (CASE WHEN aligned > 0 THEN 'a' ELSE '-' END) AS characteristics FROM r",
)
def characteristics(spark, sf_dir):
    flags = [("s", F.col("is_symbol")), ("u", F.col("is_stub")), ("r", F.col("refs") > 0), ("a", F.col("aligned") > 0)]
    return _scored(spark, sf_dir).select("addr", candidates.characteristics(flags).alias("characteristics"))


@query(
    "cap_refs",
    """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS p
       FROM lineitem) WHERE p <= 5""",
)
def cap_refs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return candidates.cap_references(lines, ["l_partkey"], ["l_orderkey", "l_linenumber"], 5).drop("place")


@query(
    "tfidf_documents",
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
            c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
            d AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) + 1 AS n FROM documents)
       SELECT doc_id, round(coalesce(sum(tf * ln((n - df) / df)), 0), 4) AS tfidf FROM documents LEFT JOIN c USING (doc_id)
       LEFT JOIN d USING (term) CROSS JOIN n GROUP BY doc_id""",
)
def tfidf_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = text.term_counts(docs, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg((F.count("*") + 1).alias("n")).first()["n"]
    scored = text.tfidf(counts, "doc_id", F.lit(n), df)
    return docs.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.round(F.coalesce("tfidf", F.lit(0.0)), 4).alias("tfidf"))


@query(
    "string_runs",
    """SELECT doc_id, CAST(len(r) AS BIGINT) AS n, coalesce(list_max(list_transform(r, lambda x: length(x))), 0) AS longest
       FROM (SELECT doc_id, regexp_extract_all(text, '[ -~]{6,128}') AS r FROM documents)""",
)
def string_runs(spark, sf_dir):
    runs = text.printable_strings(F.col("text"))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(runs).cast("long").alias("n"), longest.alias("longest"))


@query("escape_values", "SELECT page_id, regexp_replace(url, '[0-9]', '?', 'g') AS escaped FROM pages")
def escape_values(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hashes.wildcard_digits(F.col("url")).alias("escaped"))


@query(
    "pic_hash",
    """SELECT l_orderkey AS fn, substring(sha256(string_agg(lower(to_hex(l_partkey // 16)) || '??', '' ORDER BY l_linenumber, l_partkey)), 1, 16)
       AS pic_hash FROM lineitem GROUP BY l_orderkey""",
)
def pic_hash(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fn"), "l_linenumber", "l_partkey")
    escaped = F.concat(F.lower(F.hex(F.floor(F.col("l_partkey") / 16).cast("long"))), F.lit("??"))
    found = hashes.sequence_hash(lines, ["fn"], ["l_linenumber", "l_partkey"], escaped)
    return found.select("fn", hashes.hex_of_u64(F.col("sha256")).alias("pic_hash"))


@query(
    "block_hash",
    """SELECT h AS block_hash, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM
       (SELECT doc_id, sha256(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]', '?', 'g')) AS h FROM documents)
       GROUP BY h HAVING count(*) > 1""",
)
def block_hash(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hashed = lines.select("doc_id", F.sha2(hashes.wildcard_digits(F.col("line")), 256).alias("block_hash"))
    return hashed.groupBy("block_hash").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n > 1")


@query(
    "identity_hash",
    """SELECT user_id, sha256(string_agg(x, '|' ORDER BY x)) AS sha256 FROM
       (SELECT user_id, event_type || ':' || CAST(event_id AS VARCHAR) AS x FROM events) GROUP BY user_id""",
)
def identity_hash(spark, sf_dir):
    item = F.concat(F.col("event_type"), F.lit(":"), F.col("event_id").cast("string"))
    return hashes.identity_hash(_events(spark, sf_dir), ["user_id"], item)


@query(
    "language_scores",
    """SELECT doc_id, CASE WHEN de >= fr AND de >= en AND de >= es THEN 'de' WHEN fr >= en AND fr >= es THEN 'fr' WHEN es >= en THEN 'es' ELSE 'en' END
       AS guess FROM (SELECT doc_id, len(regexp_extract_all(text, ' the ')) AS en, len(regexp_extract_all(text, ' que ')) AS es,
       len(regexp_extract_all(text, ' les ')) AS fr, len(regexp_extract_all(text, ' der ')) AS de FROM documents)""",
)
def language_scores(spark, sf_dir):
    marks = {"en": " the ", "es": " que ", "fr": " les ", "de": " der "}
    scores = {lang: F.regexp_count(F.col("text"), F.lit(mark)) for lang, mark in marks.items()}
    return table(spark, sf_dir, "documents").select("doc_id", text.language_score(scores).alias("guess"))


SCC_SQL = """WITH RECURSIVE f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
            e AS (SELECT DISTINCT a.user_id, a.event_type AS src, b.event_type AS dst FROM f a JOIN f b ON a.user_id = b.user_id AND b.k = a.k + 1),
            n AS (SELECT user_id, src AS v FROM e UNION SELECT user_id, dst FROM e),
            r AS (SELECT user_id, v AS src, v AS dst FROM n UNION SELECT r.user_id, r.src, e.dst FROM r JOIN e ON e.user_id = r.user_id AND e.src = r.dst)
       SELECT a.user_id, a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.user_id = b.user_id AND a.src = b.dst AND a.dst = b.src GROUP BY ALL"""


@query("scc_per_function", SCC_SQL)
@query("scc_all_events", SCC_SQL)
def scc_per_function(spark, sf_dir):
    """Components of each user's whole graph; registered under both names it has had."""
    return graph.scc(_edges(spark, sf_dir), "user_id")


NESTING_SQL = """WITH RECURSIVE f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
            e AS (SELECT DISTINCT a.user_id, a.event_type AS src, b.event_type AS dst FROM f a JOIN f b ON a.user_id = b.user_id AND b.k = a.k + 1),
            q AS (SELECT user_id, event_type AS root FROM f WHERE k = 1),
            n AS (SELECT user_id, src AS v FROM e UNION SELECT user_id, dst FROM e),
            d AS (SELECT n.user_id, n.v AS cut, q.root AS at FROM n JOIN q USING (user_id) WHERE n.v <> q.root UNION
                  SELECT d.user_id, d.cut, e.dst FROM d JOIN e ON e.user_id = d.user_id AND e.src = d.at AND e.dst <> d.cut),
            b AS (SELECT DISTINCT e.user_id, e.dst AS v FROM e JOIN (SELECT user_id, src FROM e GROUP BY ALL HAVING count(*) > 1) x
                  ON x.user_id = e.user_id AND x.src = e.src),
            p AS (SELECT n.user_id, n.v, c.v AS dom FROM n JOIN n c ON c.user_id = n.user_id
                  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = n.user_id AND d.cut = c.v AND d.at = n.v))
       SELECT user_id, max(k) AS nesting_depth FROM (SELECT p.user_id, p.v, count(b.v) AS k FROM p LEFT JOIN b ON b.user_id = p.user_id AND b.v = p.dom
       GROUP BY p.user_id, p.v) GROUP BY user_id"""


@query("nesting_depth", NESTING_SQL)
@query("nesting_all_events", NESTING_SQL)
def nesting_depth(spark, sf_dir):
    return graph.nesting(_edges(spark, sf_dir), _roots(spark, sf_dir), "user_id")


def _roots(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("root"))


@query(
    "closure_depth",
    """WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst FROM nation),
            r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.dst WHERE r.depth < 4)
       SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY src, dst""",
)
def closure_depth(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return graph.closure(edges, 4)


@query("resume_antijoin", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def resume_antijoin(spark, sf_dir):
    return sinks.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


KINDS = ["click", "view", "purchase", "signup", "error"]


@query(
    "pivot_ref_counts",
    "SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (event_type = '{k}') AS BIGINT) AS {k}" for k in KINDS) + " FROM events GROUP BY user_id",
)
def pivot_ref_counts(spark, sf_dir):
    return refs.reference_counts(_events(spark, sf_dir), "user_id", "event_type", KINDS)


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "format_dispatch",
    """SELECT coalesce(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (starts_with(html, '<!DOCTYPE')) AS BIGINT) AS marked FROM pages GROUP BY 1""",
)
def format_dispatch(spark, sf_dir):
    lang = F.coalesce(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit("")).alias("lang")
    marked = F.count_if(F.col("html").startswith("<!DOCTYPE")).alias("marked")
    return table(spark, sf_dir, "pages").groupBy(lang).agg(F.count("*").alias("n"), marked)


@query(
    "dot_graphs",
    f"""SELECT user_id, 'digraph {{' || chr(10) || string_agg(DISTINCT '  "' || src || '" -> "' || dst || '";', chr(10)
        ORDER BY '  "' || src || '" -> "' || dst || '";') || chr(10) || '}}' AS dot FROM ({EDGES_SQL}) WHERE dst IS NOT NULL GROUP BY user_id""",
)
def dot_graphs(spark, sf_dir):
    return sinks.dot_graphs(_edges(spark, sf_dir), "user_id")


@query(
    "stats_rollup",
    """SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, CAST(count(*) AS BIGINT) AS n
       FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
def stats_rollup(spark, sf_dir):
    rolled = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    star = lambda c, n: F.coalesce(F.col(c), F.lit("*")).alias(n)
    return rolled.select(star("o_orderstatus", "status"), star("o_orderpriority", "priority"), "n")
