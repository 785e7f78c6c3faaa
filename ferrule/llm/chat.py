"""Chat formatting in budgeted windows, with DataFrame functions only.

Each conversation is cut at turn borders: prefix sums of the turns' tokens decide greedily where a window ends, so
that its own turns fit into what the budget leaves beside the system turn and the repeated history (a single longer
turn gets a window of its own, whole). Every window starts with the system turn, then repeats the turns of the
window before it that fit into the history budget, then brings its own turns. The loss mask covers the assistant
turns that a window brings, never those it repeats, so each target counts once.

Template: a turn is ``<role>text</s>``. Inside roles and texts ``^`` ``<`` ``>`` ``[`` become ``^0`` ``^1`` ``^2``
``^3``, so no text can hold a control string such as ``</s>`` or ``[INST]``, and the escape is reversible.

Edge cases: null texts and roles are empty; a null conv_id is a conversation of its own; turns sort by (turn, role,
text), so ties and repeated rows have a fixed order and each counts; empty tables give empty results; columns other
than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the template.
END = "</s>"
ESCAPES = (("^", "^0"), ("<", "^1"), (">", "^2"), ("[", "^3"))
#: Tokens of a window, tokens of repeated history, tokens that a turn's marks take.
BUDGET, HISTORY, MARKS = 1024, 256, 4


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def estimated_tokens(text: Column) -> Column:
    """Four bytes a token, rounded up, and the turn's marks."""
    return (F.ceil(F.octet_length(text) / 4) + MARKS).cast("long")


def _window_starts(tokens: Column, room: Column) -> Column:
    """Indexes at which windows start: a turn opens one if it would overrun the room, told by prefix sums."""
    start = F.struct(
        F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i")
    )

    def step(acc, t):
        after = acc["sum"] + t
        opens = (acc["i"] > F.element_at(acc["starts"], -1)) & (after - acc["base"] > room)
        return F.struct(
            F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(opens, acc["sum"]).otherwise(acc["base"]).alias("base"),
            after.alias("sum"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["starts"])


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=estimated_tokens
) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss_spans (code points, end exclusive), n_repeated."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    convs = convs.withColumn("tok", F.transform("ts", lambda t: tokens(t["text"])))
    system = F.when(F.col("ts")[0]["role"] == "system", F.col("tok")[0]).otherwise(F.lit(0))
    convs = convs.withColumn("starts", _window_starts(F.col("tok"), F.lit(budget - history) - system))
    convs = convs.withColumn(
        "opens", F.map_from_arrays(F.col("starts"), F.transform("starts", lambda s: F.lit(1)))
    ).withColumn("n_windows", F.size("starts"))
    turn = convs.select("conv_id", "n_windows", "opens", F.posexplode(F.arrays_zip("ts", "tok")).alias("i", "x"))
    order = Window.partitionBy("conv_id").orderBy("i")
    turn = turn.select(
        "conv_id",
        "n_windows",
        "i",
        F.col("x.ts.role").alias("role"),
        F.col("x.ts.text").alias("text"),
        (F.sum(F.coalesce(F.element_at("opens", F.col("i")), F.lit(0))).over(order) - 1).cast("int").alias("w"),
        (F.sum("x.tok").over(order) - F.col("x.tok")).alias("before"),
        F.sum("x.tok").over(order).alias("after"),
    )
    ends = F.max("after").over(Window.partitionBy("conv_id", "w"))
    is_system = (F.col("i") == 0) & (F.col("role") == "system")
    repeats = ends - F.col("before") <= history
    places = (
        F.when(is_system, F.sequence(F.lit(0), F.col("n_windows") - 1))
        .when(repeats & (F.col("w") + 1 < F.col("n_windows")), F.array(F.col("w"), F.col("w") + 1))
        .otherwise(F.array(F.col("w")))
    )
    placed = turn.withColumn("places", places).select("conv_id", "i", "role", "text", "w", F.explode("places").alias("window"))
    own = F.col("window") == F.col("w")
    body = escape(F.col("text"))
    placed = placed.select(
        "conv_id",
        "window",
        F.struct(
            "i",
            F.concat(F.lit("<"), escape(F.col("role")), F.lit(">")).alias("head"),
            body.alias("body"),
            (own & (F.col("role") == "assistant")).alias("target"),
            (~own).alias("repeated"),
        ).alias("p"),
    )
    windows = placed.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    spans = F.aggregate(
        "ps",
        F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
        ),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(
                p["target"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(p["head"])).alias("start"),
                            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.size(F.filter("ps", lambda p: p["repeated"])).alias("n_repeated"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Conversations read back: conv_id, turns (role, text; repeated ones once), loss_texts, formatted_chars.

    Parses nothing but the output: the formatted strings, their loss spans and the count of repeated turns.
    """
    pieces = F.split("formatted", END)
    turns = F.transform(
        F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring_index(p, ">", 1).substr(F.lit(2), F.length(p))).alias("role"),
            unescape(p.substr(F.instr(p, ">") + 1, F.length(p))).alias("text"),
        ),
    )
    loss = F.transform(
        "loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"]))
    )
    parts = windows.select(
        "conv_id",
        F.struct(F.col("window"), turns.alias("turns"), loss.alias("loss")).alias("part"),
        F.length("formatted").alias("chars"),
    )
    return (
        parts.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"),
            F.flatten(F.transform("parts", lambda p: p["loss"])).alias("loss_texts"),
            "formatted_chars",
        )
    )


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Format all ``conversations`` and conversation -1, and digest what is read back from the output."""
    from ferrule.llm.common import table

    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probes = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    back = read_windows(format_windows(turns.unionByName(probes)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


OP10_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i,
         (strlen(text) + 3) // 4 + 4 AS tok,
         length(replace(replace(replace(replace(text, '^', '^0'), '<', '^1'), '>', '^2'), '[', '^3')) + 6
           + length(replace(replace(replace(replace(role, '^', '^0'), '<', '^1'), '>', '^2'), '[', '^3')) AS chars
  FROM t
), p AS (
  SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY i) AS after,
         768 - max(CASE WHEN i = 0 AND role = 'system' THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS room FROM n
), w AS (
  SELECT conv_id, i, after, 0 AS base, 0 AS w, after AS total FROM p WHERE i = 0
  UNION ALL
  SELECT p.conv_id, p.i, p.after, CASE WHEN p.after - w.base > p.room THEN w.after ELSE w.base END,
         CASE WHEN p.after - w.base > p.room THEN w.w + 1 ELSE w.w END, p.after
  FROM w JOIN p ON p.conv_id = w.conv_id AND p.i = w.i + 1
), x AS (
  SELECT p.conv_id, p.i, p.role, p.text, p.chars, w.w, max(w.w) OVER (PARTITION BY p.conv_id) AS last,
         max(p.after) OVER (PARTITION BY p.conv_id, w.w) - (p.after - p.tok) AS behind
  FROM p JOIN w ON w.conv_id = p.conv_id AND w.i = p.i
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars * CASE WHEN i = 0 AND role = 'system' THEN last + 1
                             WHEN w < last AND behind <= 256 THEN 2 ELSE 1 END) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""
