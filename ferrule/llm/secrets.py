"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

Three base kinds follow fixed patterns. Beside them, values in a wider credential context are priced, the keyword being
any part of an identifier: dynamic programming finds the cheapest segmentation of the value into dictionary words, dates,
repeats, keyboard walks and brute-force spans, costs being log10 of the guesses. Values that cost ``MIN_COST`` or more and
that no base span covers whole (but for closing punctuation) are added as spans of kind ``guess``; base spans always stay.

The dictionary is ``WORDS`` with the words of the scanned table itself by the number of rows that hold them: words of 3 to
32 letters in 2 rows or more, the ``COUNTED`` most frequent ones. What stands in a credential context is not counted, so
that a secret which is copied often does not become a word.

Offsets are code points, end exclusive. Edge cases: null and empty texts have no spans; ties of start go by kind as
listed; beside the dictionary every row is scanned on its own, so repeated rows repeat their result; values of any length are priced
whole; an empty table gives an empty result; further columns are carried unless they bear the name of an output.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferrule.llm.common import bounded_batches, table

#: Fixed patterns and least lengths of the base kinds, in their fixed order; ``guess`` comes last.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "guess")
#: Words without which neither pattern of an assignment can match.
CONTEXT_WORDS = ("passw", "passphrase", "pwd", "secret", "token", "api", "credential", "login")
_KEYWORDS = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|credential|login"
KEYWORD = re.compile(f"(?i:{_KEYWORDS})", re.ASCII)
#: The rest of an identifier behind its keyword: a plural, digits, _parts and camelCase parts.
REST = re.compile(r"s?(?:[_-][A-Za-z0-9_-]*|[0-9][A-Za-z0-9_-]*|(?<=[a-z])[A-Z][A-Za-z0-9_-]*)?", re.ASCII)
VALUE = re.compile(r"""["']?\]?[\x20\t]*(?:[:=]{1,2}>?|\bis\b:?)[\x20\t]*["']?([^\s"'<>,;]{6,})""", re.ASCII)
CLOSING = ".)]}:`"
MIN_COST = 9.0

#: Common password words by rank.
WORDS = (
    "password admin welcome dragon monkey letmein login master sunshine princess football shadow michael superman "
    "batman trustno hello freedom whatever secret summer winter spring autumn love test user guest root change "
    "default access token server database example sample demo key pass my the your this is not company house "
    # common words of prose about credentials
    "required incorrect invalid correct wrong valid missing expired empty optional needed used unused set unset reset changed "
    "stored saved sent given provided included encrypted hashed hidden visible public private shared unique unknown known "
    "authentication authorization authenticated authorized unauthorized identification verification verified validation "
    "account accounts username email address identifier client customer member session string number value values field "
    "characters letters digits length minimum maximum security secure insecure safe strong weak protected disabled enabled "
    "available unavailable accepted rejected denied granted allowed forbidden blocked locked unlocked revoked rotated refreshed "
    "temporary permanent automatically manually always never usually currently already only also because before after when "
    "case sensitive possible impossible necessary important different same generated created deleted removed replaced updated "
    "service system computer network internet website browser application program software device machine please contact "
    "support administrator manager bearer basic refresh placeholder undefined null none false true redacted removed confidential "
    "successful unsuccessful failed failure error working broken forgotten lost stolen leaked compromised exposed written printed"
).split()
RANK = {w: i + 1 for i, w in reversed([*enumerate(WORDS)])}
LONGEST_WORD = max(map(len, WORDS))
#: Most words of the table that are sent to tasks.
COUNTED = 1 << 17
#: Rows of the keyboard; a walk goes on to a neighbour in its row, either way.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:19|20)\d\d|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
PLACE = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}


def _brute_cost(c: str) -> float:
    """log10 of the size of the character's class."""
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


def _walk_ends(low: str) -> list[int]:
    """Per index, where the keyboard walk (steps of one key in a row, one direction) that starts there ends."""
    ends = list(range(1, len(low) + 1))
    step = [0] * len(low)
    for i in range(len(low) - 2, -1, -1):
        a, b = PLACE.get(low[i]), PLACE.get(low[i + 1])
        if a and b and a[0] == b[0] and abs(b[1] - a[1]) == 1:
            step[i] = b[1] - a[1]
            ends[i] = ends[i + 1] if step[i + 1] == step[i] else i + 2
    return ends


def _repeat_ends(value: str) -> list[int]:
    ends = list(range(1, len(value) + 1))
    for i in range(len(value) - 2, -1, -1):
        if value[i] == value[i + 1]:
            ends[i] = ends[i + 1]
    return ends


def guess_cost(value: str, ranks: dict[str, int] = RANK, longest: int = LONGEST_WORD) -> float:
    """log10 of the guesses that the cheapest segmentation of the value takes."""
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = value
    best = [0.0] + [math.inf] * n
    dates = {}
    for i in range(n):
        if value[i].isdigit() and (m := DATE.match(value, i)):
            dates[i] = m.end()
    walks, repeats = _walk_ends(low), _repeat_ends(value)
    for i in range(n):
        at = best[i]

        def offer(end: int, cost: float, at=at) -> None:
            best[end] = min(best[end], at + cost)

        offer(i + 1, _brute_cost(value[i]))
        for end in range(i + 2, min(n, i + longest) + 1):
            if rank := ranks.get(low[i:end]):
                shift = 0.0 if value[i:end] == low[i:end] else 0.3 if value[i + 1 : end] == low[i + 1 : end] else 1.0
                offer(end, math.log10(rank + 1) + shift)
        if i in dates:
            offer(dates[i], math.log10(150 * (365 if dates[i] - i > 4 else 1)))
        if walks[i] - i >= 3:
            offer(walks[i], math.log10(40 * (walks[i] - i)))
        if repeats[i] - i >= 3:
            offer(repeats[i], _brute_cost(value[i]) + math.log10(repeats[i] - i))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds: leftmost, not overlapping within a kind, too short ones dropped."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if any(w in (low := text.lower()) for w in ("passw", "secret", "token", "api")) and (":" in low or "=" in low):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(found)


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each value behind an identifier that holds a keyword."""
    at = 0
    while key := KEYWORD.search(text, at):
        at = REST.match(text, key.end()).end()  # keywords in the rest lead to the same value
        if m := VALUE.match(text, at):
            yield m.span(1)
            at = m.start(1)


def guess_spans(
    text: str, base: list[tuple[int, int, int]], ranks: dict[str, int] = RANK, longest: int = LONGEST_WORD
) -> list[tuple[int, int, int]]:
    """Values in a credential context that cost enough and that no base span covers whole."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found = {}
    for start, end in context_values(text):
        covered = any(s <= start < e and not text[e:end].strip(CLOSING) for s, _, e in base)
        if end not in found and not covered and guess_cost(text[start:end], ranks, longest) >= MIN_COST:
            found[end] = (start, 3, end)
    return list(found.values())


def word_ranks(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """``RANK`` with the words of the table by the number of rows that hold them, outside credential contexts."""
    plain = F.regexp_replace(text_col, rf"(?i)(?:{_KEYWORDS})\S*+(?:\s++\S++){{0,2}}", " ")
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(plain), r"[^\p{L}]+"))).alias("word"))
    counts = words.where(F.length("word").between(3, 32)).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    rows = counts.orderBy(F.desc("n"), "word").limit(COUNTED).collect()
    ranks = {r.word: i + 1 for i, r in enumerate(rows)}
    return ranks | {w: min(r, ranks.get(w, r)) for w, r in RANK.items()}


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: kind, start, end and, for guess spans, the cost of the value."""
    item = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("cost", T.DoubleType())]
    )
    bounded_batches(docs.sparkSession)
    rest = docs.drop("secrets")
    sent = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text_col))
    schema = T.StructType([*rest.schema, T.StructField("secrets", T.ArrayType(item))])

    arrow = to_arrow_schema(T.StructType([schema["secrets"]])).types[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        longest = max(map(len, ranks))
        for batch in batches:
            out = []
            for text in batch.column(text_col).to_pylist():
                text = text or ""
                base = base_spans(text)
                out.append(
                    [
                        {"kind": KINDS[k], "start": s, "end": e, "cost": guess_cost(text[s:e], ranks, longest) if k == 3 else None}
                        for s, k, e in sorted(base + guess_spans(text, base, ranks, longest))
                    ]
                )
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, "secrets"])

    return rest.mapInArrow(run, schema)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Scan every whole text of ``documents`` and digest the spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", line), ",").alias("spans"),
        count("guess"),
    )
