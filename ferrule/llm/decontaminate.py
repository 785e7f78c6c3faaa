"""Benchmark decontamination by template canonicalisation.

A text becomes a row of template tokens: words in lower case, and typed placeholders for numbers, names (capitalised
words that do not open a sentence or follow an enumerator such as ``(a)``) and units (behind a number); neighbouring
numbers, and neighbouring names, share a placeholder unless a stop, a line break or an enumerator's bracket is between
them. Windows of ``WINDOW`` tokens with at least ``LITERALS`` words are hashed, and windows of documents join
the benchmark's on the hash. Matches on one diagonal (document place minus item place) form a candidate; it stands if
its slots are consistent, that is if one value of the item always meets one value in the document, and if it is long
enough: ``MATCHES`` windows, or all windows of a shorter item. Re-parameterised questions match like copies do. A value
on the edge of a window may have merged with what is before or behind the copy, so there the value, or what it ends or
begins with, must agree. Beside the template, windows of the plain words find items copied whole, whatever
the words around do to the placeholders; they need no slots. An item without any plain window of ``LITERALS`` words
(short, or mostly numbers) is bare: all its plain windows count, and all of them must meet the document, in their order. A
bare item of fewer than ``BARE`` tokens would be met by chance, so it must be the whole document.

The benchmark's windows are sent to the tasks, as a filter before the join, only if they are at most ``SENT`` rows;
otherwise all windows of the documents are joined.

Edge cases: null and empty texts have no windows; items of fewer tokens than a window are one window of their own
length; items without letters and digits are never matched; equal items count as the one with the smallest id; rows of
one doc_id and different texts share a verdict; rows without an id are judged by their text; an empty benchmark flags nothing;
texts of any length are read whole; further columns are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import bounded_batches, stage_table, table
from ferrule.llm.hashing import U64, mix, power_tables, run_hashes

WINDOW, LITERALS, MATCHES, BARE = 8, 4, 6, 3
#: Most benchmark windows that are sent to tasks; each takes 8 bytes.
SENT = 4 << 20

#: Units of measure and money, as text.
UNITS = (
    "mm cm m km kilometer kilometers kilometre kilometres meter meters metre metres mile miles inch inches foot feet ft yard yards "
    "mg g kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces ml l liter liters litre litres "
    "gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees kb mb gb tb hz khz mhz ghz watt watts volt volts kmh mph"
).split()

_KIND = np.zeros(256, np.int8)  # 0 separator, 1 letter, 2 digit
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2
_LOW = np.arange(256, dtype=np.uint64) + U64(1)
_LOW[65:91] += U64(32)
_CLOSE = np.zeros(256, bool)
_CLOSE[[41, 93]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 34, 46, 58, 63]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_GAPS = re.compile(r"[\x00-/:-@\[-`{-\x7f]+")
NUMBER, NAME, UNIT = (mix(np.array([k], np.uint64))[0] for k in (1, 2, 3))


def _word_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _plain_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    up, down = power_tables(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOW[raw] * up[: len(raw)], dtype=np.uint64)])
    return _word_hash(sums, down, np.array([0]), np.array([len(raw)]))[0]


_UNIT_HASHES = np.sort(np.array([_plain_hash(u) for u in UNITS], np.uint64))


class Template:
    """Template tokens of a text: hash, slot (0 word, 1 number, 2 name, 3 unit) and byte span of each; hashes of the plain tokens."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        kind = np.concatenate([[0], _KIND[raw], [0]])
        turn = np.flatnonzero(np.diff(kind))
        # a token runs from one change of kind to the next, separators left out
        which = np.flatnonzero(kind[turn + 1])
        start, end = turn[which], turn[which + 1]
        up, down = power_tables(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LOW[raw] * up[: len(raw)], out=sums[1:])
        hashes = _word_hash(sums, down, start, end)
        slot = np.zeros(len(start), np.int8)
        self.plain, self.letters = hashes, kind[start + 1] == 1
        if len(start):
            number = kind[start + 1] == 2
            stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
            before = np.concatenate([[0], end[:-1]])
            closes = np.concatenate([[0], np.cumsum(_CLOSE[raw])])
            listed = (closes[start] > closes[before]) & (before - np.concatenate([[0], start[:-1]]) <= 2)
            opens = (stops[start] > stops[before]) | listed
            opens[0] = True
            # a stop ends a sentence before white space only, unlike the one in 3.5
            hard = _STOP[raw] & (np.concatenate([raw[1:], [32]]) <= 32) | (raw == 10)
            halts = np.concatenate([[0], np.cumsum(hard)])
            apart = (halts[start] > halts[before]) | listed
            name = _UPPER[raw[start]] & ~opens & ~number
            slot[number], slot[name] = 1, 2
            after = np.flatnonzero(number[:-1] & ~number[1:]) + 1  # only these can be units
            spot = np.minimum(np.searchsorted(_UNIT_HASHES, hashes[after]), len(_UNIT_HASHES) - 1)
            slot[after[_UNIT_HASHES[spot] == hashes[after]]] = 3
            # neighbours of one slot share a placeholder
            again = (slot[1:] == slot[:-1]) & ((slot[1:] == 1) | (slot[1:] == 2)) & ~apart[1:]
            keep = np.concatenate([[True], ~again])
            last = np.concatenate([np.flatnonzero(keep)[1:] - 1, [len(slot) - 1]])
            hashes, slot, start, end = hashes[keep], slot[keep], start[keep], end[last]
            hashes = np.where(slot == 1, NUMBER, np.where(slot == 2, NAME, np.where(slot == 3, UNIT, hashes)))
        self.data, self.hashes, self.slot, self.start, self.end = data, hashes, slot, start, end

    def windows(self, length: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``length`` tokens, and which have words enough."""
        hashes = run_hashes(self.plain if plain else self.hashes, length)
        words = np.concatenate([[0], np.cumsum(self.letters if plain else self.slot == 0)])
        return hashes, words[length:] - words[: len(words) - length] >= LITERALS if len(hashes) else np.empty(0, bool)

    def slots(self, at: int, length: int) -> list[str]:
        """Values of the slots in a window, each behind its place (1 first, 2 last, 0 else) and its kind."""
        return [
            f"{1 if i == at else 2 * (i == at + length - 1)}{self.slot[i]} "
            + _GAPS.sub(" ", self.data[self.start[i] : self.end[i]].decode("utf-8", "replace").lower())
            for i in range(at, at + length)
            if self.slot[i]
        ]


#: A negative size marks windows of bare items.
_WINDOWS = "known boolean, id long, plain boolean, size int, at int, hash long, slots array<string>, n_windows int"
_NAMES = ["known", "id", "plain", "size", "at", "hash", "slots", "n_windows"]


def _item_windows(items: DataFrame) -> DataFrame:
    """Every window of every item, with the item's count of windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch["id"], batch["text"], strict=True):
                t = Template((text or "").encode())
                for plain, tokens in ((False, t.hashes), (True, t.plain)):
                    size = min(WINDOW, len(tokens))
                    hashes, good = t.windows(size, plain) if size else (np.empty(0, np.uint64), np.empty(0, bool))
                    bare = plain and not good.any()
                    good = np.ones(len(hashes), bool) if bare else good
                    rows += [
                        (True, ident, plain, -size if bare else size, int(i), int(hashes[i].astype(np.int64)), [] if plain else t.slots(i, size), int(np.sum(good)))
                        for i in np.flatnonzero(good)
                    ]
            yield pd.DataFrame(rows, columns=_NAMES)

    distinct = items.groupBy("text").agg(F.min("item_id").alias("id"))
    return distinct.select("id", "text").mapInPandas(run, _WINDOWS)


def _document_windows(docs: DataFrame, sizes: list[tuple[bool, int]], wanted: dict[bool, np.ndarray] | None) -> DataFrame:
    """Windows of documents of the given sizes; only wanted hashes if they are given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for known, ident, text in zip(batch["known"], batch["doc_id"], batch["text"], strict=True):
                if not text:
                    continue
                t = Template(text.encode())
                for plain, size in sizes:
                    hashes, good = t.windows(abs(size), plain)
                    if size < 0:
                        good = np.full(len(hashes), -size >= BARE or len(t.plain) == -size)
                    if wanted is not None and len(hashes):
                        if not len(wanted[plain]):
                            continue
                        spot = np.minimum(np.searchsorted(wanted[plain], hashes), len(wanted[plain]) - 1)
                        good &= wanted[plain][spot] == hashes
                    rows += [
                        (known, ident, plain, size, int(i), int(hashes[i].astype(np.int64)), [] if plain else t.slots(i, size), 0)
                        for i in np.flatnonzero(good)
                    ]
            yield pd.DataFrame(rows, columns=_NAMES)

    return docs.mapInPandas(run, _WINDOWS)


def _keyed(docs: DataFrame) -> DataFrame:
    """(known, doc_id, text): rows without an id go by a hash of their text, so that no number passes as null."""
    return docs.select(F.col("doc_id").isNotNull().alias("known"), _ident().alias("doc_id"), "text")


def _ident() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


#: Values that one value of the item may stand for: the one inside, or else what the first edge ends or begins with.
_CHOICES = """CASE WHEN inside IS NOT NULL THEN array(inside)
  WHEN size(firsts) > 0 THEN transform(sequence(2, size(split(firsts[0], ' '))), i -> ' ' || array_join(slice(split(firsts[0], ' '), i, 1 << 20), ' '))
  ELSE transform(sequence(2, size(split(lasts[0], ' '))), i -> array_join(slice(split(lasts[0], ' '), 1, i), ' ')) END"""
_AGREES = f"""inside IS NOT DISTINCT FROM inside_too AND exists({_CHOICES}, v ->
  forall(firsts, e -> endswith(e, v) OR endswith(v, e))
  AND forall(lasts, e -> startswith(e || ' ', v || ' ') OR startswith(v || ' ', e || ' ')))"""


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_matches): documents that hold an item, copied or re-parameterised."""
    found = _flagged(docs, items)
    return found.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "item_id", "n_matches")


def _flagged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(known, doc_id, item_id, n_matches) of keyed documents."""
    bounded_batches(docs.sparkSession)
    windows = stage_table(_item_windows(items.select("item_id", "text")), "item-windows")
    count, sizes = windows.agg(F.count("*"), F.collect_set(F.struct("plain", "size"))).first()
    wanted = None
    if count <= SENT:  # checked: at most SENT hashes reach the driver and the tasks
        sent = windows.select("plain", "hash").toPandas()
        wanted = {p: np.unique(sent["hash"][sent["plain"] == p].to_numpy(np.int64).view(np.uint64)) for p in (False, True)}
    if not count:
        return docs.sparkSession.createDataFrame([], "known boolean, doc_id long, item_id long, n_matches long")
    found = _document_windows(_keyed(docs), sorted(map(tuple, sizes)), wanted).drop("n_windows")
    found = found.withColumnsRenamed({"id": "doc_id", "at": "doc_at", "slots": "doc_slots"})
    matches = found.join(windows.drop("known").withColumnRenamed("id", "item_id"), ["plain", "size", "hash"])
    diagonal = ["known", "doc_id", "item_id", "plain", "place"]
    pairs = matches.withColumn("place", F.col("doc_at") - F.col("at")).where(F.size("slots") == F.size("doc_slots"))
    # a window's own row (no value) and a row per slot, so that one pass over the documents serves both
    own = F.array(F.struct(F.concat(F.lit("@"), F.col("at").cast("string")).alias("slots"), F.lit(None).cast("string").alias("doc_slots")))
    rows = pairs.select(*diagonal, "n_windows", F.explode(F.concat(own, F.arrays_zip("slots", "doc_slots"))).alias("v"))
    value, edge = F.expr("substring(v.doc_slots, 3)"), F.expr("substring(v.slots, 1, 1)")
    keyed = rows.groupBy(*diagonal, F.expr("if(v.doc_slots is null, v.slots, substring(v.slots, 2))").alias("key")).agg(
        F.max("n_windows").alias("n_windows"),
        F.min(F.when(edge == "0", value)).alias("inside"),
        F.max(F.when(edge == "0", value)).alias("inside_too"),
        F.collect_set(F.when(edge == "1", value)).alias("firsts"),
        F.collect_set(F.when(edge == "2", value)).alias("lasts"),
    )
    judged = keyed.groupBy(*diagonal).agg(
        F.count_if(F.col("key").startswith("@")).alias("n"),
        F.max("n_windows").alias("n_windows"),
        F.bool_and(F.col("key").startswith("@") | F.expr(_AGREES)).alias("agrees"),
    )
    sums = judged.where("agrees").groupBy("known", "doc_id", "item_id", "plain").agg(
        F.sum("n").alias("n"), F.max("n").alias("longest"), F.max("n_windows").alias("n_windows")
    )
    standing = sums.where(f"if(plain, longest >= n_windows, n >= least({MATCHES}, n_windows))")
    matched = F.coalesce(F.max(F.when(~F.col("plain"), F.col("n"))), F.max("n")).alias("n_matches")
    return standing.groupBy("known", "doc_id", "item_id").agg(matched)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs``, columns of any name, without the documents that hold a benchmark item."""
    gone = _flagged(docs.select("doc_id", "text"), items).select("known", "doc_id").distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNotNull().alias("known"), _ident().alias("doc_id"))
    return own.join(gone, ["known", "doc_id"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Check all ``documents`` against all of ``benchmark``: a row per document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = contaminated(docs, items).groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.min("item_id").alias("item_id"), F.sum("n_matches").alias("n_matches")
    )
    return docs.select("doc_id").join(hits, "doc_id", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        "item_id",
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
    )
