"""Benchmark items of few words against brute force over token lists, and the registered query as a whole."""

from __future__ import annotations

import random
import re

from ferrule.llm import decontaminate
from ferrule.llm.common import table
from ferrule.llm.decontaminate import contaminated
from ferrule.llm.registry import QUERIES

ITEMS = {
    1: "Alice Smith met Bob Jones in Paris.",
    2: "Name 3 primes below 30.",
    3: "Compute 12 + 13 * 14 - 15.",
    4: "Paris",
    5: "is 7",
    6: "1 2 3 4 5 6 7 8 9 10 11 12",
    7: "?!",
}


def tokens(text):
    return re.findall(r"[a-z]+|[0-9]+", (text or "").lower())


def holds(doc, item):
    """Whether all windows of the item that count meet the document at one distance (items without template windows)."""
    doc, item = tokens(doc), tokens(item)
    size = min(8, len(item))
    windows = [(i, item[i : i + size]) for i in range(len(item) - size + 1)] if size else []
    good = [w for w in windows if sum(t.isalpha() for t in w[1]) >= 4]
    if not good and len(item) < 3:
        return bool(item) and doc == item
    return bool(windows) and any(all(d + i >= 0 and doc[d + i : d + i + size] == w for i, w in good or windows) for d in range(-len(item), len(doc)))


def found(spark, docs, items):
    rows = contaminated(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    )
    return {(r.doc_id, r.item_id) for r in rows.collect()}


def test_short_numeric_and_name_only_items(spark):
    docs = {i: f"some lines stand here before it. {t} and more of them follow" for i, t in ITEMS.items()}
    docs |= {20 + i: t for i, t in ITEMS.items()} | {30: "they went to Paris, as it is 7 now", 31: None, 32: "", 33: "Name 4 primes below 30.", 34: "paris!"}
    got = found(spark, docs, ITEMS)
    assert got == {(d, i) for d, t in docs.items() for i, item in ITEMS.items() if holds(t, item)}
    assert {(1, 1), (2, 2), (3, 3), (6, 6), (24, 4), (25, 5), (34, 4)} <= got and not {d for d, _ in got} & {4, 5, 7, 27, 30, 31, 32, 33}


def test_random_bare_items(spark, monkeypatch):
    rng = random.Random(11)
    gaps = [" ", ", ", "+", " - "]
    text = lambda n, words: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    numbers = ["1", "2", "30"]
    items = {i: text(rng.randrange(0, 13), numbers) + rng.choice(["", "then ", "so it "]) + text(rng.randrange(0, 3), numbers) for i in range(40)}
    docs = {i: text(rng.randrange(0, 9), [*numbers, "so", "it"]) + (items[rng.randrange(40)] if i % 2 else "") + text(rng.randrange(0, 3000 if i == 7 else 9), [*numbers, "then"]) for i in range(120)}
    first = {}
    for i in sorted(items, reverse=True):
        first[items[i]] = i
    want = {(d, i) for d, t in docs.items() for i, item in items.items() if first[item] == i and holds(t, item)}
    assert found(spark, docs, items) == want and len({d for d, _ in want}) > 30
    monkeypatch.setattr(decontaminate, "SENT", 0)
    assert found(spark, docs, items) == want


def test_registered_query_has_a_row_for_every_document(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    rows = QUERIES["op8_decontamination"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.contaminated == (r.n_items > 0) == (r.item_id is not None) == (r.n_matches > 0) for r in rows)
    whole = {d for d, t in docs.items() if any(holds(t, item) for item in items.values())}
    assert whole and whole <= {r.doc_id for r in rows if r.contaminated}
