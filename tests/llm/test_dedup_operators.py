"""Near duplicates, repeated strings, line dedup and decontamination, against brute force and planted cases."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from ferrule.llm import decontaminate, near_dup, repeats
from ferrule.llm.common import table
from ferrule.llm.decontaminate import contaminated, drop_contaminated
from ferrule.llm.graphs import components
from ferrule.llm.line_dedup import MIN_WEIGHT, OP9_SQL, drop_repeated_lines, op9_line_dedup
from ferrule.llm.near_dup import OP2_SQL, drop_near_duplicates, near_duplicates, op2_near_duplicates
from ferrule.llm.repeats import brute_force, lcp_intervals, op6_repeats, remove_repeats

DOCS = "doc_id long, text string"


def words(rng: random.Random, n: int, vocabulary: int = 500) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng: random.Random, base: list[str], edits: int) -> list[str]:
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def oracle(sql: str, sf: str, tables: tuple[str, ...]) -> list[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    frame = con.execute(sql).df()
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


def rows_of(df) -> list[tuple]:
    frame = df.toPandas()
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


# --- near duplicates


def jaccard_components(docs: list[tuple], k: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for ident, text in docs:
        found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[ident] = {tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_fixture() -> list[tuple]:
    rng = random.Random(3)
    docs, ident = [], 0
    for group in range(12):
        base = words(rng, rng.randrange(40, 160))
        for copy in range(rng.randrange(1, 12)):
            docs.append((ident, " ".join(edited(rng, base, rng.randrange(0, 5)))))
            ident += 1
    chain = words(rng, 120)  # links in a chain: the ends are not similar, the component is one
    for _ in range(10):
        chain = edited(rng, chain, 2)
        docs.append((ident, " ".join(chain)))
        ident += 1
    docs += [(ident, None), (ident + 1, ""), (ident + 2, " \t\n"), (ident + 3, "one two"), (ident + 4, "ONE two"), (ident + 5, "one")]
    docs.append((ident + 6, " ".join(words(rng, 60_000, 10**6))))
    return docs


@pytest.mark.parametrize("k, long, block", [(4, near_dup.LONG, near_dup.BLOCK), (5, 1, 4)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, k, long, block):
    monkeypatch.setattr(near_dup, "LONG", long)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    docs = near_fixture()
    got = near_duplicates(spark.createDataFrame(docs, DOCS).repartition(5), k, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_components(docs, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("long", [near_dup.LONG, 1])
def test_near_duplicates_behind_passages_that_many_share(spark, monkeypatch, long):
    monkeypatch.setattr(near_dup, "LONG", long)
    rng = random.Random(11)
    passages = [words(rng, n, 10**6) for n in (50, 70, 90)]
    docs = []
    for ident in range(0, 240, 3):
        own = words(rng, rng.randrange(15, 60), 10**6)
        held = [p for p in passages if rng.random() < 0.6]
        base = [w for part in (*held, own) for w in part]
        docs += [(ident + k, " ".join(edited(rng, base, rng.randrange(0, 4)))) for k in range(rng.randrange(1, 4))]
    got = near_duplicates(spark.createDataFrame(docs, DOCS), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_components(docs, 5, 80)


def test_near_duplicates_with_repeated_rows_nulls_and_other_columns(spark):
    text = " ".join(map(str, range(30)))
    rows = [(None, text, 1), (5, text, 2), (5, text, 2), (7, text, 3), (8, None, 4), (9, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs.select("doc_id", "text")).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 5), (8, 8), (9, 9), (None, 5)]
    stay = drop_near_duplicates(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} >= {5, 8, 9} and 7 not in {r.doc_id for r in stay.collect()}
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_match_sql(spark, sf):
    assert rows_of(op2_near_duplicates(spark, sf)) == oracle(OP2_SQL, sf, ("documents",))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 400), (400, 300), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 400: 300, 500: 300}


# --- repeated strings


def repeat_fixture() -> dict[int, str]:
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh éñ\n") for _ in range(n))
    passages = [make(n) for n in (99, 100, 140, 260, 1500)]
    docs = {}
    for i in range(40):
        parts = [make(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages)[rng.randrange(0, 20) :], make(rng.randrange(0, 60))]
        docs[i] = "".join(parts)
    docs |= {50: docs[3], 51: docs[3], 52: "a" * 700, 53: "ab" * 400, 54: "a" * 450, 55: "", 56: passages[1], 57: passages[0]}
    return docs


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = repeat_fixture()
    df = spark.createDataFrame(list(docs.items()), DOCS).repartition(6)
    got = remove_repeats(df).selectExpr("doc_id", "n_bytes", "removed", "sha2(kept, 256) AS digest").collect()
    want = brute_force(docs)
    for r in got:
        assert (r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), r.digest) == want[r.doc_id], r.doc_id
    assert len(got) == len(docs)


def test_repeats_of_nulls_ties_and_empty_tables(spark):
    text = "".join(map(str, range(200)))
    rows = [(None, text), (1, text), (1, text), (2, None), (3, "")]
    got = remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    lost = sorted((str(r.doc_id), r.n_bytes, sum(x.end - x.start for x in r.removed)) for r in got)
    size = len(text)
    assert lost == [("1", size, size), ("1", size, size), ("2", 0, 0), ("3", 0, 0), ("None", size, 0)]
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_query_on_the_standard_table(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op6_repeats(spark, sf).collect()}
    assert got == brute_force(docs)


def test_intervals_of_common_prefixes():
    text = "banana"
    order = sorted(range(6), key=lambda i: text[i:])
    depth = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < 6 and text[a + n] == text[b + n]:
            n += 1
        depth.append(n)
    import numpy as np

    found = {(d, text[order[i] : order[i] + d]) for d, i, _ in lcp_intervals(np.array(depth), 1)}
    assert found == {(1, "a"), (3, "ana"), (2, "na")}


# --- lines


def lines_brute_force(docs: dict[int, str]) -> dict[int, str]:
    """Delete every line of every run that weighs enough and also starts earlier; all runs are tried."""
    seen, gone = set(), {i: set() for i in docs}
    for ident in sorted(docs):
        lines = docs[ident].split("\n")
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                run = tuple(lines[s:e])
                if sum(len(x) + 1 for x in run) >= MIN_WEIGHT:
                    if run in seen:
                        gone[ident] |= set(range(s, e))
                    seen.add(run)
    return {i: "\n".join(x for k, x in enumerate(docs[i].split("\n")) if k not in gone[i]) for i in docs}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    pool = ["", "a", "bb", "", "x" * 12, "y" * 25, "z" * 39, "q" * 40, "long " * 12]
    docs = {i: "\n".join(rng.choice(pool) + rng.choice(["", "", "!"]) for _ in range(rng.randrange(1, 14))) for i in range(60)}
    docs |= {70: docs[4], 71: "\n" * 90, 72: "", 73: "one line " * 9, 74: "one line " * 9}
    got = drop_repeated_lines(spark.createDataFrame(list(docs.items()), DOCS).repartition(5)).collect()
    assert {r.doc_id: r.text for r in got} == lines_brute_force(docs)


def test_line_dedup_of_nulls_ties_and_other_columns(spark):
    text = "some line that is long enough to count as a run\nend"
    rows = [(None, text, "x"), (1, text, "y"), (1, text, "y"), (2, None, "z"), (3, "", None)]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, gone string"))
    assert got.columns[:2] == ["doc_id", "text"] and got.count() == 5
    texts = sorted(((r.doc_id, r.text, r.n_deleted) for r in got.collect()), key=str)
    assert texts == sorted([(None, text, 0), (1, "", 2), (1, "", 2), (2, None, 0), (3, "", 0)], key=str)
    assert drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_matches_sql_and_is_native(spark, sf):
    df = op9_line_dedup(spark, sf)
    assert rows_of(df) == oracle(OP9_SQL, sf, ("documents",))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- benchmark


ITEM = (
    "A farmer named Alice sells 12 baskets of apples at the market every morning and earns 30 dollars. "
    "How much money does the farmer named Alice earn after she sells 12 baskets on 7 days"
)


def test_copies_and_new_parameters_are_found(spark):
    def story(name, baskets, pay, again, days):
        return (
            f"A farmer named {name} sells {baskets} baskets of apples at the market every morning and earns {pay} dollars. "
            f"How much money does the farmer named {again} earn after she sells {baskets} baskets on {days} days"
        )

    filler = "it was a quiet evening near the river and nobody said a word about it for a while. " * 40
    cases = {
        1: ITEM,
        2: filler + ITEM + " " + filler,
        3: filler + story("Bob", 450, 9, "Bob", 31),
        4: filler,
        5: "A farmer sells apples at the market.",
        6: None,
        7: "",
        8: ITEM.upper().lower(),  # no capitals, so no names: windows without names match still
    }
    docs = spark.createDataFrame([(i, t, "e") for i, t in cases.items()] + [(None, ITEM, "e"), (None, filler, "e")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, "too short"), (13, None), (14, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    # a row without an id is judged by its text
    assert {(1, 10), (2, 10), (3, 10), (None, 10)} <= found and not {i for i, _ in found} & {4, 5, 6, 7}
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {4, 5, 6, 7} <= {r.doc_id for r in kept.collect()}
    assert [r.text for r in kept.collect() if r.doc_id is None] == [filler]
    assert contaminated(docs, items.limit(0)).count() == 0 and contaminated(docs.limit(0), items).count() == 0


def test_slots_must_agree(spark):
    item = "take 5 of the red stones and then put 5 of the blue stones into the box before you close it for the winter"
    same = item.replace("5", "8")
    torn = item.replace("take 5", "take 8").replace("put 5", "put 9")
    docs = spark.createDataFrame([(1, same), (2, torn)], DOCS)
    got = {r.doc_id for r in contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1}


ALICE = "If Alice buys 12 apples and gives 5 of them to her brother, does Alice still have enough to bake the pie for school?"
BOXES = "12 boxes are on the truck and the driver takes 12 pens from each of them before lunch, how many are left over?"
SHORT = "If Alice buys 12 apples, does Alice eat the rest?"


@pytest.mark.parametrize("lead", ["", "(a) ", "Q3) ", "3. ", "3) ", "7, ", "Bob said, ", "see page 4\n", "No. 5: ", "as Carol knows "])
def test_numbered_and_lettered_copies_are_found(spark, lead):
    items = {1: ALICE, 2: BOXES, 3: SHORT}
    rows = [(i, f"text before it. {lead}{t} Then 9 more words follow") for i, t in items.items()]
    other = {1: ALICE.replace("Alice", "Bob Jones").replace("12", "31"), 2: BOXES.replace("12", "40")}
    rows += [(10 + i, f"{lead}{t}") for i, t in other.items()]
    rows += [(20, lead + ALICE.replace("does Alice", "does Carol")), (21, lead + BOXES.replace("12 pens", "13 pens"))]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert {(1, 1), (2, 2), (3, 3), (11, 1), (12, 2)} <= got and not {d for d, _ in got} & {20, 21}


def test_benchmark_too_large_to_send_gives_equal_rows(spark, sf, monkeypatch):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    sent = {tuple(r) for r in contaminated(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "SENT", 0)
    assert sent and {tuple(r) for r in contaminated(docs, items).collect()} == sent


def test_every_copied_item_is_found(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    want = {i for i, t in docs.items() if any(x in t for x in items.values() if len(x.split()) >= 12)}
    got = {r.doc_id for r in contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).collect()}
    assert want and want <= got
