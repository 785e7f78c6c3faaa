"""Ids beyond 2 ** 53 beside nulls of the same column: no operator may pass them through floats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ferrule.llm.decontaminate import contaminated
from ferrule.llm.media import packet_table, read_payloads, store_texts, stored_and_read
from ferrule.llm.near_dup import drop_near_duplicates, near_duplicates
from ferrule.llm.pieces import round_trip
from ferrule.llm.repeats import remove_repeats
from ferrule.llm.secrets import scan_secrets

BIG = 1 << 60
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
ROWS = [(BIG + 3, TEXT, BIG + 1), (BIG + 1, TEXT, None), (None, TEXT, BIG + 5), (BIG + 5, "other words", None), (None, None, None)]
IDS = {BIG + 3, BIG + 1, BIG + 5, None}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, more long").coalesce(1)


def ids(df) -> set:
    return {r.doc_id for r in df.collect()}


def test_near_duplicates(docs):
    found = near_duplicates(docs.select("doc_id", "text"), 4).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {
        (BIG + 3, BIG + 1), (BIG + 1, BIG + 1), (None, BIG + 1), (BIG + 5, BIG + 5), (None, None)
    }
    assert {(r.doc_id, r.more) for r in drop_near_duplicates(docs, 4).collect()} == {(BIG + 1, None), (BIG + 5, None), (None, None)}


def test_of_a_group_without_ids_one_text_stays(spark):
    rows = [(None, TEXT + " end"), (None, TEXT), (None, TEXT), (4, "alone")]
    kept = [r.text for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()]
    assert len(set(kept)) == 2 and "alone" in kept


def test_secrets_and_media(docs):
    assert ids(scan_secrets(docs)) == IDS
    assert {(r.doc_id, r.more) for r in scan_secrets(docs).collect()} == {(i, m) for i, _, m in ROWS}
    files = store_texts(docs)
    assert {(r.doc_id, r.more) for r in read_payloads(files).collect()} == {(i, m) for i, _, m in ROWS}
    assert ids(packet_table(files, "doc_id")) == IDS
    one = sorted(stored_and_read(docs).select("doc_id", "media_sha256", "feature").collect(), key=str)
    assert one == sorted(read_payloads(files).select("doc_id", "media_sha256", "feature").collect(), key=str)


def test_repeats(docs):
    lost = {(r.doc_id, sum(x.end - x.start for x in r.removed)) for r in remove_repeats(docs).collect()}
    size = len(TEXT)
    assert lost == {(None, 0), (BIG + 1, size), (BIG + 3, size), (BIG + 5, 0)}


def test_pieces_and_decontamination(spark, docs):
    back = round_trip(docs).collect()
    assert {r.doc_id for r in back} == IDS and all(r.decoded == (r.text or "") for r in back)
    items = spark.createDataFrame([(BIG + 9, TEXT)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(i, BIG + 9) for i in (BIG + 1, BIG + 3, None)}
    assert contaminated(docs.where(F.col("doc_id").isNull()), items).count() == 1
