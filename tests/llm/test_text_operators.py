"""Toxicity, sharding, secrets, media, pieces, chat and the pipeline: exact round trips, brute force, held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
from collections import Counter

import duckdb
import pytest

from ferrule.llm import media, secrets
from ferrule.llm.chat import OP10_SQL, escape, format_windows, op10_chat_formatting, read_windows, unescape
from ferrule.llm.common import table
from ferrule.llm.hashing import shingle_set
from ferrule.llm.pieces import decode_pieces, encode_pieces, lattice, MODEL
from ferrule.llm.sharding import op3_sharding, write_shards
from ferrule.llm.toxicity import op1_toxicity, score_toxicity

DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n", "é ü 漢字 \U0001f600", "▁ literal", "  two  spaces ", "tab\tand\r\nline", "x" * 300_000, "word " * 50_000]


# --- toxicity


def test_toxicity_on_held_out_rows(spark):
    scored = op1_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = table(spark, "/root/testdata/sf0.01", "labels").dropna().toPandas()
    both = scored[scored["held_out"]].merge(labels, on="doc_id")
    assert scored["score"].between(0, 1).all() and ((scored["score"] >= 0.5) == (scored["predicted"] == 1)).all()
    assert both["toxic"].sum() > 3 and (both["predicted"] == both["toxic"]).mean() > 0.9


def test_toxicity_edge_cases(spark):
    rng = random.Random(9)
    both, bad, good = "some words that all texts share".split(), "vile stupid fool hate scum".split(), "quiet river mill garden".split()
    rows = [(i, " ".join(rng.choices(both * 2 + (bad if i % 2 else good) * 2, k=40)), i, "e") for i in range(400)]
    bad = " ".join(bad)
    rows += [(1000 + k, t, 0, None) for k, t in enumerate(ODD)] + [(None, bad, 1, None), (3, rows[3][1], 3, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5, None), (7, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels)
    assert got.count() == len(rows) and sorted(got.columns) == ["doc_id", "lang", "predicted", "score", "text"]
    for r in got.where("doc_id < 400").collect():
        assert r.predicted == r.doc_id % 2
    assert all(r.predicted == 0 for r in got.where("trim(coalesce(text, '')) = ''").collect())
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), labels).count() == 0


# --- sharding


def test_shards_hold_every_row_once(spark):
    rows = [(i, f"text {i}" * (i % 50), "p", i) for i in range(300)] + [(7, None, "p", 1), (7, "", "p", 2), (None, "n", None, 3), (8, "r", "p", 4), (8, "r", "p", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string, slot long")
    out = write_shards(docs, bucket_bytes=4_000).cache()
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((a, b) for a, b, _, _ in rows), key=str)
    for shard, own in itertools.groupby(sorted(out.collect(), key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert [r.slot for r in own] == list(range(out.where(f"shard = {shard}").count()))
    assert all(r.grown_shard in (r.shard, 8) for r in out.collect()) and out.where("grown_shard = 8").count() > 0
    again = write_shards(docs.repartition(7), bucket_bytes=4_000)
    place = lambda df: sorted(((r.doc_id, r.text, r.shard, r.slot) for r in df.collect()), key=str)
    assert place(again) == place(out)
    assert write_shards(docs.limit(0)).count() == 0


def test_sharding_query(spark, sf):
    got = op3_sharding(spark, sf)
    assert got.count() == table(spark, sf, "documents").count() == got.select("shard", "slot").distinct().count()


# --- secrets


def cheapest(value: str) -> float:
    """Brute force over all segmentations, each segment priced as a whole."""
    price = {}
    for i, j in itertools.combinations(range(len(value) + 1), 2):
        part = value[i:j]
        costs = [sum(secrets._brute_cost(c) for c in part)]
        if (rank := secrets.RANK.get(part.lower())) and len(part) > 1:
            plain, first = part == part.lower(), part[1:] == part[1:].lower()
            costs.append(secrets.math.log10(rank + 1) + (0.0 if plain else 0.3 if first else 1.0))
        price[i, j] = min(costs)
    best = [0.0] + [9e9] * len(value)
    for j in range(1, len(value) + 1):
        best[j] = min(best[i] + price[i, j] for i in range(j))
    return best[-1]


@pytest.mark.parametrize("value", ["password", "Dragonmonkey", "xpasswordx", "LETMEINnow", "zkvu", "m-y/k.e"])
def test_guess_costs_of_words_match_brute_force(value):
    assert abs(secrets.guess_cost(value) - cheapest(value)) < 1e-9


def test_guess_costs_know_dates_walks_and_repeats():
    cost = secrets.guess_cost
    assert cost("20240131") < cost("83640917") and cost("qwertyui") < cost("qmzbtavk") and cost("aaaaaaaa") < cost("akdlqpwz")
    assert cost("") == 0 and cost("x" * 5_000) < cost("xy" * 2_500)


def test_base_spans_follow_the_patterns():
    rng = random.Random(4)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", '"', "'", " ", ":", "=", "abc123DEF456", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "ſecret", "\n", "x"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        pattern = r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        ci = re.sub("[a-z]+(?=[|)_?])|(?<=\\?)key", lambda m: "".join(f"[{c}{c.upper()}]" for c in m[0]), "(password|passwd|secret|token|api_?key)")
        assign = re.compile(ci + pattern[pattern.index("[\"']") :])
        want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert secrets.base_spans(text) == sorted(want), text


def test_secret_scan_rows(spark):
    texts = [*ODD, "password: 'hunter2hunter2x' and login is Xk93!fQz&81t", "pwd=password1", "token=short"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, secrets string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in secrets.scan_secrets(docs).collect()}
    assert len(got) == len(texts) and got[0] == got[1] == got[len(texts) - 1] == got[len(texts) - 2] == []
    text = texts[len(ODD)]
    assert [(k, text[s:e]) for k, s, e in got[len(ODD)]] == [("assign", "password: 'hunter2hunter2x"), ("guess", "Xk93!fQz&81t")]
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


SECRETS = ["DB_PASSWORD=Xk93!fQz&81t", "user_token: Zq8#vLw2@pRx", "AUTH_TOKEN=k$9Vb!2nQz&7", "secret_key = Qv7!xTz@41Lm", "apiKeyProd: 'Wz5%kTq9!bXv'", 'config["password"] = "Jx4^mQz8&vLt"', "token: 0123456789abcdef!Qz9#kV"]
PROSE = ["The password is incorrect.", "Your login is required", "token: authentication", "The secretary is somewhere", "A login is unavailable."]


def test_secrets_in_identifiers_and_words_in_prose(spark):
    rare = ["password is zanquiverto", "we met a zanquiverto in may", "the zanquiverto slept", "mind the zanquiverto"]
    copied = ["login: wqzkvbtrnplm"] * 3
    texts = [*SECRETS, *PROSE, *rare, *copied, "secret_" * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.secrets if s.kind == "guess"] for r in secrets.scan_secrets(docs).collect()}
    for i, text in enumerate(SECRETS):
        assert len(got[i]) == 1 and text.rstrip("'\"").endswith(got[i][0]) and len(got[i][0]) >= 11, text
    assert [got[i] for i in range(len(SECRETS), len(SECRETS) + len(PROSE) + len(rare))] == [[]] * (len(PROSE) + len(rare))
    assert [got[len(texts) - k] for k in (2, 3, 4)] == [["wqzkvbtrnplm"]] * 3


# --- media


@pytest.mark.parametrize("lacing", [media.NO_LACE, media.XIPH_LACE, media.FIXED_LACE, media.EBML_LACE])
def test_lacing_round_trips(lacing):
    rng = random.Random(lacing)
    sizes = [300] if lacing == media.NO_LACE else [77] * 5 if lacing == media.FIXED_LACE else [rng.randrange(1, 20_000) for _ in range(9)]
    frames = [rng.randbytes(n) for n in sizes]
    body = media.element(media.SEGMENT, media.element(media.CLUSTER, media.number(media.CLUSTER_TIMESTAMP, 700) + media.laced_block(130, -5, frames, lacing)))
    got = media.demux(body)
    assert got.fault is None and [body[p.offset : p.offset + p.size] for p in got.packets] == frames
    assert {(p.track, p.timestamp) for p in got.packets} == {(130, 695)}


def test_unknown_sizes_and_block_groups():
    frame = b"payload"
    block = media.element(media.BLOCK, media.vint(1) + struct.pack(">hB", 3, 0) + frame)
    cluster = media.number(media.CLUSTER_TIMESTAMP, 10) + media.element(media.BLOCK_GROUP, block)
    data = media.SEGMENT.to_bytes(4, "big") + b"\xff" + media.element(media.CLUSTER, cluster)
    (packet,) = media.demux(data).packets
    assert data[packet.offset : packet.offset + packet.size] == frame and packet.timestamp == 13
    assert media.demux(data[:-3]).fault and media.demux(b"\0\0").fault and not media.demux(b"").packets


def test_scales_references_live_clusters_and_faults(spark):
    simple = lambda t, frame: media.element(media.SIMPLE_BLOCK, media.vint(1) + struct.pack(">hB", t, 128) + frame)
    block = media.element(media.BLOCK, media.vint(1) + struct.pack(">hB", 4, 0) + b"delta")
    info = media.element(media.INFO, media.number(media.TIMESTAMP_SCALE, 500_000))
    group = media.element(media.BLOCK_GROUP, block + media.element(media.REFERENCE_BLOCK, b"\xff"))
    open_cluster = media.CLUSTER.to_bytes(4, "big") + b"\xff"
    live = b"".join(open_cluster + media.number(media.CLUSTER_TIMESTAMP, 10 * n) + simple(2, b"key") for n in range(3000))
    data = media.SEGMENT.to_bytes(4, "big") + b"\xff" + info + live + group
    got = media.demux(data)
    assert got.fault is None and got.clusters == 3000 and len(got.packets) == 3001
    assert [(p.timestamp, p.keyframe, p.cluster) for p in got.packets[:3]] == [(1, True, 0), (6, True, 1), (11, True, 2)]
    assert (got.packets[-1].timestamp, got.packets[-1].keyframe) == ((29_990 + 4) // 2, False)
    files = spark.createDataFrame([(1, data), (2, data[:-3]), (4, None)], "id long, media binary")
    rows = media.packet_table(files, "id").groupBy("id").agg({"byte_size": "count", "fault": "max"}).collect()
    found = {r["id"]: (r["count(byte_size)"], r["max(fault)"] is not None) for r in rows}
    assert found == {1: (3001, False), 2: (3000, True)}


def test_texts_survive_storage(spark):
    rows = [(i, t, "c") for i, t in enumerate([*ODD, ODD[4], "z" * 192, "z" * 193])] + [(None, "n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    stored = media.store_texts(docs)
    back = media.read_payloads(stored)
    for r in back.join(docs.select("doc_id", "text"), "doc_id").collect():
        data = (r.text or "").encode()
        padded = data.ljust(192 * max(1, -(-len(data) // 192)))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.fault) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), None)
    assert back.count() == len(rows) and back.where("doc_id in (4, 10)").select("media_sha256", "feature").distinct().count() == 1
    packets = media.packet_table(stored.where("doc_id = 8"), "doc_id").collect()
    file = bytes(stored.where("doc_id = 8").first().media)
    assert b"".join(file[p.byte_offset : p.byte_offset + p.byte_size] for p in packets).rstrip() == b"x" * 300_000
    assert media.read_payloads(media.store_texts(docs.limit(0))).count() == 0
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert media.packet_table(broken, "doc_id").count() == 0 and media.read_payloads(broken).count() == 2


# --- pieces


def test_pieces_are_lossless_and_reproducible(spark):
    rows = [(i, t, "c") for i, t in enumerate(ODD)] + [(None, "no key", None), (4, ODD[4], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    one, two = encode_pieces(docs).cache(), encode_pieces(docs.repartition(3))
    for r in decode_pieces(one).collect():
        assert r.decoded == (r.text or "") and bool(r.piece_ids) == bool(r.text)
    ids = lambda df: sorted((str(r.doc_id), r.text or "", list(r.piece_ids)) for r in df.collect())
    assert ids(one) == ids(two) and ids(encode_pieces(docs, seed=8)) != ids(one)
    assert encode_pieces(docs.limit(0)).count() == 0


def test_samples_follow_the_lattice():
    """Shares of the segmentations of a short word against the enumeration of all its paths."""
    own, word = lattice(MODEL), " hello"
    weight = {own.bytes[i].decode(): own.piece_weights[i] for i in range(len(own.bytes)) if own.piece_weights[i] > 0}
    paths = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[last:i])
                last = i
        parts.append(word[last:])
        if all(p in weight for p in parts):
            total = 1.0
            for p in parts:
                total *= weight[p]
            paths[tuple(parts)] = total
    every = sum(paths.values())
    n = 20_000
    seen = Counter(tuple(own.bytes[i].decode() for i in ids) for ids in own.encode(["hello"] * n, list(range(n))))
    assert set(seen) <= set(paths)
    for path, total in paths.items():
        share = total / every
        assert abs(seen[path] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-4


# --- chat


def test_escapes_hide_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "^1^^0", "<<^>>", "", "[[", "^"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape("t").alias("e"), unescape(escape("t")).alias("u"))
    for r in got.collect():
        assert r.u == r.t and not re.search(r"[<>\[]", r.e)


def test_windows_keep_budget_order_and_targets(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(30):
        turns = [("system", "s" * rng.randrange(0, 200))] if conv % 3 else []
        turns += [(("user", "assistant")[k % 2], rng.choice(["</s>", "<assistant>", "é", "t "]) * rng.randrange(0, 700)) for k in range(rng.randrange(1, 20))]
        rows += [(conv, k, role, text) for k, (role, text) in enumerate(turns)]
    rows += [(100, 0, None, None), (100, 0, "user", "tie"), (None, 1, "assistant", "no id"), (101, 0, "assistant", "long " * 40_000), (102, 3, "user", "same"), (102, 3, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = format_windows(df)
    said = {}
    for conv, k, role, text in rows:
        said.setdefault(conv, []).append((k, role or "", text or ""))
    for r in read_windows(windows).collect():
        want = [(role, text) for _, role, text in sorted(said[r.conv_id], key=lambda t: t)]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss_texts == [text for role, text in want if role == "assistant"]
    assert format_windows(df.limit(0)).count() == 0
    tokens = lambda s: -(-len(unescape_py(s).encode()) // 4) + 4
    for r in windows.collect():
        parts = [p.split(">", 1)[1] for p in r.formatted.split("</s>")[:-1]]
        assert sum(map(tokens, parts)) <= 1024 or len(parts) - r.n_repeated == 1


def unescape_py(text: str) -> str:
    for plain, code in (("[", "^3"), (">", "^2"), ("<", "^1"), ("^", "^0")):
        text = text.replace(code, plain)
    return text


def test_chat_query_matches_sql_and_is_native(spark, sf):
    df = op10_chat_formatting(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want, got = con.execute(OP10_SQL).df(), df.toPandas()
    normal = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert normal(got) == normal(want)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# --- shared, and the pipeline


def test_shingles_are_sets_of_word_runs():
    assert len(shingle_set(None, 4)) == len(shingle_set(" \n", 4)) == 0 and len(shingle_set("a b", 4)) == 1
    assert len(shingle_set("a b c d e a b c d", 4)) == 5
    assert list(shingle_set("A b\tC d", 4)) == list(shingle_set("a  B c D ", 4))


def test_pipeline_keeps_clean_rows_and_columns(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    out = corpus_pipeline.run(spark, sf).cache()
    assert out.columns[: len(docs.columns)] == docs.columns and out.where("not lossless").count() == 0
    ids = {r.doc_id for r in out.collect()}
    assert ids <= {r.doc_id for r in docs.collect()} and len(ids) > docs.count() / 3
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, kept, sf)
        assert left.columns == docs.columns and left.count() <= kept.count()
        kept = left.cache()
    assert {r.doc_id for r in kept.collect()} == ids


def test_all_ten_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
