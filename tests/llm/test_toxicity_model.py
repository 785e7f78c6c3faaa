"""The toxicity model's log ratios against a brute-force pair of interpolated models over the same rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from ferrule.llm import toxicity as X


def brute_force(rows, texts, discount):
    """A function from a text to log P(text | toxic) - log P(text | ordinary) per word."""
    contexts = {(r.toxic, a, h, w) for r in rows for ws in [X.words_of(r.text)] for a, h, w in zip(["<s>"] * 2 + ws, ["<s>", *ws], ws)}
    word, pair, history = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for k, _, h, w in contexts:
        word[k][w] += 1
        pair[k][h, w] += 1
        history[k][h] += 1
    n = [sum(c.values()) for c in word]
    seen = Counter(w for t in texts for w in set(X.words_of(t)))
    spread = X.SHARED_DISCOUNT * len(seen) / (len(seen) + 1)

    def excess(own, other):
        return max(own - (own + other) / 2 * (1 + X.MARGIN) - discount, 0)

    def of_word(w):
        scaled = [word[0][w] * n[1] / n[0], word[1][w]]
        return [excess(scaled[k], scaled[1 - k]) / n[1] for k in (0, 1)]

    left = [1 - sum(of_word(w)[k] for w in set(word[0]) | set(word[1])) for k in (0, 1)]

    def lower(w):
        backoff = (max(seen[w] - X.SHARED_DISCOUNT, 0) + spread) / sum(seen.values())
        return [of_word(w)[k] + left[k] * backoff for k in (0, 1)]

    def of_pair(h, w):
        scaled = [pair[0][h, w] * history[1][h] / history[0][h], pair[1][h, w]]
        return [excess(scaled[k], scaled[1 - k]) / history[1][h] for k in (0, 1)]

    def chance(h, w):
        if h is None or not history[0][h] or not history[1][h]:
            return lower(w)
        follow = {x for k in (0, 1) for g, x in pair[k] if g == h}
        rest = [1 - sum(of_pair(h, x)[k] for x in follow) for k in (0, 1)]
        return [of_pair(h, w)[k] + rest[k] * lower(w)[k] for k in (0, 1)]

    def ratio(text):
        ws = X.words_of(text)
        odds = [chance(h, w) for h, w in zip([None, *ws], ws)]
        return sum(math.log(p[1] / p[0]) for p in odds) / len(ws)

    return ratio


def test_log_ratios_match_brute_force(spark):
    rng = random.Random(4)
    plain, rude = [f"w{i}" for i in range(30)], ["awful", "fool", "nasty"]
    rows = []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(25)]
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(25), rng.choice(rude))
            words += ["you", "fool"]
        else:
            words += ["you", rng.choice(plain)]
        rows.append((i, " ".join(words), i % 4 == 0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    assert model.word and model.pair
    fitted = [r for r in X._training_rows(docs, labels).collect() if not r.scales]
    probes = [t for _, t, _ in rows[:12]] + ["never seen words", "you fool", "w1"]
    models = [brute_force(fitted, [t for _, t, _ in rows], d) for d in X.DISCOUNTS]
    got = [model.log_ratio(t) for t in probes]
    assert any(got == pytest.approx([m(t) for t in probes], abs=1e-9) for m in models)
    assert model.log_ratio("") is None and model.score(None) == 0.0
    assert model.score("you fool awful nasty") > 0.5 > model.score(" ".join(plain))
