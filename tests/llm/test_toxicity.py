"""Toxicity: n-grams, ratios, the fit and the scores against plain forms; held-out accuracy; odd inputs."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import toxicity as tx

SYLLABLES = ["ba", "lo", "ki", "tre", "un", "so", "mi", "fa", "er", "ga"]
RUDE = ["grobnik", "klotz", "dummbart"]


def texts(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 80))]
        toxic = int(r.random() < 0.3)
        if toxic:
            words[r.randrange(len(words))] = r.choice(RUDE).upper() if r.random() < 0.3 else r.choice(RUDE)
        rows.append((i, " ".join(words), toxic))
    return rows


def plain_bucket(gram):
    mixed = 0
    for c in gram:
        mixed = ((mixed ^ ord(c)) * 0x9E3779B97F4A7C15) % 2**64
        mixed ^= mixed >> 29
    return (mixed * 0xBF58476D1CE4E5B9) % 2**64 >> (64 - tx.BUCKET_BITS)


def plain_buckets(text):
    found = set()
    for word in (text or "").lower().split():
        padded = f" {word} "
        found |= {plain_bucket(padded[i : i + n]) for n in tx.GRAMS for i in range(len(padded) - n + 1)}
    return found


@pytest.mark.parametrize("text", [None, "", "  \n ", "a", "Ab ab AB", "größe 你好 😀😀😀 x", "one two three two"])
def test_buckets_as_by_hand(text):
    assert set(tx.distinct_buckets(text).tolist()) == plain_buckets(text)


def test_buckets_of_long_words_and_texts(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice("abcdef") for _ in range(900)) + " " + " ".join("".join(r.choice("abc") for _ in range(9)) for _ in range(60))
    want = plain_buckets(text)
    for chunk in (7, 64, 1000):
        monkeypatch.setattr(tx, "CHUNK", chunk)
        assert set(tx.distinct_buckets(text).tolist()) == want


def test_places_as_by_hand(monkeypatch):
    rows = [t for _, t, _ in texts(40, 3)] + [None, "", "x" * 200 + " grobnik"]
    names = np.array(sorted({b for t in rows[:10] for b in plain_buckets(t)} | plain_buckets("grobnik")))
    features = tx.Features(names)
    for _ in range(2):
        assert features.of(rows) == [{int(np.searchsorted(names, b)) for b in plain_buckets(t) if b in set(names.tolist())} for t in rows]
        monkeypatch.setattr(tx, "MEMORY_WORDS", 3)


def test_fit_is_at_the_minimum():
    r = np.random.default_rng(5)
    rows, cols = np.nonzero(r.random((80, 12)) < 0.3)
    toxic = (r.random(80) < 0.4).astype(float)
    ratios = r.normal(size=12)
    w, b = tx.fit_scaled(rows, cols, toxic, ratios)

    def loss(w, b):
        total = 0.25 * float(w @ w)
        for i in range(80):
            z = b + sum(w[c] * ratios[c] for c in cols[rows == i])
            total += math.log1p(math.exp(-z if toxic[i] else z))
        return total

    least = loss(w, b)
    assert all(loss(w + d, b) > least - 1e-6 for k in range(12) for d in (1e-3 * (np.arange(12) == k), -1e-3 * (np.arange(12) == k)))
    assert loss(w, b + 1e-3) > least - 1e-6 and loss(w, b - 1e-3) > least - 1e-6


def test_counts_ratios_and_choice_as_by_hand(spark):
    rows = texts(150, 6)
    held = spark.createDataFrame([(t, x) for _, x, t in rows], "toxic int, body string").repartition(4)
    sets = [(plain_buckets(x), t) for _, x, t in rows]
    n1, n0 = sum(t for *_, t in rows), sum(1 - t for *_, t in rows)
    want = {b: (sum(b in s for s, t in sets if t), sum(b in s for s, t in sets if not t)) for b in set().union(*(s for s, _ in sets))}
    assert {r.gram: (r.toxic, r.other) for r in tx.gram_counts(held).collect()} == want
    chosen = set()
    for b, (a, c) in want.items():
        g = sum(2 * x * math.log(x * (n1 + n0) / (row * col)) for x, row, col in ((a, a + c, n1), (c, a + c, n0), (n1 - a, n1 + n0 - a - c, n1), (n0 - c, n1 + n0 - a - c, n0)) if x)
        if a + c >= tx.MIN_TEXTS and g >= tx.MIN_ASSOCIATION:
            chosen.add(b)
    assert {r.gram for r in tx.telling_grams(tx.gram_counts(held), n1, n0).collect()} == chosen
    model = tx.fit(spark.createDataFrame(rows, "doc_id long, text string, t int"), spark.createDataFrame([(i, t) for i, _, t in rows], "id long, toxic int"))
    assert set(model.names.tolist()) == chosen
    for b, ratio, weight in zip(model.names.tolist(), model.ratios, model.weights, strict=True):
        a, c = want[b]
        assert ratio == pytest.approx(math.log((a + 1) / (n1 + 2)) - math.log((c + 1) / (n0 + 2))) and math.isfinite(weight)


def test_held_out_texts(spark):
    rows = texts(1200, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string, t int")
    model = tx.fit(df, df.filter("doc_id < 700").select(F.col("doc_id").alias("id"), F.col("t").alias("toxic")))
    got = tx.add_scores(df.filter("doc_id >= 700"), model, "text", "score").collect()
    assert sum((r.score >= tx.TOXIC_AT) == (r.t == 1) for r in got) >= 0.98 * len(got)
    # Scores by hand, from the weights.
    weight = dict(zip(model.names.tolist(), model.weights.tolist(), strict=True))
    for r in got[:50]:
        z = model.bias + sum(weight.get(b, 0.0) for b in plain_buckets(r.text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_odd_inputs(spark):
    rows = texts(120, 8)
    odd = [(None, "grobnik", 0), (500, None, 0), (501, "", 0), (502, "   ", 0), (503, rows[0][1], 0), (503, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (500, None), (0, None), (0, rows[0][2])], "id long, toxic int")
    first, again = (tx.fit(df.repartition(n), labels) for n in (1, 5))
    assert (first.names == again.names).all() and np.allclose(first.weights, again.weights)
    with pytest.raises(ValueError, match="there already"):
        tx.add_scores(df, first, "text", "score")
    got = tx.add_scores(df, first, "text", "s").collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r.s for r in got}
    assert by[500] == by[501] == by[502] and by[503] == by[0] and all(0 <= r.s <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, text string")
    nothing = tx.fit(none, labels)
    assert tx.add_scores(none, nothing, "text", "s").collect() == []
    one_kind = tx.fit(df, labels.withColumn("toxic", F.lit(0)))
    assert all(r.s < 0.02 for r in tx.add_scores(df, one_kind, "text", "s").collect())


def test_query_rows(spark, tmp_path):
    rows = texts(300, 9)
    spark.createDataFrame([(i, x, "en") for i, x, _ in rows] + [(None, "klotz", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    # Labels of held-out rows are wrong on purpose: they must not be learned.
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    spark.createDataFrame([(i, 1, 1 - t if held(i) else t) for i, _, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in tx.op11_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 301 and not got[None].held_out
    assert all(got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.3) for i, *_ in rows)
    assert sum(got[i].predicted == t for i, _, t in rows) >= 0.93 * len(rows)
