"""Counts against a plain version; verdicts on planted junk."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from colloquy.llm import quality_rules as qr


def slow(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def texts():
    r = random.Random(2)
    out = [None, "", " \n\t", "a", "a b c d e", "a b c d e\na b c d e", "é#|\n\né#|\x0b é#|", "x " * 40, "a b c d e f a b c d e f a b", "    x"]
    for _ in range(120):
        out.append("".join(r.choice(["a", "b", "c", "dé", "😀"]) + r.choice([" ", "\n", "  ", "\t", " "]) for _ in range(r.randint(0, 60))))
    out.append(" ".join(f"w{i % 9001}" for i in range(20_000)))
    return out


def test_counts_equal_a_plain_version(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in qr.add_features(df, "text").collect()}
    for i, t in rows:
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == slow(t), (i, t)


def junk_and_prose(n=400):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(40, 200))]
        prose = " ".join(w.capitalize() if k % 9 == 0 else w + ("." if k % 9 == 8 else ",") * (k % 3 == 2) for k, w in enumerate(words))
        kind = i % 10
        rows.append((i, {0: " ".join(w.upper() + "!!" for w in words), 1: " ".join(w + "###" for w in words), 2: " | ".join(words), 3: (words[0] + " ") * 150}.get(kind, prose), kind < 4))
    return rows


def test_junk_goes_and_prose_stays(spark):
    rows = junk_and_prose()
    judged, model = qr.judge(spark.createDataFrame(rows, "doc_id long, text string, junk boolean"))
    assert judged.filter(F.col("junk") == F.col("kept")).count() == 0
    assert all(model.accuracy(n) > 0.6 for n in ("symbols", "prose", "exclaims"))
    assert 0.5 < model.good < 0.75


def test_posterior_is_bayes(spark):
    model = qr.VoteModel(["a", "b"])
    model.good = 0.7
    model.votes = {("a", 1): {1: 0.6, -1: 0.1, 0: 0.3}, ("a", -1): {1: 0.2, -1: 0.5, 0: 0.3}, ("b", 1): {1: 0.4, -1: 0.2, 0: 0.4}, ("b", -1): {1: 0.1, -1: 0.8, 0: 0.1}}
    rows = [(x, y) for x in (1, -1, 0) for y in (1, -1, 0)]
    df = spark.createDataFrame(rows, "a int, b int")
    for r in df.withColumn("p", model.posterior({n: F.col(n) for n in "ab"})).collect():
        g, b = (p * model.votes["a", c][r.a] * model.votes["b", c][r.b] for p, c in ((0.7, 1), (0.3, -1)))
        assert abs(r.p - g / (g + b)) < 1e-12


def test_columns_nulls_repeats_and_empty(spark):
    rows = [(1, "w " * 3, "k"), (1, "w " * 3, "k"), (None, None, None), *[(i, t, "k") for i, t, _ in junk_and_prose(40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = qr.filter_quality(df)
    assert out.columns == df.columns
    assert out.count() == 24
    assert qr.filter_quality(df.limit(0)).count() == 0
