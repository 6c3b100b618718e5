"""Ordinal regression: gradients, held-out accuracy, odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import quality_classifier as qc


def graded(n, seed):
    """Texts of four grades: each grade adds its own cue words to common ones."""
    r = random.Random(seed)
    common = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        grade = r.randrange(4)
        cues = [f"cue{k}" for k in range(3) if k < grade]
        rows.append((i, " ".join(r.choice(common) for _ in range(60)) + " " + " ".join(f"{c}, {c}s" for c in cues), grade))
    return rows


def test_held_out_grades(spark):
    rows = graded(900, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    ratings = df.filter("doc_id < 600").select(F.col("doc_id").alias("id"), "grade")
    model = qc.fit(df, ratings, 4)
    assert model.thresholds == sorted(model.thresholds)
    got = qc.add_grades(df.filter("doc_id >= 600"), model, "text", "expected", "top").collect()
    assert np.mean([abs(r.expected - r.grade) for r in got]) < 0.3
    assert np.mean([(r.top >= 0.5) == (r.grade == 3) for r in got]) > 0.95


def test_gradient_is_the_loss_slope():
    r = np.random.default_rng(4)
    rows, cols, grades = r.integers(0, 40, 160), r.integers(0, 12, 160), r.integers(0, 4, 40)
    pairs = np.unique(np.stack((rows, cols), axis=1), axis=0)
    w, theta = r.normal(size=12), np.array([-1.0, 0.2, 1.5])
    loss = lambda w, t: qc.loss_and_gradient(pairs[:, 0], pairs[:, 1], grades, w, t)[0]
    _, by_w, by_theta = qc.loss_and_gradient(pairs[:, 0], pairs[:, 1], grades, w, theta)
    e = 1e-6
    for k in range(12):
        d = e * (np.arange(12) == k)
        assert abs((loss(w + d, theta) - loss(w - d, theta)) / (2 * e) - by_w[k]) < 1e-6
    for k in range(3):
        d = e * (np.arange(3) == k)
        assert abs((loss(w, theta + d) - loss(w, theta - d)) / (2 * e) - by_theta[k]) < 1e-6


def test_repeated_ids_and_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (1, "a b"), (2, "e")], "doc_id long, TEXT string")
    ratings = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "id long, grade int")
    first, again = (qc.fit(docs.repartition(n), ratings, 2) for n in (1, 3))
    assert first == again
    assert qc.add_grades(docs, first, "text", "e", "t").columns == ["doc_id", "TEXT", "e", "t"]
    with pytest.raises(ValueError, match="there already"):
        qc.add_grades(docs, first, "text", "Text", "t")


def test_tails_are_ordered_and_bounded():
    model = qc.OrdinalModel({1: 2.0}, [-1.0, 0.5, 2.0])
    tails = model.tails(np.linspace(-9, 9, 50))
    assert (np.diff(tails, axis=1) <= 0).all() and (tails >= 0).all() and (tails <= 1).all()


def test_selection_is_the_same_in_both_places(spark):
    r = random.Random(8)
    buckets = [np.array(sorted(r.sample(range(40), 8))) for _ in range(300)]
    grades = np.array([int(3 in b) + int(7 in b) for b in buckets])
    held = spark.createDataFrame([(int(g), b.tolist()) for g, b in zip(grades, buckets, strict=True)], "grade int, buckets array<int>")
    got = {x.bucket for x in qc.telling_features(held, [int((grades == k).sum()) for k in range(3)]).collect()}
    rows = np.repeat(np.arange(300), 8)
    names, at = np.unique(np.concatenate(buckets), return_inverse=True)
    want = names[qc._association(at, rows, grades, len(names), 3) >= qc.MIN_ASSOCIATION]
    assert got == set(want.tolist()) and {3, 7} <= got


def test_fit_does_not_depend_on_row_order():
    r = random.Random(3)
    buckets = [np.array(sorted(r.sample(range(50), 8))) for _ in range(200)]
    grades = np.array([int(3 in b) + int(7 in b) for b in buckets])
    order = list(range(200))
    r.shuffle(order)
    a = qc.fit_arrays(buckets, grades, 3)
    b = qc.fit_arrays([buckets[i] for i in order], grades[order], 3)
    assert np.allclose(a.thresholds, b.thresholds) and a.weights.keys() == b.weights.keys()


def test_filter_takes_toxic_and_junk(spark):
    r = random.Random(5)
    common = [f"plain{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(common) for _ in range(50)]
        kind = i % 6
        if kind == 0:
            words[r.randrange(50)] = r.choice(["vileheit", "vilement", "vile,"])
        rows.append((i, "!! ".join(words) if kind == 1 else " ".join(words) + ".", "x"))
        if i < 400:
            labels.append((i, int(kind != 1), int(kind == 0)))
    rows += [(None, None, None), (700, "", "x"), (rows[2][0], rows[2][1], "x")]
    labels += [(None, 0, 0), (5000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _grade string")
    kept = qc.filter_by_grade(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    late = [i for i in ids if i is not None and 400 <= i < 600]
    assert sum(i % 6 < 2 for i in late) <= 4 and sum(i % 6 >= 2 for i in late) >= 128
    assert ids.count(2) == 2


def test_no_labels_keep_all_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert qc.filter_by_grade(docs, labels).count() == 2
    assert qc.filter_by_grade(docs.limit(0), labels).count() == 0


def test_long_text_is_read_whole():
    words = [f"w{i}" for i in range(50_000)]
    features = qc.Features()
    assert qc._bucket(b"last") in features.of(" ".join([*words, "last"]).encode())
