"""Lloyd and Yinyang Lloyd in whole numbers against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from colloquy.llm import centroids, vector_codes
from colloquy.llm.vectors import LARGEST

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, id string, v string"


def rows_of(n, size, seed, spread=3.0):
    r = random.Random(seed)
    middles = [[r.uniform(-spread, spread) for _ in range(size)] for _ in range(5)]
    return [(i, [float(np.float32(m + r.gauss(0, 0.5))) for m in r.choice(middles)], r.choice([0, 1, None]), "c", "i", "v") for i in range(n)]


def plain_lloyd(points, centers, rounds):
    near = lambda x: min(range(len(centers)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(x, centers[c], strict=True)), c))
    for _ in range(rounds):
        of = [near(x) for x in points]
        for c in range(len(centers)):
            mine = [x for x, o in zip(points, of, strict=True) if o == c]
            if mine:
                centers[c] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    of = [near(x) for x in points]
    return of, [sum((a - b) ** 2 for a, b in zip(x, centers[o], strict=True)) for x, o in zip(points, of, strict=True)], centers


def sha(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def test_clusters_as_by_plain_loops(spark):
    rows = rows_of(300, 6, 1)
    odd = [(900, None, 1, "", "", ""), (901, [1.0] * 5, 1, "", "", ""), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "", "", ""), (903, [math.nan] + [1.0] * 5, 1, "", "", ""), (904, [math.inf] + [1.0] * 5, 1, "", "", ""), (905, [], 1, "", "", "")]
    # Rows without an id and repeated ones have their own rows in the result.
    rows += [(None, rows[3][1], 1, "", "", ""), rows[7], rows[7]]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    got = centroids.cluster(df, "vec_id", "embedding", k=7, rounds=3, scale=256, components=6)
    assert got.columns == ["vec_id", *centroids.OUTPUT] and dict(got.dtypes)["vec_id"] == "bigint"
    points = [[math.floor(256 * x) for x in v] for _, v, *_ in rows]
    first = sorted((sha_of, p) for sha_of, p in ((hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), p) for r, p in zip(rows, points, strict=True) if r[0] is not None))[:7]
    of, apart, centers = plain_lloyd(points, [list(p) for _, p in first], 3)
    inertia = {c: sum(d for d, o in zip(apart, of, strict=True) if o == c) for c in set(of)}
    want = sorted((str(r[0]), o, d, inertia[o], sum(apart), sha(centers[o])) for r, o, d in zip(rows, of, apart, strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_ties_go_to_the_lower_centroid(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [2.0], 0), (3, [1.0], 0)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in centroids.cluster(df, "vec_id", "embedding", k=3, rounds=0, scale=1, components=1).collect()}
    order = sorted((1, 2, 3), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    assert {i: r.cluster for i, r in got.items()} == {i: order.index(i) for i in (1, 2, 3)}
    held = centroids.cluster(df, "vec_id", "embedding", k=2, rounds=0, scale=1, components=1).collect()
    points = {1: 0, 2: 2, 3: 1}
    assert {r.vec_id: r.cluster for r in held} == {i: min((0, 1), key=lambda c: (abs(points[i] - points[order[c]]), c)) for i in points}


def test_clusters_of_nothing_and_of_too_much(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(df, "vec_id", "embedding").collect() == []
    assert vector_codes.encode(df, "vec_id", "embedding", "label").collect() == []
    far = spark.createDataFrame([(1, [float(LARGEST)] * 8, 1)], "vec_id long, embedding array<double>, label int")
    for call in (lambda: centroids.cluster(far, "vec_id", "embedding", components=8).collect(), lambda: vector_codes.encode(far, "vec_id", "embedding", "label").collect()):
        with pytest.raises(Exception, match="is beyond"):
            call()
    with pytest.raises(ValueError, match="column of the result"):
        centroids.cluster(df, "cluster", "embedding")
    with pytest.raises(ValueError, match="column of the result"):
        vector_codes.encode(df, "vec_id", "embedding", "code")


@pytest.mark.parametrize("seed", range(6))
def test_bounds_find_what_looking_at_all_finds(seed):
    r = np.random.default_rng(seed)
    # Few values: many ties. Later seeds are spread so that bounds hold.
    x = r.integers(-3, 4, (400, 3)) if seed < 3 else r.integers(-40, 40, (400, 3)) + 1000 * r.integers(0, 5, (400, 1))
    entries = x[r.choice(400, 16, replace=False)].copy()
    book = vector_codes.Codebook.start(entries)
    held, full = vector_codes.assign_all(x, book)
    cost = 0
    for _ in range(8):
        sums = np.zeros_like(entries)
        np.add.at(sums, held.code, x)
        book = book.after(vector_codes.floor_means(sums, np.bincount(held.code, minlength=16), book.entries))
        held, looked = vector_codes.assign_by_bounds(x, book, held)
        want, _ = vector_codes.assign_all(x, book)
        assert (held.code == want.code).all()
        assert (held.lower <= want.lower * (1 + 1e-12)).all() and (held.upper >= want.upper * (1 - 1e-12)).all()
        cost += looked
    assert seed < 3 or cost < 0.5 * 8 * full


def plain_codes(rows, parts, entries, rounds, scale):
    kept = sorted((r for r in rows), key=lambda r: (r[0] is None, r[0]))
    points = [[math.floor(scale * x) for x in r[1]] for r in kept]
    width = len(points[0]) // parts
    codes, errors, books = [[] for _ in kept], [0] * len(kept), []
    for p in range(parts):
        part = [x[p * width : (p + 1) * width] for x in points]
        of, apart, centers = plain_lloyd(part, [list(x) for x in part[:entries]], rounds)
        for i, (o, d) in enumerate(zip(of, apart, strict=True)):
            codes[i].append(f"{o:02x}")
            errors[i] += d
        books += [y for c in centers for y in c]
    by = {}
    for r, e in zip(kept, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted((str(r[0]), "".join(c), e, by[r[2]], sha(books)) for r, c, e in zip(kept, codes, errors, strict=True))


@pytest.mark.parametrize(("n", "entries", "seed"), [(250, 16, 3), (6, 16, 4), (120, 3, 5)])
def test_codes_as_by_plain_loops(spark, n, entries, seed):
    rows = rows_of(n, 16, seed)
    df = spark.createDataFrame(rows + [(None, rows[0][1], None, "", "", ""), rows[5]], SCHEMA).repartition(3)
    odd = spark.createDataFrame([(800, None, 0, "", "", ""), (801, [math.nan] * 16, 0, "", "", ""), (802, [1.0] * 15 + [None], 0, "", "", "")], SCHEMA)
    got = vector_codes.encode(df.unionByName(odd), "vec_id", "embedding", "label", parts=8, entries=entries, rounds=4, scale=64)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_codes([*rows, (None, rows[0][1], None), rows[5]], 8, entries, 4, 64)


def test_vectors_of_another_length_have_no_code(spark):
    rows = rows_of(20, 16, 6)
    df = spark.createDataFrame([*rows, (-5, [1.0] * 8, 2, "", "", ""), (-4, [1.0] * 3, 0, "", "", ""), (-3, [], 0, "", "", "")], SCHEMA)
    got = {r.vec_id: r for r in vector_codes.encode(df, "vec_id", "embedding", "label").collect()}
    assert len(got) == 23 and [got[i].code for i in (-5, -4, -3)] == [None] * 3 and got[-5].label_error is None
    assert all(got[i].code and got[i].error is not None for i in range(20))
    assert got[-4].label_error == sum(r.error for i, r in got.items() if i >= 0 and rows[i][2] == 0)


def test_rounds_look_at_fewer_entries(spark):
    df = spark.createDataFrame(rows_of(400, 16, 7, spread=40.0), SCHEMA)
    found = vector_codes.fit_codes(df.select("vec_id", "label", "embedding"), ["vec_id", "label"], "embedding")
    assert found.looked[0] == 400 * 8 * 16 and found.looked[-1] < 0.5 * found.looked[0]
