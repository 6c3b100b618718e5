"""SimHash components against a brute-force version."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, distance=2):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            root = find(i)
            least[root] = min(least.get(root, doc), doc)
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def corpus(seed=3, copies=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(60):
        text = [r.choice(words) for _ in range(r.randint(1, 120))]
        rows.append(" ".join(text))
        for _ in range(r.randint(0, 2)):
            near = list(text)
            near[r.randrange(len(near))] = "Other"
            rows.append("\n".join(near).upper())
    long = [r.choice(words) for _ in range(900)]
    for i in range(copies):
        near = list(long)
        near[i * 20 % 900] = f"x{i}"
        rows.append(" ".join(near))
    rows += [None, "", " \t\n", "one", "one", "two words"]
    r.shuffle(rows)
    out = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    return out + [out[5], (None, rows[7])]


@pytest.mark.parametrize("dense", [2, 64])
def test_components_equal_brute_force(spark, dense):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, "doc_id", "text", dense_key=dense).collect()
    assert sorted((tuple(x) for x in got), key=str) == slow_components(rows)


def test_links_are_complete_on_both_paths(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = {b for b in base}
    for b in base:
        for k in (1, 2, 3):
            x = b
            for bit in r.sample(range(64), k):
                x ^= 1 << bit
            prints.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "fp long")
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {tuple(x) for x in simhash.links(df).collect()} == want
    dense = simhash.connected_components(simhash.links(df, dense_key=0)).collect()
    assert sorted(map(tuple, dense)) == sorted(map(tuple, simhash.connected_components(simhash.links(df)).collect()))


def test_one_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _row string")
    kept = simhash.drop_near_duplicates(df, "doc_id", "text")
    assert kept.columns == df.columns
    # A null id counts after all others, so each component keeps its least id once.
    want = sorted({c for _, _, c in slow_components(rows)})
    assert sorted(x.doc_id for x in kept.collect()) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df, "doc_id", "text").collect() == []
    assert simhash.drop_near_duplicates(df, "doc_id", "text").count() == 0


def test_long_text_is_taken_whole(spark):
    text = " ".join(f"w{i % 977}" for i in range(3 * simhash.CHUNK // 2))
    assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(text + " tail") == slow_fingerprint(text + " tail")


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(spark.range(1).withColumn("fp", F.lit("x")), "id", "fp", keep=["fp"])
