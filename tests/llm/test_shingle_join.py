"""Near copies by shingle similarity against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from colloquy.llm import components, shingle_join, simhash


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_kept(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return sorted(min(d for (d, _), g in zip(rows, group) if g == k) for k in set(group))


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    licence = [r.choice(words) for _ in range(40)]
    rows = []
    for _ in range(50):
        text = [r.choice(words) for _ in range(r.randint(1, 200))]
        if r.random() < 0.4:
            text += licence
        rows.append(" ".join(text))
        for changes in range(r.randint(0, 5)):
            near = list(text)
            for _ in range(changes):
                near[r.randrange(len(near))] = f"x{r.random()}"
            rows.append("\n".join(near).upper())
    hot = [r.choice(words) for _ in range(150)]
    for _ in range(90):
        near = list(hot)
        for at in r.sample(range(150), r.randint(0, 8)):
            near[at] = f"y{r.random()}"
        rows.append(" ".join(near))
    rows += [None, "", " \t", "one", "One", "two words"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("dense", [2, 64])
def test_rows_equal_brute_force(spark, dense):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingle_join.drop_similar(df, "doc_id", "text", dense_key=dense).collect()
    assert sorted(r.doc_id for r in got) == slow_kept(rows)


def test_stage_drops_copies_with_changed_words(spark):
    words = [f"w{i}" for i in range(300)]
    changed = [f"new{i}" if i in (40, 150, 260) else w for i, w in enumerate(words)]
    far = [f"far{i}" if i % 20 == 0 else w for i, w in enumerate(words)]
    rows = [(7, " ".join(words)), (8, " ".join(changed)), (9, " ".join(far)), (None, " ".join(words))]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [7, 9]


def test_sketches_differ_in_no_more_than_the_sets():
    r = random.Random(2)
    for size in (3, 200, 5000):
        a = {r.getrandbits(63) for _ in range(size)}
        b = set(list(a)[: size // 2]) | {r.getrandbits(63) for _ in range(size // 3)}
        for words in (shingle_join.SKETCH_WORDS, shingle_join.LONG_WORDS):
            x, y = (shingle_join.sketch(np.array(sorted(s), np.int64), words) for s in (a, b))
            assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "LONG_SET", 20)
    rows = corpus(9)
    got = shingle_join.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", dense_key=4).collect()
    assert sorted(r.doc_id for r in got) == slow_kept(rows)


def test_empty_table(spark):
    assert shingle_join.drop_similar(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def near_copies(n, seed=7):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(n):
        near = list(base)
        for at in r.sample(range(300), r.randint(1, 4)):
            near[at] = f"z{r.random()}"
        rows.append((i, " ".join(near)))
    return rows


def test_fingerprints_are_linked_first(spark, monkeypatch):
    words = [f"w{i}" for i in range(2000)]
    one = [*words[:1000], "other", *words[1001:]]
    rows = [(1, " ".join(words)), (2, " ".join(one)), (3, " ".join(reversed(words)))]
    assert (simhash.fingerprint(rows[0][1], 5) ^ simhash.fingerprint(rows[1][1], 5)).bit_count() <= 2
    found = []
    pairs = shingle_join.fingerprint_pairs
    monkeypatch.setattr(shingle_join, "fingerprint_pairs", lambda facts: found.append(pairs(facts)) or found[0])
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert found[0].count() == 1


def test_later_links_go_between_components_only(spark, monkeypatch):
    rows, fed = near_copies(300), []
    components = shingle_join.connected_components
    monkeypatch.setattr(shingle_join, "connected_components", lambda edges: fed.append(edges.filter("a <> b").distinct().count()) or components(edges))
    out = shingle_join.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", dense_key=20)
    assert [r.doc_id for r in out.collect()] == slow_kept(rows)
    assert sum(fed[1:]) < len(rows)


@pytest.mark.parametrize("seed", range(2))
def test_components_of_stars_and_chains(spark, seed, monkeypatch):
    r = random.Random(seed)
    edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(100, 120)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    want = {}
    for a, b in edges:
        if a != b:
            both = want.get(a, {a}) | want.get(b, {b})
            want |= dict.fromkeys(both, both)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(x) for x in components.connected_components(df).collect()} == {(x, min(g)) for x, g in want.items()}
    # A star is its own result: no round, so no join of its links.
    monkeypatch.setattr(components, "_large_star", None)
    assert components.connected_components(df.filter("b < 30")).count() == 30
