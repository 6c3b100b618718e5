"""Titles of a date by bounds against all pairs."""

import difflib
import random

import pytest

from colloquy.operators.title_match import best_of, best_titles


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def plain(title, others, at_least):
    score, order = max(((ratio(title, o), -n) for o, n in others), default=(-1, 0))
    return (score, -order) if score >= at_least else None


@pytest.mark.parametrize("seed", range(20))
def test_best_as_by_all_pairs(seed):
    r = random.Random(seed)
    words = ["plan", "sync", "weekly", "q3", "회의", "call"]
    title = lambda: "".join(r.choice(words) for _ in range(r.randint(0, 4)))
    titles, others = [title() for _ in range(30)], sorted({title() for _ in range(40)})
    order = r.sample(range(1000), len(others))
    at_least = r.choice([0.0, 0.55, 0.9])
    found = best_of(titles, others, order, at_least)
    for t, (score, at, scored) in zip(titles, found, strict=True):
        want = plain(t, list(zip(others, order, strict=True)), at_least)
        assert (None if at < 0 else (score, at)) == want and scored <= len(others)


def test_few_pairs_are_scored():
    r = random.Random(1)
    keys = [r.randrange(10**5) for _ in range(200)]
    found = best_of([f"callwith{k}" for k in keys], [f"callw{k}" for k in keys], list(range(200)), 0.55)
    assert sum(n for *_, n in found) < 200 * 200 / 10


@pytest.mark.parametrize("block", [3, 512])
def test_blocks_of_a_crowded_date(spark, block):
    r = random.Random(4)
    rows = [(r.choice(["d1", "d1", "d1", "d2", ""]), f"{r.choice(['plan', 'sync', 'call'])}{r.randrange(30)}") for _ in range(120)]
    titles = sorted(set(rows))
    others = {(d, f"{t}x"): i for i, (d, t) in enumerate(reversed(rows))}
    got = best_titles(spark.createDataFrame(titles, "date string, title string"), spark.createDataFrame([(d, o, i) for (d, o), i in others.items()], "date string, other string, order long"), 0.55, block)
    got = {(x.date, x.title): (x.score, x.order) for x in got.collect() if x.score is not None}
    want = {(d, t): plain(t, [(o, i) for (e, o), i in others.items() if e == d], 0.55) for d, t in titles}
    assert got == {k: v for k, v in want.items() if v}


def test_a_date_of_thousands_scores_few_and_ends(spark):
    keys = random.Random(3).sample(range(900_000), 3000)
    titles = spark.createDataFrame([("d", f"callwith{k}") for k in keys], "date string, title string")
    others = spark.createDataFrame([("d", f"callw{k}", i) for i, k in enumerate(keys)], "date string, other string, order long")
    got = best_titles(titles, others, 0.55).collect()
    assert {r.title: r.order for r in got} == {f"callwith{k}": i for i, k in enumerate(keys)}
    assert sum(r.scored for r in got) < 10 * len(keys)


@pytest.mark.parametrize("seed", range(5))
def test_profiles_of_anagrams_and_rare_characters(seed):
    r = random.Random(seed)
    titles = ["".join(r.sample("plan회의ab", r.randint(0, 8))) for _ in range(60)] + ["", "가나다", "x\U0001f600"]
    others = sorted({"".join(r.sample("nalp의회ba", r.randint(0, 8))) for _ in range(60)} | {"", "가다나", "\U0001f600x"})
    order = r.sample(range(1000), len(others))
    for t, (score, at, _) in zip(titles, best_of(titles, others, order, 0.3), strict=True):
        assert (None if at < 0 else (score, at)) == plain(t, list(zip(others, order, strict=True)), 0.3)
