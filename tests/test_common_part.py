"""The passages' automaton against brute force, by itself and over partitions and blocks."""

import random

import duckdb
import pytest

from colloquy.operators.common_part import Automaton, Scorer, best_shares
from colloquy.plans.queries import ORACLE_SQL, QUERIES


def common(a, b):
    """Length of the longest part of both, by the table of all pairs of ends."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else 0)
        best, before = max(best, *row), row
    return best


def strings(r, alphabet, n, longest):
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]


def best_by_hand(fragments, texts):
    return max(min((common(f, x) / len(f) if f else 1.0 for f in fragments), default=1.0) for x in texts)


@pytest.mark.parametrize("seed", range(60))
def test_parts_as_by_brute_force(seed):
    r = random.Random(seed)
    alphabet = ["ab", "abcd", "aé😀"][seed % 3]
    passages, texts = strings(r, alphabet, r.randint(1, 7), 12), strings(r, alphabet + "z", 4, 15)
    automaton, over_all = Automaton(passages), {}
    owners = automaton.owners()
    for x in texts:
        one = {}
        automaton.walk(x, over_all)
        automaton.walk(x, one)
        found = automaton.parts_of_one(one, owners)
        assert [found.get(i, 0) for i in range(len(passages))] == [common(p, x) for p in passages] == automaton.parts(one)
    assert automaton.parts(over_all) == [max(common(p, x) for x in texts) for p in passages]
    assert len(automaton.arcs) <= max(2, 2 * sum(map(len, passages)) + 1)
    split = [(i, strings(r, alphabet, r.randint(0, 3), 6)) for i in range(5)]
    scorer = Scorer(split)
    assert scorer.scores() == []
    for x in texts:
        scorer.take(x)
    assert dict(scorer.scores()) == {i: best_by_hand(f, texts) for i, f in split}


@pytest.mark.parametrize("at_once", [40, 10_000])
def test_shares_over_blocks_and_partitions(spark, at_once):
    r = random.Random(9)
    passages = [(f"p{i}", strings(r, "abc", r.choice([1, 1, 2]), 15)) for i in range(25)]
    texts = strings(r, "abcd", 40, 60)
    df = spark.createDataFrame([(x,) for x in [*texts, None, ""]], "text string").repartition(5)
    got = {x.id: x.score for x in best_shares(spark.createDataFrame(passages, "id string, parts array<string>"), df, at_once).collect()}
    assert got == {i: best_by_hand(f, texts) for i, f in passages}
    assert best_shares(spark.createDataFrame(passages, "id string, parts array<string>"), df.limit(0), 10_000).collect() == []
    assert best_shares(spark.createDataFrame([], "id string, parts array<string>"), df, 10_000).collect() == []


def test_short_passages_stand_verbatim(spark, tmp_path):
    items = [(1, "one"), (2, "one two"), (3, "!!"), (4, ""), (5, None), (6, "ne two thr"), (7, "two three four"), (8, "nowhere else"), (9, "a unknownword b")]
    docs = [(1, "one two three four!!"), (2, "someone two"), (3, ""), (4, None), (5, "xtwo three foury"), (6, "two  three four")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.item_id, r.doc_id) for r in QUERIES["quote_grounding_exact"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["quote_grounding_exact"]).fetchall())
    assert {(1, 2), (2, 2), (6, 1), (7, 5)} <= set(got) and (7, 6) not in got
