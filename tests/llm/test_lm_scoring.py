"""Scores against a brute-force model; the automaton's weights are probabilities."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import lm_scoring as lm


def corpus():
    r = random.Random(11)
    words = ["the", "The", "É", "é", "a\x00b", "of,", "x"] + [f"w{i}" for i in range(40)]
    texts = [r.choice([" ", "\n", "\t "]).join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(200)]
    rows = list(enumerate([*texts, None, "", " ", "rare"]))
    return rows + [rows[3], (None, "the w1")]


def slow(rows, mu=lm.MU):
    split = lambda t: [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split(), "END"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    train = [split(t) for d, t in rows if not held(d)]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    out = []
    for d, t in rows:
        w = split(t)
        base = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        model = [base[0], *((two[a, b] + mu * p) / (one[a] + mu) for a, b, p in zip(w, w[1:], base[1:]))]
        out.append((d, held(d), len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, base)), sum(map(math.log10, model))))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_scores_equal_brute_force(spark, tmp_path, parts):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(str(tmp_path / "docs"))
    got = lm.score_documents(spark.read.parquet(str(tmp_path / "docs"))).collect()
    got = sorted(map(tuple, got), key=str)
    want = slow(rows)
    assert [g[:5] for g in sorted(got, key=lambda g: (str(g[0]), g[2]))] == [w[:5] for w in sorted(want, key=lambda g: (str(g[0]), g[2]))]
    for g, w in zip(sorted(got, key=lambda g: (str(g[0]), g[2])), sorted(want, key=lambda g: (str(g[0]), g[2])), strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=1e-9)


def test_blocks_do_not_change_keys():
    import pyarrow as pa

    rows = corpus()
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([None if t is None else t.encode() for _, t in rows])], names=["doc_id", "body"])
    whole = list(lm.blocks(iter([batch]), 0))
    small = []
    size, lm.BLOCK_TOKENS = lm.BLOCK_TOKENS, 100
    try:
        small = list(lm.blocks(iter([batch]), 0))
    finally:
        lm.BLOCK_TOKENS = size
    assert len(whole) == 1 and len(small) > 10
    keys = lambda b: set(b.keys(b.pairs()[0]).tolist())
    assert set().union(*map(keys, small)) == keys(whole[0])


def test_automaton_is_a_distribution_and_steps_like_it_traverses():
    r = np.random.RandomState(2)
    n = 12
    pairs = np.unique(r.randint(0, n * n, 60))
    counts = r.randint(0, 5, len(pairs))
    unigrams = np.zeros(n, np.int64)
    np.add.at(unigrams, pairs // n, counts)
    model = lm.BackoffAutomaton.of_counts(unigrams, pairs, counts, int(unigrams.sum()), int((unigrams > 0).sum()), mu=3.0, alpha=0.1)
    p = 10**model.root
    for state in range(n):
        seen = sum(10 ** model.step(state, w)[1] for w in range(n))
        assert seen == pytest.approx((unigrams[state] + 3.0 * p.sum()) / (unigrams[state] + 3.0))
    words, starts = r.randint(0, n, 50), np.array([0, 1, 20])
    want = []
    for a, b in zip(starts, [*starts[1:], 50]):
        state, total = model.ROOT, 0.0
        for w in words[a:b].tolist():
            state, weight = model.step(state, w)
            total += weight
        want.append(total)
    assert model.traverse(words, starts) == pytest.approx(want)


def test_packed_counts():
    r = np.random.RandomState(3)
    keys = np.unique(r.randint(0, 1 << 62, 500).astype(np.uint64) * np.uint64(3))
    counts = r.randint(0, 1 << 40, len(keys))
    for k, n in ((keys, counts), (keys[:0], counts[:0])):
        a, b = lm.unpack_counts(lm.pack_counts(k, n))
        assert (a == k).all() and (b == n).all()
    cuts = lm._range_starts(keys, 7)
    assert cuts[0] == 0 and cuts[-1] == len(keys) and (np.diff(cuts) >= 0).all()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    assert lm.score_documents(spark.read.schema("doc_id long, text string").parquet(str(tmp_path / "docs"))).collect() == []
