"""The stored index against plain scans: searches, segments, merging, substrings, and what is read."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as t
from colloquy.operators import search, stored_index
from colloquy.operators.stored_index import StoredIndex, pattern_grams
from colloquy.sources import storage

WORDS = ["of", "the", "theme", "Café", "cafe", "x1", "que", "de", "la", "ΟΔΟΣ", "straße"]


def texts(n, seed, start=0):
    r = random.Random(seed)
    odd = [None, "", "  ", "...", "of", "of the of the", "😀 the 😀"]
    return [(start + 3 * i, odd[i] if i < len(odd) else r.choice([" ", "-", ", "]).join(r.choice(WORDS) for _ in range(r.randint(0, 30))), r.choice(["la", "of the", None])) for i in range(n)]


@pytest.fixture(params=["three segments", "merged"])
def both(spark, tmp_path, request, monkeypatch):
    monkeypatch.setattr(stored_index, "RUN", 7)
    monkeypatch.setattr(stored_index, "AT_ONCE", 300)
    rows = [*texts(60, 1), *texts(60, 2, 1), *texts(60, 3, 2), (None, "the", "the")]
    df = spark.createDataFrame(rows, "doc long, body string, side string")
    index = StoredIndex.create(spark, f"{tmp_path}/ix", "doc")
    for i in range(3):
        index.add(df.filter((F.col("doc") % 3 == i) | (F.lit(i == 0) & F.col("doc").isNull())), ["body", "side"])
    if request.param == "merged":
        index.merge()
        assert len(index.facts["segments"]) == 1 and StoredIndex(spark, f"{tmp_path}/ix").facts == index.facts
    return index, search.token_index(df.filter("doc is not null"), "doc", ["body", "side"])


def test_searches_as_by_scan(both):
    index, plain = both
    ids = lambda df: sorted(r.doc for r in df.collect())
    for words, columns in ((["of", "the"], None), (["CAFE", "la", "x1"], ["body"]), (["of", "nowhere"], None), (["la", "la"], ["side"])):
        assert ids(index.match_all(words, columns)) == ids(search.match_all(plain, "doc", words, columns))
        assert ids(index.match_any(words, columns)) == ids(search.match_any(plain, "doc", words, columns))
    assert ids(index.match_not(["of"], ["la", "nowhere"])) == ids(search.match_not(plain, "doc", ["of"], ["la", "nowhere"]))
    for phrase in (["of", "the", "of"], ["the"], ["la", "nowhere"], ["the", "the", "the"]):
        assert ids(index.match_phrase(phrase)) == ids(search.match_phrase(plain, "doc", phrase))
    for prefix in ("the", "CA"):
        assert ids(index.match_prefix(prefix, ["body"])) == ids(search.match_prefix(plain, "doc", prefix, ["body"]))
    assert index.match_all([]).collect() == [] and index.match_phrase([]).collect() == []
    assert sorted(index.document_counts().collect()) == sorted(search.document_counts(plain, "doc").collect())


def test_rare_word_is_met_by_shuffle_too(both, monkeypatch):
    index, plain = both
    monkeypatch.setattr(stored_index, "BROADCAST_KEYS", 0)
    assert sorted(index.match_all(["of", "the"]).collect()) == sorted(search.match_all(plain, "doc", ["of", "the"]).collect())


def test_rows_hold_bounded_runs_in_order(both):
    index, plain = both
    rows = index.postings(F.lit(True)).collect()
    assert max(r.n for r in rows) <= 2 * stored_index.RUN
    for r in rows:
        assert r.n == len(r.ids) == len(r.places) and min(r.ids) == 0 and max(r.ids) == r.last - r.first
    got = sorted((r.token, r.col, r.first + i, p) for r in rows for i, places in zip(r.ids, r.places, strict=True) for p in places)
    # The scan counts places with what is left of a text's start; both start at zero.
    assert got == sorted((r.token, r.col, r.doc, r.pos) for r in plain.collect())


@pytest.mark.parametrize("grown", [False, True])
def test_substrings_as_by_scan(spark, tmp_path, grown, monkeypatch):
    monkeypatch.setattr(stored_index, "AT_ONCE", 200)
    monkeypatch.setattr(stored_index, "WORTH_A_LOOK", 1.0)
    df = spark.createDataFrame([*texts(80, 4), (9001, "50% of_it \\ done", None), (9002, "İstanbul", None)], "doc long, body string, side string")
    index = StoredIndex.create(spark, f"{tmp_path}/ix", "doc", grams=True)
    for part in [df.filter("doc % 2 = 0"), df.filter("doc % 2 = 1")] if grown else [df]:
        index.add(part, ["body", "side"])
    if grown:
        index.merge(keep_old=True)
    for part in ("THEME", "f t", "th", "", "caf_", "of%la", "nowhere", "οδος, ", "50\\%", "İst", "😀 t"):
        got = sorted(r.doc for r in index.containing(df, "body", part).collect())
        assert got == sorted(r.doc for r in df.filter(t.like(F.col("body"), part)).collect()), part
    assert index.plan("th") is None and index.plan("nowhere") and len(index.plan("nowhere")) == 1
    monkeypatch.setattr(stored_index, "WORTH_A_LOOK", 0.0)
    assert index.plan("the") is None


def test_grams_of_patterns():
    assert pattern_grams("abcd") == ["abc", "bcd"] and pattern_grams("ab%cd_ef") == [] and pattern_grams("a\\%b") == ["a%b"] and pattern_grams("abc\\") == ["abc", "bc\\"]


def test_index_of_nothing(spark, tmp_path):
    index = StoredIndex.create(spark, f"{tmp_path}/ix", "doc")
    assert index.match_all(["a"]).collect() == index.match_any(["a"]).collect() == index.document_counts().collect() == []
    index.add(spark.createDataFrame([], "doc long, body string"), ["body"])
    assert index.match_phrase(["a", "b"]).collect() == index.match_prefix("a").collect() == []
    with pytest.raises(ValueError, match="no index"):
        StoredIndex(spark, f"{tmp_path}/elsewhere")


def test_generations(spark, tmp_path):
    path = f"{tmp_path}/ix"
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc long, body string")
    index = StoredIndex.create(spark, path, "doc")
    other = StoredIndex(spark, path)
    index.add(df, ["body"])
    # A reader of the earlier generation sees nothing of the change; a writer of it is refused.
    assert other.match_any(["b"]).collect() == [] and StoredIndex(spark, path).match_any(["b"]).count() == 2
    with pytest.raises(RuntimeError, match="another writer"):
        other.add(df, ["body"])
    assert StoredIndex(spark, path).match_any(["b"]).count() == 2
    again = StoredIndex.create(spark, path, "doc")
    assert again.generation == 1 and not storage.put_new(spark, f"{path}/generation-00000001.json", "{}")
