"""Many names in one pass: equal to masking them one after the other."""

import random
import re

import pytest

import corpus
from colloquy.operators import erase, erase_many
from colloquy.sources import files


def longest_first(names):
    return [(n, [n]) for n in sorted(set(names), key=lambda x: (-len(x), x))]


def test_random_texts_equal_the_chain(spark):
    rng = random.Random(5)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    names = longest_first([some(rng.randint(1, 5), "ab ") .strip() or "ab" for _ in range(60)] + [some(rng.randint(1, 3), "김이박") for _ in range(20)])
    texts = [some(rng.randint(0, 80), "ab 김이박c") for _ in range(300)] + [f"**[{n}] (0:01)** {n}{n} **{n} (" for n, _ in names]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r for r in erase_many.erase_texts(df, "text", names).collect()}
    order = [n for n, _ in names]
    safe = [n for n in order if erase.is_body_safe(n)]
    # The chain, in plain Python; no name shares a character with the mask.
    for i, text in enumerate(texts):
        out = text
        for n in order:
            out = re.sub(rf"(\*\*\[?){re.escape(n)}(\]?\s*\()", rf"\1{erase.MASK}\2", out)
        for n in safe:
            out = out.replace(n, erase.MASK)
        assert got[i].text == out
        assert got[i].mentions == sum(text.count(n) for n in safe)
        assert got[i].mentioned == {n: text.count(n) for n in safe if text.count(n)}


def test_people_of_a_corpus(spark, tmp_path):
    folder = corpus.write(tmp_path)
    registry = spark.createDataFrame([(r["name"], r.get("aliases", [])) for r in corpus.REGISTRY], "name string, aliases array<string>")
    names = erase_many.tokens_of([corpus.MATEO, corpus.INES], registry)
    assert [n for n, _ in names] == sorted((n for n, _ in names), key=lambda x: (-len(x), x))
    assert {n for n, people in names if people == [corpus.MATEO]} == set(erase.tokens(corpus.MATEO, registry))
    talks = files.transcripts(spark, folder).filter("readable").select("path", "content")
    chain = {r.path: r for r in erase.erase_transcripts(talks, [n for n, _ in names]).collect()}
    for r in erase_many.erase_texts(talks, "content", names).collect():
        assert (r.content, r.mentions) == (chain[r.path].content, chain[r.path].mentions)


def test_cases(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "élan Ann", "z"), (4, "삭제 Ann " * 20_000, "w")], "i int, text string, mentions string")
    none = {r.i: r for r in erase_many.erase_texts(df, "text", []).collect()}
    assert none[1].text is None and none[3].text == "élan Ann" and none[3].mentions == 0
    got = {r.i: r for r in erase_many.erase_texts(df, "text", [("Ann", ["Ann", "Bo"]), ("삭제", ["Cy"])]).collect()}
    assert (got[1].text, got[1].mentions, got[2].text) == (None, 0, "")
    assert (got[3].text, got[3].mentioned) == ("élan (삭제)", {"Ann": 1, "Bo": 1})
    # A mask is not masked again.
    assert got[4].text == "(삭제) (삭제) " * 20_000 and got[4].mentioned == {"Ann": 20_000, "Bo": 20_000, "Cy": 20_000}
    assert erase_many.erase_texts(df.limit(0), "text", [("Ann", ["Ann"])]).collect() == []
    monkeypatch.setattr(erase_many, "MOST_BYTES", 4)
    with pytest.raises(ValueError):
        erase_many.erase_texts(df, "text", [("Ann", ["Ann"])])
