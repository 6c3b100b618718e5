"""Decontamination against a brute-force version."""

import hashlib
import random
import re

import pytest

from colloquy.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items):
    windows = []
    for item, text in items:
        w = words_of(text)
        size = min(len(w), 10)
        windows += [(item, tuple(w[i : i + size])) for i in range(len(w) - size + 1) if w]
    out = []
    for doc, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for item, span in windows:
            for i in range(len(w) - len(span) + 1):
                if tuple(w[i : i + len(span)]) == span:
                    hit.update(range(i, i + len(span)))
                    ids |= {str(item)} - {"None"}
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(out, key=str)


def tables(short):
    r = random.Random(8)
    vocabulary = ["the", "of", "É", "é", "naïve", "x1", "日本", "Ba", "ba", "q"] + [f"w{i}" for i in range(60)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, text(r.randint(10, 40))) for i in range(12)] + [(12, text(10)), (13, text(11)), (3, text(15)), (None, text(12))]
    items += [(20 + k, text(k)) for k in (1, 3, 9)] if short else []
    docs = []
    for i in range(90):
        body = text(r.randint(0, 80))
        if i % 2:
            passage = r.choice(items)[1]
            a = r.randint(0, max(0, len(passage) - 9))
            at = r.randint(0, len(body))
            body[at:at] = passage[a : a + r.randint(8, 30)]
        docs.append((i, r.choice([" ", ", ", "\n", "-"]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in body)))
    docs += [(None, None), (200, ""), (201, "... \x00"), docs[1], (docs[1][0], "clean " * 12), (300, " ".join(items[0][1] * 400))]
    return docs, [(i, " ".join(t)) for i, t in items] + [(50, None), (51, " - ")]


@pytest.mark.parametrize("short", [False, True])
def test_equals_brute_force(spark, short):
    docs, items = tables(short)
    got = dc.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == slow(docs, items)


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, items = tables(False)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, _row int")
    kept = dc.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    want = sorted(str(d) for d, *_, hit in slow(docs, items) if not hit)
    assert sorted(str(x.doc_id) for x in kept.collect()) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.find(none, items).collect() == []
    row = dc.find(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), items).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
