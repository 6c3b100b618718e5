"""The pipeline over planted documents, each stage against a plain version of its decision."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_decontaminate import slow as slow_hits
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import quality_classifier as qc
from colloquy.llm import quality_rules as qr
from colloquy.llm import simhash
from colloquy.llm.tokens import default_tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(4000)]
    prose = lambda n: [w.capitalize() if k % 9 == 0 else w + (".," [k % 2]) * (k % 5 == 4) for k, w in enumerate(r.choice(vocabulary) for _ in range(n))]
    items = [(i, " ".join(prose(30))) for i in range(5)]
    docs, labels, kinds = [], [], {}
    for i in range(700):
        words = prose(r.randint(60, 160))
        kind = "clean"
        if i % 10 == 0:
            kind, words = "junk", [w + "###" for w in words]
        elif i % 10 == 1:
            kind = "toxic"
            for at in r.sample(range(len(words)), 3):
                words[at] = "vile"
        elif i % 50 == 2:
            kind, words = "leak", words + items[i % 5][1].split()[3:20]
        text = " ".join(words)
        if i % 50 == 3 and i > 3:
            kind, text = "copy", docs[i - 49][1]
        kinds[i] = kind
        docs.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    docs += [(900, None, None, None, None), (None, " ".join(prose(80)), "en", "s", 1), docs[4]]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), kinds, items


def plain_rules(spark, rows):
    """Which rows the rules keep, with the model fitted by plain loops over all rows."""
    votes = qr.rules()
    features = qr.add_features(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, text string"), "text")
    table = features.select("i", qr.base_failed(features.n_words, features.n_repeat_words).alias("failed"), *[v.alias(n) for n, v in votes.items()]).collect()
    good, p = qr.START_GOOD, {(n, c): dict(zip((1, -1, 0), (g, b, 1 - g - b))) for n in votes for c, (g, b) in qr.START_VOTES.items()}

    def posterior(x):
        a, b = good, 1 - good
        for n in votes:
            a, b = a * p[n, 1][x[n]], b * p[n, -1][x[n]]
        return a / (a + b)

    for _ in range(qr.ROUNDS):
        q = [posterior(x) for x in table]
        prior, total = qr.PRIOR_WEIGHT * len(table), {1: sum(q), -1: len(q) - sum(q)}
        new = {}
        for n in votes:
            for c in (1, -1):
                w = Counter()
                for x, y in zip(table, q):
                    w[x[n]] += y if c == 1 else 1 - y
                start = dict(zip((1, -1), qr.START_VOTES[c]))
                one = {v: (w[v] + prior * start[v]) / (total[c] + prior) for v in (1, -1)}
                new[n, c] = one | {0: max(1e-9, 1 - sum(one.values()))}
        good, p = (total[1] + prior * qr.START_GOOD) / (len(table) + prior), new
    return {x.i for x in table if not x.failed and posterior(x) >= qr.KEEP_AT}


def test_stages(spark, sf_dir):
    folder, kinds, items = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda rows: sorted(map(tuple, rows), key=str)
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "packing"]

    out = stages["quality_rules"](spark, docs, folder)
    assert out.columns == docs.columns
    after = out.collect()
    kept = plain_rules(spark, [r.text for r in before])
    assert key(after) == key(r for i, r in enumerate(before) if i in kept)
    assert not {kinds.get(r.doc_id) for r in after} & {"junk"} and sum(k != "junk" for k in kinds.values()) <= len(after)

    docs, before = spark.createDataFrame(after, COLUMNS), after
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = qc.fit(docs, qc.document_ratings(labels), 3)
    tails = model.tails(model.scores((None if r.text is None else r.text.encode() for r in before), qc.Features(model.weights)))[:, -1]
    after = stages["quality_classifier"](spark, docs, folder).collect()
    assert key(after) == key(r for r, p in zip(before, tails, strict=True) if p >= qc.KEEP_AT)
    assert sum(kinds.get(r.doc_id) == "toxic" for r in after) <= 1 and sum(kinds.get(r.doc_id) == "clean" for r in after) >= 0.99 * sum(k == "clean" for k in kinds.values())

    docs, before = spark.createDataFrame(after, COLUMNS), after
    prints = [simhash.fingerprint(r.text, 5) for r in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for i, r in enumerate(before):
        best[group[i]] = min(best.get(group[i], (True, 0)), (r.doc_id is None, r.doc_id or 0))
    after = stages["near_duplicates"](spark, docs, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == sorted(best.values())
    assert not any(kinds.get(r.doc_id) == "copy" for r in after) and sum(r.doc_id == 4 for r in after) == 1

    docs, before = spark.createDataFrame(after, COLUMNS), after
    hit = {str(d) for d, *_, bad in slow_hits([(r.doc_id, r.text) for r in before], items) if bad}
    after = stages["decontamination"](spark, docs, folder).collect()
    assert key(after) == key(r for r in before if str(r.doc_id) not in hit) and {kinds[int(d)] for d in hit} == {"leak"}

    packed = stages["packing"](spark, spark.createDataFrame(after, COLUMNS), folder).collect()
    whole = Tokenizer.from_file(default_tokenizer())
    want = []
    for r in after:
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
    assert key((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == key(want)


def test_run(spark, sf_dir):
    folder, kinds, _ = sf_dir
    ids = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert {kinds.get(i) for i in ids if i is not None} == {"clean"} and len(ids) >= 0.98 * sum(k == "clean" for k in kinds.values())
