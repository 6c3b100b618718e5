"""The permutation, and exact round trips through the shards."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from colloquy.llm import training_order as to
from colloquy.llm.common import fresh_path
from colloquy.llm.tokens import default_tokenizer


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(size):
    f = to.Feistel(size, b"key")
    slots = f.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert f.numbers(slots).tolist() == list(range(size))


def test_keys_and_spread():
    a, b = (to.Feistel(100_000, k).slots(np.arange(1000)) for k in (b"a", b"b"))
    assert (a == b).sum() < 10
    assert 40_000 < a.mean() < 60_000


@pytest.mark.parametrize("parts", [1, 3])
def test_round_trip(spark, parts):
    texts = [" ".join(f"word{i * k % 37}" for k in range(i % 50)) for i in range(120)] + [None, "", "last " * 400]
    docs = spark.createDataFrame([(None if i == 4 else i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, slot int").coalesce(1).repartition(parts)
    folder = fresh_path(spark, "order-test")
    index = to.write(docs, folder, length=64, shard_sequences=7).orderBy("slot").collect()
    read = list(to.read_from(folder))
    assert [r.slot for r in index] == list(range(len(read)))
    assert all(len(x) == 64 for x in read)
    # Back in the order of their numbers, the sequences of each partition are its documents.
    numbers = to.Feistel(len(read), to.KEY).numbers(np.arange(len(read)))
    stream = np.concatenate([read[s][: index[s].n_tokens] for s in np.argsort(numbers)])
    got = [tuple(x.tolist()) for x in np.split(stream, np.flatnonzero(stream == 1) + 1)][:-1]
    whole = Tokenizer.from_file(default_tokenizer())
    want = [(*whole.encode(t or "", add_special_tokens=False).ids, 1) for t in texts]
    assert sorted(got) == sorted(want)
    assert {d for r in index for d in r.doc_ids} == {None if i == 4 else i for i in range(len(texts))}
    assert [x.tolist() for x in to.read_from(folder, 10, 15)] == [x.tolist() for x in read[10:15]]
    checked = to.verify(spark.createDataFrame(index, to.INDEX), folder).collect()
    assert all(r.crc32 == r.read_crc32 for r in checked)


def test_empty(spark):
    folder = fresh_path(spark, "order-test")
    assert to.write(spark.createDataFrame([], "doc_id long, text string"), folder).collect() == []
    assert list(to.read_from(folder)) == []


def test_plain_words_cost_no_rules_for_text(monkeypatch):
    """The ids of a partition's stream are the tokenizer's, and of its words only those that are not plain
    letters went through the file's rules for text."""
    used = to.tokenizer(default_tokenizer())
    whole, asked = used._tokenizer, []

    class Asked:
        def encode_batch_fast(self, rows, **options):
            asked.extend(rows)
            return whole.encode_batch_fast(rows, **options)

    monkeypatch.setattr(used, "_tokenizer", Asked())
    used._forget()
    texts = ["Straßen straßen, STRASSEN. Übermäßig?", "Слово слово! plain words and x=2"] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array([t.encode() for t in texts], pa.binary())], names=["doc_id", "body"])
    found = list(to._sequences(iter([batch]), default_tokenizer(), 64, 1))
    want = [i for t in texts for i in (*whole.encode(t, add_special_tokens=False).ids, 1)]
    assert np.concatenate([ids for ids, _ in found]).tolist() == want
    assert sorted(set(asked)) == sorted({"x=2", ",", ".", "?", "!", ""})
