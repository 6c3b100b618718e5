"""Packing: exact ids, whole documents, gapless places, and few sequences."""

import random
import re
import sys
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import packing, tokens


def texts():
    r = random.Random(5)
    words = ["the", "Straße", "it's", "don't", "naïve", "x=1", "日本語", "á", "\x1cq", "<|endoftext|>", "ÇA", "1234", "l'eau", "a b", "'s", "\x85z"]
    out = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(80)]
    out += ["\t \n".join(r.choice(words) for _ in range(9000)), "x" * 3000, None, "", " ", "one", "one"]
    return out


def test_ids_equal_the_tokenizers(monkeypatch):
    whole = Tokenizer.from_file(tokens.default_tokenizer())
    for size in (64, 1 << 20):
        monkeypatch.setattr(tokens, "BATCH_BYTES", size)
        monkeypatch.setattr(tokens, "MEMORY_WORDS", 40)
        column = pa.array([None if t is None else t.encode() for t in texts()], pa.binary())
        got = list(tokens.WordTokenizer(tokens.default_tokenizer()).encode(column))
        assert [g.tolist() for g in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts()]


def test_every_character():
    """Each assigned character alone, among letters, and before marks."""
    whole = Tokenizer.from_file(tokens.default_tokenizer())
    found = [chr(c) for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    found = [c for c in found if not (0x3400 <= ord(c) <= 0x9FFF or 0xAC00 <= ord(c) <= 0xD7A3 or ord(c) >= 0x17000) or ord(c) % 97 == 0]
    rows = [f"{c} a{c} {c}b, X{c}y.{c}" for c in found]
    got = tokens.WordTokenizer(tokens.default_tokenizer()).encode(pa.array([r.encode() for r in rows], pa.binary()))
    want = whole.encode_batch_fast(rows, add_special_tokens=False)
    assert [c for c, g, w in zip(found, got, want, strict=True) if g.tolist() != w.ids] == []


def test_bytes_that_are_no_text_and_other_files():
    t = tokens.WordTokenizer(tokens.default_tokenizer())
    a, b = t.encode(pa.array([b"a\xffb c", "a\ufffdb c".encode()], pa.binary()))
    assert a.tolist() == b.tolist()
    path = str(Path(tokens.default_tokenizer()).parent / "byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    got = tokens.WordTokenizer(path).encode(pa.array([None if x is None else x.encode() for x in texts()], pa.binary()))
    assert [g.tolist() for g in got] == [whole.encode(x or "", add_special_tokens=False).ids for x in texts()]


def test_each_part_is_asked_once_and_plain_ones_of_the_model():
    """Words that differ in marks and capitals share what is remembered; only other words go through the
    file's rules for text."""
    t = tokens.WordTokenizer(tokens.default_tokenizer())

    class Asked:
        def __init__(self, of):
            self.of, self.rows = of, []

        def encode_batch_fast(self, rows, **options):
            self.rows += rows
            return self.of.encode_batch_fast(rows, **options)

    asked = Asked(t._tokenizer)
    t._tokenizer = asked
    rows = ["Wörter, wörter. WÖRTER!!", "мир МИР? ÆØþ,", "x=1, it's"]
    got = [g.tolist() for g in t.encode(pa.array([r.encode() for r in rows], pa.binary()))]
    assert got == [asked.of.encode(r, add_special_tokens=False).ids for r in rows]
    assert {"wörter", "мир", "æøþ"}.isdisjoint(" ".join(asked.rows).lower().split())
    assert sorted(t._known.to_pylist()) == sorted(["wörter", "мир", "æøþ", "x=1,", "it's", ",", ".", "!!", "?", ""])


def test_letters_of_bytes():
    from tokenizers.pre_tokenizers import ByteLevel

    plain = re.compile(tokens._PLAIN)
    words = ["".join(chr(c) for c in range(1, 0x530) if plain.match(chr(c))), "a b"]
    rules = ByteLevel(add_prefix_space=False, use_regex=False)
    want = [" ".join(rules.pre_tokenize_str(x)[0][0] for x in w.split()) for w in words]
    assert tokens._byte_letters(pa.array(["skipped", *words]).slice(1)) == want


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 8), (9, 2)])
def test_documents_are_packed_whole(spark, parts, fan_in):
    rows = list(enumerate(texts()))
    rows += [(3, rows[3][1]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = packing.pack(packing.token_pieces(df), fan_in=fan_in).toPandas()
    whole = Tokenizer.from_file(tokens.default_tokenizer())
    want = []
    for doc, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    have = [tuple(None if x != x else int(x) for x in t) for t in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_few_sequences_over_many_partitions(spark):
    r = random.Random(1)
    sizes = [(i, min(4096, int(r.lognormvariate(6.5, 1.1)) + 1)) for i in range(6000)]
    got = packing.pack(spark.createDataFrame(sizes, "k long, length long").repartition(30)).toPandas()
    least = -(-sum(s for _, s in sizes) // 4096)
    assert got.sequence_id.nunique() <= least * 1.005 + 1
    assert len(got) == 6000


def test_items_that_fit_with_none(spark, monkeypatch):
    monkeypatch.setattr(packing, "NODE_BINS", 5)
    df = spark.range(100, numPartitions=5).select("id", F.lit(2100).cast("long").alias("length"))
    assert packing.pack(df).select("sequence_id").distinct().count() == 100


def test_items_that_lie_together(spark, monkeypatch):
    """What would fill bins lies in other partitions, and the bins are too many for one task."""
    monkeypatch.setattr(packing, "NODE_BINS", 100)
    df = spark.range(2000, numPartitions=20).select("id", F.when(F.col("id") < 1000, 2596).otherwise(1500).cast("long").alias("length"))
    got = packing.pack(df)
    assert got.count() == 2000
    assert got.select("sequence_id").distinct().count() <= 1120


def test_bounds_and_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.range(1).withColumnRenamed("id", "offset"), "offset")
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(spark.range(5000, 5001).withColumnRenamed("id", "length")).collect()
