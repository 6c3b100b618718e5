"""WARC archives: exact round trips, equal bytes on every run, revisits against a plain version."""

import base64
import gzip
import hashlib
import random

import pytest

from colloquy.llm import warc
from colloquy.llm.common import fresh_path
from colloquy.llm.shared_files import at

KIND = "page_id long, url string, html string, digest string"


def rows():
    r = random.Random(6)
    texts = ["<p>é</p>\r\n\r\nx", "", None, "same " * 30, "WARC/1.1\r\n\r\n", "x" * 200_000]
    out = [(i, f"http://h/{i}\n%", r.choice([*texts, f"page {i}"]), "c") for i in range(150)]
    return out + [(None, None, "same " * 30, None), (None, "u", "alone", None), (7, "http://h/7\n%", out[7][2], "c"), (200, "z", "twin", "c"), (200, "z", "twin", "c"), (200, "a", "other", "c")]


def slow(rows):
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    first, out = {}, []
    for page, _, html, _ in order:
        body = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), sha, "revisit", first[sha]) if sha in first else (page, len(body), sha, "response", None))
        first.setdefault(sha, page)
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), KIND)
    folder = fresh_path(spark, "warc-test")
    manifest = warc.write(df, folder, 3, roll_bytes=3000).collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == len(rows())
    got = warc.read(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == slow(rows())
    want = {(p, (h or "").encode()) for p, _, h, _ in rows()}
    assert {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"} <= want
    files, root = at(folder)
    for m in manifest:  # plain gzip readers can read them
        with files.open_input_stream(f"{root}/{m.file}", compression=None) as f:
            data = f.read()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and hashlib.sha256(data).hexdigest() == m.sha256


def test_same_bytes_again(spark):
    df = spark.createDataFrame(rows(), KIND)
    names = lambda d, n: sorted(warc.write(d, fresh_path(spark, "warc-test"), n, roll_bytes=5000).select("file", "sha256").collect())
    assert names(df, 1) == names(df.repartition(7), 1)
    assert names(df, 4) == names(df, 4)


def test_small_payloads_never_revisit(spark):
    df = spark.createDataFrame([(1, "u", "aa", ""), (2, "u", "aa", ""), (3, "u", "bbbb", ""), (4, "u", "bbbb", "")], KIND)
    folder = fresh_path(spark, "warc-test")
    warc.write(df, folder, 1, least_bytes=3)
    assert [(r.page_id, r.record_type) for r in warc.read(spark, folder).orderBy("page_id").collect()] == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_and_broken(spark):
    df = spark.createDataFrame([], KIND)
    folder = fresh_path(spark, "warc-test")
    assert warc.write(df, folder, 2).collect() == []
    assert warc.read(spark, folder).collect() == []
    record = warc.page_record(1, "u", b"text", None, 0, warc.digest(b"text"))
    plain = gzip.decompress(record)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(plain.replace(b"\r\n\r\ntext", b"\r\n\r\ntexx"))
