"""Deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared_files
from .common import fresh_path, read_table

#: A file is closed once it has this many compressed bytes.
ROLL_BYTES = 64 << 20
#: Payloads of at least this many bytes are written once; later equal ones revisit the first.
REVISIT_BYTES = 0
#: Compressed bytes of input (as read) for each range partition.
PARTITION_BYTES = 16 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:colloquy:warc")

MANIFEST = "file string, records long, bytes long, sha256 string, first_page long, last_page long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, record_offset long, payload binary"


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {payload_digest} {copy}')}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters and the percent sign's own are escaped."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member. Equal records give equal bytes: it holds no time."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None, str | None] | None, copy: int, payload_digest: str) -> bytes:
    """A response, or (refers_to: page and url of the response) a revisit without the payload. The
    HTTP head gives the full payload's length for both."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if refers_to else payload)
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", _record_id(page_id, payload_digest, copy)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    headers += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers_to:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to[0], payload_digest, 0)), ("WARC-Refers-To-Date", DATE)]
        if refers_to[1] is not None:
            headers.append(("WARC-Refers-To-Target-URI", _clean(refers_to[1])))
        headers.append(("X-Refers-To-Page", "" if refers_to[0] is None else str(refers_to[0])))
    headers += [("X-Page", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response")]
    return _member(headers, block)


def _info(name: str) -> bytes:
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _member(headers, b"format: WARC File Format 1.1\r\nsoftware: colloquy\r\n")


def revisits(pages: DataFrame, id_col: str, url: str, page: str, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """`page_id`, `digest` (raw SHA-1), `first_page`, `first_url` of the rows whose payload of at
    least `least_bytes` another row has too. The first is the least id, null after all others; of
    rows of that id, that with the least url.

    Only ids, urls and digests are shuffled; counts are combined before it.
    """
    body = F.coalesce(F.col(page), F.lit(""))
    marks = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("u"), F.unhex(F.sha1(body.cast("binary"))).alias("digest"), F.octet_length(body).alias("size"))
    marks = marks.filter(F.col("size") >= least_bytes)
    key = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("u").isNotNull().alias("has"), "u")
    first = marks.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.u").alias("first_url"))
    return marks.select("page_id", "digest").join(first, "digest").select("page_id", "digest", "first_page", "first_url").distinct()


def write(pages: DataFrame, folder: str, partitions: int, id_col: str = "page_id", url: str = "url", page: str = "html", roll_bytes: int = ROLL_BYTES, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes one record per row of `pages` into `folder` and returns the manifest (its columns: MANIFEST).

    Rows are range-sorted by `id_col` (null first; equal ids by url, then by digest); each partition
    writes files that are closed at `roll_bytes`, `part-<partition>-<n>.warc.gz`, through temporary
    names. Then the manifest is written, and last `_MANIFEST.json`; what no manifest lists is no
    part of the archive. The same rows and `partitions` give the same bytes.

    Null pages are empty payloads, null urls have no target. Of repeated rows the first is the
    response. An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).cast("binary").alias("payload"))
    notes = revisits(pages.withColumn(id_col, F.col(id_col).cast("long")), id_col, url, page, least_bytes)
    # A note sorts before the rows of its page: payloads are shuffled once, by the range sort.
    rows = rows.withColumns({"note": F.lit(False), "digest": F.lit(None).cast("binary"), "first_page": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")})
    notes = notes.withColumns({"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary"), "note": F.lit(True)})
    both = rows.unionByName(notes).repartitionByRange(partitions, "page_id").sortWithinPartitions("page_id", F.desc("note"), F.col("url").asc_nulls_last(), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        done: list[tuple] = []
        out, name, size, count, sha, first, last = None, "", 0, 0, hashlib.sha256(), None, None
        noted: dict[bytes, tuple[int | None, str | None]] = {}
        copies: dict[str, int] = {}
        now: int | None = -1
        fresh = True

        def close() -> None:
            nonlocal out
            if out is not None:
                out.commit()
                done.append((name, count, size, sha.hexdigest(), first, last))
                out = None

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if fresh or row["page_id"] != now:
                        now, noted, copies, fresh = row["page_id"], {}, {}, False
                    if row["note"]:
                        noted[row["digest"]] = (row["first_page"], row["first_url"])
                        continue
                    raw = hashlib.sha1(row["payload"]).digest()
                    text = base64.b32encode(raw).decode()
                    copy = copies.get(text, 0)
                    copies[text] = copy + 1
                    head = noted.get(raw)
                    is_first = head is None or (head[0] == now and copy == 0)
                    if out is None:
                        name = f"part-{task:05d}-{len(done):05d}.warc.gz"
                        out = shared_files.Committed(folder, name)
                        info = _info(name)
                        out.stream.write(info)
                        size, count, sha, first = len(info), 0, hashlib.sha256(info), now
                    member = page_record(now, row["url"], row["payload"], None if is_first else head, copy, text)
                    out.stream.write(member)
                    sha.update(member)
                    size, count, last = size + len(member), count + 1, now
                    if size >= roll_bytes:
                        close()
            close()
        except BaseException:
            if out is not None:
                out.abort()
            raise
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes", "sha256", "first_page", "last_page"), d, strict=True)) for d in done], schema=_MANIFEST_ARROW)

    manifest = f"{folder}/_manifest"
    both.mapInArrow(run, MANIFEST).write.parquet(manifest)
    listed = spark.read.parquet(manifest)
    total = listed.agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    commit = shared_files.Committed(folder, "_MANIFEST.json")
    commit.stream.write(json.dumps({"manifest": "_manifest", "files": total.files, "records": total.records or 0, "bytes": total.bytes or 0}).encode())
    commit.commit()
    return listed


_MANIFEST_ARROW = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64())])
_RECORD_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("record_offset", pa.int64()), ("payload", pa.binary())]
)


def members(stream: object, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Place and content of each gzip member of a stream; holds one record at a time."""
    rest, at, start = b"", 0, 0
    unpack, parts = zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            if parts or at != start:
                raise ValueError("the file ends within a record")
            return
        parts.append(unpack.decompress(data))
        at += len(data) - len(unpack.unused_data)
        if unpack.eof:
            yield start, b"".join(parts)
            rest, start, parts, unpack = unpack.unused_data, at, [], zlib.decompressobj(31)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is not as long as it says")
    if (said := headers.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
        raise ValueError("a block does not have its digest")
    return headers, block


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of all files that the manifest of `folder` lists (columns: RECORD). Digests
    and lengths are checked; a revisit's `payload` is null, its size and digest those of the full
    payload. `payloads=False` leaves payloads null."""
    filesystem, root = shared_files.at(folder)
    with filesystem.open_input_stream(f"{root}/_MANIFEST.json") as f:
        listed = json.loads(f.read())
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/{listed['manifest']}")
    work = files.select("file", "records").repartition(max(1, listed["files"]), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                source, base = shared_files.at(folder)
                held, size, count = [], 0, 0
                with source.open_input_stream(f"{base}/{entry['file']}", compression=None) as stream:
                    for start, record in members(stream):
                        headers, block = parse_record(record)
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        count += 1
                        row = _page_row(headers, block, payloads) | {"file": entry["file"], "record_offset": start}
                        held.append(row)
                        size += len(block)
                        if size > 8 << 20 or len(held) >= 5000:
                            yield pa.RecordBatch.from_pylist(held, schema=_RECORD_ARROW)
                            held, size = [], 0
                if count != entry["records"]:
                    raise ValueError(f"{entry['file']} has {count} records, its manifest says {entry['records']}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_RECORD_ARROW)

    return work.mapInArrow(run, RECORD)


def _page_row(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    size, kind = int(said["content-length"]), headers["warc-type"]
    payload_digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != payload_digest):
        raise ValueError("a payload does not have its length or digest")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(headers["x-page"]),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": payload_digest,
        "record_type": kind,
        "refers_to": number(headers.get("x-refers-to-page")),
        "payload": payload if payloads and kind == "response" else None,
    }


def partitions_for(df: DataFrame) -> int:
    """Range partitions for a table, of its size on disk as the optimizer knows it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(4, min(200_000, -(-size // PARTITION_BYTES)))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files into the shared folder, and read back."""
    pages = read_table(spark, sf_dir, "pages")
    folder = fresh_path(spark, "warc")
    write(pages, folder, partitions_for(pages))
    return read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL: dict[str, str] = {}
