"""Token sequences in training order: a keyed permutation gives every sequence a global slot, and
range partitions write shards of fixed stride."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared_files
from .common import fresh_path, materialize, read_table
from .tokens import default_tokenizer, tokenizer

SEQUENCE_TOKENS = 2048
#: Sequences of a shard: 32 MB of 16-bit ids.
SHARD_SEQUENCES = 8192
END_ID = 1
PAD_ID = 0
KEY = b"training-order-1"
ROUNDS = 6
INDEX = "slot long, shard long, byte_offset long, n_tokens int, doc_ids array<long>, crc32 long"


class Feistel:
    """A keyed permutation of 0..size-1: a balanced Feistel network over the least even number of
    bits that holds `size`, walked along its cycles until it is below `size`.

    The domain is less than four times `size`, so a walk has four steps on average at most.
    """

    def __init__(self, size: int, key: bytes, rounds: int = ROUNDS) -> None:
        self.size = size
        self.half = max(1, ((max(1, size - 1)).bit_length() + 1) // 2)
        self._mask = np.uint64((1 << self.half) - 1)
        self._keys = [np.uint64(int.from_bytes(hashlib.blake2b(struct.pack("<q", i), key=key[:64], digest_size=8).digest(), "little")) for i in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ key
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self._mask

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self._mask
        if inverse:
            for key in reversed(self._keys):
                left, right = right ^ self._mix(left, key), left
        else:
            for key in self._keys:
                left, right = right, left ^ self._mix(right, key)
        return left << shift | right

    def _walk(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(x.astype(np.uint64), inverse)
            while (far := out >= np.uint64(self.size)).any():
                out[far] = self._once(out[far], inverse)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """The slot of each number."""
        return self._walk(np.asarray(numbers), False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The number that each slot holds."""
        return self._walk(np.asarray(slots), True)


def _sequences(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int) -> Iterator[tuple[np.ndarray, list[int | None]]]:
    """A partition's documents, each with `end_id` after it, as one stream cut every `length` ids;
    with the ids of the documents that have a part in each. The last sequence may be shorter."""
    held, docs = np.zeros(0, np.uint32), []
    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), tokenizer(path).encode(batch.column(1)), strict=True):
            held = np.concatenate((held, ids, np.array([end_id], np.uint32)))
            docs.append(doc)
            at = 0
            while len(held) - at >= length:
                yield held[at : at + length], docs
                at += length
                docs = [doc] if len(held) > at else []
            held = held[at:]
    if len(held):
        yield held, docs


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", length: int = SEQUENCE_TOKENS, shard_sequences: int = SHARD_SEQUENCES, key: bytes = KEY, path: str | None = None) -> DataFrame:
    """Writes all documents as sequences of `length` ids into `folder`; returns the index (INDEX).

    A sequence is numbered by the input partition and its place there, and slot = permutation of the
    number. Shard s holds slots s * shard_sequences and on, `length` little-endian unsigned 16-bit
    ids each, the last of a partition padded with PAD_ID (n_tokens tells). So slot i begins at a
    known byte of a known file, and reading can be resumed anywhere.

    The sequences are first written as a table, so that their numbers stand whatever is run again;
    of each of its partitions one number goes to the driver. Then they are moved once, packed, to
    the partition of their shard. Null and blank texts are an `end_id`; null ids stay null in doc_ids.
    Repeated rows are written each. An empty table gives no shard.
    """
    spark = docs.sparkSession
    path = path or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, list]] = []

        def out() -> pa.RecordBatch:
            nonlocal at
            places = range(at, at + len(held))
            at += len(held)
            columns = [pa.array([part] * len(held), pa.int32()), pa.array(places, pa.int64()), pa.array([len(s) for s, _ in held], pa.int32()), pa.array([d for _, d in held], pa.list_(pa.int64())), pa.array([s.astype("<u2").tobytes() for s, _ in held], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "at", "n_tokens", "doc_ids", "ids"])

        for sequence, of in _sequences(batches, path, length, END_ID):
            held.append((sequence, list(of)))
            if len(held) >= 500:
                yield out()
        if held:
            yield out()

    table = materialize(rows.mapInArrow(cut, "part int, at long, n_tokens int, doc_ids array<long>, ids binary"), "order-sequences", compression="zstd")
    first, total = {}, 0
    for r in table.groupBy("part").count().orderBy("part").collect():
        first[r.part] = total
        total += r["count"]
    permutation = Feistel(total, key) if total else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            numbers = np.array([first[p] for p in batch.column(0).to_pylist()], np.int64) + batch.column(1).to_numpy()
            slots = permutation.slots(numbers)
            packed = pa.array([packer.compress(x.as_py()) for x in batch.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array((slots // shard_sequences).astype(np.int32)), batch.column(2), batch.column(3), packed], names=["slot", "shard", "n_tokens", "doc_ids", "packed"])

    stride = 2 * length

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, at, done = None, None, 0, []
        unpacker = zstandard.ZstdDecompressor()
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["shard"] != now:
                        if out is not None:
                            out.commit()
                        now, at = row["shard"], 0
                        out = shared_files.Committed(folder, shard_name(now))
                    if row["slot"] != now * shard_sequences + at:
                        raise RuntimeError(f"slot {row['slot']} stands where {now * shard_sequences + at} belongs")
                    data = unpacker.decompress(row["packed"])
                    data += struct.pack("<H", PAD_ID) * ((stride - len(data)) // 2)
                    out.stream.write(data)
                    done.append((row["slot"], now, at * stride, row["n_tokens"], row["doc_ids"], zlib.crc32(data)))
                    at += 1
                    if len(done) >= 5000:
                        yield _index_batch(done)
                        done = []
            if out is not None:
                out.commit()
        except BaseException:
            if out is not None:
                out.abort()
            raise
        if done:
            yield _index_batch(done)

    shards = -(-total // shard_sequences)
    placed = table.mapInArrow(place, "slot long, shard int, n_tokens int, doc_ids array<long>, packed binary")
    ranged = placed.repartitionById(max(1, shards), "shard").sortWithinPartitions("slot")
    ranged.mapInArrow(store, INDEX).write.parquet(f"{folder}/_index")
    commit = shared_files.Committed(folder, "_ORDER.json")
    said = {"sequences": total, "length": length, "shard_sequences": shard_sequences, "stride": stride, "pad_id": PAD_ID, "key": key.hex()}
    commit.stream.write(json.dumps(said).encode())
    commit.commit()
    return spark.read.schema(INDEX).parquet(f"{folder}/_index")


def shard_name(shard: int) -> str:
    return f"shard-{shard:07d}.bin"


def _index_batch(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["slot", "shard", "byte_offset", "n_tokens", "doc_ids", "crc32"])


def read_from(folder: str, slot: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The padded sequences of slots `slot` to `stop` (default: all) in order, in one process: what a
    training run reads, and resumes."""
    files, root = shared_files.at(folder)
    with files.open_input_stream(f"{root}/_ORDER.json") as f:
        said = json.loads(f.read())
    stop = said["sequences"] if stop is None else min(stop, said["sequences"])
    while slot < stop:
        shard, at = divmod(slot, said["shard_sequences"])
        with files.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(at * said["stride"])
            while slot < stop and slot // said["shard_sequences"] == shard:
                yield np.frombuffer(f.read(said["stride"]), "<u2")
                slot += 1


def verify(index: DataFrame, folder: str) -> DataFrame:
    """The rows of `index` with `read_crc32`, of the bytes that the shards hold at their places."""
    schema = INDEX + ", read_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = shared_files.at(folder)
        with files.open_input_stream(f"{root}/_ORDER.json") as f:
            stride = json.loads(f.read())["stride"]
        now, stream = None, None
        for batch in batches:
            found = []
            for shard, offset in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if shard != now:
                    now, stream = shard, files.open_input_file(f"{root}/{shard_name(shard)}")
                stream.seek(offset)
                found.append(zlib.crc32(stream.read(stride)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "read_crc32"])

    return index.mapInArrow(run, schema)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences in training order, with what the shards hold."""
    folder = fresh_path(spark, "training-order")
    index = write(read_table(spark, sf_dir, "documents"), folder)
    return verify(index, folder)


QUERIES = {"op4_training_order": op4_training_order}
ORACLE_SQL: dict[str, str] = {}
