"""Best-fit sequence packing by hierarchical residual rounds."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read_table
from .tokens import default_tokenizer, tokenizer

CAPACITY = 4096
END_ID = 1
#: A bin of at least this share of the capacity is closed at once.
NEARLY_FULL = 0.998
#: A bin below this share is handed on as the items it was made of, which may fit better elsewhere.
HALF_EMPTY = 0.875
#: Nodes of the merge tree that meet in one.
FAN_IN = 8
#: Underfull bins, and pieces in them, that one task of a merging round gets on average at most; more are
#: spread over more tasks.
NODE_BINS = 50_000
NODE_PIECES = 400_000
#: Rounds at most; their number is part of a sequence's id. Nodes are an eighth after each, as a rule.
MOST_ROUNDS = 31

PIECE = T.StructType([T.StructField(c, T.IntegerType() if c == "piece" else T.LongType()) for c in ("doc_id", "piece", "start", "length", "ids_crc32")])


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin. Longest items first, each into the
    fullest bin that has room; items of equal length in the given order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = at, fills[at]
        fills[at] += length
        room -= length
        if room:
            by_room[room].append(at)
            rooms |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


def _bin_type(piece: T.StructType) -> T.StructType:
    held = T.StructType([*(T.StructField(f.name, f.dataType) for f in piece), T.StructField("offset", T.LongType())])
    return T.StructType(
        [
            T.StructField("node", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("fill", T.LongType()),
            T.StructField("done", T.BooleanType()),
            T.StructField("pieces", T.ArrayType(held)),
        ]
    )


def _pack(pieces: pa.StructArray, offsets: np.ndarray, items: np.ndarray, fills: np.ndarray, capacity: int, node: int, level: int, close_all: bool) -> pa.RecordBatch:
    """Best fit over items of `fills` tokens. pieces: all pieces, of which piece i belongs to item
    items[i] and stands at offsets[i] in it."""
    bins, place, new_fills = best_fit_decreasing(fills, capacity)
    if not close_all and (loose := (new_fills < int(capacity * HALF_EMPTY))[bins]).any():
        bins[loose] = len(new_fills) + np.arange(loose.sum())
        place[loose] = 0
        _, bins = np.unique(bins, return_inverse=True)
        new_fills = np.bincount(bins, fills).astype(np.int64)
    at, offset = bins[items], place[items] + offsets
    order = np.lexsort((offset, at))
    fields = [f.name for f in pieces.type if f.name != "offset"]
    columns = [pieces.field(f).take(pa.array(order)) for f in fields]
    held = pa.StructArray.from_arrays([*columns, pa.array(offset[order])], names=[*fields, "offset"])
    ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(new_fills)))))
    done = np.full(len(new_fills), close_all) | (new_fills >= int(capacity * NEARLY_FULL))
    ids = (level << 58) + (node << 32) + np.arange(len(new_fills))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(new_fills), node)), pa.array(ids), pa.array(new_fills), pa.array(done), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), held)],
        names=["node", "sequence_id", "fill", "done", "pieces"],
    )


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """All rows of `items` with `sequence_id` (long, any numbers) and `offset` (long, gapless from 0
    in each sequence), so that the `length` of no sequence is over `capacity`.

    Each partition packs its own items best-fit and closes the nearly full bins. The underfull ones
    (of those below HALF_EMPTY, what they were made of) become items for `fan_in` times fewer nodes, and so on until one is left. They are dealt to nodes
    by a hash, so each node gets the same mix of fills wherever the rows lay, and as many nodes as
    keep it below NODE_BINS bins on average. Where the bins that fit with no others are too many for
    three quarters as many nodes, the round that finds it is the last one, as is that of number MOST_ROUNDS:
    no bin is closed without having met that mix.
    Every round is written to the shared folder. A task holds one partition's columns (give ids and
    lengths here, not texts) or one node's bins. Lengths must be 1 to `capacity`, not null; other
    columns may hold anything and repeated rows stay. Columns named `offset` or `sequence_id` are
    refused. An empty table gives an empty result.
    """
    if {c.lower() for c in items.columns} & {"offset", "sequence_id"}:
        raise ValueError("items may not have columns named offset or sequence_id")
    names = items.columns
    return _tree(items, items.schema, lambda batches: _pack_partition(batches, names, length, capacity), capacity, fan_in)


def _pack_partition(batches: Iterator[pa.RecordBatch], names: list[str], length: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """The first round: one partition's items."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    columns = [pa.concat_arrays(c.chunks) for c in table.columns]
    sizes = table.column(length).to_numpy().astype(np.int64)
    if sizes.min() < 1 or sizes.max() > capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    n = table.num_rows
    yield _pack(pa.StructArray.from_arrays(columns, names=names), np.zeros(n, np.int64), np.arange(n), sizes, capacity, TaskContext.get().partitionId(), 0, False)


def _tree(source: DataFrame, piece: T.StructType, first: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], capacity: int, fan_in: int) -> DataFrame:
    """The rounds over what `first` makes of each partition of `source`, see `pack`."""
    kind = _bin_type(piece)
    names = piece.names
    rounds = [materialize(source.mapInArrow(first, kind), "pack-0")]
    nodes = (rounds[-1].agg(F.max("node")).first()[0] or 0) + 1
    level = 0
    last = False
    while not last:
        level += 1
        underfull = rounds[-1].filter(~F.col("done"))
        held = underfull.agg(F.count("*").alias("bins"), F.coalesce(F.sum(F.size("pieces")), F.lit(0)).alias("pieces")).first()
        fewer = max(-(-nodes // fan_in), -(-held.bins // NODE_BINS), -(-held.pieces // NODE_PIECES))
        last = fewer == 1 or 4 * fewer > 3 * nodes or level == MOST_ROUNDS
        nodes = fewer

        def merge(key: tuple, table: pa.Table, *, level: int = level, last: bool = last) -> pa.Table:
            table = table.sort_by("sequence_id")  # the order of rows is the shuffle's
            pieces = pa.concat_arrays(table.column("pieces").chunks)
            flat = pieces.flatten()
            items_of = np.repeat(np.arange(len(pieces)), np.diff(pieces.offsets.to_numpy()))
            fills = table.column("fill").to_numpy()
            return pa.Table.from_batches([_pack(flat, flat.field("offset").to_numpy(), items_of, fills, capacity, key[0].as_py(), level, last)])

        parent = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(nodes))
        rounds.append(materialize(underfull.withColumn("node", parent).groupBy("node").applyInArrow(merge, kind), f"pack-{level}"))
    out = None
    for i, bins in enumerate(rounds):
        closed = bins if i == len(rounds) - 1 else bins.filter("done")
        out = closed if out is None else out.unionByName(closed)
    flat = out.select("sequence_id", F.explode("pieces").alias("p"))
    return flat.select(*[F.col("p")[c].alias(c) for c in names], "sequence_id", F.col("p")["offset"].alias("offset"))


def token_pieces(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` tokens of every document: `doc_id`, `piece`, `start`, `length`,
    `ids_crc32` (of the ids as little-endian unsigned 32-bit numbers). A document is its text's ids
    and one `end_id`; a null or blank text is the `end_id` alone. Only longer ones are cut."""
    path = path or default_tokenizer()
    return _bodies(df, id_col, text).mapInArrow(lambda batches: _cut_pieces(batches, path, capacity, end_id), PIECE)


def _bodies(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))


def _cut_pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple] = []
        for doc, ids in zip(batch.column(0).to_pylist(), tokenizer(path).encode(batch.column(1)), strict=True):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                found.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
        columns = list(zip(*found, strict=True)) or [()] * len(PIECE.names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=PIECE.names)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places in packed sequences: see `token_pieces`, `pack`.
    Ids and the first round are made in one pass over the texts."""
    path = path or default_tokenizer()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack_partition(_cut_pieces(batches, path, capacity, end_id), PIECE.names, "length", capacity)

    return _tree(_bodies(df, id_col, text), PIECE, first, capacity, FAN_IN)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
