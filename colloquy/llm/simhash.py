"""SimHash near-duplicate detection with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, materialize, read_table, small_enough
from .components import connected_components

BITS = 64
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
#: Segment keys with more fingerprints than this take the exact linear path, not pairs.
DENSE_KEY = 64
#: Shingles hashed at once, so that the memory of a long text is bounded.
CHUNK = 1 << 16


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words.

    A-Z are lower-cased; words are runs without ASCII white space; a text of fewer words than a
    shingle has is one shingle. A bit is 1 if it is set in more than half of the XXH64 values.
    """
    if text is None:
        return 0
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    if not words:
        return 0
    # One joined text, of which each shingle is a slice.
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - size] + 1)).tolist()
    stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, text: str, out: str, keep: list[str], shingle: int = SHINGLE_WORDS) -> DataFrame:
    """`keep` columns of `df` and a signed 64-bit fingerprint `out` of column `text`."""
    rows = df.select(*keep, F.col(text).cast("binary").alias(fresh_name(keep, "_body")))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(len(keep))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(prints.view(np.int64))], names=[*keep, out])

    return rows.mapInArrow(run, schema)


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """First bit and width of each of `segments` nearly equal segments of a fingerprint."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in pairwise(edges)]


def _segment(value: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1))


def chain_holds(a: Column, b: Column, start: int, distance: int, segments: int) -> Column:
    """Pigeonring condition: from segment `start` on, round the ring, every chain of l segments
    differs in at most floor(l * distance / segments) bits. Of two fingerprints within `distance`
    some start fulfils it, so it loses no link."""
    bounds = segment_bounds(segments)
    so_far, holds = F.lit(0), F.lit(True)
    for length in range(1, segments + 1):
        first, width = bounds[(start + length - 1) % segments]
        so_far = so_far + F.bit_count(_segment(a.bitwiseXOR(b), first, width))
        holds = holds & (so_far <= length * distance // segments)
    return holds


def links(prints: DataFrame, distance: int = MAX_DISTANCE, dense_key: int = DENSE_KEY) -> DataFrame:
    """Links `a`, `b` that join all distinct fingerprints `fp` within `distance` bits.

    With distance + 1 segments, a chain of length one has no difference: pairs are looked for
    among fingerprints that share a whole segment, and pruned by the longer chains before the full
    Hamming check. A segment value that more than `dense_key` fingerprints share would give pairs
    with the square of their number. Its members are linked exactly another way: each emits the
    codes within half the distance of it, and fingerprints that share a code link to the least of
    them (any two within `distance` share one; any two that share one are within it). That is
    linear, and complete, however many share the segment.
    """
    segments = distance + 1
    bounds = segment_bounds(segments)
    keyed = prints.select("fp", F.posexplode(F.array(*[_segment(F.col("fp"), *b) for b in bounds])).alias("seg", "val"))
    dense = keyed.groupBy("seg", "val").count().filter(F.col("count") > dense_key).select("seg", "val")
    dense = materialize(dense, "simhash-dense")
    if small_enough(dense):
        dense = F.broadcast(dense)
    sparse = keyed.join(dense, ["seg", "val"], "left_anti")
    a, b = sparse.select("seg", "val", F.col("fp").alias("a")), sparse.select("seg", "val", F.col("fp").alias("b"))
    ring = F.lit(False)
    for i in range(segments):
        ring = ring | ((F.col("seg") == i) & chain_holds(F.col("a"), F.col("b"), i, distance, segments))
    near = a.join(b, ["seg", "val"]).filter("a < b").filter(ring)
    near = near.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()

    crowd = keyed.join(dense, ["seg", "val"], "left_semi").select("fp").distinct()
    codes = crowd.select("fp", F.explode(F.array(*_ball(F.col("fp"), distance // 2))).alias("code"))
    least = codes.groupBy("code").agg(F.min("fp").alias("m"), F.count("*").alias("n")).filter("n > 1").select("code", "m")
    met = codes.join(least, "code").filter("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct()
    return near.unionByName(met)


def _ball(value: Column, radius: int) -> list[Column]:
    """All codes within `radius` (0 or 1) bits."""
    flips = [value.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)]
    return [value, *flips] if radius else [value]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(df: DataFrame, id_col: str, text: str, keep: list[str] | None = None, distance: int = MAX_DISTANCE, shingle: int = SHINGLE_WORDS, dense_key: int = DENSE_KEY) -> DataFrame:
    """One row per row of `df`: the `keep` columns (default: `id_col`), `fingerprint` (16 lower-case
    hex digits) and `component_id`, the least `id_col` that links reach, its own included.

    distance: 2 (or 0 to 3; odd values use the next lower half for the dense path's codes and are
    refused). Null and blank texts have fingerprint zero and link like others. Repeated rows and
    ids each give their own row. A null id is never a component's least id; a component of null
    ids only has a null component_id. An empty table gives an empty result.
    """
    if distance not in (0, 2):
        raise ValueError("distance must be 0 or 2")
    keep = keep or [id_col]
    if {c.lower() for c in keep} & {"fp", "fingerprint", "component_id", "component", "node"}:
        raise ValueError(f"clashing names in keep: {keep}")
    rows = materialize(add_fingerprints(df, text, "fp", keep, shingle), "simhash-rows")
    prints = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-prints")
    parts = connected_components(links(prints.select("fp"), distance, dense_key)) if distance else None
    if parts is not None:
        parts = materialize(parts, "simhash-parts")
        linked = prints.join(parts, prints.fp == parts.node)
        least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
        linked = linked.join(least, "component").select("fp", "component_id")
        single = prints.join(parts, prints.fp == parts.node, "left_anti").select("fp", F.col("first_id").alias("component_id"))
        prints = linked.unionByName(single)
    else:
        prints = prints.withColumnRenamed("first_id", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(prints, "fp").select(*keep, hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str, text: str, **how: int) -> DataFrame:
    """The rows of `df` of which one stays for each near-duplicate component: that with the least id,
    of equal ids the first row. Columns as in `df`. Rows with a null id count after all others.
    """
    row = fresh_name(df.columns, "_row")
    rows = materialize(df.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    # Order by id, then by row: dense over the ids and unique, so one row of each component has the least.
    ranked = rows.select(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("key"), F.col(text).alias("body"))
    found = near_duplicates(ranked, "key", "body", keep=["key"], **how)
    gone = found.filter(F.col("key.row") != F.col("component_id.row")).select(F.col("key.row").alias(row))
    gone = materialize(gone, "simhash-gone")
    if small_enough(gone, 1_000_000):
        gone = F.broadcast(gone)
    return rows.join(gone, row, "left_anti").select(*df.columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
