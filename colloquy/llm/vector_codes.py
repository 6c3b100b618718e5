"""Codes for vectors: a codebook for each part of them, fitted by Yinyang Lloyd in whole numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, fresh_path, read_table
from .vectors import digest, finite, floor_means, scaled, squared_distances

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Groups that the entries of a codebook are put in; a vector's part keeps one bound for each.
GROUPS = 4
#: More than the rounding of one step with floating-point numbers, of which bounds are made.
SLACK = 2.0**-50

OUTPUT = ("code", "error", "label_error", "codebooks_sha256")


def _above(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0) * (1 - SLACK)


def group_entries(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """A group for each entry of a codebook: near entries, by a few rounds of Lloyd. Which group an entry
    is in changes what is looked at, never a result."""
    centers = entries[np.linspace(0, len(entries) - 1, min(groups, len(entries))).astype(int)] if len(entries) else entries
    of = np.zeros(len(entries), np.int64)
    for _ in range(rounds if len(entries) else 0):
        of = squared_distances(entries, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, entries)
        centers = floor_means(sums, np.bincount(of, minlength=len(centers)), centers)
    return of


@dataclass
class Codebook:
    """Entries for one part, what group each is in, and how far each has moved since the bounds were set."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @classmethod
    def start(cls, entries: np.ndarray, groups: int = GROUPS) -> Codebook:
        return cls(entries, group_entries(entries, groups), np.zeros(len(entries)))

    def after(self, entries: np.ndarray) -> Codebook:
        apart = entries - self.entries
        return Codebook(entries, self.group, _above(np.sqrt(np.einsum("ij,ij->i", apart, apart).astype(np.float64))))

    @property
    def groups(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.group == g) for g in range(self.group.max() + 1)] if len(self.group) else []


@dataclass
class Bounds:
    """Of each row: its entry, a distance that its entry is not beyond, and for each group one that no other
    entry of the group is nearer than."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def _bound_of(apart: np.ndarray, members: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Least distance among the members other than the row's own entry; infinite if there is none."""
    others = np.where(members[None, :] == code[:, None], np.inf, apart.astype(np.float64))
    return _below(np.sqrt(others.min(axis=1, initial=np.inf)))


def assign_all(x: np.ndarray, book: Codebook) -> tuple[Bounds, int]:
    """Nearest entries by looking at all, with the bounds that follow; and how many distances that took."""
    apart = squared_distances(x, book.entries)
    code = apart.argmin(axis=1)
    lower = np.stack([_bound_of(apart[:, g], g, code) for g in book.groups], axis=1)
    return Bounds(code, _above(np.sqrt(apart[np.arange(len(x)), code].astype(np.float64))), lower), apart.size


def assign_by_bounds(x: np.ndarray, book: Codebook, held: Bounds) -> tuple[Bounds, int]:
    """Nearest entries after the codebook moved, as `assign_all` finds them, the lower of equally near ones.

    Bounds give way by as much as the entries moved. A row whose upper bound stays below all its lower ones
    keeps its entry; for others the upper bound is made exact, and only groups whose bound does not exceed
    it are looked at. Bounds are rounded outwards and compared strictly, distances are whole numbers: a tie
    is always looked at and decided exactly.
    """
    groups = book.groups
    drift = np.array([book.moved[g].max(initial=0.0) for g in groups])
    code, upper, lower = held.code.copy(), _above(held.upper + book.moved[held.code]), _below(held.lower - drift)
    rows = np.flatnonzero(lower.min(axis=1) <= upper)
    own = x[rows] - book.entries[code[rows]]
    exact = np.einsum("ij,ij->i", own, own)
    least, best = exact.copy(), code[rows]
    limit = _above(np.sqrt(exact.astype(np.float64)))
    looked = [np.flatnonzero(lower[rows, g] <= limit) for g in range(len(groups))]
    found = [squared_distances(x[rows[at]], book.entries[members]) for at, members in zip(looked, groups, strict=True)]
    for at, members, apart in zip(looked, groups, found, strict=True):
        for entry, d in zip(members, apart.T, strict=True):
            nearer = (d < least[at]) | ((d == least[at]) & (entry < best[at]))
            least[at] = np.where(nearer, d, least[at])
            best[at] = np.where(nearer, entry, best[at])
    # The entry that a row left is one of the others now.
    left = np.flatnonzero(best != code[rows])
    of = book.group[code[rows[left]]]
    lower[rows[left], of] = np.minimum(lower[rows[left], of], _below(np.sqrt(exact[left].astype(np.float64))))
    for g, (at, members, apart) in enumerate(zip(looked, groups, found, strict=True)):
        lower[rows[at], g] = _bound_of(apart, members, best[at])
    code[rows] = best
    upper[rows] = _above(np.sqrt(least.astype(np.float64)))
    return Bounds(code, upper, lower), len(rows) + sum(a.size for a in found)


def _flat(column: pa.Array, dtype: type) -> np.ndarray:
    """Values of a column of lists, one after the other."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype)


def _assign(batch: pa.RecordBatch, books: list[Codebook]) -> tuple[np.ndarray, list[Bounds], int]:
    """The vectors of a batch, by row and part, their entries and bounds, and the distances looked at."""
    n = batch.num_rows
    x = _flat(batch.column("v"), np.int64).reshape(n, len(books), -1)
    bounds, looked = [], 0
    if "code" in batch.schema.names:
        code = _flat(batch.column("code"), np.int64).reshape(n, len(books))
        upper = _flat(batch.column("upper"), np.float64).reshape(n, len(books))
        lower = np.split(_flat(batch.column("lower"), np.float64).reshape(n, -1), np.cumsum([len(b.groups) for b in books])[:-1], axis=1)
    for p, book in enumerate(books):
        found, cost = assign_by_bounds(x[:, p], book, Bounds(code[:, p], upper[:, p], lower[p])) if "code" in batch.schema.names else assign_all(x[:, p], book)
        bounds.append(found)
        looked += cost
    return x, bounds, looked


_STATE = "v array<int>, code array<int>, upper array<double>, lower array<double>"
_SUMS = "part int, entry int, n long, total array<long>, looked long"


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _round(books: list[Codebook], names: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their new state, then for each entry that a partition uses the number and the sum of its
    parts. Both in one table: each is read without the other's columns."""

    def filled(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(b.entries) for b in books]
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        looked = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, bounds, cost = _assign(batch, books)
            looked += cost
            for p, found in enumerate(bounds):
                np.add.at(sums[p], found.code, x[:, p])
                counts[p] += np.bincount(found.code, minlength=len(counts[p]))
            yield filled(batch.num_rows, {
                **{c: batch.column(c) for c in (*names, "v")},
                "code": _lists(np.stack([b.code for b in bounds], axis=1), pa.int32()),
                "upper": _lists(np.stack([b.upper for b in bounds], axis=1), pa.float64()),
                "lower": _lists(np.concatenate([b.lower for b in bounds], axis=1), pa.float64()),
            })
        used = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        if used:
            yield filled(len(used), {
                "part": pa.array([p for p, _ in used], pa.int32()),
                "entry": pa.array([e for _, e in used], pa.int32()),
                "n": pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
                "total": pa.array([sums[p][e] for p, e in used], pa.list_(pa.int64())),
                "looked": pa.array([looked, *[0] * (len(used) - 1)], pa.int64()),
            })

    return run


def _final(books: list[Codebook], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their code in hex and the exact error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, bounds, _ = _assign(batch, books)
            error = np.zeros(batch.num_rows, np.int64)
            for p, found in enumerate(bounds):
                apart = x[:, p] - books[p].entries[found.code]
                error += np.einsum("ij,ij->i", apart, apart)
            codes = [row.tobytes().hex() for row in np.stack([b.code for b in bounds], axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(codes), pa.array(error)], names=[*names, "code", "error"])

    return run


def _written(df: DataFrame, before: str | None) -> tuple[DataFrame, str]:
    """`df` written into the shared folder and read back. The table that it was made of goes then."""
    spark = df.sparkSession
    path = fresh_path(spark, "codes-round")
    df.write.parquet(path)
    if before:
        old = spark._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(df.schema).parquet(path), path


@dataclass
class Codes:
    """Rows (id, label, `code`, `error`) and the codebooks. looked: of each round, the distances that were
    computed."""

    rows: DataFrame
    books: list[np.ndarray]
    looked: list[int]


def fit_codes(df: DataFrame, names: list[str], vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, groups: int = GROUPS) -> Codes:
    """Codebooks of `df`'s vectors and the rows (columns `names`, of which the first is the id) with their
    codes; see `encode`. `names` may not be a column of the state."""
    spark = df.sparkSession
    kept = df.filter(finite(F.col(vector))).select(*names, F.col(vector).alias("v"))
    usual = kept.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    plain = T.StructType([*(kept.schema[c] for c in names), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    odd = kept.filter(F.size("v") != (usual.n if usual else -1)).select(*names, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not usual:
        return Codes(odd, [np.zeros((0, 0), np.int64)] * parts, [])
    state, path = _written(kept.filter(F.size("v") == usual.n).select(*names, scaled(F.col("v"), scale).alias("v")), None)
    first = state.orderBy(F.col(names[0]).asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1)
    books = [Codebook.start(start[:, p].copy(), groups) for p in range(parts)]
    shape = T.StructType([*(kept.schema[c] for c in names), *T._parse_datatype_string(_STATE).fields, *T._parse_datatype_string(_SUMS).fields])
    width, looked = usual.n // parts, []
    for _ in range(rounds):
        fields = pa.schema([*spark.createDataFrame([], shape).toArrow().schema])
        state, path = _written(state.mapInArrow(_round(books, names, fields), shape), path)
        totals = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
        new, counts = [np.zeros_like(b.entries) for b in books], [np.zeros(len(b.entries), np.int64) for b in books]
        looked.append(0)
        for row in state.filter("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("looked").alias("looked"), *totals).collect():
            counts[row[0]][row[1]], new[row[0]][row[1]] = row[2], row[4:]
            looked[-1] += row[3]
        books = [b.after(floor_means(s, c, b.entries)) for b, s, c in zip(books, new, counts, strict=True)]
        state = state.filter("v is not null").select(*names, "v", "code", "upper", "lower")
    rows, _ = _written(state.mapInArrow(_final(books, names), plain), path)
    return Codes(rows.unionByName(odd), [b.entries for b in books], looked)


def encode(df: DataFrame, id_col: str, vector: str, label: str, **how: int) -> DataFrame:
    """One row for each vector without null and non-finite components: `id_col`, `code` (two hex digits a
    part), `error` (squared distances of its parts from their entries), `label_error` (errors summed over
    rows of equal labels, nulls together), `codebooks_sha256` (of all entries, by part).

    Components become floor(scale * x); vectors are cut into `parts` equal parts. Each part's codebook starts
    as that part of the vectors with the `entries` least ids, null ids last, of equal ids the least vectors.
    Each of `rounds` rounds assigns every part to the nearest entry, of equally near ones the lower, and moves
    each entry that is used to the floored mean of its parts. Bounds and groups save distances and change
    nothing.

    Vectors are those of the most frequent length that can be cut, of equally frequent ones the longest;
    one of another length has a row with null code and error, and its label's error counts it not. A label
    without any error has null. Repeated rows each have theirs, an empty table gives an empty result, and
    fewer vectors than entries give a smaller codebook. Further columns are ignored. A component beyond
    `vectors.LARGEST` after scaling is an error.
    """
    if {id_col.lower(), label.lower()} & set(OUTPUT):
        raise ValueError(f"{id_col} or {label} is a column of the result")
    found = fit_codes(df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x")), ["id", "label"], "x", **how)
    sums = found.rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    rows = found.rows.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("of")))
    sha = digest(np.concatenate([b.ravel() for b in found.books]))
    return rows.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their codes."""
    return encode(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def _sql() -> str:
    """The rounds written out one after the other, each over all parts."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM kept, unnest(range({PARTS})) AS u(p))",
        f"c0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM cut) WHERE e < {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, p, v, e, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS r FROM (SELECT vec_id, k.p, k.v, e,
 CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cut k JOIN c{i} m ON k.p = m.p)) WHERE r = 1)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (SELECT p, e, list(m ORDER BY j) AS v FROM (SELECT p, e, j, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
 FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{i}) GROUP BY p, e, j) GROUP BY p, e)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(s.v, o.v) AS v FROM c{i} o LEFT JOIN s{i} s ON o.p = s.p AND o.e = s.e)")
    return f"""WITH {", ".join(steps)}, coded AS (SELECT vec_id, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE_SQL = {"op13_vector_codes": _sql()}
