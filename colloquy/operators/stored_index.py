"""A stored inverted index: posting lists by token, or by runs of three characters, in segments.

    index = StoredIndex.create(spark, "/lake/ix", key="doc_id")
    index.add(docs, ["text"])                     # a segment; later files are added as further ones
    index.match_phrase(["of", "the"]).show()
    index.merge()                                 # one segment of all

A segment is a Parquet table sorted by token: `token`, `col`, `first` and `last` (keys), `n`, `ids` (keys less
`first`) and `places` (of each key, where the token stands). The file format's statistics of row groups and
pages lead a question to the few pages that hold its tokens; whole numbers are delta-coded by the format.
A directory beside it tells how many keys have each token, which questions are planned by.

A generation is a small file that names the segments. A writer puts the next generation's file in place under
a name that was not there; readers take the latest one, so they see all of a change or nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import storage

#: Keys of one posting row at most.
RUN = 4096
#: Tokens or characters that a task turns into posting rows at once.
AT_ONCE = 1 << 20
#: Of the least frequent token, so many keys may be broadcast; more are met by a shuffled join.
BROADCAST_KEYS = 500_000
#: Tokens of a table that are named to the scan of the index; more meet it in a join.
TOKENS_PUSHED = 2_000
#: Runs of so many characters are what substrings are looked up by; of a pattern's, at most so many are
#: looked up in the directory, and the keys of so many rarest ones met. More could only prune more.
GRAM = 3
GRAMS_PLANNED = 64
GRAMS_MET = 4
#: Beyond this share of all keys that have the rarest run, all texts are read.
WORTH_A_LOOK = 0.5
#: Bytes of a row group and of a page: what is read for a token at least.
GROUP_BYTES = 4 << 20
PAGE_BYTES = 16 << 10

_SCHEMA = "token string, first long, last long, n int, ids array<long>, places array<array<int>>"


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where one of the sorted columns has another value than before."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _rows(names: pa.Array, code: np.ndarray, keys: np.ndarray, places: pa.Array, run: int) -> pa.RecordBatch:
    """Posting rows of entries (token code, key, places), sorted by code and key, of `run` keys at most."""
    within = np.arange(len(code)) - np.repeat(heads := _heads(code), np.diff(np.append(heads, len(code))))
    start = _heads(code, within // run)
    bounds = np.append(start, len(code))
    first, n = keys[start], np.diff(bounds)
    ids = pa.array(keys - np.repeat(first, n))
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(code[start])), pa.array(first), pa.array(keys[bounds[1:] - 1]), pa.array(n.astype(np.int32)), _lists(bounds, ids), _lists(bounds, places)],
        names=["token", "first", "last", "n", "ids", "places"],
    )


def _of_tokens(keys: np.ndarray, units: pa.Array, run: int) -> pa.RecordBatch:
    """Posting rows of rows of tokens; rows in order of their keys."""
    sizes = np.diff(units.offsets.to_numpy())
    flat = units.flatten().dictionary_encode()
    code = flat.indices.to_numpy()
    row = np.repeat(np.arange(len(keys)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(code, kind="stable")
    code, row, place = code[order], row[order], place[order]
    start = _heads(code, row)
    return _rows(flat.dictionary, code[start], keys[row[start]], _lists(np.append(start, len(code)), pa.array(place.astype(np.int32))), run)


def _of_text(keys: np.ndarray, texts: pa.Array, run: int) -> pa.RecordBatch:
    """Posting rows, without places, of the runs of GRAM characters of texts; texts in order of their keys."""
    found = [x or "" for x in texts.to_pylist()]
    chars = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    size = max(0, len(chars) - GRAM + 1)
    packed = np.zeros(size, np.int64)
    for i in range(GRAM):
        packed = (packed << 21) | chars[i : i + size]
    inside = row[:size] == row[GRAM - 1 :]
    grams, code = np.unique(packed[inside], return_inverse=True)
    code, row = np.divmod(np.unique(code * len(found) + row[:size][inside]), max(1, len(found)))
    names = pa.array(["".join(chr((g >> 21 * i) & 0x1FFFFF) for i in reversed(range(GRAM))) for g in grams.tolist()], pa.string())
    return _rows(names, code, keys[row], pa.nulls(len(code), pa.list_(pa.int32())), run)


def _blocks(batch: pa.RecordBatch, sizes: np.ndarray, at_once: int) -> Iterator[pa.RecordBatch]:
    """A batch in blocks of about so many units."""
    block = np.cumsum(sizes) // at_once
    for start, end in zip(heads := _heads(block), [*heads[1:], len(block)], strict=True):
        yield batch.slice(start, end - start)


def _posting_rows(df: DataFrame, of: Callable[[np.ndarray, pa.Array, int], pa.RecordBatch], run: int, at_once: int) -> DataFrame:
    """Of `key`, `unit`: each task makes posting rows of its own texts, so that what is shuffled is lists."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            units = batch.column(1)
            sizes = np.diff(units.offsets.to_numpy()) if pa.types.is_list(units.type) else np.array([len(x or "") for x in units.to_pylist()])
            for block in _blocks(batch, sizes, at_once):
                yield of(block.column(0).to_numpy(), block.column(1), run)

    return df.mapInArrow(make, _SCHEMA)


def _joined(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a token and column as one, of up to twice `run` keys. Lists stay where they are in memory;
    only their bounds and the ids' bases change."""
    for batch in batches:
        if not batch.num_rows:
            continue
        token, col = (batch.column(c).dictionary_encode().indices.to_numpy() for c in ("token", "col"))
        first, last, n = (batch.column(c).to_numpy() for c in ("first", "last", "n"))
        heads = _heads(token, col)
        before = np.cumsum(n) - n
        within = before - np.repeat(before[heads], np.diff(np.append(heads, len(n))))
        start = _heads(token, col, within // run)
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(n))))
        base = np.minimum.reduceat(first, start)
        bounds = np.append(before[start], n.sum())
        ids = batch.column("ids").flatten().to_numpy() + np.repeat(first - base[of], n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("token").take(pa.array(start)), batch.column("col").take(pa.array(start)), pa.array(base), pa.array(np.maximum.reduceat(last, start)), pa.array(np.diff(bounds).astype(np.int32)), _lists(bounds, pa.array(ids)), _lists(bounds, batch.column("places").flatten())],
            names=["token", "col", "first", "last", "n", "ids", "places"],
        )


def _moved(n: int) -> Column:
    """Places, so many less."""
    return F.transform("places", lambda p: p - n)


def pattern_grams(pattern: str) -> list[str]:
    """The runs of GRAM characters that a text must have that fits a lower-cased `LIKE` pattern."""
    pieces, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            pieces[-1] += pattern[at]
        elif c in "%_":
            pieces.append("")
        else:
            pieces[-1] += c
        at += 1
    # A sigma's lower case depends on what stands beside it, which a pattern does not tell.
    return sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1) if not set(p[i : i + GRAM]) & set("σς")})


class StoredIndex:
    """An index of the columns of tables with a whole-number key. A key has one text a column; rows with a
    null key are not indexed, null and empty texts have no tokens, and an index of nothing finds nothing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        found = [name for name, *_ in storage.entries(spark, self.path) if name.startswith("generation-")]
        if not found:
            raise ValueError(f"no index at {path}")
        self.generation = int(max(found)[len("generation-") : -len(".json")])
        self.facts = json.loads(storage.read_text(spark, f"{self.path}/{max(found)}"))
        self.key = self.facts["key"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str, grams: bool = False) -> StoredIndex:
        """A new index. grams: of runs of characters, for `containing`, in place of tokens."""
        storage.put_new(spark, f"{path.rstrip('/')}/generation-{0:08d}.json", json.dumps({"key": key, "grams": grams, "rows": 0, "segments": []}))
        return cls(spark, path)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return any(name.startswith("generation-") for name, *_ in storage.entries(spark, path))

    def _publish(self, facts: dict) -> None:
        name = f"{self.path}/generation-{self.generation + 1:08d}.json"
        if not storage.put_new(self.spark, name, json.dumps(facts)):
            raise RuntimeError(f"another writer changed {self.path}; its segments are kept, this one's is not part of the index")
        self.generation, self.facts = self.generation + 1, facts

    def _write(self, rows: DataFrame) -> str:
        """Posting rows as a new segment."""
        name = f"segment-{uuid.uuid4().hex}"
        # Once, and not once more for the samples that ranges are chosen by.
        rows, aside = storage.materialize(rows, "index-rows")
        ordered = rows.repartitionByRange("token", "first").sortWithinPartitions("token", "col", "first")
        options = {"parquet.block.size": GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}
        ordered.mapInArrow(partial(_joined, run=RUN), rows.schema).write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{self.path}/{name}/postings")
        postings = self.spark.read.parquet(f"{self.path}/{name}/postings")
        counts = postings.groupBy("token", "col").agg(F.sum("n").alias("n"))
        counts.repartitionByRange("token").sortWithinPartitions("token").write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{self.path}/{name}/directory")
        storage.delete(self.spark, aside)
        return name

    def add(self, df: DataFrame, columns: list[str]) -> str:
        """The texts of `df` as a further segment. Its keys may not be in the index yet."""
        parts = []
        for c in columns:
            body = F.coalesce(F.col(c), F.lit(""))
            unit = F.lower(body) if self.facts["grams"] else t.tokens(body)
            rows = df.filter(F.col(self.key).isNotNull()).select(F.col(self.key).cast("long").alias("key"), unit.alias("unit"))
            parts.append(_posting_rows(rows, _of_text if self.facts["grams"] else _of_tokens, RUN, AT_ONCE).select("token", F.lit(c).alias("col"), "first", "last", "n", "ids", "places"))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        name = self._write(rows)
        self._publish(self.facts | {"rows": self.facts["rows"] + df.count(), "segments": [*self.facts["segments"], name]})
        return name

    def merge(self, keep_old: bool = False) -> None:
        """All segments as one. keep_old: readers of an earlier generation still find its segments."""
        old = self.facts["segments"]
        if len(old) < 2:
            return
        name = self._write(self._table("postings"))
        self._publish(self.facts | {"segments": [name]})
        for s in [] if keep_old else old:
            storage.delete(self.spark, f"{self.path}/{s}")

    def _table(self, kind: str) -> DataFrame:
        schema = "token string, col string, n long" if kind == "directory" else "token string, col string, first long, last long, n int, ids array<long>, places array<array<int>>"
        segments = self.facts["segments"]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s}/{kind}" for s in segments]) if segments else self.spark.createDataFrame([], schema)

    def postings(self, where: Column, columns: list[str] | None = None) -> DataFrame:
        found = self._table("postings").filter(where)
        return found.filter(F.col("col").isin(*columns)) if columns else found

    def _keys(self, where: Column, columns: list[str] | None) -> DataFrame:
        """`token`, key of what fits."""
        return self.postings(where, columns).select("token", F.explode(F.transform("ids", lambda x: F.col("first") + x)).alias(self.key))

    def frequencies(self, words: list[str], columns: list[str] | None = None) -> dict[str, int]:
        """In how many keys (of each column) each of the words is."""
        found = self._table("directory").filter(F.col("token").isin(*words))
        found = found.filter(F.col("col").isin(*columns)) if columns else found
        return {r.token: r.n for r in found.groupBy("token").agg(F.sum("n").alias("n")).collect()}

    def directory(self, columns: list[str] | None = None) -> DataFrame:
        """`token`, `n`: in how many keys (of each column) each token is."""
        found = self._table("directory")
        found = found.filter(F.col("col").isin(*columns)) if columns else found
        return found.groupBy("token").agg(F.sum("n").alias("n"))

    def keys_of(self, wanted: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """`wanted` (with a column `token`) with the keys that have its tokens, a row each."""
        found = self.postings(F.lit(True), columns).select("token", "first", "ids")
        few = wanted.select("token").distinct().limit(TOKENS_PUSHED + 1).collect()
        if len(few) <= TOKENS_PUSHED:
            # Few tokens are named to the scan, which then reads their pages only.
            found = found.filter(F.col("token").isin(*[r.token for r in few]))
        return found.join(wanted, "token").select(*[c for c in wanted.columns if c != "token"], F.explode(F.transform("ids", lambda x: F.col("first") + x)).alias(self.key))

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], f"`{self.key}` long")

    def _within(self, rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
        """The rows with one of `keys`, of which there are at most n."""
        return rows.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, self.key, "left_semi")

    def match_all(self, words: list[str], columns: list[str] | None = None) -> DataFrame:
        """Keys that have all words, in any of the columns: those of the rarest, then what the others' lists
        have of them."""
        words = sorted({w.lower() for w in words})
        n = self.frequencies(words, columns)
        if not words or len(n) < len(words):
            return self._nothing()
        rarest = min(words, key=lambda w: (n[w], w))
        keys = self._keys(F.col("token") == rarest, columns).select(self.key).distinct()
        rest = [w for w in words if w != rarest]
        if not rest:
            return keys
        found = self._within(self._keys(F.col("token").isin(*rest), columns), keys, n[rarest])
        return found.groupBy(self.key).agg(F.count_distinct("token").alias("n")).filter(F.col("n") == len(rest)).select(self.key)

    def match_any(self, words: list[str], columns: list[str] | None = None) -> DataFrame:
        return self._keys(F.col("token").isin(*[w.lower() for w in words]), columns).select(self.key).distinct()

    def match_not(self, words: list[str], without: list[str], columns: list[str] | None = None) -> DataFrame:
        return self.match_all(words, columns).join(self.match_any(without, columns), self.key, "left_anti")

    def match_prefix(self, prefix: str, columns: list[str] | None = None) -> DataFrame:
        return self._keys(F.col("token").startswith(prefix.lower()), columns).select(self.key).distinct()

    def match_phrase(self, phrase: list[str], columns: list[str] | None = None) -> DataFrame:
        """Keys with the tokens one after the other in one column: each token's places are moved back to the
        phrase's first, and some start must be left that all have."""
        words = [w.lower() for w in phrase]
        n = self.frequencies(sorted(set(words)), columns)
        if not words or len(n) < len(set(words)):
            return self._nothing()
        rarest = min(n, key=lambda w: (n[w], w))
        rows = self.postings(F.col("token").isin(*set(words)), columns).select("token", "col", "first", F.explode(F.arrays_zip("ids", "places")).alias("e"))
        rows = rows.select("token", "col", (F.col("first") + F.col("e.ids")).alias(self.key), F.col("e.places").alias("places"))
        if len(n) > 1:
            rows = self._within(rows, self._keys(F.col("token") == rarest, columns).select(self.key).distinct(), n[rarest])
        starts = [F.flatten(F.collect_list(F.when(F.col("token") == w, _moved(i)))).alias(f"s{i}") for i, w in enumerate(words)]
        met = F.col("s0")
        for i in range(1, len(words)):
            met = F.array_intersect(met, F.col(f"s{i}"))
        return rows.groupBy(self.key, "col").agg(*starts).filter(F.size(met) > 0).select(self.key).distinct()

    def document_counts(self) -> DataFrame:
        """In how many keys each token occurs. The directory tells it where there is one column."""
        found = self._table("directory")
        if found.select("col").distinct().limit(2).count() < 2:
            return found.groupBy("token").agg(F.sum("n").alias("n"))
        return self._keys(F.lit(True), None).groupBy("token").agg(F.count_distinct(self.key).alias("n"))

    def plan(self, part: str) -> list[str] | None:
        """The runs of characters to look up for a part: the rarest ones. None if looking up is not worth it:
        a part with no GRAM characters in a row that are no wildcards, or runs that most texts have."""
        grams = pattern_grams(self.spark.sql("SELECT lower(:part)", args={"part": part}).first()[0])
        grams = grams[:: -(-len(grams) // GRAMS_PLANNED)] if grams else grams
        if not grams:
            return None
        n = self.frequencies(grams)
        if len(n) < len(grams):
            return [g for g in grams if g not in n][:1]
        rarest = sorted(grams, key=lambda g: (n[g], g))[:GRAMS_MET]
        return rarest if n[rarest[0]] <= WORTH_A_LOOK * max(1, self.facts["rows"]) else None

    def containing(self, df: DataFrame, column: str, part: str) -> DataFrame:
        """Rows of `df` with the part anywhere in the column, case ignored, `%` and `_` wildcards: those that
        have its rarest runs of characters are looked up, and only they are read through."""
        grams = self.plan(part)
        if grams is None:
            return df.filter(t.like(F.col(column), part))
        keys = self.match_all(grams, [column])
        n = min(self.frequencies(grams, [column]).values(), default=0)
        return self._within(df, keys, n).filter(t.like(F.col(column), part))
