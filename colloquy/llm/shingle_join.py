"""Near copies: SimHash fingerprints with pigeonring first, checked by the similarity of the texts' sets of word
shingles; what fingerprints cannot tell is looked for by an exact join of the sets, so no pair is lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .common import broadcast_if_small, fresh_name, give_back, materialize, small_enough
from .components import connected_components

SHINGLE_WORDS = 5
#: Least similarity |A & B| / |A | B|, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Bits of a text's sketch, in words of 64.
SKETCH_WORDS = 16
#: Sets from this size on, which fill such a sketch, have a second one of so many words.
LONG_SET = 1500
LONG_WORDS = 256
#: Keys with more texts than this are compared through leaders first.
DENSE_KEY = 64
#: Random leaders that each dense key gets, all at once, before what they leave is compared pair by pair.
LEADERS = 4
#: Texts of one dense key that meet in one task, about.
CROWD = 512
#: One of so many texts is looked at for frequent shingles, and at most so many are put last.
#: Both only choose the order in which shingles are taken, on which no result depends.
SAMPLE_ONE_OF = 16
MOST_FREQUENT = 100_000
#: Rows of output at once, so that the memory of long texts is bounded.
CHUNK = 1 << 18


def shingles(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles; words as in `simhash.fingerprint`. A text of
    fewer words is one shingle, so is one without words."""
    found = (text or b"").lower().split()
    codes: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((codes[w] if w in codes else codes.setdefault(w, digest(w)) for w in found), np.uint64, len(found))
    size = max(1, min(words, len(found)))
    out = np.full(max(1, len(found) - size + 1), len(found) if len(found) < words else words, np.uint64)
    for i in range(min(size, len(found))):
        out = (out ^ hashed[i : len(found) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((out ^ (out >> np.uint64(32))) >> np.uint64(1)).view(np.int64)


def prefix_size(n: int) -> int:
    """So many first elements of n, in any common order, meet those of each set that is similar."""
    return n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1


def in_order(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys of shingles in the common order: frequent ones, which are not negative, come last."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        last = frequent[at] == hashes
    else:
        last = np.zeros(len(hashes), bool)
    return np.sort(np.where(last, hashes, hashes + np.iinfo(np.int64).min))


def _flat(df: DataFrame, pick: Callable[[np.ndarray], np.ndarray], words: int) -> DataFrame:
    """`key`, `row`: one row per picked hash of each text of `df` (`row`, `body`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, held = [], [], 0
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(pick(shingles(body.as_py(), words)))
                rows.append(np.full(len(keys[-1]), row, np.int64))
                held += len(keys[-1])
                if held >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rows))], names=["key", "row"])
                    keys, rows, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rows))], names=["key", "row"])
            give_back()

    return df.select("row", "body").mapInArrow(run, "key long, row long")


def _sets(df: DataFrame, words: int) -> DataFrame:
    """`row`, `hashes` of the texts of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets, held = [], [], 0
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append(row)
                sets.append(shingles(body.as_py(), words))
                held += len(sets[-1])
                if held >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["row", "hashes"])
                    rows, sets, held = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["row", "hashes"])
            give_back()

    return df.select("row", "body").mapInArrow(run, "row long, hashes array<long>")


def sketch(hashes: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """64 * words bits: each element of a set turns one over. So the sketches of two sets differ in at
    most as many bits as there are elements in one set only: what differs in more need not be compared."""
    bits = np.bincount(hashes & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _facts(df: DataFrame, words: int) -> DataFrame:
    """`row`, `fp` (the text's SimHash), `digest` (of the set), `n` (its size), `sketch`, and `long` (the second one, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash.fingerprint(body.as_py(), words) for body in batch.column(1)), np.uint64, batch.num_rows)
            sets = (shingles(body.as_py(), words) for body in batch.column(1))
            facts = [(xxhash.xxh3_128_digest(x.tobytes()), len(x), sketch(x), sketch(x, LONG_WORDS) if len(x) >= LONG_SET else None) for x in sets]
            digests, sizes, *sketches = zip(*facts, strict=True) if facts else ((), (), (), ())
            columns = [batch.column(0), pa.array(prints.view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in sketches)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "fp", "digest", "n", "sketch", "long"])
            give_back()

    return df.select("row", "body").mapInArrow(run, "row long, fp long, digest binary, n int, sketch array<long>, long array<long>")


def _pruned(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs `a`, `b`, ... without those of two long sets whose second sketches differ in too many bits."""
    s, t = SIMILAR
    longs = facts.filter(F.col("long").isNotNull())
    for x in ("a", "b"):
        pairs = pairs.join(longs.select(F.col("row").alias(x), F.col("n").alias(f"{x}_n"), F.col("long").alias(f"{x}_long")), x, "left")
    differing = F.aggregate(F.zip_with("a_long", "b_long", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    near = differing * (t + s) <= (F.col("a_n") + F.col("b_n")) * (t - s)
    return pairs.filter(F.coalesce(near, F.lit(True))).drop("a_n", "b_n", "a_long", "b_long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs `a`, `b` whose sets are similar."""
    pairs = materialize(pairs.select("a", "b"), "near-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = materialize(_sets(texts.join(broadcast_if_small(wanted), "row", "left_semi"), words), "near-sets")
    a, b = (sets.select(F.col("row").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    # |A & B| / |A | B| >= s / t, without division.
    s, t = SIMILAR
    enough = both * (s + t) >= (F.size("set_a") + F.size("set_b")) * s
    return materialize(pairs.join(a, "a").join(b, "b").filter(enough).select("a", "b"), "near-links")


def _may_be_similar(x: str, y: str) -> Column:
    """Whether sizes and sketches (columns `<x>n`, `<x>sketch`, ...) allow the similarity. Similar sets of
    p and q elements have (p + q) (t - s) / (t + s) in one only at most."""
    s, t = SIMILAR
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    differing = sum((F.bit_count(F.col(f"{x}sketch")[i].bitwiseXOR(F.col(f"{y}sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    return (F.least(n, m) * t >= F.greatest(n, m) * s) & (differing * (t + s) <= (n + m) * (t - s))


def _shared(texts: DataFrame, words: int) -> DataFrame:
    """`key`, `row` and `m` (in how many texts the key is) of the prefixes, keys of one text left out."""
    sampled = texts.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE_ONE_OF)) == 0)
    often = _flat(sampled, lambda x: x, words).groupBy("key").agg(F.count("*").alias("m"))
    often = often.filter(F.col("m") > DENSE_KEY // SAMPLE_ONE_OF).orderBy(F.desc("m"), "key").limit(MOST_FREQUENT)
    frequent = np.sort(np.array([r.key for r in often.select("key").collect()], np.int64))
    entries = _flat(texts, lambda x: in_order(x, frequent)[: prefix_size(len(x))], words)
    # One shuffle: counted in the sort that brings the rows of a key together. Keys of the same texts (those
    # of one passage) are one.
    of_key = W.partitionBy("key")
    marks = [F.bit_xor(F.xxhash64("row", F.lit(i))).over(of_key) for i in (1, 2)]
    counted = entries.select("row", F.count("*").over(of_key).alias("m"), F.xxhash64(*marks).alias("key")).filter("m > 1")
    return materialize(counted.distinct(), "near-shared")


def fingerprint_pairs(facts: DataFrame) -> DataFrame:
    """Pairs `a`, `b` that the SimHash operator links: texts of one fingerprint with the first of them, and
    the first ones of fingerprints that pigeonring finds within its distance. Sizes and sketches must allow them.
    facts: `row`, `fp`, `n`, `sketch`."""
    prints = materialize(facts.groupBy("fp").agg(F.min("row").alias("first")), "near-prints")
    equal = facts.join(prints, "fp").filter("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    near = simhash.links(prints.select("fp"))
    for x in ("a", "b"):
        near = near.join(prints.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first")), x)
    pairs = materialize(equal.unionByName(near.select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))), "near-prints-met")
    for x in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("row").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "sketch")]), x)
    return pairs.filter(_may_be_similar("a_", "b_")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def groups(texts: DataFrame, facts: DataFrame, words: int = SHINGLE_WORDS, dense_key: int = DENSE_KEY) -> DataFrame:
    """`row`, `comp` (the least row of the component) of the `texts` (`row`, `body`, distinct sets) that are
    similar to another. facts: `row`, `fp`, `n`, `sketch`, `long`.

    SimHash comes first: what its fingerprints link is compared whole, and joined if it is similar. Texts of
    the similarity asked for can differ in more bits than pigeonring can look for, so the rest is met exactly.
    Two similar sets share one of the first fifth of their elements in any order common to all, so
    pairs not yet of one component are looked for there, rare shingles first, and pruned by sizes and sketches
    in the join that finds them. What passes is compared whole: first the likeliest pair of each text, then those
    pairs that are not yet of one component. A key that over `dense_key` texts share would give pairs
    with the square of their number: there each text is met with a few leaders first, and only after what
    these have joined are pairs that are not yet of one component, spread over tasks.
    """
    parts = _grown(None, _verified(_pruned(fingerprint_pairs(facts), facts), texts, words))
    shared = _shared(texts, words).join(facts.select("row", "n", "sketch"), "row").join(parts, "row", "left")
    keyed = materialize(shared.withColumn("comp", F.coalesce("comp", "row")), "near-keyed")
    sparse = keyed.filter(F.col("m") <= dense_key)
    a, b = (sparse.select("key", *[F.col(c).alias(f"{x}{c}") for c in ("row", "n", "sketch", "comp")]) for x in ("a_", "b_"))
    met = a.join(b, "key").filter("a_row < b_row and a_comp <> b_comp")
    crowd = keyed.filter(F.col("m") > dense_key)
    to_leaders = crowd.join(_leaders(crowd), "key").withColumnsRenamed({c: f"a_{c}" for c in ("row", "n", "sketch", "comp")}).filter("a_row <> b_row and a_comp <> b_comp")
    pairs = materialize(_pruned(_pairs(met).unionByName(_pairs(to_leaders)).distinct(), facts), "near-candidates")

    both = pairs.select(F.col("a").alias("row"), "*").unionByName(pairs.select(F.col("b").alias("row"), "*"))
    likeliest = both.groupBy("row").agg(F.min(F.struct("differing", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    parts = _grown(parts, _verified(likeliest, texts, words))
    rest = _apart(pairs, parts).join(likeliest, ["a", "b"], "left_anti")
    parts = _grown(parts, _verified(rest, texts, words))
    # Only what no leader has joined is left to the pairs of the crowds.
    return _grown(parts, _verified(_pruned(_crowd_pairs(crowd.drop("comp"), parts).distinct(), facts), texts, words))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs `a`, `b` of different components, with these: `a_comp`, `b_comp`."""
    for x in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("row").alias(x), F.col("comp").alias(f"{x}_comp")), x, "left").withColumn(f"{x}_comp", F.coalesce(f"{x}_comp", x))
    return pairs.filter("a_comp <> b_comp").select("a", "b", "a_comp", "b_comp")


def _grown(parts: DataFrame | None, found: DataFrame) -> DataFrame:
    """`row`, `comp` of the rows that `parts` and the links `found` join. Components are single nodes by then, so
    each row goes through the rounds once, whatever number of links lead to it later."""
    if parts is None:
        return materialize(connected_components(found).select(F.col("node").alias("row"), F.col("component").alias("comp")), "near-parts")
    edges = _apart(found, parts).select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    new = materialize(connected_components(edges), "near-joined")
    moved = parts.join(new, F.col("comp") == F.col("node"), "left").select("row", F.coalesce("component", "comp").alias("comp"))
    fresh = new.join(parts, F.col("node") == F.col("row"), "left_anti").select(F.col("node").alias("row"), F.col("component").alias("comp"))
    return materialize(moved.unionByName(fresh), "near-parts")


def _pairs(met: DataFrame) -> DataFrame:
    """`a`, `b`, `differing` (bits of the sketches) of the pairs that may be similar."""
    differing = sum((F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    return met.filter(_may_be_similar("a_", "b_")).select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b"), differing.alias("differing"))


def _crowd_pairs(crowd: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of different components that share a dense key and may be similar. Where a key is all of one
    component nothing is met; else each of its rows meets the rest in as many tasks as keep them small."""
    rows = crowd.join(parts, "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    open_keys = rows.groupBy("key").agg((F.min("comp") < F.max("comp")).alias("open")).filter("open").select("key")
    rows = materialize(rows.join(open_keys, "key", "left_semi"), "near-crowd")
    salts = F.floor(F.col("m") / CROWD).cast("int") + 1
    a, b = (rows.select("key", salts.alias("salts"), *[F.col(c).alias(f"{x}{c}") for c in ("row", "n", "sketch", "comp")]) for x in ("a_", "b_"))
    a = a.withColumn("salt", F.pmod(F.xxhash64("a_row"), F.col("salts")).cast("int")).drop("salts")
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = a.join(b, ["key", "salt"]).filter("a_row < b_row and a_comp <> b_comp")
    return _pairs(met).select("a", "b")


def _leaders(crowd: DataFrame) -> DataFrame:
    """LEADERS rows of each key, by hashes of row and key: a text that shares many keys with others meets many
    different leaders, so that few texts are left whose component no leader told."""
    row = F.struct(*[F.col(c).alias(f"b_{c}") for c in ("row", "n", "sketch", "comp")])
    picked = F.array_distinct(F.array(*[F.min_by(row, F.xxhash64("row", "key", F.lit(i))) for i in range(LEADERS)]))
    return crowd.groupBy("key").agg(picked.alias("picked")).select("key", F.explode_outer("picked").alias("l")).select("key", "l.*")


def drop_similar(df: DataFrame, id_col: str, text: str, words: int = SHINGLE_WORDS, dense_key: int = DENSE_KEY) -> DataFrame:
    """The rows of `df` of which one stays for each component of similar texts: that with the least id,
    of equal ids the first row. Columns as in `df`. Rows with a null id count after all others; null
    and blank texts are similar to each other."""
    row = fresh_name(df.columns, "_row")
    docs = materialize(df.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    texts = docs.select(F.col(row).alias("row"), F.col(text).cast("binary").alias("body"))
    ids = docs.select(F.col(row).alias("row"), F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("rank"))
    facts = materialize(_facts(texts, words).join(ids, "row"), "near-facts")
    # Equal sets first: in linear time, and each set is compared once.
    firsts = materialize(facts.groupBy("digest").agg(F.min("rank").alias("rank"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("long").alias("long"), F.min_by("fp", "rank").alias("fp")), "near-firsts")
    equal = facts.join(firsts.select("digest", F.col("rank.row").alias("first")), "digest").filter("row <> first").select("row")
    equal = _small(materialize(equal, "near-equal"))
    firsts = firsts.select(F.col("rank.row").alias("row"), "rank", "fp", "n", "sketch", "long")
    parts = groups(texts.join(equal, "row", "left_anti"), firsts, words, dense_key).join(firsts, "row")
    best = parts.groupBy("comp").agg(F.min("rank").alias("best"))
    worse = parts.join(best, "comp").filter(F.col("rank") != F.col("best")).select("row")
    gone = _small(materialize(equal.unionByName(worse), "near-gone")).withColumnRenamed("row", row)
    return docs.join(gone, row, "left_anti").select(*df.columns)


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if small_enough(rows, 1_000_000) else rows
