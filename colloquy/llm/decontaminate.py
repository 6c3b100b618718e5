"""Benchmark decontamination by winnowed fingerprints. DataFrame and SQL functions only.

Arrays that are computed in the same plan are exploded with `explode_outer`: for `explode` the
optimizer infers a filter on the array's size, and pushing it below the projections that make the
array copies their expressions, over and over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, drop_first, drop_last, fresh_name, materialize, read_table, small_enough, zip_hash

#: Every shared span of this many words is found.
SPAN = 10
#: Words of a gram, and grams of a window: GRAM + WINDOW - 1 = SPAN.
GRAM, WINDOW = 7, 4
#: Fingerprints and spans of the benchmark are broadcast up to this many rows, else shuffled.
BROADCAST_SPANS = 2_000_000
#: Ids of documents with a fingerprint hit are broadcast up to this many.
BROADCAST_IDS = 1_000_000

#: What parts words: all ASCII but digits and letters. The texts are split before they are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_GAP_CHARS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD))


def _word_hashes(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_GAP_CHARS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(ascii_lower(bare), _GAP))
    return F.transform(words, lambda w: F.xxhash64(w))


def _with_grams(df: DataFrame, text: Column, names: dict[str, str]) -> DataFrame:
    """Adds arrays of hashes: words, and grams of 2, 4, 7. Each is made in a projection of its own."""
    w, two, four = (F.col(names[k]) for k in ("w", "two", "four"))
    df = df.withColumn(names["w"], _word_hashes(text))
    df = df.withColumn(names["two"], zip_hash(w, drop_first(w, 1)))
    df = df.withColumn(names["four"], zip_hash(two, drop_first(two, 2)))
    return df.withColumn(names["seven"], drop_last(zip_hash(four, drop_first(four, GRAM - 4)), GRAM - 1))


def _names(df: DataFrame) -> dict[str, str]:
    return {k: fresh_name(df.columns, f"_dc_{k}") for k in ("w", "two", "four", "seven", "low", "fp", "spans", "row", "flag", "cut")}


def fingerprints(df: DataFrame, text: Column, out: str) -> DataFrame:
    """`df` with the distinct fingerprints of `text` in the array column `out`: of each WINDOW
    consecutive grams the least hash. Two texts that share SPAN words share the fingerprint of the
    window that these words are, so they share at least one."""
    n = _names(df)
    df = _with_grams(df, text, n)
    seven, low = F.col(n["seven"]), F.col(n["low"])
    df = df.withColumn(n["low"], F.zip_with(seven, drop_first(seven, 1), lambda a, b: F.least(a, b)))
    least = F.zip_with(low, drop_first(low, 2), lambda a, b: F.least(a, b))
    df = df.withColumn(out, F.array_distinct(drop_last(least, WINDOW - 1)))
    return df.drop(*[n[k] for k in ("w", "two", "four", "seven", "low")])


def spans(df: DataFrame, text: Column, out: str, short: list[int]) -> DataFrame:
    """`df` with the array column `out`: a struct of `pos`, `len` and hash `h` for each SPAN
    consecutive words of `text` and, for each length in `short`, for each so many words."""
    n = _names(df)
    df = _with_grams(df, text, n)
    w, two, seven = F.col(n["w"]), F.col(n["two"]), F.col(n["seven"])
    # Ten words: seven of them, and the seven that end with the last one.
    ten = zip_hash(seven, drop_first(seven, SPAN - GRAM))
    parts = [_spans_of(drop_last(ten, SPAN - GRAM), SPAN)]
    grown = {1: w, 2: two}
    for k in range(3, max(short, default=0) + 1):
        grown[k] = zip_hash(grown[k - 1], drop_first(w, k - 1))
    parts += [_spans_of(drop_last(grown[k], k - 1), k) for k in short]
    df = df.withColumn(out, F.concat(*parts))
    return df.drop(*[n[k] for k in ("w", "two", "four", "seven")])


def _spans_of(hashes: Column, length: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(i.alias("pos"), F.lit(length).alias("len"), h.alias("h")))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of `docs`: `id_col`, `n_words`, `n_hit`, `n_items`, `items_sha256`,
    `contaminated`.

    A span is SPAN consecutive words of an item, or all words of a shorter one; a document's word
    inside any occurrence of one is hit. Winnowed fingerprints of both sides are joined; documents
    with a hit are read again and the hit is extended: all their spans are joined with the spans of
    the items. Items shorter than SPAN have no winnowing guarantee; where there are some, spans of
    their lengths serve as further fingerprints.

    Null and blank texts have no words and no hit. Items without words match nothing; a null item
    id counts for hit words but not as an item; items of equal id count once. Repeated ids are told
    apart row by row. Empty tables give empty results, or no hits.
    """
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("body"))
    sizes = items.select(count_words(F.col("body")).alias("n")).filter(F.col("n").between(1, SPAN - 1)).distinct()
    short = sorted(r.n for r in sizes.collect())  # nine numbers at most
    item_spans = spans(items.withColumn("n", count_words(F.col("body"))), F.col("body"), "spans", short)
    item_spans = item_spans.select("item", "n", F.explode_outer("spans").alias("s")).filter((F.col("s.len") == SPAN) | (F.col("s.len") == F.col("n")))
    item_spans = materialize(item_spans.select("item", F.col("s.len").alias("len"), F.col("s.h").alias("h")).distinct(), "decon-spans")

    # 1. Fingerprints: which documents share one with the benchmark.
    n = _names(docs)
    marks = fingerprints(items.select("body"), F.col("body"), "fp").select(F.explode_outer("fp").alias("fp")).filter("fp is not null")
    marks = marks.unionByName(item_spans.filter(F.col("len") < SPAN).select(F.col("h").alias("fp"))).distinct()
    marks = broadcast_if_small(materialize(marks, "decon-marks"), BROADCAST_SPANS)
    printed = fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("body")), F.col("body"), "fp")
    if short:
        printed = spans(printed, F.col("body"), "more", short)
        more = F.transform(F.filter("more", lambda s: s["len"] < SPAN), lambda s: s["h"])
        printed = printed.withColumn("fp", F.concat("fp", more))
    hit = printed.select("id", F.explode_outer("fp").alias("fp")).join(marks, "fp", "left_semi").select("id").distinct()
    hit = materialize(hit.withColumn("hit", F.lit(True)), "decon-hits")

    # 2. All documents; those hit with their spans.
    if small_enough(hit, BROADCAST_IDS):
        hit = F.broadcast(hit)
    both = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body"))
    both = both.join(hit.withColumnRenamed("id", "hit_id"), F.col("id").eqNullSafe(F.col("hit_id")), "left")
    both = both.withColumn("n_words", count_words(F.col("body")).cast("long"))
    both = spans(both.withColumn("body", F.when(F.col("hit"), F.col("body"))), F.col("body"), "spans", short)
    both = materialize(both.select(F.monotonically_increasing_id().alias("row"), "id", "n_words", "spans"), "decon-docs")

    # 3. Extension: spans that some item has too.
    found = both.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    found = found.join(broadcast_if_small(item_spans, BROADCAST_SPANS), ["len", "h"])
    words = found.select("row", "pos", "len").distinct().groupBy("row").agg(F.collect_list(F.struct("pos", "len")).alias("at"))
    covered = F.flatten(F.transform("at", lambda a: F.sequence(a["pos"], a["pos"] + a["len"] - 1)))
    words = words.select("row", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    named = found.filter("item is not null").select("row", F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = both.select("row", "id", "n_words").join(words, "row", "left").join(named, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` without any hit word, with its columns.

    A row is told apart by its id and its text's hash, for which the verdict is the same; so null and
    repeated ids do no harm, and texts are not written a second time.
    """
    n = _names(docs)
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    found = find(docs.select(key.alias("key"), F.col(text).alias("body")), benchmark, "key", "body", item_id, item_text)
    gone = found.filter("contaminated").select(F.col("key.id").alias(n["row"]), F.col("key.h").alias(n["fp"])).distinct()
    gone = broadcast_if_small(materialize(gone, "decon-gone"), BROADCAST_IDS)
    same = (F.xxhash64(docs[text]) == gone[n["fp"]]) & docs[id_col].eqNullSafe(gone[n["row"]])
    return docs.join(gone, same, "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL: dict[str, str] = {
    "op7_benchmark_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents), b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
 s AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), {SPAN}) AS size, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS i FROM b WHERE len(w) > 0)),
 g AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM s) WHERE len(w) >= size)),
 f AS (SELECT r, i, g.size, item_id FROM g JOIN s ON g.k = s.k AND g.size = s.size),
 h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM f) GROUP BY r),
 m AS (SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM f GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)"""
}
