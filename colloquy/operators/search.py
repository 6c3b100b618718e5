"""Full-text search over a token table; substring search beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def token_index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`key`, `col`, `pos`, `token` of the text columns: the inverted index. Written partitioned by a
    hash of the token it answers searches without reading the texts."""
    rows = reduce(DataFrame.unionByName, [df.select(key, F.lit(c).alias("col"), t.tokens(F.coalesce(F.col(c), F.lit(""))).alias("t")) for c in columns])
    return rows.select(key, "col", F.posexplode_outer("t").alias("pos", "token")).filter("token is not null")


def _in(index: DataFrame, columns: list[str] | None) -> DataFrame:
    return index.filter(F.col("col").isin(*columns)) if columns else index


def match_all(index: DataFrame, key: str, words: list[str], columns: list[str] | None = None) -> DataFrame:
    """Keys that have all words as tokens, in any of the columns."""
    words = sorted({w.lower() for w in words})
    found = _in(index, columns).filter(F.col("token").isin(*words))
    return found.groupBy(key).agg(F.count_distinct("token").alias("n")).filter(F.col("n") == len(words)).select(key)


def match_any(index: DataFrame, key: str, words: list[str], columns: list[str] | None = None) -> DataFrame:
    return _in(index, columns).filter(F.col("token").isin(*[w.lower() for w in words])).select(key).distinct()


def match_not(index: DataFrame, key: str, words: list[str], without: list[str], columns: list[str] | None = None) -> DataFrame:
    return match_all(index, key, words, columns).join(match_any(index, key, without, columns), key, "left_anti")


def match_prefix(index: DataFrame, key: str, prefix: str, columns: list[str] | None = None) -> DataFrame:
    return _in(index, columns).filter(F.col("token").startswith(prefix.lower())).select(key).distinct()


def match_phrase(index: DataFrame, key: str, phrase: list[str], columns: list[str] | None = None) -> DataFrame:
    """Keys with the tokens one after the other in one column: each token's places are moved back to
    the phrase's first, so all meet in one group and nothing is joined."""
    places = [(w.lower(), i) for i, w in enumerate(phrase)]
    found = _in(index, columns).filter(F.col("token").isin(*{w for w, _ in places}))
    # A token may stand at several places of the phrase: each counts by itself.
    found = found.select(key, "col", F.posexplode(F.array(*[F.when(F.col("token") == w, F.col("pos") - i) for w, i in places])).alias("nth", "start"))
    return found.filter("start >= 0").groupBy(key, "col", "start").agg(F.count_distinct("nth").alias("n")).filter(F.col("n") == len(places)).select(key).distinct()


def contains(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows with the part anywhere in the column, case ignored: another result than whole tokens give."""
    return df.filter(t.like(F.col(column), part))


def document_counts(index: DataFrame, key: str) -> DataFrame:
    """In how many keys each token occurs."""
    return index.groupBy("token").agg(F.count_distinct(key).alias("n"))


def snippet(text: Column, words: list[str], before: str = "[", after: str = "]", more: str = "…", size: int = 12) -> Column:
    """`size` words of the text from a little before the first hit, hits marked."""
    hit = lambda w: F.array_contains(F.array(*[F.lit(x.lower()) for x in words]), F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    parts = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    first = F.coalesce(F.array_position(F.transform(parts, hit), True), F.lit(0)).cast("int")
    start = F.greatest(F.lit(1), F.least(first - size // 2, F.size(parts) - size + 1))
    shown = F.transform(F.slice(parts, start, F.lit(size)), lambda w: F.when(hit(w), F.concat(F.lit(before), w, F.lit(after))).otherwise(w))
    return F.concat(F.when(start > 1, more).otherwise(""), F.array_join(shown, " "), F.when(start + size <= F.size(parts), more).otherwise(""))
