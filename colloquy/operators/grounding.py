"""Evidence: quotes grounded in what was said, stale models, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import storage
from . import search
from .common_part import best_shares
from .stored_index import StoredIndex

GROUNDED_AT = 0.55
RAREST = 2
CANDIDATES = 400
#: Quotes that are compared with all documents at once.
QUOTES_AT_ONCE = 10_000


def ground_quotes(models: DataFrame, utterances: DataFrame, autojunk: bool = True, candidates: int | None = CANDIDATES) -> DataFrame:
    """`id`, `score`, `grounded` of the models with a quote: the best share of it that one utterance
    holds. Candidates are the utterances with one of its two rarest tokens, the first `candidates` of
    each by utterance. Scores are computed for candidates only.

    candidates None: the exact score over all utterances, by the passages' automaton; no character is
    passed over then (autojunk must be False), and ids are unique."""
    quoted = models.filter("trim(coalesce(quote, '')) <> ''").select("id", t.strip(F.col("quote")).alias("quote"))
    quoted = quoted.withColumn("parts", F.transform(t.fragments(F.col("quote")), t.bare))
    if candidates is None:
        if autojunk:
            raise ValueError("the exact score passes over no characters")
        best = best_shares(quoted.select("id", "parts"), utterances.select(t.bare(F.col("text")).alias("text")))
        return _scored(quoted, best)
    index = search.token_index(utterances, "utt_id", ["speaker", "text"])
    said = t.longest_tokens(F.col("quote"))
    wanted = quoted.select("id", F.explode_outer(said).alias("said")).filter("said is not null")
    wanted = wanted.withColumn("token", F.lower("said"))
    needed = index.join(wanted.select("token").distinct(), "token", "left_semi").select("token", "utt_id").distinct()
    counts = needed.groupBy("token").agg(F.count("*").alias("n"))
    rare = wanted.join(counts, "token").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("n", "said"))).filter(F.col("r") <= RAREST)
    # Only tokens that some quote looks up, and a running number instead of a gathered list.
    needed = needed.join(rare.select("token").distinct(), "token", "left_semi")
    needed = needed.withColumn("c", F.row_number().over(W.partitionBy("token").orderBy("utt_id"))).filter(F.col("c") <= candidates).drop("c")
    pairs = rare.select("id", "token").join(needed, "token").select("id", "utt_id").distinct()
    tried = pairs.join(utterances.select("utt_id", t.bare(F.col("text")).alias("said")), "utt_id").join(quoted.select("id", "parts"), "id")
    best = tried.withColumn("score", t.grounding_score(autojunk)(F.col("parts"), F.col("said"))).groupBy("id").agg(F.max("score").alias("score"))
    return _scored(quoted, best)


def _scored(quoted: DataFrame, best: DataFrame) -> DataFrame:
    """All quotes with their best score, 0 if none, and whether that is enough."""
    out = quoted.select("id").join(best, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return out.withColumn("grounded", F.col("score") >= GROUNDED_AT)


def verbatim(quotes: DataFrame, docs: DataFrame, index: StoredIndex, column: str, block: int = QUOTES_AT_ONCE) -> DataFrame:
    """`id`, key of the index, once each, for quotes (`id`, `quote`) that stand in documents as they are.

    The outer tokens of a quote may be parts of longer ones in a document; of those between, the rarest
    leads to the documents that may have it, through the stored index. A quote with none between is
    compared with all documents, in blocks of quotes. An empty quote stands in every text; null ones and
    null texts in none."""
    key = index.key
    texts = docs.filter(F.col(column).isNotNull()).select(key, F.col(column).alias("_text"))
    quotes, _ = storage.materialize(quotes.filter("quote is not null").select("id", "quote", F.array_distinct(F.slice(t.tokens(F.col("quote")), 2, F.greatest(F.size(t.tokens(F.col("quote"))) - 2, F.lit(0)))).alias("inner")), "quotes")
    wanted = quotes.select("id", F.explode("inner").alias("token"))
    counts = index.directory([column])
    # A token that no document has has no row in the directory; nor can its quote be anywhere.
    known = wanted.join(counts, "token", "left").groupBy("id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.count_if(F.col("n").isNull()).alias("unknown"))
    rarest = known.filter("unknown = 0").select("id", "token")
    pairs = index.keys_of(rarest, [column])
    found = pairs.join(texts, key).join(quotes.select("id", "quote"), "id").filter(F.contains("_text", "quote")).select("id", key)
    short = quotes.filter(F.size("inner") == 0).select("id", "quote")
    blocks = -(-short.count() // block)
    for b in range(blocks):
        mine = short.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        found = found.unionByName(texts.join(F.broadcast(mine), F.contains("_text", "quote")).select("id", key))
    return found.distinct()


def stale(models: DataFrame, meetings: DataFrame, days: int = 180) -> DataFrame:
    """`id`, `seen` of models last seen more than `days` before the newest meeting."""
    newest = meetings.agg(F.max(t.iso_date(F.col("date"))).alias("newest"))
    seen = t.iso_date(F.coalesce(F.when(F.col("last_seen") != "", F.col("last_seen")), F.col("first_seen")))
    return models.select("id", seen.alias("seen")).crossJoin(F.broadcast(newest)).filter(t.days_between(F.col("newest"), F.col("seen")) > days).select("id", "seen")


def coverage(utterances: DataFrame, aliases: DataFrame) -> DataFrame:
    """Utterances, those of canonical speakers, and their share."""
    known = aliases.select(F.col("canonical").alias("speaker")).distinct().withColumn("known", F.lit(True))
    both = utterances.join(known, "speaker", "left").agg(F.count("*").alias("total"), F.count("known").alias("canonical"))
    return both.withColumn("share", t.percent(F.col("canonical"), F.when(F.col("total") > 0, F.col("total"))))


def silent_people(people: DataFrame, utterances: DataFrame) -> DataFrame:
    person = people.filter(F.coalesce(F.when(F.col("type") != "", F.col("type")), F.lit("person")) == "person")
    return person.select("name").join(utterances.select(F.col("speaker").alias("name")), "name", "left_anti")


def silent_meetings(meetings: DataFrame, utterances: DataFrame) -> DataFrame:
    return meetings.select("rowid", "path").join(utterances.select(F.col("meeting_rowid").alias("rowid")), "rowid", "left_anti")


def duplicate_sources(meetings: DataFrame) -> DataFrame:
    """Recordings that several files hold; parts of one recording are several recordings."""
    rows = meetings.filter("source_id <> ''").groupBy("source_id", "part").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))
    return rows.filter("n > 1")


