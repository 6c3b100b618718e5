"""The library of questions. Each takes the built tables (a dict of DataFrames) and gives a
DataFrame; every top-k has a tie-breaker, so answers do not depend on the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import search
from ..operators.stored_index import StoredIndex

Tables = dict[str, DataFrame]

# The order of statuses and levels, the categories that backfilling puts first.
BET_ORDER = ("진행중", "검토중", "보류")
RISK_ORDER = ("high", "mid")
BACKFILL_FIRST = ("내부-전략", "내부-주간회의", "내부-1on1")
STALE_DAYS = 180


def resolve_label(x: Tables, part: str) -> DataFrame:
    """A0. Canonical names with an alias that contains the part."""
    return x["person_aliases"].filter(t.like(F.col("alias"), part)).select("canonical").distinct()


def person_profile(x: Tables, person: str) -> DataFrame:
    """A. What a person holds, most often seen first."""
    held = x["model_people"].filter(F.col("person") == person)
    return x["models"].join(held, F.col("id") == F.col("model_id")).select("category", "title", "evidence", "count", "quote").orderBy(F.desc("count"), "title")


def beliefs_about(x: Tables, entity: str) -> DataFrame:
    """A2. What is held about an entity, and by whom."""
    holders = x["model_people"].groupBy("model_id").agg(F.array_join(F.sort_array(F.collect_list("person")), ", ").alias("held_by"))
    about = x["model_about"].filter(t.like(F.col("entity"), entity)).select("model_id").distinct()
    rows = x["models"].join(about, F.col("id") == F.col("model_id"), "left_semi").join(holders, F.col("id") == F.col("model_id"), "left")
    return rows.select("title", "evidence", "quote", "held_by")


def tensions(x: Tables) -> DataFrame:
    """B. Who is at odds with whom, and over what."""
    return x["relations"].filter("type = 'tension'").select("from_person", "to_person", "topic", "note")


def _with_words(x: Tables, words: list[str], columns: list[str] | None, index: StoredIndex | None) -> DataFrame:
    """Utterances with all words: looked up in a stored index of `speaker` and `text`, else by a scan."""
    if index is None:
        keys = search.match_all(search.token_index(x["utterances"], "utt_id", ["speaker", "text"]), "utt_id", words, columns)
    else:
        keys = index.match_all(words, columns)
    return x["utterances"].join(keys, "utt_id", "left_semi")


def search_utterances(x: Tables, words: list[str], limit: int = 20, columns: list[str] | None = None, index: StoredIndex | None = None) -> DataFrame:
    """C. Utterances with all words, newest first."""
    hits = _with_words(x, words, columns, index)
    rows = hits.join(x["meetings"], F.col("meeting_rowid") == F.col("rowid"))
    return rows.select("date", "title", "speaker", search.snippet(F.col("text"), words).alias("hit"), "utt_id").orderBy(F.desc("date"), "utt_id").limit(limit)


def search_substring(x: Tables, part: str, limit: int = 20) -> DataFrame:
    """C without tokens: utterances that contain the part."""
    rows = search.contains(x["utterances"], "text", part).join(x["meetings"], F.col("meeting_rowid") == F.col("rowid"))
    return rows.select("date", "title", "speaker", "text", "utt_id").orderBy(F.desc("date"), "utt_id").limit(limit)


def evolution(x: Tables) -> DataFrame:
    """D. What changed, in order of time."""
    return x["timeline"].select("date", "change").orderBy("date", "change")


def topic_owners_substring(x: Tables, part: str, index: StoredIndex | None = None) -> DataFrame:
    """E by substring, through a stored index of runs of characters if there is one."""
    hits = search.contains(x["utterances"], "text", part) if index is None else index.containing(x["utterances"], "text", part)
    return hits.groupBy("speaker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "speaker")


def topic_owners(x: Tables, words: list[str], columns: list[str] | None = None, index: StoredIndex | None = None) -> DataFrame:
    """E. Who says the words most; utterances without a speaker are a row of their own."""
    return _with_words(x, words, columns, index).groupBy("speaker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "speaker")


def meetings_between(x: Tables, start: str, end: str, category: str, canonical: bool = False) -> DataFrame:
    """F. Meetings of a category in a span of dates; by the raw category unless `canonical`."""
    kind = F.col("category" if canonical else "category_raw")
    return x["meetings"].filter(F.col("date").between(start, end) & (kind == category)).select("rowid", "date", "title", kind.alias("category"), "path")


def interactions(x: Tables, person: str) -> DataFrame:
    """G. A person's meetings, newest first."""
    mine = x["person_meetings"].filter(F.col("person") == person)
    return mine.join(x["meetings"], F.col("meeting_rowid") == F.col("rowid")).select("date", "title", "category").orderBy(F.desc("date"), "title")


def neglected(x: Tables, least: int = 3, limit: int = 15) -> DataFrame:
    """H. People met at least so often whose last meeting is longest ago."""
    rows = x["person_meetings"].join(x["meetings"], F.col("meeting_rowid") == F.col("rowid"))
    seen = rows.groupBy("person").agg(F.max("date").alias("last_met"), F.count_distinct("meeting_rowid").alias("total"))
    return seen.filter(F.col("total") >= least).orderBy("last_met", "person").limit(limit)


def met_with(x: Tables, person: str, limit: int = 10) -> DataFrame:
    """I. Who is in the same meetings as a person most often."""
    pm = x["person_meetings"]
    mine = pm.filter(F.col("person") == person).select("meeting_rowid").distinct()
    others = pm.filter(F.col("person") != person).join(mine, "meeting_rowid", "left_semi")
    return others.groupBy("person").agg(F.count_distinct("meeting_rowid").alias("n")).orderBy(F.desc("n"), "person").limit(limit)


def network_of(x: Tables, part: str) -> DataFrame:
    """J1. Edges with the part in either end."""
    return x["network"].filter(t.like(F.col("a"), part) | t.like(F.col("b"), part)).select("kind", "a", "b", "since", "note")


def introductions(x: Tables) -> DataFrame:
    """J2. Who introduced whom."""
    return x["network"].filter("kind = '소개'").select("a", "b", "note")


def open_commitments(x: Tables) -> DataFrame:
    """K. Promises not done, by date due, those without a date last."""
    rows = x["commitments"].filter("done = 0").join(x["meetings"], F.col("meeting_rowid") == F.col("rowid"))
    return rows.select("from_person", "to_person", "text", "due", "date", "title").orderBy(t.blank_last(F.col("due")), "due", "text")


def report_lines(x: Tables) -> DataFrame:
    """M1. Who reports to whom."""
    return x["network"].filter("kind = '보고'").select("a", "b", "note")


def team_rosters(x: Tables) -> DataFrame:
    """M2. The names of each team."""
    return x["people"].filter("team <> ''").groupBy("team").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))


def by_relationship(x: Tables) -> DataFrame:
    """M3. People with a relationship."""
    return x["people"].filter("relationship <> ''").select("name", "relationship")


def bets_register(x: Tables) -> DataFrame:
    """R1. Bets by status, newest first."""
    return x["bets"].select("status", "tag", "title", "owner", "date").orderBy(t.rank(F.col("status"), BET_ORDER), F.desc("date"), "title")


def risks_register(x: Tables) -> DataFrame:
    """R2. Risks by level."""
    return x["risks"].select("status", "level", "title", "mitigation").orderBy(t.rank(F.col("level"), RISK_ORDER), "title")


def is_unresolved(speaker: Column, wide: bool = False) -> Column:
    """No speaker, or a numbered one; `wide` takes every generic label."""
    narrow = (speaker == "") | speaker.ilike("Speaker%") | speaker.like("발화자%")
    return narrow | t.is_generic(speaker) if wide else narrow


def backfill_ranking(x: Tables, limit: int = 10, wide: bool = False) -> DataFrame:
    """BF. Meetings with more than half of the utterances unresolved, weighty categories first."""
    said = x["utterances"].groupBy("meeting_rowid").agg(F.count("*").alias("total"), F.count_if(is_unresolved(F.col("speaker"), wide)).alias("unresolved"))
    rows = said.filter("unresolved * 2 > total").join(x["meetings"], F.col("meeting_rowid") == F.col("rowid"))
    rows = rows.select("path", "date", "title", F.col("category_raw").alias("category"), "total", "unresolved")
    return rows.orderBy(F.col("category").isin(*BACKFILL_FIRST).desc(), F.desc("total"), "path").limit(limit)


def attribution(x: Tables) -> DataFrame:
    """Utterances by how their speaker is known, with percentages."""
    counted = x["utterances"].groupBy("kind").agg(F.count("*").alias("n"))
    return counted.withColumn("share", t.percent(F.col("n"), F.sum("n").over(W.partitionBy())))


def pain_terms(x: Tables, terms: list[str]) -> DataFrame:
    """S1. Utterances with each term, by month and category."""
    index = search.token_index(x["utterances"], "utt_id", ["text"]).filter(F.col("token").isin(*[w.lower() for w in terms]))
    hits = index.select("utt_id", "token").distinct().join(x["utterances"], "utt_id").join(x["meetings"], F.col("meeting_rowid") == F.col("rowid"))
    return hits.groupBy("token", t.month(F.col("date")).alias("month"), "category").agg(F.count("*").alias("n"))


# What the dossiers show, for all people in one pass.


def _top(df: DataFrame, by: str, order: list, n: int, out: str = "place") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col(out) <= n)


def dossier_meetings(x: Tables, n: int = 30) -> DataFrame:
    """DS1. Each person's latest meetings, how many there are, first and last date."""
    rows = x["person_meetings"].join(x["meetings"], F.col("meeting_rowid") == F.col("rowid")).select("person", "date", "title", "path", "src")
    all_of = W.partitionBy("person")
    rows = rows.withColumns({"total": F.count("*").over(all_of), "first_met": F.min("date").over(all_of), "last_met": F.max("date").over(all_of)})
    return _top(rows, "person", [F.desc("date"), "path"], n).withColumn("more", F.greatest(F.col("total") - n, F.lit(0)))


def dossier_peers(x: Tables, n: int = 8, shown: int = 6) -> DataFrame:
    """DS2. Each person's most frequent companions: the first `n`, of these without generic labels
    the first `shown`."""
    pm = x["person_meetings"].select("person", "meeting_rowid")
    pairs = pm.join(pm.withColumnRenamed("person", "peer"), "meeting_rowid").filter("person <> peer")
    counted = pairs.groupBy("person", "peer").agg(F.count_distinct("meeting_rowid").alias("n"))
    first = _top(counted, "person", [F.desc("n"), "peer"], n, "_p").filter(~t.is_generic(F.col("peer"))).drop("_p")
    return _top(first, "person", [F.desc("n"), "peer"], shown)


def dossier_relations(x: Tables) -> DataFrame:
    """DS3. Relations seen from either end."""
    r = x["relations"].select("from_person", "to_person", "type", "topic", "note")
    there = r.select(F.col("from_person").alias("person"), F.col("to_person").alias("other"), "type", "topic", "note")
    back = r.filter("from_person <> to_person").select(F.col("to_person").alias("person"), F.col("from_person").alias("other"), "type", "topic", "note")
    return there.unionByName(back)


def dossier_network(x: Tables) -> DataFrame:
    """DS4. Network edges seen from either end."""
    n = x["network"].select("a", "b", "kind", "since", "note")
    there = n.select(F.col("a").alias("person"), F.col("b").alias("other"), "kind", "since", "note")
    return there.unionByName(n.filter("a <> b").select(F.col("b").alias("person"), F.col("a").alias("other"), "kind", "since", "note"))


def dossier_open_loops(x: Tables) -> DataFrame:
    """DS5. Open promises of each person, as giver or taker."""
    rows = x["commitments"].filter("done = 0").join(x["meetings"], F.col("meeting_rowid") == F.col("rowid"))
    ends = F.array_distinct(F.array("from_person", "to_person"))
    return rows.select(F.explode(ends).alias("person"), "from_person", "to_person", "text", "due", "date", "title").filter("person <> ''")


def dossier_models(x: Tables, n: int = 12, ranked: bool = False) -> DataFrame:
    """DS6. What each person holds, most often seen first; of equal counts by the evidence's name
    (or, `ranked`, by its weight)."""
    rows = x["model_people"].join(x["models"], F.col("model_id") == F.col("id"))
    evidence = t.rank(F.col("evidence"), ("high", "mid", "low")) if ranked else F.col("evidence")
    return _top(rows, "person", [F.desc("count"), evidence, "id"], n).select("person", "place", "id", "category", "title", "evidence", "count", "quote")


def people_index(x: Tables) -> DataFrame:
    """IX1. Meetings, first and last date of each person."""
    rows = x["person_meetings"].join(x["meetings"], F.col("meeting_rowid") == F.col("rowid"))
    return rows.groupBy("person").agg(F.count_distinct("meeting_rowid").alias("n"), F.min("date").alias("first_met"), F.max("date").alias("last_met"))


def contacts(x: Tables, registry: DataFrame, promote_at: int = 3) -> DataFrame:
    """IX2. People met who are in no registry; from `promote_at` meetings on worth an entry."""
    known = registry.select(t.norm(F.col("name")).alias("person"))
    rows = people_index(x).filter(~t.is_generic(F.col("person"))).join(known, "person", "left_anti")
    return rows.withColumn("promote", F.col("n") >= promote_at).orderBy(F.desc("n"), "person")


def index_counts(x: Tables) -> DataFrame:
    """Meetings by category and by month in one pass, with all minutes as hours."""
    by = x["meetings"].withColumn("month", t.month(F.col("date"))).groupingSets([["category"], ["month"], []], "category", "month")
    counted = by.agg(F.count("*").alias("n"), t.hours(F.coalesce(F.sum("duration_min"), F.lit(0))).alias("hours"), F.grouping_id().alias("g"))
    return counted.select(F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "month").otherwise("all").alias("by"), F.coalesce("category", "month", F.lit("")).alias("value"), "n", "hours")


def assertions(x: Tables) -> DataFrame:
    """How each model may be told: asserted, hedged or admitted as weak; past tense if stale."""
    newest = x["meetings"].agg(F.max(t.iso_date(F.col("date"))).alias("newest"))
    rows = x["models"].crossJoin(F.broadcast(newest))  # one row
    seen = t.iso_date(F.coalesce(F.when(F.col("last_seen") != "", F.col("last_seen")), "first_seen"))
    stale = F.coalesce(t.days_between(F.col("newest"), seen) > STALE_DAYS, F.lit(False))
    voice = F.when(F.col("evidence") == "high", "assert").when(F.col("evidence") == "mid", "hedge").otherwise("admit")
    return rows.select("id", "evidence", voice.alias("assertion"), stale.alias("stale"))
