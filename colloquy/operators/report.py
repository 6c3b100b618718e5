"""Reports as rows of text: the index and the dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans import recipes
from . import grounding


def index_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """`ord`, `line` of the index: totals, meetings by category and month, and the list of meetings."""
    counts = recipes.index_counts(tables)
    head = F.when(F.col("by") == "all", F.format_string("# %d meetings, %d hours", "n", "hours")).otherwise(F.format_string("- %s %s: %d", "by", "value", "n"))
    group = F.when(F.col("by") == "all", 0).when(F.col("by") == "category", 1).otherwise(2)
    lines = counts.select(F.struct(group.alias("g"), F.col("value").alias("a"), F.lit("").alias("b")).alias("ord"), head.alias("line"))
    rows = tables["meetings"].select(F.struct(F.lit(3).alias("g"), F.col("date").alias("a"), F.col("path").alias("b")).alias("ord"), F.format_string("- %s [[%s]] %s", "date", t.base_name(F.col("path")), "title").alias("line"))
    return lines.unionByName(rows)


def dossier_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """`person`, `ord`, `line`: the dossiers of all people in one pass, a section after the other."""
    def part(n: int, df: DataFrame, order, line) -> DataFrame:
        return df.select("person", F.struct(F.lit(n).alias("g"), order.cast("string").alias("a")).alias("ord"), line.alias("line"))

    met = recipes.dossier_meetings(tables)
    peers = recipes.dossier_peers(tables)
    place = F.format_string("%06d", "place")
    return (
        part(0, recipes.people_index(tables), F.lit(""), F.format_string("# %s: %d meetings, %s ~ %s", "person", "n", "first_met", "last_met"))
        .unionByName(part(1, recipes.dossier_models(tables), place, F.format_string("- %s (%s ×%d)", "title", "evidence", "count")))
        .unionByName(part(2, recipes.dossier_relations(tables), F.concat_ws(" ", "other", "topic"), F.format_string("- %s %s: %s", t.relation_name(F.col("type")), "other", F.coalesce("topic", F.lit("")))))
        .unionByName(part(3, recipes.dossier_network(tables), F.concat_ws(" ", "kind", "other"), F.format_string("- %s %s", "kind", "other")))
        .unionByName(part(4, recipes.dossier_open_loops(tables), F.concat_ws(" ", "due", "text"), F.format_string("- [ ] %s → %s: %s %s", "from_person", "to_person", "text", "due")))
        .unionByName(part(5, peers, place, F.format_string("- with %s ×%d", "peer", "n")))
        .unionByName(part(6, met, place, F.format_string("- %s %s", "date", "title")))
        .unionByName(part(7, met.filter("place = 1 and more > 0"), F.lit(""), F.format_string("- and %d more", "more")))
    )


def dossiers(tables: dict[str, DataFrame], registry: DataFrame) -> DataFrame:
    """`dossier_lines` of those who get a dossier: people of the registry, but not contacts. Without a tier one is core."""
    wanted = registry.filter((F.col("name") != "") & (F.coalesce("tier", F.lit("core")) != "contact")).select(t.norm(F.col("name")).alias("person"))
    return dossier_lines(tables).join(wanted, "person", "left_semi")


def listed(rows: DataFrame, kind: str, first: int) -> DataFrame:
    """`kind`, `place`, `what`, `n`, `more`: the `first` rows (`what`, `n`) of the highest `n`, of equal ones those of the
    least `what`, and how many rows are not listed."""
    top = rows.select("what", F.col("n").cast("long").alias("n")).orderBy(F.desc("n"), "what").limit(first)
    place = F.row_number().over(W.orderBy(F.desc("n"), "what"))  # over `first` rows
    total = rows.agg(F.count("*").alias("total"))
    return top.withColumn("place", place).crossJoin(total).select(F.lit(kind).alias("kind"), "place", "what", "n", (F.col("total") - F.least(F.lit(first), F.col("total"))).alias("more"))


def build_warnings(tables: dict[str, DataFrame]) -> DataFrame:
    """What a build should be looked at for: files with lines that look spoken and were not understood (10 of the most
    lines), meetings without any utterance (10), and recordings that several files hold (8 of the most files)."""
    lost = tables["discarded"].filter("lost_lines > 0").select(F.col("path").alias("what"), F.col("lost_lines").alias("n"))
    silent = tables["meetings"].join(tables["utterances"].select(F.col("meeting_rowid").alias("rowid")).distinct(), "rowid", "left_anti")
    twice = grounding.duplicate_sources(tables["meetings"]).select(F.concat(F.col("source_id"), F.lit(": "), F.array_join("paths", " | ")).alias("what"), "n")
    rows = listed(lost, "lost lines", 10).unionByName(listed(silent.select(F.col("path").alias("what"), F.lit(0).alias("n")), "no utterances", 10))
    return rows.unionByName(listed(twice, "several files", 8))


def lost_holders(counts: DataFrame) -> DataFrame:
    """The five holders with the most instances that were dropped. counts: the second result of `batch.known_instances`."""
    return listed(counts.select(F.col("holder").alias("what"), F.col("count").alias("n")), "unknown holders", 5)


def personal_notes(registry: DataFrame) -> DataFrame:
    """`person`, `pos`, `note`, `mark`, `caution`: personal notes, given as text or as an object with
    a use, whose mark warns of private and forbidden ones."""
    rows = registry.select(F.col("name").alias("person"), F.posexplode("personal").alias("pos", "raw"))
    is_object = F.ltrim("raw").startswith("{")
    said = F.from_json("raw", "date string, note string, use string")
    note = F.when(is_object, F.coalesce(said["note"], F.lit(""))).otherwise(F.col("raw"))
    mark = F.when(is_object, t.note_mark(said["use"])).otherwise("")
    return rows.select("person", "pos", note.alias("note"), mark.alias("mark"), (mark != "").alias("caution"))


def with_manual_block(lines: DataFrame, old: DataFrame, start: str, end: str) -> DataFrame:
    """Dossier lines with the hand-written block of the person's old text (`person`, `content`) last."""
    kept = old.select("person", F.struct(F.lit(9).alias("g"), F.lit("").alias("a")).alias("ord"), t.manual_block(F.col("content"), start, end).alias("line"))
    return lines.unionByName(kept.filter("line <> ''"))
