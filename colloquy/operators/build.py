"""All tables of a corpus: transcripts, ontology and registry put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as t
from ..sources import files
from . import parse
from . import resolve as r


def ontology_tables(onto: DataFrame) -> dict[str, DataFrame]:
    """Tables of an ontology document of either version. Of equal names or ids the last counts. In
    version 1 people's `models` are links too: of persons as holders, of organisations as subjects."""
    empty = F.array().cast("array<string>")
    version = F.coalesce("meta.schema_version", F.lit(1))
    people = r.last_by_key(files.section(onto, "people").filter("name <> ''"), "name")
    models_in = files.section(onto, "models").filter("id <> ''")
    held = models_in.select(F.col("id").alias("model_id"), F.explode(F.coalesce("holders", "people", empty)).alias("person"))
    about = models_in.select(F.col("id").alias("model_id"), F.explode(F.coalesce("about", empty)).alias("entity"))
    old = onto.filter(version < 2).select(F.explode("people").alias("p")).select("p.name", "p.type", F.explode("p.models").alias("model_id"))
    is_org = F.coalesce(F.col("type") == "org", F.lit(False))
    held = held.unionByName(old.filter(~is_org).select("model_id", F.col("name").alias("person")))
    about = about.unionByName(old.filter(is_org).select("model_id", F.col("name").alias("entity")))
    models = r.last_by_key(models_in, "id").select("id", "category", "title", "desc", "evidence", "quote", "first_seen", "last_seen", F.coalesce("count", F.lit(1)).alias("count"))
    relations = files.section(onto, "relations").select(F.col("from").alias("from_person"), F.col("to").alias("to_person"), "type", "topic", "note", "direction")
    return {
        "people": people,
        "models": models,
        "model_people": held.distinct(),
        "model_about": about.distinct(),
        "model_related": models_in.select(F.col("id").alias("model_id"), F.explode(F.coalesce("related", empty)).alias("related_id")),
        "relations": relations,
        "network": files.section(onto, "network").drop("pos"),
        "timeline": files.section(onto, "timeline").drop("pos"),
        "bets": files.section(onto, "bets").drop("pos").withColumn("source", F.array_join("source", ", ")),
        "risks": files.section(onto, "risks").drop("pos").withColumn("source", F.array_join("source", ", ")),
        "onto_meetings": files.section(onto, "meetings").select("id", "date", "title", "source_id", "path"),
    }


def resolved(meetings: DataFrame, said: DataFrame, promised: DataFrame, onto: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """Every table of `schemas.TABLES`, and `aliases_dropped` (labels of several people), of parsed transcripts: numbered
    meetings, and utterances and commitments that know their meeting's `rowid`."""
    tables = ontology_tables(onto)
    registry = registry.filter("name <> ''")
    candidates = r.alias_candidates(registry, tables["people"])
    aliases = r.alias_map(candidates)

    said = r.resolve(said.withColumn("_raw", t.strip_wrappers(F.col("speaker_raw"))), "_raw", aliases, "speaker").drop("_raw")
    said = r.classify(said, "speaker_raw", "speaker", aliases)
    promised = promised.withColumns({"f": t.strip_wrappers(F.col("from_raw")), "o": t.strip_wrappers(F.col("to_raw"))})
    promised = r.resolve(r.resolve(promised, "f", aliases, "from_person"), "o", aliases, "to_person")

    listed = meetings.select("rowid", F.explode("participant_list").alias("label")).withColumn("label", t.clean_participant(t.strip_wrappers(F.col("label"))))
    listed = r.resolve(listed, "label", aliases, "person").select("person", F.col("rowid").alias("meeting_rowid"))
    speakers = said.filter(F.col("kind").isin("canonical", "raw-name") & (t.clean_participant(t.strip_wrappers(F.col("speaker"))) != ""))
    speakers = speakers.select(F.col("speaker").alias("person"), F.col("rowid").alias("meeting_rowid"))

    tables["network"] = tables["network"].unionByName(r.org_edges(registry, tables["network"], aliases))
    tables["people"] = r.overlay(tables["people"], registry)
    tables["person_aliases"] = aliases
    tables["person_meetings"] = r.person_meetings(listed, speakers)
    tables["commitments"] = promised.select("from_person", "to_person", "text", "due", F.col("rowid").alias("meeting_rowid"), "done")
    tables["meetings"] = meetings.drop("participant_list")
    # An utterance is known by its meeting and line.
    utt_id = F.col("rowid") * F.lit(1 << 24) + F.col("i")
    tables["utterances"] = said.select(utt_id.alias("utt_id"), F.col("rowid").alias("meeting_rowid"), "speaker", "speaker_raw", "ts", "text", "kind")
    out = {n: df.select(*schemas.TABLES[n].names) for n, df in tables.items()}
    out["aliases_dropped"] = r.ambiguous(candidates)
    return out


def build_tables(transcripts: DataFrame, onto: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """The tables of `resolved`, and another report: `discarded` (lines that became no utterance)."""
    meetings = parse.meetings(transcripts)
    lines = parse.lines(meetings)
    out = resolved(meetings.drop("body"), parse.utterances(lines), parse.commitments(lines), onto, registry)
    out["discarded"] = parse.discarded(lines).join(meetings.select("rowid", "path"), "rowid")
    return out


def documents(spark: SparkSession, corpus: str) -> tuple[DataFrame, DataFrame]:
    """Ontology and registry of a corpus folder. Absent or broken documents count as empty."""
    onto = files.json_document(spark, f"{corpus}/_ontology/objects.json", schemas.ONTOLOGY).drop(files.CORRUPT)
    return onto, files.json_document(spark, f"{corpus}/_meta/speakers.json", schemas.REGISTRY).drop(files.CORRUPT)


def build(spark: SparkSession, corpus: str) -> dict[str, DataFrame]:
    """The tables of a corpus folder."""
    return build_tables(files.transcripts(spark, corpus), *documents(spark, corpus))


def catalog(meetings: DataFrame) -> DataFrame:
    """The meeting catalog, newest first."""
    return meetings.withColumn("vault_link", t.base_name(F.col("path"))).orderBy(F.desc("date"), F.desc("title"), "path")
