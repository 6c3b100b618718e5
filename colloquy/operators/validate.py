"""Findings: one operator per rule, all of one shape: rule, severity (E, W, I), key, message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import section
from . import grounding
from .resolve import union

# What may stand in evidence, relation type and entity type.
EVIDENCE = ("high", "mid", "low")
RELATION_TYPES = ("agree", "tension", "builds-on")
ENTITY_TYPES = ("person", "org")


def finding(df: DataFrame, rule: str, severity: str, key: Column, message: Column | str) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(key.cast("string"), F.lit("")).alias("key"), text.alias("message"))


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def not_one_of(c: str, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))


def dangling(df: DataFrame, column: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose value of `column` no row of `targets` has, nulls included."""
    return df.join(targets.select(F.col(target).alias("_t")).distinct(), F.col(column).eqNullSafe(F.col("_t")), "left_anti")


def structure(onto: DataFrame) -> DataFrame:
    """V1-V8, V29."""
    people, models = section(onto, "people"), section(onto, "models")
    v2 = onto.select((F.coalesce("meta.schema_version", F.lit(1)) >= 2).alias("v2"))
    v2_people, v2_models = people.crossJoin(F.broadcast(v2)).filter("v2"), models.crossJoin(F.broadcast(v2)).filter("v2")
    name, mid = F.coalesce("name", F.lit("<unnamed>")), F.coalesce("id", F.lit("<no-id>"))
    return union(
        [
            *[finding(onto.filter(F.col(k).isNull()), "V1", "E", F.lit(k), f"{k} is missing") for k in ("meta", "people", "models")],
            finding(people.filter(blank("name")), "V2", "E", F.col("pos"), "an entry has no name"),
            finding(people.filter(blank("summary")), "V2", "W", name, "no summary"),
            finding(people.filter(not_one_of("evidence", EVIDENCE)), "V3", "E", name, "evidence is not one of high, mid, low"),
            finding(v2_people.filter(not_one_of("type", ENTITY_TYPES)), "V4", "E", name, "type is neither person nor org"),
            finding(models.filter(blank("id")), "V5", "E", F.col("pos"), "a model has no id"),
            finding(models.filter(~blank("id")).groupBy("id").count().filter("count > 1"), "V5", "E", F.col("id"), "the id is there more than once"),
            *[finding(models.filter(blank(k)), "V6", "E", mid, f"{k} is missing") for k in ("category", "title")],
            finding(models.filter(not_one_of("evidence", EVIDENCE)), "V7", "E", mid, "evidence is not one of high, mid, low"),
            finding(v2_models.filter(F.col("holders").isNull()), "V8", "E", mid, "holders are missing"),
            finding(v2.filter(~F.col("v2")), "V29", "W", F.lit("meta"), "the document has version 1"),
        ]
    )


def integrity(onto: DataFrame, registry: DataFrame) -> DataFrame:
    """V9-V17: every reference has its target."""
    people, models = section(onto, "people"), section(onto, "models").withColumn("h", F.coalesce("holders", "people"))
    held = models.select("id", F.explode("h").alias("x"))
    about, related = models.select("id", F.explode("about").alias("x")), models.select("id", F.explode("related").alias("x"))
    listed = people.select("name", F.explode("models").alias("x"))
    ends = union([section(onto, "relations").select(F.lit(e).alias("end"), F.col(e).alias("x")) for e in ("from", "to")])
    network = section(onto, "network")
    net_ends = union([network.select(F.lit(e).alias("end"), F.col(e).alias("x")) for e in ("a", "b")])
    names = people.select("name").unionByName(registry.select("name"))
    timeline = section(onto, "timeline")
    in_models = listed.join(models.select(F.col("id").alias("x")).distinct(), "x", "left_semi")
    not_holder = in_models.join(held.select(F.col("id").alias("x"), F.col("x").alias("name")), ["x", "name"], "left_anti")
    says = lambda text: F.concat(F.lit(text + ": "), F.coalesce("x", F.lit("")))
    bosses = registry.withColumn("x", F.trim(F.coalesce("manager", F.lit("")))).filter("x <> ''")
    return union(
        [
            finding(models.filter(F.coalesce(F.size("h"), F.lit(0)) <= 0), "V9", "E", F.col("id"), "nobody holds it"),
            finding(dangling(held, "x", people, "name"), "V10", "E", F.col("id"), says("a holder is not among the people")),
            finding(dangling(about, "x", people, "name"), "V11", "W", F.col("id"), says("it is about somebody who is not among the people")),
            finding(dangling(related, "x", models, "id"), "V12", "E", F.col("id"), says("a related model does not exist")),
            finding(dangling(listed, "x", models, "id"), "V13", "E", F.col("name"), says("a model does not exist")),
            finding(not_holder, "V13", "E", F.col("name"), says("lists a model without being one of its holders")),
            finding(dangling(ends, "x", people, "name"), "V14", "E", F.col("end"), says("an end of a relation is not among the people")),
            finding(section(onto, "relations").filter(not_one_of("type", RELATION_TYPES)), "V14", "E", F.concat_ws("→", "from", "to"), "type is not one of agree, tension, builds-on"),
            finding(dangling(bosses, "x", registry, "name"), "V15", "W", F.col("name"), says("the manager is not in the registry")),
            finding(network.filter(blank("kind")), "V16", "E", F.concat_ws("↔", "a", "b"), "kind is missing"),
            finding(net_ends.filter(blank("x")), "V16", "E", F.col("end"), "an end is missing"),
            finding(dangling(net_ends.filter(~blank("x")), "x", names, "name"), "V16", "W", F.col("x"), "neither among the people nor in the registry"),
            finding(dangling(timeline.filter(~blank("meeting")), "meeting", section(onto, "meetings"), "id"), "V17", "W", F.col("date"), F.concat(F.lit("no such meeting: "), "meeting")),
        ]
    )


def honesty(onto: DataFrame) -> DataFrame:
    """V18-V20: evidence is not stronger than its source."""
    people = section(onto, "people")
    models = section(onto, "models").withColumn("h", F.coalesce("holders", "people"))
    kinds = people.groupBy(F.col("name").alias("x")).agg(F.max("type").alias("type"))
    held = models.filter("evidence = 'high'").select("pos", "id", F.explode("h").alias("x")).join(kinds, "x", "left")
    org_only = held.groupBy("pos", "id").agg(F.bool_and(F.coalesce(F.col("type") == "org", F.lit(False))).alias("all_orgs")).filter("all_orgs")
    return union(
        [
            finding(people.filter("type = 'org' and evidence = 'high'"), "V18", "E", F.col("name"), "an organisation's profile is at most mid"),
            finding(org_only, "V19", "E", F.col("id"), "held by organisations only, so at most mid"),
            finding(models.filter((F.col("evidence") == "high") & blank("quote")), "V20", "W", F.col("id"), "high without a quote"),
        ]
    )


def provenance(onto: DataFrame, catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """V21, V22. catalog: `source_id`; paths: `path` of the files that are there."""
    met = section(onto, "meetings")
    sourced = met.filter(~blank("source_id") & ~blank("path"))
    processed = onto.select(F.explode("meta.processed_source_ids").alias("source_id")).distinct()
    ids = catalog.select("source_id").distinct()
    counts = ids.join(processed.withColumn("p", F.lit(True)), "source_id", "left").agg(F.count("*").alias("n"), F.count("p").alias("done")).filter("n > 0")
    any_catalog = F.broadcast(catalog.limit(1).select(F.lit(True).alias("any")))
    return union(
        [
            finding(met.filter(blank("source_id") | blank("path")), "V21", "W", F.col("id"), "no source or path"),
            finding(dangling(sourced, "path", paths, "path"), "V21", "W", F.col("id"), F.concat(F.lit("no such file: "), "path")),
            finding(dangling(sourced, "source_id", ids, "source_id").crossJoin(any_catalog), "V21", "W", F.col("id"), "the source is not in the catalog"),
            finding(counts, "V22", "I", F.lit("catalog"), F.format_string("%d of %d transcripts are processed", "done", "n")),
        ]
    )


def database(tables: dict[str, DataFrame], built_at: float | None = None, changed_at: float | None = None) -> DataFrame:
    """V23-V28 over the built tables. built_at, changed_at: when they and the ontology were written."""
    said, people, met = tables["utterances"], tables["people"], tables["meetings"]
    some = said.limit(1).select(F.lit(1).alias("one"))
    grounded = grounding.ground_quotes(tables["models"], said).crossJoin(F.broadcast(some))
    covered = grounding.coverage(said, tables["person_aliases"]).filter("total > 0")
    old = some.filter(F.lit(built_at is not None and changed_at is not None and built_at < changed_at))
    n_quotes = grounded.agg(F.count("*").alias("n"), F.count_if("grounded").alias("ok")).filter("n > 0 and n = ok")
    return union(
        [
            finding(old, "V23", "W", F.lit("tables"), "the tables are older than the ontology"),
            finding(grounded.filter("not grounded"), "V24", "W", F.col("id"), F.format_string("the quote is not grounded (%.2f)", "score")),
            finding(n_quotes, "V24", "I", F.lit("quotes"), F.format_string("%d/%d quotes are grounded", "ok", "n")),
            finding(grounding.stale(tables["models"], met), "V25", "W", F.col("id"), F.concat(F.lit("stale since "), F.col("seen").cast("string"))),
            finding(covered, "V26", "I", F.lit("coverage"), F.format_string("%.1f%% of %d utterances have a canonical speaker", "share", "total")),
            finding(grounding.silent_people(people, said), "V27", "W", F.col("name"), "says nothing in any meeting"),
            finding(grounding.silent_meetings(met, said), "V28", "W", F.col("path"), "nothing is said in it"),
        ]
    )


def validate(onto: DataFrame, registry: DataFrame, catalog: DataFrame, paths: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """All findings."""
    return union([structure(onto), integrity(onto, registry), honesty(onto), provenance(onto, catalog, paths), database(tables)])


def verdict(findings: DataFrame) -> DataFrame:
    """Counts by severity, and whether there is no error."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("E", "errors"), ("W", "warnings"), ("I", "infos"))]).withColumn("passed", F.col("errors") == 0)
