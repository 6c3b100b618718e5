"""Ontology version 1 to 2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.files import section
from .resolve import union
from .title_match import best_titles

SIMILAR_AT = 0.55


def version(onto: DataFrame) -> int:
    row = onto.select(F.coalesce("meta.schema_version", F.lit(1)).alias("v")).first()
    return row.v if row else 1


def typed_people(people: DataFrame, registry: DataFrame, persons: tuple[str, ...] = (), orgs: tuple[str, ...] = ()) -> DataFrame:
    """People with `type`: a person if some variant of the name is one of the registry's, else an
    organisation, whose evidence is at most mid; `persons` and `orgs` are set by hand."""
    lower = lambda c: F.explode(F.transform(t.variants(t.norm(c)), lambda v: F.lower(v)))
    labels = registry.select(F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("x"))
    keys = labels.select(lower(F.col("x")).alias("v")).distinct()
    hits = people.select("name", lower(F.col("name")).alias("v")).join(keys, "v", "left_semi").select("name").distinct().withColumn("hit", F.lit(True))
    kind = F.when(F.col("name").isin(*persons), "person").when(F.col("name").isin(*orgs), "org").when(F.col("hit"), "person").otherwise("org")
    out = people.join(hits, "name", "left").withColumn("type", kind).drop("hit")
    return out.withColumn("evidence", F.when((F.col("type") == "org") & (F.col("evidence") == "high"), "mid").otherwise(F.col("evidence")))


def canonical(labels: DataFrame, people: DataFrame, name: str = "x") -> DataFrame:
    """`labels` with `canon`: the name itself if it is one, else the only one with a common variant,
    else the name itself."""
    v = lambda c: F.explode(F.transform(t.variants(t.norm(c)), lambda x: F.lower(x)))
    owners = people.select(F.col("name").alias("owner"), v(F.col("name")).alias("v")).distinct()
    distinct = labels.select(name).distinct()
    exact = people.select(F.col("name").alias("exact")).distinct()
    hits = distinct.select(name, v(F.col(name)).alias("v")).join(owners, "v").groupBy(name).agg(F.collect_set("owner").alias("owners"))
    out = labels.join(hits, name, "left").join(exact, F.col(name) == F.col("exact"), "left")
    return out.withColumn("canon", F.coalesce("exact", F.when(F.size("owners") == 1, F.col("owners")[0]), name)).drop("owners", "exact")


def migrated(onto: DataFrame, registry: DataFrame, catalog: DataFrame, persons: tuple[str, ...] = (), orgs: tuple[str, ...] = ()) -> dict[str, DataFrame] | None:
    """`people`, `models`, `meetings` of version 2; None if it is that already."""
    if version(onto) >= 2:
        return None
    people = typed_people(section(onto, "people"), registry, persons, orgs)
    models = section(onto, "models")
    kinds = people.select(F.col("name").alias("canon"), "type").distinct()
    linked = canonical(models.select("id", F.explode("people").alias("x")), people).join(kinds, "canon", "left")
    linked = linked.select("id", "canon", F.coalesce(F.col("type") == "person", F.lit(False)).alias("holds"))
    own = people.select(F.explode("models").alias("id"), F.col("name").alias("canon"), (F.col("type") == "person").alias("holds"))
    said = models.select("id", F.explode("about").alias("canon"), F.lit(False).alias("holds"))
    links = union([linked, own, said]).groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(F.col("holds"), F.col("canon")))).alias("h"),
        F.sort_array(F.collect_set(F.when(~F.col("holds"), F.col("canon")))).alias("a"),
    )
    none = F.array().cast("array<string>")
    rows = models.join(links, "id", "left").withColumns({"h": F.coalesce("h", none), "a": F.coalesce("a", none)})
    org_only = F.size("h") == 0
    rows = rows.withColumn("evidence", F.when(org_only & (F.col("evidence") == "high"), "mid").otherwise(F.col("evidence")))
    rows = rows.withColumns({"holders": F.when(org_only, F.col("a")).otherwise(F.col("h")), "about": F.when(org_only, none).otherwise(F.col("a"))}).drop("h", "a", "people")
    held = rows.select("id", F.explode("holders").alias("name")).groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("models"))
    people = people.drop("models").join(held, "name", "left").withColumn("models", F.coalesce("models", none))
    return {"people": people, "models": rows, "meetings": match_meetings(section(onto, "meetings"), catalog)}


def match_meetings(meetings: DataFrame, catalog: DataFrame, similar_at: float = SIMILAR_AT) -> DataFrame:
    """Meetings with source and path of the catalog entry of the same date whose title is most alike,
    if it is alike enough; of equal ones the first. catalog: `pos`, `date`, `title`, `source_id`, `path`."""
    entries = catalog.select(F.col("pos").alias("c_pos"), F.coalesce("date", F.lit("")).alias("date"), t.slug(F.col("title")).alias("c_slug"), F.struct("source_id", "path").alias("found"))
    open_ones = meetings.filter(F.coalesce("source_id", F.lit("")) == "").select("pos", F.coalesce("date", F.lit("")).alias("date"), t.slug(F.coalesce("title", F.lit(""))).alias("slug"))
    # Equal titles of a date are scored once, for the first entry that has them.
    entries = entries.groupBy("date", "c_slug").agg(F.min(F.struct("c_pos", "found")).alias("e")).select("date", "c_slug", "e.c_pos", "e.found")
    alike = best_titles(open_ones.select("date", F.col("slug").alias("title")).distinct(), entries.select("date", F.col("c_slug").alias("other"), F.col("c_pos").cast("long").alias("order")), similar_at)
    best = alike.filter("score is not null").select("date", F.col("title").alias("slug"), F.col("order").alias("c_pos")).join(entries.select("date", "c_pos", "found"), ["date", "c_pos"])
    out = meetings.join(open_ones.join(best.select("date", "slug", "found"), ["date", "slug"]).select("pos", "found"), "pos", "left")
    return out.withColumns({c: F.coalesce(f"found.{c}", c) for c in ("source_id", "path")}).drop("found")
