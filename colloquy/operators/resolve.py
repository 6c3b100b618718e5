"""Entity resolution: aliases to canonical names, registry overlay, org chart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

REPORTS_TO, ORG_CHART = "보고", "조직도"


def alias_candidates(registry: DataFrame, people: DataFrame) -> DataFrame:
    """`canonical`, `alias` (lower-cased): names and aliases of the registry and the ontology's
    persons, with the variants of each."""
    listed = registry.select(t.norm(F.col("name")).alias("canonical"), F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("label"))
    persons = people.filter(F.coalesce(F.when(F.col("type") != "", F.col("type")), F.lit("person")) == "person")
    listed = listed.unionByName(persons.select(t.norm(F.col("name")).alias("canonical"), F.col("name").alias("label")))
    rows = listed.filter("canonical <> ''").withColumn("label", t.norm(F.col("label")))
    return rows.select("canonical", F.explode(t.variants(F.col("label"))).alias("alias")).select("canonical", F.lower("alias").alias("alias")).distinct()


def alias_map(candidates: DataFrame) -> DataFrame:
    """Aliases with one owner only; an alias of two is dropped for both."""
    return candidates.groupBy("alias").agg(F.count_distinct("canonical").alias("n"), F.min("canonical").alias("canonical")).filter("n = 1").select("canonical", "alias")


def ambiguous(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("alias").agg(F.sort_array(F.collect_set("canonical")).alias("owners")).filter(F.size("owners") > 1)


def resolve(df: DataFrame, raw: str, aliases: DataFrame, out: str) -> DataFrame:
    """`df` with `out`: the canonical name of label `raw`; a generic or unknown label as it is; empty
    for null or blank. Spark broadcasts the aliases if they are small enough."""
    label = t.norm(F.coalesce(F.col(raw), F.lit("")))
    keyed = df.withColumn("_label", label)
    found = keyed.join(aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical")), F.lower("_label") == F.col("_alias"), "left")
    name = F.when(F.col("_label") == "", "").when(t.is_generic(F.col("_label")), F.col(raw)).otherwise(F.coalesce("_canonical", F.col(raw)))
    return found.withColumn(out, name).drop("_label", "_alias", "_canonical")


def classify(df: DataFrame, raw: str, speaker: str, aliases: DataFrame, out: str = "kind") -> DataFrame:
    """`df` with `out`: unattributed, generic, canonical or raw-name."""
    names = aliases.select(F.col("canonical").alias("_name")).distinct().withColumn("_is_name", F.lit(True))
    known = aliases.select(F.col("alias").alias("_known"), F.lit(True).alias("_is_alias"))
    rows = df.join(names, F.col(speaker) == F.col("_name"), "left").withColumn("_key", F.lower(t.norm(F.col(raw)))).join(known, F.col("_key") == F.col("_known"), "left")
    kind = (
        F.when(F.coalesce(F.col(speaker), F.lit("")) == "", "unattributed")
        .when(t.is_generic(t.norm(F.col(speaker))), "generic")
        .when(F.col("_is_name") | F.col("_is_alias"), "canonical")
        .otherwise("raw-name")
    )
    return rows.withColumn(out, kind).drop("_name", "_is_name", "_key", "_known", "_is_alias")


def last_by_key(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Of rows with equal keys the one with the highest place."""
    names = [c for c in df.columns if c != pos]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), pos).alias("r")).select("r.*")


def overlay(people: DataFrame, registry: DataFrame) -> DataFrame:
    """People of the ontology with tier, relationship, team and manager of the registry, whose other
    persons are added; an ontology entry's other columns stay as they are."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    left = people.select(t.norm(F.col("name")).alias("name"), *[blank(c).alias(c) for c in ("type", "role", "org", "summary", "evidence")], F.lit(True).alias("_old"))
    extra = registry.filter(blank("name") != "").select(
        t.norm(F.col("name")).alias("name"), blank("role").alias("r_role"), blank("org").alias("r_org"), F.coalesce("tier", F.lit("core")).alias("tier"), blank("relationship").alias("relationship"), blank("team").alias("team"), blank("manager").alias("manager")
    )
    both = left.join(extra.dropDuplicates(["name"]), "name", "full_outer")
    old = F.col("_old").isNotNull()
    return both.select(
        "name",
        F.when(old, F.col("type")).otherwise("person").alias("type"),
        F.when(old, F.col("role")).otherwise(F.col("r_role")).alias("role"),
        F.when(old, F.col("org")).otherwise(F.col("r_org")).alias("org"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("tier", "relationship", "team", "manager")],
    )


def org_edges(registry: DataFrame, network: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges person -> manager that the network does not have yet; the manager's label is resolved."""
    rows = registry.filter((F.coalesce("manager", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    rows = resolve(rows.withColumn("name", t.norm(F.col("name"))), "manager", aliases, "boss")
    edges = rows.select(F.col("name").alias("a"), F.col("boss").alias("b"), F.lit(REPORTS_TO).alias("kind"), F.lit("").alias("since"), F.coalesce("team", F.lit("")).alias("note"), F.lit(ORG_CHART).alias("source"))
    return edges.join(network.select("a", "b", "kind"), ["a", "b", "kind"], "left_anti")


def person_meetings(participants: DataFrame, speakers: DataFrame) -> DataFrame:
    """`person`, `meeting_rowid`, `src`: one row for each pair; having spoken counts before being listed."""
    rows = participants.withColumn("src", F.lit("participant")).unionByName(speakers.withColumn("src", F.lit("speaker")))
    return rows.filter("person <> ''").groupBy("person", "meeting_rowid").agg(F.max("src").alias("src"))


def canonical_by_variant(df: DataFrame, name: str, known: DataFrame, out: str, key: list[str]) -> DataFrame:
    """`df` with `out`: the one known name of which some variant of `name` is a variant; with none or
    several, the name as it is, normalised. known: `name`; a full match wins, of several the first by
    `pos`. key: columns that tell the rows of `df` apart."""
    owners = known.select("pos", F.col("name").alias("_owner"), F.explode(t.variants(t.norm_ends(F.col("name")))).alias("_v")).select("pos", "_owner", F.lower("_v").alias("_v"))
    owners = owners.groupBy("_v").agg(F.min_by("_owner", "pos").alias("_owner"))
    labels = df.select(*key, t.norm_ends(F.col(name)).alias("_n")).distinct()
    tried = labels.select(*key, "_n", F.explode(t.variants(F.col("_n"))).alias("_v")).withColumn("_v", F.lower("_v"))
    hits = tried.join(owners, "_v").groupBy(*key).agg(F.collect_set("_owner").alias("_hits"), F.max(F.when(F.col("_v") == F.lower("_n"), F.col("_owner"))).alias("_full"))
    one = F.when(F.size("_hits") == 1, F.col("_hits")[0])
    return df.join(hits, key, "left").withColumn(out, F.coalesce("_full", one, t.norm_ends(F.col(name)))).drop("_hits", "_full")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))
