"""Incremental merging: extracts to tasks, syntheses and pools back into the ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from .resolve import canonical_by_variant

OTHER = t.OTHER_CATEGORY
SPLIT_ABOVE = 30
FOLD_BELOW = 8


def new_meetings(extracts: DataFrame, processed: DataFrame) -> DataFrame:
    """Meetings of the extract documents whose source is not processed yet, with place `pos`."""
    rows = extracts.select("batch", F.posexplode("meetings").alias("pos", "m")).select("batch", "pos", "m.*")
    return rows.join(processed.select("source_id").distinct(), "source_id", "left_anti")


def flatten(meetings: DataFrame, part: str) -> DataFrame:
    """The items of one array of the meetings, with the meeting's source, date and title."""
    rows = meetings.select(F.col("source_id").alias("mtg_source_id"), F.col("date").alias("mtg_date"), F.col("title").alias("mtg_title"), F.explode(part).alias("i"))
    return rows.select("i.*", "mtg_source_id", "mtg_date", "mtg_title")


def known_instances(instances: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instances whose holder is in the registry, and counts of the other holders."""
    rows = instances.withColumn("holder", t.norm_ends(F.coalesce("holder", F.lit(""))))
    names = registry.filter("name <> ''").select(t.norm_ends(F.col("name")).alias("holder")).distinct()
    lost = rows.join(names, "holder", "left_anti").groupBy(F.when(F.col("holder") == "", "<empty>").otherwise(F.col("holder")).alias("holder")).count()
    return rows.join(names, "holder", "left_semi"), lost


def signals(meetings: DataFrame) -> DataFrame:
    """The timeline signals of the meetings, in their order."""
    return meetings.filter("timeline_signal <> ''").select("date", "title", F.col("timeline_signal").alias("signal"), "batch", "pos")


#: An id that was renamed before: the id and its number.
NUMBERED = r"(?s)^(.+)-([0-9]{1,9})$"


def tasks(models: DataFrame, instances: DataFrame, split_above: int = SPLIT_ABOVE, fold_below: int = FOLD_BELOW) -> DataFrame:
    """`kind` (model, instance), `owner`, `category`, `task_key` of all items. models: `owner` (the
    first holder), `category`; instances likewise. An owner with more than `split_above` instances is
    split by category; of these, tasks with fewer than `fold_below` items go to the owner's 기타."""
    both = models.select(F.lit("model").alias("kind"), "owner", F.coalesce("category", F.lit(OTHER)).alias("category"))
    both = both.unionByName(instances.select(F.lit("instance").alias("kind"), "owner", F.coalesce("category", F.lit(OTHER)).alias("category")))
    heavy = F.count_if(F.col("kind") == "instance").over(W.partitionBy("owner")) > split_above
    both = both.withColumn("heavy", heavy).withColumn("size", F.count("*").over(W.partitionBy("owner", "category")))
    kept = F.when((F.col("size") < fold_below) & (F.col("category") != OTHER), OTHER).otherwise(F.col("category"))
    key = F.when(F.col("heavy"), F.concat_ws("-", "owner", kept)).otherwise(F.concat(F.lit("person-"), "owner"))
    return both.select("kind", "owner", "category", key.alias("task_key"))


def needed(task_items: DataFrame) -> DataFrame:
    """Keys of tasks with at least one instance."""
    return task_items.groupBy("task_key").agg(F.count_if(F.col("kind") == "instance").alias("instances"), F.count_if(F.col("kind") == "model").alias("models")).filter("instances > 0")


def merge_models(base: DataFrame, assigned: DataFrame, synthesized: DataFrame) -> DataFrame:
    """Models of the base that no finished task was given, and the synthesized ones (`key`, `pos` and
    a model's columns). assigned: `id`, `key` of the tasks' models. A task without output keeps its
    models. A synthesized id that is taken is renamed `-2`, `-3` ..., and `renamed_from` tells."""
    good = synthesized.filter("coalesce(id, '') <> '' and coalesce(title, '') <> '' and size(coalesce(holders, array())) > 0")
    replaced = assigned.join(synthesized.select("key").distinct(), "key", "left_semi").select("id").distinct()
    carried = base.join(replaced, "id", "left_anti")
    taken = carried.select("id").distinct().withColumn("taken", F.lit(1))
    numbered = carried.select("id").unionByName(good.select("id")).select(F.regexp_extract("id", NUMBERED, 1).alias("id"), F.regexp_extract("id", NUMBERED, 2).try_cast("long").alias("k"))
    highest = numbered.filter("id <> ''").groupBy("id").agg(F.max("k").alias("highest"))
    new = good.join(taken, "id", "left").join(highest, "id", "left")
    nth = F.row_number().over(W.partitionBy("id").orderBy("key", "pos")) + F.coalesce("taken", F.lit(0)) - 1
    new = new.withColumn("nth", nth)
    other = F.concat_ws("-", "id", (F.greatest(F.coalesce("highest", F.lit(1)), F.lit(1)) + F.col("nth")).cast("string"))
    new = new.withColumn("renamed_from", F.when(F.col("nth") > 0, F.col("id"))).withColumn("id", F.when(F.col("nth") > 0, other).otherwise(F.col("id")))
    columns = [c for c in base.columns]
    return carried.select(*columns, F.lit(None).cast("string").alias("renamed_from")).unionByName(new.select(*columns, "renamed_from"))


def canonical_about(models: DataFrame, known: DataFrame) -> DataFrame:
    """`id`, `about`: the canonical names, sorted and distinct. known: `pos`, `name`."""
    rows = canonical_by_variant(models.select("id", F.explode("about").alias("x")), "x", known, "name", ["id", "x"])
    return rows.filter("name <> ''").groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("about"))


def models_of_people(people: DataFrame, models: DataFrame) -> DataFrame:
    """`name`, `models`: what each person holds."""
    held = models.select("id", F.explode("holders").alias("name")).groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("models"))
    return people.select("name").join(held, "name", "left").select("name", F.coalesce("models", F.array().cast("array<string>")).alias("models"))


def merge_evolution(old: DataFrame, new: DataFrame) -> DataFrame:
    """`person`, `date`, `note`: the old entries, and the new ones that are not there yet."""
    add = new.filter("person <> '' and note <> ''").select("person", F.coalesce("date", F.lit("")).alias("date"), "note").distinct()
    return old.select("person", "date", "note").unionByName(add.join(old, ["person", "date", "note"], "left_anti"))


def new_tensions(relations: DataFrame, pool: DataFrame, people: DataFrame) -> DataFrame:
    """The pool's tensions between known people that the relations do not have, each once."""
    names = people.select("name").distinct()
    rows = pool.withColumn("topic", F.coalesce("topic", F.lit("")))
    for end in ("from", "to"):
        rows = rows.join(names, F.col(end) == F.col("name"), "left_semi")
    first = rows.groupBy("from", "to", "topic").agg(F.min_by(F.struct("direction", "note", "mtg_date"), F.struct("mtg_date", "note")).alias("r"))
    new = first.join(relations.select("from", "to", F.coalesce("topic", F.lit("")).alias("topic")), ["from", "to", "topic"], "left_anti")
    note = F.trim(F.concat(F.coalesce("r.note", F.lit("")), F.lit(" ("), F.coalesce("r.mtg_date", F.lit("")), F.lit(")")))
    one_way = F.when(F.col("r.direction") == "one-way", "one-way")
    return new.select("from", "to", F.lit("tension").alias("type"), one_way.alias("direction"), "topic", note.alias("note"))


def merge_tensions(relations: DataFrame, pool: DataFrame, people: DataFrame) -> DataFrame:
    """The relations, and the pool's tensions that are new."""
    return relations.unionByName(new_tensions(relations, pool, people))


def new_edges(network: DataFrame, pool: DataFrame, known: DataFrame, self_name: str = "") -> DataFrame:
    """The pool's edges by canonical names that the network does not have; edges with one's own organisation
    are left out."""
    rows = pool.select(F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"), "kind", F.coalesce("note", F.lit("")).alias("note"), "mtg_date")
    for end in ("a", "b"):
        rows = canonical_by_variant(rows, end, known, "_c", [end]).withColumn(end, F.col("_c")).drop("_c", "_n")
    own = F.transform(t.variants(F.lit(self_name)), lambda v: F.lower(v)) if self_name else F.array().cast("array<string>")
    rows = rows.filter((F.col("a") != "") & (F.col("b") != "") & (F.coalesce("kind", F.lit("")) != ""))
    rows = rows.filter(~F.array_contains(own, F.lower("a")) & ~F.array_contains(own, F.lower("b")))
    first = rows.groupBy("a", "b", "kind").agg(F.min_by(F.struct("note", "mtg_date"), F.struct("mtg_date", "note")).alias("r"))
    new = first.join(network.select("a", "b", "kind"), ["a", "b", "kind"], "left_anti")
    return new.select("a", "b", "kind", F.lit(None).cast("string").alias("since"), "r.note", F.coalesce("r.mtg_date", F.lit("")).alias("source"))


def merge_network(network: DataFrame, pool: DataFrame, known: DataFrame, self_name: str = "") -> DataFrame:
    """The network, and the pool's edges that are new."""
    return network.unionByName(new_edges(network, pool, known, self_name))


def new_signals(timeline: DataFrame, pool: DataFrame) -> DataFrame:
    """Of each month of the pool the first and the last signal, unless the timeline has them."""
    order = F.struct("date", "batch", "pos") if "batch" in pool.columns else F.struct("date", "signal")
    ends = pool.groupBy(t.month(F.col("date")).alias("month")).agg(F.min_by(F.struct("date", "signal"), order).alias("first"), F.max_by(F.struct("date", "signal"), order).alias("last"))
    new = ends.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("s")).select(F.col("s.date").alias("date"), F.col("s.signal").alias("change")).distinct()
    new = new.join(timeline.select("date", "change"), ["date", "change"], "left_anti")
    return new.select("date", F.lit(None).cast("string").alias("meeting"), "change")


def merge_timeline(timeline: DataFrame, pool: DataFrame) -> DataFrame:
    """The timeline, and the pool's signals that are new."""
    return timeline.unionByName(new_signals(timeline, pool))


def processed_sources(onto: DataFrame, meetings: DataFrame) -> DataFrame:
    """`source_id` of all that is processed after this batch."""
    old = onto.select(F.explode("meta.processed_source_ids").alias("source_id"))
    return old.unionByName(meetings.select("source_id")).filter("source_id <> ''").distinct()
