"""Document in, document out: an ontology as ordered sections, merged, migrated or erased from as a whole,
compared with what it was, and put in place as a new version.

A document is a dict of DataFrames: `meta` has one row, every other section a row for each object, with its
place `pos`. Nothing of it goes through the driver or is gathered in one row.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .. import schemas
from ..functions import text as t
from ..sources import storage
from ..sources.files import section
from . import batch, erase, migrate

Document = dict[str, DataFrame]

#: The arrays of a document, in its order.
SECTIONS = tuple(f.name for f in schemas.ONTOLOGY if isinstance(f.dataType, ArrayType))
#: Places of what is added begin here.
_AFTER = 1 << 40


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def sections(onto: DataFrame) -> Document:
    """The document that a row of `schemas.ONTOLOGY` holds. Absent sections are empty."""
    return {"meta": onto.select("meta.*")} | {name: section(onto, name) for name in SECTIONS}


def empty(spark: SparkSession) -> Document:
    """The document that has nothing but a `meta` of nulls."""
    kinds = {f.name: f.dataType for f in schemas.ONTOLOGY}
    objects = {n: StructType([StructField("pos", LongType()), *kinds[n].elementType]) for n in SECTIONS}
    return {"meta": spark.createDataFrame([tuple(None for _ in kinds["meta"])], kinds["meta"])} | {n: spark.createDataFrame([], k) for n, k in objects.items()}


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with places in the order of these columns, which go: increasing, not without gaps."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.drop(*order).withColumn("pos", F.monotonically_increasing_id())


def _added(old: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """`old`, and after it `new` in the order of its columns `order`."""
    key = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in order])
    late = new.select("*", F.lit(1).alias("_late"), key.alias("_key"))
    early = old.select("*", F.lit(0).alias("_late")).withColumn("_key", F.lit(None).cast(late.schema["_key"].dataType))
    rows = early.unionByName(late, allowMissingColumns=True).withColumn("_pos", F.coalesce("pos", F.lit(0))).drop("pos")
    return _placed(rows, "_late", "_pos", "_key")


def _only(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """`rows`, of whose array `column` only the entries among `ids` stay, in their order; null stays null."""
    listed = rows.select("pos", F.posexplode(column).alias("_at", "id")).join(ids.select("id").distinct(), "id", "left_semi")
    kept = listed.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"]).alias("_kept"))
    names = rows.columns
    value = F.when(F.col(column).isNotNull(), F.coalesce("_kept", _no_texts())).alias(column)
    return rows.join(kept, "pos", "left").select(*[value if c == column else F.col(c) for c in names])


def merged(document: Document, registry: DataFrame, assigned: DataFrame, syntheses: DataFrame, pools: dict[str, DataFrame], sources: DataFrame | None = None) -> Document:
    """The document after a batch.

    registry: `pos`, `name`. assigned: `id`, `key` of the models given to tasks. syntheses: rows of `schemas.SYNTHESIS`; a
    task without one keeps its models. pools: `tensions`, `network`, `timeline`, each may be absent. sources: `source_id`
    of what is processed now. Models that stay keep their order, new ones follow by task; subjects get their
    canonical names, people the models they hold and their changes, by date; the timeline is sorted by date,
    and `meta.date_range` is what it spans.
    """
    out = dict(document)
    people, meta = out["people"], out["meta"]
    known = people.select("pos", "name").unionByName(registry.select((F.col("pos") + _AFTER).alias("pos"), "name")).filter("name <> ''")

    made = syntheses.select("key", F.posexplode("models").alias("pos", "m")).select("key", "pos", "m.*")
    made = made.withColumns({"count": F.coalesce("count", F.lit(1)), "about": F.coalesce("about", _no_texts())})
    # The outputs without any model count as outputs too.
    none = syntheses.filter("coalesce(size(models), 0) <= 0").select("key")
    made = made.unionByName(none, allowMissingColumns=True)
    models = batch.merge_models(out["models"].withColumn("key", F.lit("")), assigned, made).drop("renamed_from")
    row = F.concat_ws("\u0001", "key", F.col("pos").cast("string"))
    names = batch.canonical_about(models.select(row.alias("id"), "about"), known).select(F.col("id").alias("_row"), F.col("about").alias("_about"))
    models = models.withColumn("_row", row).join(names, "_row", "left").withColumn("about", F.coalesce("_about", F.when(F.col("about").isNotNull(), _no_texts()))).drop("_row", "_about")
    out["models"] = _placed(models.withColumnRenamed("pos", "_pos"), "key", "_pos")

    held = batch.models_of_people(people.select("name").distinct(), models).withColumnRenamed("models", "_models")
    told = syntheses.select(F.explode("evolution").alias("e")).select("e.*").filter("person <> '' and note <> ''")
    told = told.groupBy(F.col("person").alias("name")).agg(F.sort_array(F.collect_set(F.struct(F.coalesce("date", F.lit("")).alias("date"), "note"))).alias("_told"))
    had = F.coalesce(F.col("evolution"), F.array().cast(people.schema["evolution"].dataType))
    grown = F.when(F.col("_told").isNull(), F.col("evolution")).otherwise(F.concat(had, F.array_except("_told", had)))
    rows = people.join(held, "name", "left").join(told, "name", "left").withColumns({"models": F.coalesce("_models", _no_texts()), "evolution": grown})
    out["people"] = rows.select(*people.columns)

    if "tensions" in pools:
        out["relations"] = _added(out["relations"], batch.new_tensions(out["relations"], pools["tensions"], people), "from", "to", "topic")
    if "network" in pools:
        own = meta.select(F.explode(t.variants(F.coalesce("org", F.lit("")))).alias("v")).select(F.lower("v").alias("v")).filter("v <> ''")
        new = batch.new_edges(out["network"], pools["network"], known)
        for end in ("a", "b"):
            new = new.join(own, F.lower(end) == F.col("v"), "left_anti")
        out["network"] = _added(out["network"], new, "source", "a", "b", "kind")
    timeline = out["timeline"]
    if "timeline" in pools:
        timeline = _added(timeline, batch.new_signals(timeline, pools["timeline"]), "date", "change")
    timeline = timeline.withColumns({"_date": F.coalesce("date", F.lit("")), "_pos": F.col("pos")}).drop("pos")
    out["timeline"] = _placed(timeline, "_date", "_pos")

    span = out["timeline"].filter("date <> ''").agg(F.concat_ws(" ~ ", F.min("date"), F.max("date")).alias("_span"))
    meta = meta.crossJoin(span).withColumn("date_range", F.coalesce(F.nullif("_span", F.lit("")), "date_range")).drop("_span")  # one row each
    if sources is not None:
        done = sources.filter("source_id <> ''").agg(F.collect_set("source_id").alias("_done"))
        ids = F.sort_array(F.array_union(F.coalesce("processed_source_ids", _no_texts()), "_done"))
        meta = meta.crossJoin(done).withColumn("processed_source_ids", ids).drop("_done")
    out["meta"] = meta.select(*document["meta"].columns)
    return out


def migrated(onto: DataFrame, registry: DataFrame, catalog: DataFrame, persons: tuple[str, ...] = (), orgs: tuple[str, ...] = ()) -> Document | None:
    """The document in version 2; None if it is that already. See `migrate.migrated`."""
    new = migrate.migrated(onto, registry, catalog, persons, orgs)
    if new is None:
        return None
    old = sections(onto)
    return old | {n: df.select(*[c for c in old[n].columns if c in df.columns]) for n, df in new.items()} | {"meta": old["meta"].withColumn("schema_version", F.lit(2).cast(old["meta"].schema["schema_version"].dataType))}


def _others(column: str, name: str) -> Column:
    """The entries of an array of names that are not `name`, in whatever form that is written."""
    plain = F.split(t.nfc(F.array_join(F.transform(column, lambda x: F.coalesce(x, F.lit(""))), "\u0001")), "\u0001")
    both = F.zip_with(column, plain, lambda said, x: F.struct(said.alias("said"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "").alias("plain")))
    rest = F.transform(F.filter(both, lambda x: x["plain"] != name), lambda x: x["said"])
    return F.when(F.size(column) > 0, rest).otherwise(F.col(column))


def erased(document: Document, name: str, names: list[str]) -> Document:
    """The document without a person: their entry, their relations and edges, and the models that only they
    held go, with every mention of those models' ids; elsewhere they are no holder and no subject, and `names`
    (see `erase.tokens`) are masked in all text but ids and paths."""
    out = dict(document)
    said = lambda c: t.norm_ends(F.coalesce(c, F.lit("")))
    models = out["models"].withColumn("_holders", _others("holders", name))
    models = models.filter("not coalesce(size(holders) > 0 and size(_holders) = 0, false)")
    models = models.withColumns({"holders": F.col("_holders"), "about": _others("about", name)}).drop("_holders")
    out["models"] = _only(models, "related", models)
    out["people"] = _only(out["people"].filter(said(F.col("name")) != name), "models", models)
    out["bets"] = _only(out["bets"], "related_models", models)
    for part, ends in (("relations", ("from", "to")), ("network", ("a", "b"))):
        gone = reduce(Column.__or__, [said(F.col(e)) == name for e in ends])
        out[part] = out[part].filter(~gone)
    for part, df in out.items():
        plain = {f.name: erase.mask_text(F.col(f.name), names) for f in df.schema if f.dataType.simpleString() == "string" and f.name not in ("id", "path", "source_id", "batch", "kind")}
        nested = {f.name: F.from_json(erase.mask_text(F.to_json(F.col(f.name)), names), f.dataType) for f in df.schema if isinstance(f.dataType, ArrayType) and f.name not in ("models", "related", "related_models", "processed_source_ids", "source")}
        out[part] = df.withColumns(plain | nested)
    return out


def plan(old: Document, new: Document) -> DataFrame:
    """What would change: `section`, objects `before` and `after`, and how many of them are `added` and `removed`
    (one that changes is both). Equal objects are counted as often as they stand there."""

    def rows(document: Document, side: str) -> DataFrame:
        digest = lambda df: F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != "pos"])), 256)
        return reduce(DataFrame.unionAll, [document[n].select(F.lit(n).alias("section"), digest(document[n]).alias("d"), F.lit(side).alias("side")) for n in ("meta", *SECTIONS)])

    counts = rows(old, "old").unionAll(rows(new, "new")).groupBy("section", "d").agg(F.count_if(F.col("side") == "old").alias("o"), F.count_if(F.col("side") == "new").alias("n"))
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    return counts.groupBy("section").agg(F.sum("o").alias("before"), F.sum("n").alias("after"), more("n", "o").alias("added"), more("o", "n").alias("removed"))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions in a folder, oldest first."""
    return [int(name) for name, _, _ in storage.entries(spark, f"{folder}/versions") if name.isdigit()]


def write(spark: SparkSession, document: Document, folder: str, after: int | None = None) -> int:
    """Puts a document in place as the version after `after` (of the newest, unless named), and tells its number.
    All of it is written aside first; one small file, put there last, makes it count, so a reader sees the old
    version or the new one. Older ones stay. Fails if another writer made that version meanwhile."""
    there = versions(spark, folder)
    number = (after if after is not None else there[-1] if there else 0) + 1
    if number in there:
        raise FileExistsError(f"version {number} of {folder} is there")
    data = f"data-{uuid.uuid4().hex}"
    for name, df in document.items():
        df.write.parquet(f"{folder}/{data}/{name}")
    if not storage.put_new(spark, f"{folder}/versions/{number:09d}", data):
        storage.delete(spark, f"{folder}/{data}")
        raise FileExistsError(f"version {number} of {folder} is there")
    return number


def read(spark: SparkSession, folder: str, version: int | None = None) -> Document:
    """A version of the document in a folder; the newest, unless named."""
    there = versions(spark, folder)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"no version {version or ''} in {folder}")
    data = storage.read_text(spark, f"{folder}/versions/{version or there[-1]:09d}")
    return {name: spark.read.parquet(f"{folder}/{data}/{name}") for name in ("meta", *SECTIONS)}


def change(spark: SparkSession, folder: str, new: Document, apply: bool = False) -> DataFrame:
    """The plan from the newest version to `new`; with `apply`, `new` is written first, as the version after it."""
    newest = versions(spark, folder)[-1]
    old = read(spark, folder, newest)
    if apply:
        new = read(spark, folder, write(spark, new, folder, newest))
    return plan(old, new)


def json_lines(document: Document) -> DataFrame:
    """`part`, `place`, `pos`, `line`: the document as JSON, line by line. In the order of the first three columns the
    lines are one JSON text, with the objects of each section in their order."""
    marks = document["meta"].select(F.lit(0).alias("part"), F.lit(0).alias("place"), F.concat(F.lit('{"meta": '), F.to_json(F.struct("*"))).alias("line"))
    rows = []
    for i, name in enumerate(SECTIONS, 1):
        ends = document["meta"].select(F.lit(i).alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit(f', "{name}": [').alias("line")), F.struct(F.lit(2).alias("place"), F.lit("]" if i < len(SECTIONS) else "]}").alias("line")))).alias("m"))
        marks = marks.unionAll(ends.select("part", "m.place", "m.line"))
        df = document[name]
        rows.append(df.select(F.lit(i).alias("part"), F.lit(1).alias("place"), F.col("pos").cast("long").alias("pos"), F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "pos"])).alias("line")))
    objects = reduce(DataFrame.unionAll, rows)
    first = objects.groupBy("part").agg(F.min("pos").alias("first"))  # a row a section
    comma = F.when(F.col("pos") == F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), F.col("line")))
    objects = objects.join(F.broadcast(first), "part").select("part", "place", "pos", comma.alias("line"))
    return objects.unionByName(marks.withColumn("pos", F.lit(0).cast("long")))


def export(document: Document, folder: str) -> None:
    """The JSON text of a document as text files, which are one JSON text when put together by their names."""
    order = ("part", "place", "pos")
    json_lines(document).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(folder)
