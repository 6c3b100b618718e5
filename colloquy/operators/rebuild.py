"""Rebuild after an edit: only new and changed transcripts are read and parsed again.

A store keeps what parsing made of each transcript, under its path, and a manifest of the files it was made of. What
was parsed at one time is a generation: Parquet files that are never changed. The manifest tells for every file its
digest and the generation that has its rows; rows of any other generation are dead. A version is one small file that
names a manifest and its generations. It is put in place last, so readers see the old tables or the new ones, and a
writer that dies leaves nothing that counts. Numbers and people's names depend on all files and on the registry: they
are given when tables are read, so these equal a full build's whatever the order of edits.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, storage
from . import build, parse

MANIFEST = "path string, modified timestamp, length long, digest string, generation string"
#: Generations that a version has before they are joined.
MOST_GENERATIONS = 16


def parsed(transcripts: DataFrame) -> dict[str, DataFrame]:
    """What each transcript says for itself, by `path`: no numbers, no resolved names."""
    talks = parse.meetings(transcripts, numbered=False)
    lines = parse.lines(talks, "path")
    return {
        "talks": talks.drop("body"),
        "said": parse.utterances(lines, "path"),
        "promised": parse.commitments(lines, "path"),
        "discarded": parse.discarded(lines, "path"),
    }


class Store:
    """The parsed transcripts in a folder. Without a version it is empty."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        there = [name for name, *_ in storage.entries(spark, f"{self.folder}/versions") if name.isdigit()]
        self.version = int(max(there)) if there else 0
        self.facts = json.loads(storage.read_text(spark, f"{self.folder}/versions/{max(there)}")) if there else {"manifest": None, "generations": []}

    def manifest(self) -> DataFrame:
        """`path`, `modified`, `length`, `digest`, `generation` of each file, unreadable ones too."""
        if not self.facts["manifest"]:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/{self.facts['manifest']}")

    def plan(self, listing: DataFrame) -> DataFrame:
        """`path`, `change` ("new", "changed", "vanished") and `modified` of the files of `listing` (`path`, `modified`,
        `length`) that are not as the manifest has them. Whether a touched file says anything else is known when it
        is read. A file that changed but kept both time and length is not noticed."""
        old = self.manifest().select("path", F.col("modified").alias("m"), F.col("length").alias("n"))
        both = listing.select("path", "modified", "length").join(old, "path", "full_outer")
        change = F.when(F.col("n").isNull(), "new").when(F.col("length").isNull(), "vanished").when((F.col("modified") != F.col("m")) | (F.col("length") != F.col("n")), "changed")
        return both.select("path", change.alias("change"), "modified").filter("change is not null")

    def update(self, listing: DataFrame, contents_since: Callable[[datetime], DataFrame]) -> dict[str, int]:
        """Brings the store to the files of `listing`, as the next version, and tells how many files are new, changed,
        touched (another time, the same bytes) and vanished; without any, no version is made.
        `contents_since(time)` gives `path`, `content`, `readable`, `digest` of files modified from then on: those to be
        read are taken from it, so bytes read grow with what was modified since the oldest of them.
        Fails if another writer made that version meanwhile."""
        plan, aside = storage.materialize(self.plan(listing), "rebuild-plan")
        found = {r.change: r.n for r in plan.groupBy("change").agg(F.count("*").alias("n")).collect()}
        counts = {"new": found.get("new", 0), "changed": 0, "touched": 0, "vanished": found.get("vanished", 0)}
        leftover = [aside]
        if found:
            old = self.manifest()
            kept = old.join(plan, "path", "left_anti")
            generations = list(self.facts["generations"])
            wanted = plan.filter("change <> 'vanished'")
            since = wanted.agg(F.min("modified").alias("t")).first().t
            if since is not None:
                known = old.select("path", F.col("digest").alias("known"), F.col("generation").alias("was"))
                texts = contents_since(since).join(wanted.select("path"), "path", "left_semi").join(known, "path", "left")
                same = F.coalesce(F.col("digest") == F.col("known"), F.lit(False))
                texts, path = storage.materialize(texts.withColumn("same", same), "rebuild-texts")
                leftover.append(path)
                counts["touched"] = texts.filter("same").count()
                counts["changed"] = found.get("changed", 0) - counts["touched"]
                generation = self._write(parsed(texts.filter("not same").select("path", "content", "readable")))
                generations.append(generation)
                stamp = listing.select("path", "modified", "length")
                fresh = texts.select("path", "digest", F.when(F.col("same"), F.col("was")).otherwise(generation).alias("generation")).join(stamp, "path")
                kept = kept.unionByName(fresh)
            self._publish(kept, generations)
        for path in leftover:
            storage.delete(self.spark, path)
        if len(self.facts["generations"]) > MOST_GENERATIONS:
            self.compact()
        return counts

    def update_from(self, corpus: str) -> dict[str, int]:
        """`update` to a corpus folder."""
        return self.update(files.listing(self.spark, corpus), lambda since: files.contents_since(self.spark, corpus, since))

    def compact(self) -> None:
        """All rows that count as one generation. Older versions keep theirs."""
        generation = self._write({kind: self._live(kind, self.manifest()) for kind in ("talks", "said", "promised", "discarded")})
        self._publish(self.manifest().withColumn("generation", F.lit(generation)), [generation])

    def _write(self, parts: dict[str, DataFrame]) -> str:
        generation = f"generation-{uuid.uuid4().hex}"
        for kind, df in parts.items():
            df.withColumn("generation", F.lit(generation)).write.parquet(f"{self.folder}/{generation}/{kind}")
        return generation

    def _publish(self, manifest: DataFrame, generations: list[str]) -> None:
        facts = {"manifest": f"manifest-{uuid.uuid4().hex}", "generations": generations}
        manifest.write.parquet(f"{self.folder}/{facts['manifest']}")
        if not storage.put_new(self.spark, f"{self.folder}/versions/{self.version + 1:09d}", json.dumps(facts)):
            raise FileExistsError(f"version {self.version + 1} of {self.folder} is there")
        self.version, self.facts = self.version + 1, facts

    def _live(self, kind: str, owners: DataFrame) -> DataFrame:
        """Rows of a kind that count, with what else `owners` (`path`, `generation`) has."""
        rows = self.spark.read.parquet(*[f"{self.folder}/{g}/{kind}" for g in self.facts["generations"]])
        more = [c for c in owners.columns if c not in ("modified", "length", "digest")]
        return rows.join(owners.select(*more), ["path", "generation"]).drop("generation")

    def parts(self) -> dict[str, DataFrame]:
        """`talks`, `said`, `promised`, `discarded`, all with `path` and `rowid`, which numbers readable files by path."""
        if not self.facts["generations"]:
            nothing = parsed(self.spark.createDataFrame([], "path string, content string, readable boolean"))
            return {kind: df.withColumn("rowid", F.lit(None).cast("long")) for kind, df in nothing.items()}
        talks = self._live("talks", self.manifest())
        numbers = parse.number_rows(talks.select("path"), "path", "rowid").join(self.manifest().select("path", "generation"), "path")
        return {kind: self._live(kind, numbers) for kind in ("talks", "said", "promised", "discarded")}

    def tables(self, onto: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
        """The tables of `build.build_tables` of the same files."""
        parts = self.parts()
        out = build.resolved(parts["talks"], parts["said"], parts["promised"], onto, registry)
        out["discarded"] = parts["discarded"]
        return out


def rebuild(spark: SparkSession, corpus: str, folder: str) -> dict[str, DataFrame]:
    """The tables of a corpus folder, by a store in `folder` that is brought to it first."""
    store = Store(spark, folder)
    store.update_from(corpus)
    return store.tables(*build.documents(spark, corpus))
