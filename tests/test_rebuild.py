"""A store after any edits gives the tables of a full build, and reads only what was edited."""

import os
import time

import pytest

import corpus
from colloquy.operators import build, rebuild
from colloquy.sources import files


def same_tables(spark, folder, store, names=("meetings", "utterances")):
    full, kept = build.build(spark, folder), store.tables(*build.documents(spark, folder))
    assert set(full) == set(kept)
    for name in names:
        df = full[name]
        assert set(kept[name].columns) == set(df.columns), name
        key = lambda rows: sorted(str(tuple(r)) for r in rows)
        assert key(kept[name].select(*df.columns).collect()) == key(df.collect()), name


def edit(folder, name, text, when):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    os.utime(f"{folder}/{name}", (when, when))


def test_equal_to_a_full_build(spark, tmp_path):
    folder = corpus.write(tmp_path / "corpus")
    store = rebuild.Store(spark, str(tmp_path / "store"))
    # One of them is unreadable.
    assert store.update_from(folder) == {"new": len(corpus.TALKS) + 1, "changed": 0, "touched": 0, "vanished": 0}

    # Nothing edited: no version, no file opened.
    assert store.update_from(folder) == dict.fromkeys(("new", "changed", "touched", "vanished"), 0) and store.version == 1

    # A new file before all others renumbers them; one changes, one is only touched, one goes, the unreadable one is mended.
    first, second, third, *_ = corpus.TALKS
    later = time.time() + 60
    edit(folder, "transcripts/2025/0000.md", corpus.render(second), later)
    edit(folder, corpus.path(first), corpus.render(first).replace("late again", "early for once"), later)
    edit(folder, corpus.path(second), corpus.render(second), later)
    edit(folder, "transcripts/2025/unreadable.md", corpus.render(third), later)
    os.remove(f"{folder}/{corpus.path(third)}")
    assert store.update_from(folder) == {"new": 1, "changed": 2, "touched": 1, "vanished": 1} and store.version == 2
    same_tables(spark, folder, store, ("meetings", "utterances", "commitments", "person_meetings", "discarded", "person_aliases"))
    made = spark.read.parquet(f"{store.folder}/{store.facts['generations'][-1]}/talks")
    assert sorted(r.path for r in made.collect()) == sorted(["transcripts/2025/0000.md", corpus.path(first), "transcripts/2025/unreadable.md"])

    # Another opens the same store; joined generations give the same.
    again = rebuild.Store(spark, store.folder)
    again.compact()
    assert len(again.facts["generations"]) == 1 and again.version == 3
    same_tables(spark, folder, again)
    # The first is behind now: its write is refused and nothing changes.
    os.remove(f"{folder}/{corpus.path(second)}")
    with pytest.raises(FileExistsError):
        store.update_from(folder)
    assert rebuild.Store(spark, store.folder).update_from(folder)["vanished"] == 1


def test_only_edited_files_are_opened(spark, tmp_path):
    folder = corpus.write(tmp_path / "corpus")
    for root, _, names in os.walk(folder):
        for name in names:
            os.utime(f"{root}/{name}", (1_000_000_000, 1_000_000_000))
    store = rebuild.Store(spark, str(tmp_path / "store"))
    store.update_from(folder)
    talk = corpus.TALKS[0]
    edit(folder, corpus.path(talk), corpus.render(talk) + "\nmore\n", 1_100_000_000)
    opened = []

    def contents(since):
        found = files.contents_since(spark, folder, since)
        opened.extend(r.path for r in found.collect())
        assert "GreaterThanOrEqual(modificationTime" in found._jdf.queryExecution().executedPlan().toString()
        return found

    assert store.update(files.listing(spark, folder), contents)["changed"] == 1
    assert opened == [corpus.path(talk)]


def test_empty(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    store = rebuild.Store(spark, str(tmp_path / "store"))
    assert sum(store.update_from(str(tmp_path / "corpus")).values()) == 0
    tables = store.tables(*build.documents(spark, str(tmp_path / "corpus")))
    assert tables["utterances"].count() == 0 and tables["meetings"].count() == 0
    # All files vanish.
    folder = corpus.write(tmp_path / "other")
    full = rebuild.Store(spark, str(tmp_path / "full"))
    full.update_from(folder)
    for talk in corpus.TALKS:
        os.remove(f"{folder}/{corpus.path(talk)}")
    assert full.update_from(folder)["vanished"] == len(corpus.TALKS)
    assert full.tables(*build.documents(spark, folder))["utterances"].count() == 0


def test_generations_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rebuild, "MOST_GENERATIONS", 2)
    folder = corpus.write(tmp_path / "corpus")
    store = rebuild.Store(spark, str(tmp_path / "store"))
    store.update_from(folder)
    talk = corpus.TALKS[0]
    for i in range(2):
        edit(folder, corpus.path(talk), corpus.render(talk) + f"\n**Ines (9:{i}0)** once more\n", time.time() + 60 * (i + 1))
        store.update_from(folder)
    assert len(store.facts["generations"]) == 1
    same_tables(spark, folder, store)
