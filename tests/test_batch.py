"""Merging of a batch, migration of the old version, erasure, stream."""

import json

import corpus
from colloquy import schemas
from colloquy.operators import batch, build, erase, migrate
from colloquy.sources import files, sinks
from colloquy.streaming import ingest

MODEL = schemas.MODEL


def models(spark, *rows):
    names = MODEL.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MODEL)


INES, MATEO = corpus.INES, corpus.MATEO


def extract_rows(spark, tmp_path):
    """Four talks: one done before, one of beliefs, one of quarrels, one of acquaintances."""
    done, believed, quarrelled, acquainted = (
        {"instances": [{"holder": INES, "title": "old news"}]},
        {"instances": [{"title": "nobody's"}, {"holder": f"{MATEO}  ", "title": "mulch", "category": "growing"}, {"holder": "A Stranger", "title": "gnomes"}, {"holder": MATEO, "title": "slugs"}], "timeline_signal": "mulch bought"},
        {"tensions": [{"from": MATEO, "to": "Gone", "topic": "tea"}, {"from": INES, "to": MATEO, "topic": "tea", "note": "too much"}], "timeline_signal": "tea rationed"},
        {"network_facts": [{"a": "Fernhill", "b": MATEO, "kind": "customer"}, {"a": MATEO, "b": f"Inez ({INES})", "kind": "neighbour"}], "timeline_signal": "fence mended"},
    )
    parts = {"fh-0902": ("2025-09-02", done), "n1": ("2025-12-01", believed), "n2": ("2025-12-08", quarrelled), "n3": ("2025-12-15", acquainted)}
    doc = {"batch": "winter", "meetings": [{"source_id": key, "date": date, "title": key} | part for key, (date, part) in parts.items()]}
    (tmp_path / "extract-winter.json").write_text(json.dumps(doc), encoding="utf-8")
    return files.json_document(spark, f"{tmp_path}/extract-*.json", schemas.EXTRACT)


def test_tasks_of_new_meetings(spark, tmp_path):
    done = spark.createDataFrame([("fh-0902",)], "source_id string")
    met = batch.new_meetings(extract_rows(spark, tmp_path), done).cache()
    assert sorted(r.source_id for r in met.collect()) == ["n1", "n2", "n3"]
    registry = spark.createDataFrame([(INES,), (MATEO,)], "name string")
    known, lost = batch.known_instances(batch.flatten(met, "instances"), registry)
    assert sorted((r.holder, r.title) for r in known.collect()) == [(MATEO, "mulch"), (MATEO, "slugs")]
    assert {r.holder: r["count"] for r in lost.collect()} == {"A Stranger": 1, "<empty>": 1}
    items = batch.tasks(spark.createDataFrame([(MATEO, "growing")], "owner string, category string"), known.selectExpr("holder as owner", "category"))
    assert [tuple(r) for r in batch.needed(items).collect()] == [(f"person-{MATEO}", 2, 1)]
    onto = spark.createDataFrame([((["fh-0902", "fh-0000"],),)], "meta struct<processed_source_ids:array<string>>")
    assert batch.processed_sources(onto, met).count() == 5


def test_pools_of_new_meetings(spark, tmp_path):
    met = batch.new_meetings(extract_rows(spark, tmp_path), spark.createDataFrame([("fh-0902",)], "source_id string")).cache()
    people = spark.createDataFrame([(0, INES), (1, MATEO)], "pos int, name string")
    relations = spark.createDataFrame([(MATEO, INES, "tension", None, "compost", "late")], "from string, to string, type string, direction string, topic string, note string")
    merged = batch.merge_tensions(relations, batch.flatten(met, "tensions"), people).collect()
    assert sorted((r["from"], r.topic, r.note) for r in merged) == [(INES, "tea", "too much (2025-12-08)"), (MATEO, "compost", "late")]
    again = batch.merge_tensions(spark.createDataFrame(merged, relations.schema), batch.flatten(met, "tensions"), people)
    assert again.count() == 2
    network = spark.createDataFrame([], "a string, b string, kind string, since string, note string, source string")
    edges = batch.merge_network(network, batch.flatten(met, "network_facts"), people, "FernHill").collect()
    assert [(r.a, r.b, r.kind, r.source) for r in edges] == [(MATEO, INES, "neighbour", "2025-12-15")]
    timeline = spark.createDataFrame([("2025-12-15", None, "fence mended")], "date string, meeting string, change string")
    assert sorted(r.change for r in batch.merge_timeline(timeline, batch.signals(met)).collect()) == ["fence mended", "mulch bought"]


def test_heavy_owners_are_split_and_small_tasks_folded(spark):
    rows = [("a", "x")] * 25 + [("a", "y")] * 5 + [("a", "z")] * 3 + [("b", "x")] * 30
    items = batch.tasks(spark.createDataFrame([("a", "y")] * 3, "owner string, category string"), spark.createDataFrame(rows, "owner string, category string"))
    got = {r.task_key: (r.instances, r.models) for r in batch.needed(items).collect()}
    assert got == {"a-x": (25, 0), "a-y": (5, 3), "a-기타": (3, 0), "person-b": (30, 0)}


def made(spark, key, *rows):
    """Synthesized models of one task, in their order."""
    kind = schemas.StructType([*MODEL.fields, schemas.StructField("key", schemas.StringType()), schemas.StructField("pos", schemas.IntegerType())])
    return spark.createDataFrame([(*(r.get(n) for n in MODEL.names), key, i) for i, r in enumerate(rows)], kind)


def test_finished_tasks_replace_their_models(spark):
    base = models(spark, *[{"id": i, "title": i.upper(), "holders": [who]} for i, who in (("soil", INES), ("shade", MATEO), ("wind", INES))])
    assigned = spark.createDataFrame([("soil", "finished"), ("wind", "without output")], "id string, key string")
    out = made(
        spark, "finished",
        {"id": "shade", "title": "taken", "holders": [INES]}, {"id": "soil", "title": "free again", "holders": [INES, MATEO]}, {"id": "untitled", "title": "", "holders": [INES]},
        {"id": "unheld", "title": "x", "holders": []}, {"id": "shade", "title": "taken twice", "holders": [MATEO]},
    )
    merged = batch.merge_models(base, assigned, out).cache()
    assert {r.title: (r.id, r.renamed_from) for r in merged.collect()} == {"SHADE": ("shade", None), "WIND": ("wind", None), "free again": ("soil", None), "taken": ("shade-2", "shade"), "taken twice": ("shade-3", "shade")}
    held = batch.models_of_people(spark.createDataFrame([(INES,), (MATEO,), ("Nobody",)], "name string"), merged)
    assert {r.name: r.models for r in held.collect()} == {INES: ["shade-2", "soil", "wind"], MATEO: ["shade", "shade-3", "soil"], "Nobody": []}


def test_subjects_and_changes_of_people(spark):
    known = spark.createDataFrame([(0, "Oak (Quercus)"), (1, "Elm"), (2, "Pine (Elm)")], "pos int, name string")
    about = batch.canonical_about(models(spark, {"id": "m", "about": ["quercus", "Eiche (Quercus)", "elm", "", "Heather"]}), known)
    assert about.first().about == ["Elm", "Heather", "Oak (Quercus)"]
    kind = "person string, date string, note string"
    old = spark.createDataFrame([(MATEO, "2025-09-02", "hired")], kind)
    new = spark.createDataFrame([(MATEO, None, "trained"), (MATEO, "2025-09-02", "hired"), (MATEO, "2025-10-01", ""), ("", "2025-10-01", "x")], kind)
    assert sorted((r.date, r.note) for r in batch.merge_evolution(old, new).collect()) == [("", "trained"), ("2025-09-02", "hired")]


#: Version 1: people and firms alike, links from either side, meetings without their source.
OLD = {
    "people": [{"name": corpus.TARN, "evidence": "high", "models": ["prices", "yews"]}, {"name": f"Nessa({INES})", "evidence": "mid", "models": ["rain"]}],
    "models": [
        {"id": "prices", "title": "Prices", "evidence": "high"},
        {"id": "yews", "title": "Yews", "evidence": "high", "people": ["ines okafor"]},
        {"id": "rain", "title": "Rain", "evidence": "low", "people": [corpus.TARN], "about": ["weather"]},
    ],
    "meetings": [{"id": "t1", "date": "2025-10-06", "title": "Yews, and hedges"}, {"id": "t2", "date": "2025-10-07", "title": "Yews and hedges"}, {"id": "t3", "date": "2025-10-06", "title": "Yews and hedges", "source_id": "own", "path": "own.md"}],
}


def test_migration(spark, tmp_path):
    corpus.write(tmp_path, OLD)
    onto = files.json_document(spark, f"{tmp_path}/_ontology/objects.json", schemas.ONTOLOGY).drop(files.CORRUPT)
    registry = files.json_document(spark, f"{tmp_path}/_meta/speakers.json", schemas.REGISTRY)
    catalog = spark.createDataFrame([(0, "2025-10-06", "telephone", "far", "far.md"), (1, "2025-10-06", "Yews and hedges", "near", "near.md")], "pos int, date string, title string, source_id string, path string")
    out = migrate.migrated(onto, registry, catalog)
    head = f"Nessa({INES})"
    assert {r.name: (r.type, r.evidence, r.models) for r in out["people"].collect()} == {head: ("person", "mid", ["rain", "yews"]), corpus.TARN: ("org", "mid", ["prices"])}
    assert {r.id: (r.holders, r.about, r.evidence) for r in out["models"].collect()} == {
        "prices": ([corpus.TARN], [], "mid"),
        "yews": ([head], [corpus.TARN], "high"),
        "rain": ([head], [corpus.TARN, "weather"], "low"),
    }
    assert {r.id: r.source_id for r in out["meetings"].collect()} == {"t1": "near", "t2": None, "t3": "own"}
    corpus.write(tmp_path)
    assert migrate.migrated(files.json_document(spark, f"{tmp_path}/_ontology/objects.json", schemas.ONTOLOGY), registry, catalog) is None


def test_old_version_builds_with_both_link_directions(spark, tmp_path):
    old = {"people": [{"name": corpus.TARN, "type": "org", "models": ["moss"]}, {"name": INES, "models": ["moss"]}], "models": [{"id": "moss", "title": "first", "people": [MATEO]}, {"id": "moss", "title": "second", "people": [MATEO]}]}
    out = build.build(spark, corpus.write(tmp_path, old))
    assert sorted(r.person for r in out["model_people"].collect()) == [INES, MATEO]
    assert [r.entity for r in out["model_about"].collect()] == [corpus.TARN] and [r.title for r in out["models"].collect()] == ["second"]


def test_erasure(spark, tmp_path):
    folder = corpus.write(tmp_path)
    registry = files.json_document(spark, f"{folder}/_meta/speakers.json", schemas.REGISTRY).drop(files.CORRUPT)
    names = erase.tokens(MATEO, registry)
    assert names == [MATEO, "Matti"]
    found = {r.path: r for r in erase.erase_transcripts(files.transcripts(spark, folder).filter("readable"), names).collect()}
    told = {corpus.path(talk): sum(corpus.render(talk).count(n) for n in names) for talk in corpus.TALKS}
    assert {p: r.mentions for p, r in found.items()} == told
    assert not any(n in r.content for r in found.values() for n in names)
    assert all("**[(삭제)] (0:01)" in found[corpus.path(talk)].content for talk in corpus.TALKS if talk.slug.startswith("stocktaking"))
    built = build.build(spark, folder)
    before = {n: built[n] for n in schemas.TABLES}
    after = erase.erase_tables(before, MATEO, names)
    assert erase.residual(after, names).count() == 0 < erase.residual(before, names).count()
    assert {r.id for r in after["models"].collect()} == {"water-early", "peat-free"} and after["relations"].count() == 0
    assert {r.table: (r.before, r.after) for r in erase.impact({"people": before["people"]}, {"people": after["people"]}).collect()} == {"people": (4, 3)}
    people = spark.createDataFrame([(MATEO, "x", ""), ("Jo", MATEO, MATEO), ("Al", INES, "")], "name string, manager string, intro_by string")
    assert sorted(tuple(r) for r in erase.erase_registry(people, MATEO).collect()) == [("Al", INES, ""), ("Jo", "", "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "l1"), ("p", 2, "l2")], "person string, ord int, line string")
    sinks.write_lines(df, f"{tmp_path}/lines", "person")
    assert [r.value for r in spark.read.text(f"{tmp_path}/lines/person=p").collect()] == ["l1", "l2"]
    assert sinks.write_json(df, f"{tmp_path}/json", apply=False).count() == 2 and not (tmp_path / "json").exists()
    sinks.write_json(df, f"{tmp_path}/json")
    assert sinks.backup(spark, f"{tmp_path}/json").endswith("json.bak1") and sinks.backup(spark, f"{tmp_path}/json").endswith("json.bak2")
    assert sinks.backup(spark, f"{tmp_path}/none") is None
    sinks.register({"some_lines": df})
    assert spark.sql("SELECT count(*) AS n FROM some_lines").first().n == 2


def test_other_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"items": [{"type": "outline", "text": "x"}, {"type": "transaction", "speaker": "a", "start": 3723000, "text": "hi"}]}), encoding="utf-8")
    assert [tuple(r) for r in files.recorder_items(spark, f"{tmp_path}/r.json", schemas.RECORDER).collect()] == [(1, "a", "1:02:03", "hi")]
    (tmp_path / "w.json").write_text(json.dumps({"id": "f", "segments": [{"start": 65.4, "text": " yes"}]}), encoding="utf-8")
    assert [tuple(r) for r in files.speech_segments(spark, f"{tmp_path}/w.json").collect()] == [("f", 0, "1:05", "yes")]


def test_stream_equals_batch(spark, tmp_path):
    folder = corpus.write(tmp_path / "c")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(spark, f"{folder}/transcripts", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == build.build(spark, folder)["utterances"].count() == len(corpus.SAID)
