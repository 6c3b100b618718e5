"""Documents as sections: merged, migrated, erased from, compared, put in place as versions, exported."""

import json

import corpus
import pytest
from colloquy import schemas
from colloquy.operators import document as doc
from colloquy.operators import erase
from colloquy.sources import files

INES, MATEO, PRIYA, TARN = corpus.INES, corpus.MATEO, corpus.PRIYA, corpus.TARN


def opened(spark, folder):
    return files.json_document(spark, f"{folder}/_ontology/objects.json", schemas.ONTOLOGY).drop(files.CORRUPT)


def exported(document, folder):
    doc.export(document, str(folder))
    return json.loads("".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*"))))


def without_nulls(x):
    return {k: without_nulls(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [without_nulls(v) for v in x] if isinstance(x, list) else x


@pytest.fixture
def start(spark, tmp_path):
    return doc.sections(opened(spark, corpus.write(tmp_path / "corpus")))


def test_export_gives_the_document_back(spark, start, tmp_path):
    assert exported(start, tmp_path / "out") == without_nulls(corpus.ONTOLOGY)
    nothing = doc.sections(spark.createDataFrame([({},)], "meta struct<title:string>").select("meta", *[doc.F.lit(None).cast(schemas.ONTOLOGY[n].dataType).alias(n) for n in doc.SECTIONS]))
    assert exported(nothing, tmp_path / "none") == {"meta": {}} | {n: [] for n in doc.SECTIONS}


def test_versions(spark, start, tmp_path):
    folder = f"{tmp_path}/kept"
    with pytest.raises(FileNotFoundError):
        doc.read(spark, folder)
    assert doc.write(spark, start, folder) == 1
    fewer = start | {"risks": start["risks"].filter("level = 'high'"), "bets": start["bets"].withColumn("status", doc.F.lit("x"))}
    told = {r.section: (r.before, r.after, r.added, r.removed) for r in doc.change(spark, folder, fewer).collect()}
    assert doc.versions(spark, folder) == [1]
    assert {n: v for n, v in told.items() if v[2:] != (0, 0)} == {"risks": (2, 1, 0, 1), "bets": (2, 2, 2, 2)}
    assert {r.section: (r.before, r.after, r.added, r.removed) for r in doc.change(spark, folder, fewer, apply=True).collect()} == told
    assert doc.versions(spark, folder) == [1, 2]
    assert [doc.read(spark, folder, v)["risks"].count() for v in (1, 2, None)] == [2, 1, 1]
    with pytest.raises(FileExistsError):
        doc.write(spark, start, folder, after=1)
    assert exported(doc.read(spark, folder, 1), tmp_path / "first") == without_nulls(corpus.ONTOLOGY)


def test_merge(spark, start, tmp_path):
    registry = spark.createDataFrame([(0, INES), (1, "Nina (Priya Raman)")], "pos int, name string")
    assigned = spark.createDataFrame([("peat-free", "done"), ("label-all", "failed")], "id string, key string")
    out = {
        "key": "done",
        "models": [{"id": "no-peat", "title": "No peat at all", "holders": [INES], "about": ["priya raman", "tarn nursery", ""]}, {"id": "water-early", "title": "Again", "holders": [MATEO]}, {"id": "x", "title": "", "holders": [INES]}],
        "evolution": [{"person": INES, "date": "2025-12-02", "note": "later"}, {"person": INES, "date": "2025-12-01", "note": "earlier"}, {"person": INES, "note": ""}, {"person": "Gone", "note": "x"}],
    }
    syntheses = spark.createDataFrame([out], schemas.SYNTHESIS)
    kind = "`from` string, `to` string, topic string, note string, direction string, mtg_date string"
    pools = {
        "tensions": spark.createDataFrame([(MATEO, INES, "compost", "again", None, "2025-12-01"), (INES, MATEO, "tea", "strong", "one-way", "2025-12-01"), (INES, "Gone", "tea", "", None, "")], kind),
        "network": spark.createDataFrame([("Fernhill", INES, "customer", "", ""), ("nina", "tarn nursery", "friend", "old", "2025-12-01")], "a string, b string, kind string, note string, mtg_date string"),
        "timeline": spark.createDataFrame([("2025-08-01", "peat bought"), ("2025-12-02", "b"), ("2025-12-01", "a"), ("2025-12-30", "c")], "date string, signal string"),
    }
    new = doc.merged(start, registry, assigned, syntheses, pools, spark.createDataFrame([("n2",), ("n1",), ("",)], "source_id string"))
    got = exported(new, tmp_path / "merged")
    assert [(m["id"], m.get("about")) for m in got["models"]] == [("water-early", [TARN]), ("label-all", None), ("no-peat", ["Nina (Priya Raman)", TARN]), ("water-early-2", [])]
    assert [m.get("count") for m in got["models"]] == [2, None, 1, 1]
    assert [(p["name"], p["models"]) for p in got["people"]] == [(INES, ["no-peat", "water-early"]), (MATEO, ["label-all", "water-early-2"]), (TARN, [])]
    assert [p.get("evolution") for p in got["people"]] == [[{"date": "2025-12-01", "note": "earlier"}, {"date": "2025-12-02", "note": "later"}], None, None]
    assert got["relations"] == [*corpus.ONTOLOGY["relations"], {"from": INES, "to": MATEO, "type": "tension", "direction": "one-way", "topic": "tea", "note": "strong (2025-12-01)"}]
    assert got["network"] == [*corpus.ONTOLOGY["network"], {"a": "Nina (Priya Raman)", "b": TARN, "kind": "friend", "note": "old", "source": "2025-12-01"}]
    assert [(x["date"], x["change"]) for x in got["timeline"]] == [("2025-08-01", "peat bought"), ("2025-09-02", "peat given up"), ("2025-12-01", "a"), ("2025-12-30", "c")]
    assert got["meta"] == corpus.ONTOLOGY["meta"] | {"date_range": "2025-08-01 ~ 2025-12-30", "processed_source_ids": ["fh-0902", "n1", "n2"]}
    # The same batch once more changes nothing but what synthesis makes anew.
    again = doc.merged(new, registry, assigned.limit(0), syntheses.limit(0), pools)
    assert [(r.section, r.added, r.removed) for r in doc.plan(new, again).filter("added + removed > 0").collect()] == []


def test_migration(spark, tmp_path):
    old = {"meta": {"org": "Fernhill"}, "people": [{"name": TARN, "evidence": "high", "models": ["prices"]}, {"name": f"Nessa({INES})", "models": []}], "models": [{"id": "prices", "title": "Prices", "people": ["ines okafor"]}], "timeline": [{"date": "2025-01-01", "change": "x"}]}
    folder = corpus.write(tmp_path / "corpus", old)
    registry = files.json_document(spark, f"{folder}/_meta/speakers.json", schemas.REGISTRY)
    catalog = spark.createDataFrame([], "pos int, date string, title string, source_id string, path string")
    new = doc.migrated(opened(spark, folder), registry, catalog)
    assert doc.write(spark, doc.sections(opened(spark, folder)), f"{tmp_path}/kept") == 1
    doc.change(spark, f"{tmp_path}/kept", new, apply=True)
    got = exported(doc.read(spark, f"{tmp_path}/kept"), tmp_path / "out")
    assert got["meta"] == {"org": "Fernhill", "schema_version": 2} and got["timeline"] == old["timeline"]
    assert [(p["name"], p["type"], p["models"]) for p in got["people"]] == [(TARN, "org", []), (f"Nessa({INES})", "person", ["prices"])]
    assert [(m["id"], m["holders"], m["about"]) for m in got["models"]] == [("prices", [f"Nessa({INES})"], [TARN])]
    corpus.write(tmp_path / "corpus", got)
    assert doc.migrated(opened(spark, folder), registry, catalog) is None


def test_erasure(spark, start, tmp_path):
    more = start["people"].filter(doc.F.col("name") == INES).withColumn("evolution", doc.F.from_json(doc.F.lit(json.dumps([{"date": "2025-01-01", "note": f"taught {MATEO}"}])), schemas.ONTOLOGY["people"].dataType.elementType["evolution"].dataType)).withColumn("models", doc.F.array(doc.F.lit("label-all"), doc.F.lit("peat-free")))
    start = start | {"people": more.unionByName(start["people"].filter(doc.F.col("name") != INES))}
    # A model that two hold, one of them with blanks round the name, and one that nobody holds.
    held = start["models"].filter("id = 'peat-free'").withColumn("holders", doc.F.array(doc.F.lit(f" {MATEO} "), doc.F.lit(INES)))
    nobodys = start["models"].filter("id = 'peat-free'").withColumns({"id": doc.F.lit("old"), "pos": doc.F.lit(9), "holders": doc.F.array().cast("array<string>"), "related": doc.F.array(doc.F.lit("old"), doc.F.lit("label-all"), doc.F.lit("peat-free"))})
    start = start | {"models": start["models"].filter("id <> 'peat-free'").unionByName(held).unionByName(nobodys)}
    got = exported(doc.erased(start, MATEO, [MATEO, "Matti"]), tmp_path / "out")
    assert [p["name"] for p in got["people"]] == [INES, TARN] and got["people"][0]["models"] == ["peat-free"]
    assert got["people"][0]["evolution"] == [{"date": "2025-01-01", "note": f"taught {erase.MASK}"}]
    assert [(m["id"], m["holders"]) for m in got["models"]] == [("water-early", [INES]), ("peat-free", [INES]), ("old", [])] and got["models"][2]["related"] == ["old", "peat-free"]
    assert got["relations"] == got["network"] == []
    assert MATEO not in json.dumps(got, ensure_ascii=False)
    assert got["models"][0] == corpus.ONTOLOGY["models"][0] and got["bets"] == corpus.ONTOLOGY["bets"]
