"""One planted fault for each rule; the sound corpus has none of its errors."""

import pytest

import corpus
from colloquy import schemas
from colloquy.operators import build, grounding, validate
from colloquy.sources import files


def findings(spark, folder, ontology):
    corpus.write(folder, ontology)
    onto = files.json_document(spark, f"{folder}/_ontology/objects.json", schemas.ONTOLOGY).drop(files.CORRUPT)
    registry = files.json_document(spark, f"{folder}/_meta/speakers.json", schemas.REGISTRY).drop(files.CORRUPT)
    tables = build.build(spark, str(folder))
    paths = files.transcripts(spark, str(folder)).select("path")
    found = validate.validate(onto, registry, tables["meetings"].select("source_id"), paths, tables).cache()
    return found, tables


@pytest.fixture(scope="module")
def bad(spark, tmp_path_factory):
    return findings(spark, tmp_path_factory.mktemp("bad"), corpus.faulty())[0]


def test_sound_corpus(spark, tmp_path):
    found, _ = findings(spark, tmp_path, corpus.ONTOLOGY)
    assert found.filter("severity = 'E'").collect() == []
    rules = {(r.rule, r.severity): r.message for r in found.collect()}
    named = sum(x.kind == "canonical" for _, x in corpus.SAID)
    assert rules["V24", "I"] == "1/1 quotes are grounded" and ("V22", "I") in rules and rules["V26", "I"].startswith(f"{100 * named / len(corpus.SAID):.1f}% of {len(corpus.SAID)}")
    assert validate.verdict(found).first().passed
    assert {r.key for r in found.filter("rule = 'V28'").collect()} == {corpus.path(talk) for talk in corpus.TALKS if not talk.lines}
    # The manager is given by an alias, which the plain check does not resolve.
    assert {r.key for r in found.filter("rule = 'V15'").collect()} == {corpus.MATEO}


@pytest.mark.parametrize(("rule", "severity", "key"), [f for entries in corpus.FAULTS.values() for _, found in entries for f in found])
def test_each_fault_is_found(bad, rule, severity, key):
    assert key in {r.key for r in bad.filter(f"rule = '{rule}' and severity = '{severity}'").collect()}


def test_version_1_and_missing_parts(spark):
    onto = spark.createDataFrame([(None,) * len(schemas.ONTOLOGY)], schemas.ONTOLOGY)
    rules = {(r.rule, r.key) for r in validate.structure(onto).collect()}
    assert {("V1", "meta"), ("V1", "people"), ("V1", "models"), ("V29", "meta")} <= rules


def test_old_tables(spark, tmp_path):
    _, tables = findings(spark, tmp_path, corpus.ONTOLOGY)
    assert validate.database(tables, 1.0, 2.0).filter("rule = 'V23'").count() == 1
    assert validate.database(tables, 2.0, 1.0).filter("rule = 'V23'").count() == 0


def test_frequent_characters_hide_a_verbatim_quote(spark):
    said = "가나다라 마바사아 자차카타 " * 40 + "다른말"
    utterances = spark.createDataFrame([(1, "", said)], "utt_id long, speaker string, text string")
    models = spark.createDataFrame([("m", "자차카타 가나다라 마바사아")], "id string, quote string")
    score = lambda junk: grounding.ground_quotes(models, utterances, junk).first().score
    assert score(False) == 1.0 and score(True) < 1.0
