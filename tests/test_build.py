"""Corpus to tables, and the questions over them."""

import pytest
from pyspark.sql import functions as F

import corpus
from colloquy import schemas
from colloquy.functions import text as t
from colloquy.operators import build, grounding, parse, report, search
from colloquy.plans import recipes
from colloquy.sources import files, sinks


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    out = build.build(spark, corpus.write(folder))
    saved = str(tmp_path_factory.mktemp("tables"))
    sinks.save_tables(out, saved)
    return sinks.load_tables(spark, saved, list(out))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_utterances(tables):
    paths = {r.rowid: r.path for r in tables["meetings"].collect()}
    assert paths == {i: corpus.path(talk) for i, talk in enumerate(corpus.TALKS, 1)}
    said = tables["utterances"].orderBy("utt_id").collect()
    assert [(u.meeting_rowid, u.speaker, u.ts, u.text, u.kind) for u in said] == [(i, x.speaker, x.ts, x.text.replace("\n", " "), x.kind) for i, x in corpus.SAID]


def test_commitments_and_meetings(tables):
    assert rows(tables["commitments"], "done", "from_person", "to_person", "due") == [(0, corpus.MATEO, corpus.INES, "2025-09-09"), (1, corpus.INES, corpus.PRIYA, "")]
    met = {r.path.rpartition("/")[2][11:-3]: r for r in tables["meetings"].collect()}
    assert (met["seed-bank"].duration_min, met["telephone"].duration_min) == (45, None)
    kinds = {"seed-bank": "내부-전략", "walk": "외부-파트너", "telephone": "개인-통화", "lecture-b": "강연-세미나", "stocktaking-1": "기타", "import": "내부-전략"}
    assert {k: met[k].category for k in kinds} == kinds and met["stocktaking-1"].category_raw == "unheard of"
    lectures = sorted(corpus.path(talk) for talk in corpus.TALKS if talk.slug.startswith("lecture"))
    assert [r.paths for r in grounding.duplicate_sources(tables["meetings"]).collect()] == [lectures]
    lost = {r.rowid: (r.lost_lines, r.continuations, r.empty_headers) for r in tables["discarded"].collect()}
    assert lost[met["walk"].rowid] == (0, 0, 1) and lost[met["lecture-a"].rowid] == (0, 1, 0) and lost[met["seed-bank"].rowid] == (1, 0, 0)


def test_people_edges_and_aliases(tables):
    people = {r.name: r for r in tables["people"].collect()}
    apprentice = people[corpus.MATEO]
    assert (apprentice.tier, apprentice.relationship, apprentice.team, apprentice.evidence) == ("core", "apprentice", "Collections", "mid")
    assert set(people) == {corpus.INES, corpus.MATEO, corpus.PRIYA, corpus.TARN}
    assert rows(tables["network"], "a", "b", "kind", "note") == [(corpus.MATEO, corpus.INES, "보고", "Collections"), (corpus.PRIYA, corpus.MATEO, "소개", "cousins")]
    aliases = {r.alias: r.canonical for r in tables["person_aliases"].collect()}
    assert (aliases["nessa"], aliases["matti"], aliases["priya raman"]) == (corpus.INES, corpus.MATEO, corpus.PRIYA)
    met = {(r.person, r.meeting_rowid): r.src for r in tables["person_meetings"].collect()}
    spoke = {(x.speaker, i) for i, x in corpus.SAID if x.kind in ("canonical", "raw-name")}
    listed = {(name, i) for i, talk in enumerate(corpus.TALKS, 1) if "participants" in talk.head for name in (corpus.INES, corpus.MATEO)}
    of_people = {k: src for k, src in met.items() if not k[0].startswith("화자")}
    assert of_people == dict.fromkeys(listed, "participant") | dict.fromkeys(spoke, "speaker")
    assert rows(tables["bets"].filter("tag = 'now'"), "source") == [("t1, t4",)]


def test_ambiguous_alias_is_dropped_for_all(spark, tmp_path):
    registry = [{"name": "Rowan Ash", "aliases": ["Ro", "Ashy"]}, {"name": "Rosalind Birch", "aliases": ["RO"]}]
    out = build.build(spark, corpus.write(tmp_path, registry=registry))
    aliases = {r.alias for r in out["person_aliases"].collect()}
    assert "ro" not in aliases and {"ashy", "rosalind birch"} <= aliases
    assert [tuple(r) for r in out["aliases_dropped"].collect()] == [("ro", ["Rosalind Birch", "Rowan Ash"])]


def test_absent_and_broken_documents(spark, tmp_path):
    out = build.build(spark, str(tmp_path))
    assert all(out[n].count() == 0 for n in ("people", "meetings", "utterances", "network"))
    (tmp_path / "_meta").mkdir()
    (tmp_path / "_meta" / "speakers.json").write_text("{broken", encoding="utf-8")
    doc = files.json_document(spark, f"{tmp_path}/_meta/speakers.json", schemas.REGISTRY)
    assert doc.filter(F.col(files.CORRUPT).isNotNull()).cache().count() == 1
    assert build.build(spark, str(tmp_path))["people"].count() == 0


def test_line_shapes(spark):
    cases = [
        ("**A** (0:01) x **B (0:02)** y", 1, "A** (0:01) x **B", "0:02", "y"),
        ("**(0:07)** only", 1, "", "0:07", "only"),
        ("**A B** (시간: 0:01): text", 2, "A B", "0:01", "text"),
        ("(1:02:03) t", 4, "", "1:02:03", "t"),
        ("[0:01]: t", 3, "", "0:01", "t"),
        ("0:01 no", None, None, None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "line string").coalesce(1).select(parse.spoken(F.col("line")).alias("s"))
    assert [(None,) * 4 if r.s is None else tuple(r.s) for r in df.collect()] == [c[1:] for c in cases]


def test_frontmatter(spark):
    text = '---\ntitle: "a"\ntitle: b\nnot a line\nlist: [x, "y z", ]\n키: 값\n---\nbody\n---\n'
    r = spark.createDataFrame([(text,)], "c string").select(parse.frontmatter(F.col("c")).alias("fm"), parse.body(F.col("c")).alias("b"), parse.value_list(F.lit('[x, "y z", ]')).alias("l")).first()
    assert r.fm == {"title": "b", "list": '[x, "y z", ]', "키": "값"} and r.b == "body\n---\n" and r.l == ["x", "y z"]


def test_search(spark, tables):
    index = search.token_index(tables["utterances"], "utt_id", ["speaker", "text"])
    n = lambda df: df.count()
    assert n(search.match_all(index, "utt_id", ["compost"])) == 2
    assert n(search.match_all(index, "utt_id", ["okafor"])) > n(search.match_all(index, "utt_id", ["okafor"], ["text"])) == 0
    small = spark.createDataFrame([(1, "a b a b c"), (2, "b a"), (3, "Abc déjà"), (4, None)], "utt_id long, text string")
    ix = search.token_index(small, "utt_id", ["text"])
    ids = lambda df: sorted(r.utt_id for r in df.collect())
    assert ids(search.match_phrase(ix, "utt_id", ["a", "b", "c"])) == [1] and ids(search.match_phrase(ix, "utt_id", ["a", "b", "a"])) == [1]
    assert ids(search.match_prefix(ix, "utt_id", "AB")) == [3] and ids(search.match_all(ix, "utt_id", ["deja"])) == [3]
    assert ids(search.match_any(ix, "utt_id", ["c", "abc"])) == [1, 3] and ids(search.match_not(ix, "utt_id", ["a"], ["c"])) == [2]
    long = spark.createDataFrame([(" ".join(f"w{i}" for i in range(40)),)], "x string")
    assert long.select(search.snippet(F.col("x"), ["w20"]).alias("s")).first().s == "…w14 w15 w16 w17 w18 w19 [w20] w21 w22 w23 w24 w25…"


def test_recipes(tables):
    ines, mateo = corpus.INES, corpus.MATEO
    assert rows(recipes.resolve_label(tables, "NESSA"), "canonical") == [(ines,)]
    assert [r.title for r in recipes.person_profile(tables, ines).collect()] == ["No peat", "Water early"]
    assert rows(recipes.beliefs_about(tables, "Tarn"), "title", "held_by") == [("Water early", ines)]
    assert rows(recipes.tensions(tables), "topic") == [("compost",)]
    told = [x for _, x in corpus.SAID if "compost" in x.text]
    assert recipes.search_utterances(tables, ["compost"]).count() == recipes.search_substring(tables, "compos").count() == len(told)
    assert rows(recipes.topic_owners(tables, ["compost"]), *recipes.topic_owners(tables, ["compost"]).columns) == sorted((x.speaker, 1) for x in told)
    assert recipes.meetings_between(tables, "2025-09-01", "2025-10-06", "회의").count() == 1
    assert recipes.meetings_between(tables, "2025-09-02", "2025-11-24", "내부-전략", canonical=True).count() == 2
    assert [r.title for r in recipes.interactions(tables, ines).collect()][0] == "import"
    assert {r.person for r in recipes.neglected(tables).collect()} == {ines, mateo}
    assert [tuple(r) for r in recipes.met_with(tables, ines, 1).collect()] == [(mateo, 3)]
    assert recipes.network_of(tables, "Mateo").count() == 2 and recipes.introductions(tables).count() == 1
    assert rows(recipes.open_commitments(tables), "text") == [("Order peat",)]
    assert recipes.report_lines(tables).count() == 1 and rows(recipes.team_rosters(tables), "names") == [(mateo,)] and recipes.by_relationship(tables).count() == 1
    assert [r.status for r in recipes.bets_register(tables).collect()] == ["진행중", "보류"] and [r.level for r in recipes.risks_register(tables).collect()] == ["high", "mid"]
    assert [(r.total, r.unresolved) for r in recipes.backfill_ranking(tables).collect()] == [(4, 4)]
    assert sum(r.n for r in recipes.attribution(tables).collect()) == len(corpus.SAID)
    assert recipes.pain_terms(tables, ["compost"]).first().n == len(told)
    assert recipes.evolution(tables).count() == 1


def test_dossiers_and_reports(spark, tables, tmp_path):
    ines, mateo = corpus.INES, corpus.MATEO
    assert {(r.person, r.id): r.place for r in recipes.dossier_models(tables).collect()} == {(ines, "peat-free"): 1, (ines, "water-early"): 2, (mateo, "label-all"): 1}
    peers = {(r.person, r.peer): r.n for r in recipes.dossier_peers(tables).collect()}
    assert peers[ines, mateo] == peers[mateo, ines] == 3 and peers[ines, corpus.PRIYA] == 2 and not any(p.startswith("화자") for _, p in peers)
    assert recipes.dossier_relations(tables).count() == 2 and recipes.dossier_network(tables).count() == 4 and recipes.dossier_open_loops(tables).count() == 2
    met = recipes.dossier_meetings(tables, 2).filter(F.col("person") == ines).collect()
    assert len(met) == 2 and (met[0].total, met[0].more) == (7, 5)
    registry = files.json_document(spark, corpus.write(tmp_path) + "/_meta/speakers.json", schemas.REGISTRY)
    assert [tuple(r)[:2] for r in recipes.contacts(tables, registry).collect()] == [("Olu Bright", 1)]
    counts = {(r.by, r.value): r.n for r in recipes.index_counts(tables).collect()}
    months = {m: sum(talk.date.startswith(m) for talk in corpus.TALKS) for m in ("2025-09", "2025-10", "2025-11")}
    assert counts["all", ""] == len(corpus.TALKS) and {v: n for (by, v), n in counts.items() if by == "month"} == months and counts["category", "내부-전략"] == 2
    assert {r.id: r.assertion for r in recipes.assertions(tables).collect()} == {"peat-free": "assert", "water-early": "hedge", "label-all": "admit"}
    assert report.index_lines(tables).count() == len(corpus.TALKS) + len(counts)
    lines = report.dossier_lines(tables).filter(F.col("person") == ines).orderBy("ord").collect()
    assert lines[0].line.startswith(f"# {ines}: ") and any(f"with {mateo} ×3" in r.line for r in lines)
    assert any(r.line == f"- 대립 {mateo}: compost" for r in lines)
    tiers = spark.createDataFrame([(ines, "contact"), (mateo, None), ("", "core"), ("Never Met", "core")], "name string, tier string")
    assert {r.person for r in report.dossiers(tables, tiers).select("person").collect()} == {mateo}
    old = spark.createDataFrame([(ines, "top\n<!-- keep -->\nby hand\n<!-- /keep -->\nend")], "person string, content string")
    kept = report.with_manual_block(report.dossier_lines(tables), old, "<!-- keep -->", "<!-- /keep -->")
    assert kept.filter("ord.g = 9").first().line == "<!-- keep -->\nby hand\n<!-- /keep -->"
    notes = report.personal_notes(registry).orderBy("pos").collect()
    assert [(r.note, r.mark, r.caution) for r in notes] == [("keeps bees", "", False), ("moved house", "△", True)]
    assert build.catalog(tables["meetings"]).first().vault_link == "2025-11-24-import"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(t.norm(F.lit(" a　\tbÅ "))) == "a bÅ"
    assert one(t.variants(F.lit("Nessa (Ines Okafor)"))) == ["Nessa (Ines Okafor)", "Nessa", "Ines Okafor"]
    assert one(t.strip_wrappers(F.lit("[['\\uc815우진']]"))) == "정우진"
    assert [one(t.clean_participant(F.lit(x))) for x in ("고객", "B", "화자 7", "Olu")] == ["", "", "", "Olu"]
    assert one(t.fragments(F.lit("짧다...여섯 글자 넘는 말…또 다른 여섯 글자"))) == ["여섯 글자 넘는 말", "또 다른 여섯 글자"]
    assert one(t.longest_tokens(F.lit("bb a aaa ccc dddd dddd"), 3)) == ["dddd", "aaa", "ccc"]
    assert one(t.iso_date(F.lit("2026-06"))) is None and str(one(t.iso_date(F.lit("2026-06-01T10")))) == "2026-06-01"
    assert one(t.integer(F.lit(" 10 "))) is None and one(t.integer(F.lit("10"))) == 10
    assert [one(t.body_safe(F.lit(x))) for x in ("Bo", "Bob", "나무", "숲")] == [False, True, True, False]
    assert one(t.base_name(F.lit("a/b.c.md"))) == "b.c" and one(t.file_safe(F.lit("a/b:c"))) == "a-b-c"
    assert one(t.similarity(F.lit("abcd"), F.lit("abce"))) == 0.75
    assert [one(t.category(F.lit(x))) for x in (None, " IR ", "인터뷰", "x")] == ["기타", "외부-투자IR", "인터뷰", "기타"]


def test_build_warnings(spark, tables):
    got = {}
    for r in report.build_warnings(tables).orderBy("kind", "place").collect():
        got.setdefault(r.kind, []).append((r.place, r.what, r.n, r.more))
    lost = sorted(((r.path, r.lost_lines) for r in tables["discarded"].filter("lost_lines > 0").collect()), key=lambda x: (-x[1], x[0]))
    assert lost and got["lost lines"] == [(i, p, n, 0) for i, (p, n) in enumerate(lost, 1)]
    silent = sorted(corpus.path(talk) for talk in corpus.TALKS if not talk.lines)
    assert got["no utterances"] == [(i, p, 0, 0) for i, p in enumerate(silent, 1)]
    lectures = [corpus.path(talk) for talk in corpus.TALKS if talk.date == "2025-11-03"]
    assert got["several files"] == [(1, "fh-1103: " + " | ".join(lectures), 3, 0)]


def test_listed_ties_and_rest(spark):
    counts = spark.createDataFrame([(f"h{i}", i // 3) for i in range(9)], "holder string, count long")
    assert [(r.place, r.what, r.n, r.more) for r in report.lost_holders(counts).orderBy("place").collect()] == [(1, "h6", 2, 4), (2, "h7", 2, 4), (3, "h8", 2, 4), (4, "h3", 1, 4), (5, "h4", 1, 4)]
    assert report.lost_holders(counts.limit(0)).collect() == []
