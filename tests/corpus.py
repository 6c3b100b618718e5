"""A garden's talks. What is said is a table of lines; files are rendered from it in the line shapes
that transcripts come in, and the tests take the rows they expect from the same table."""

import copy
import json
from collections import namedtuple

INES, MATEO, PRIYA, TARN = "Ines Okafor", "Mateo Lindqvist", "Priya Raman", "Tarn Nursery"
QUOTE = "Water the seedlings before the frost comes"

#: How a line looks in a file.
SHAPES = {
    "span": "**[{label}] ({ts})** {text}\n",
    "bold": "**{label} ({ts})** {text}\n",
    "wiki": "**[[{label}]] ({ts})** {text}\n",
    "colon": "**{label}** ({ts}): {text}\n",
    "under": "**{label}** ({ts})\n{text}\n\n",
    "clock": "(시간: {ts}) {text}\n",
    "square": "[{ts}] {text}\n",
    "range": "[{ts} - 59:59] {text}\n",
}

#: A line as written, with the speaker and the kind it must get.
Line = namedtuple("Line", "shape label ts text speaker kind", defaults=("", "unattributed"))
Talk = namedtuple("Talk", "date slug category lines after head")


def by(name, shape, label, ts, text):
    return Line(shape, label, ts, text, name, "canonical")


TALKS = [
    Talk(
        "2025-09-02", "seed-bank", "회의",
        [
            by(INES, "span", INES, "0:02", QUOTE + "."),
            by(MATEO, "bold", "Matti", "0:07", "The compost is late again"),
            by(PRIYA, "wiki", PRIYA, "0:11", "Fine by me"),
            by(INES, "colon", "Nessa(Ines Okafor)", "0:15", "Then we buy compost."),
            Line("span", "화자 4", "0:21", "Is this on?", "화자 4", "generic"),
            Line("span", "", "0:24", "a door"),
            Line("bold", "Olu Bright", "0:33", "I only visit", "Olu Bright", "raw-name"),
            by(INES, "span", "ines", "1:00:05", "An hour gone"),
            by(MATEO, "colon", MATEO, "1:00:40", "Noted"),
        ],
        "## 액션\n- [ ] (Matti→Ines) Order peat (기한: 2025-09-09)\n- [x] (Ines Okafor->Priya Raman) Label the beds\n**[Ines Okafor] cut off (0:55)\n",
        {"participants": f'["{INES}", {MATEO}]', "duration_min": 45},
    ),
    Talk("2025-09-18", "walk", "파트너", [by(INES, "under", INES, "0:00", "Here the oaks\nthere the elms"), by(PRIYA, "under", PRIYA, "00:09", "And the pond")], f"**{MATEO}** (0:20)\n\nLeft over\n", {}),
    Talk(
        "2025-10-06", "telephone", "통화",
        [Line("clock", "", "0:00", "Good morning"), Line("range", "", "0:04", "Who is it"), Line("square", "", "0:08", "The nursery"), Line("square", "", "0:12", "Goodbye")],
        "", {"participants": f"[Ines, {MATEO}]", "duration_min": "half an hour"},
    ),
    Talk("2025-10-20", "minutes-only", "기타", [], "Everybody agreed.\n", {}),
    *[Talk("2025-11-03", f"lecture-{c}", "세미나", [by(INES, "span", INES, "0:01", "Ferns are old")], more, {}) for c, more in (("a", "and so they stay\n"), ("b", ""), ("c", ""))],
    *[Talk("2025-11-10", f"stocktaking-{i}", "unheard of", [by(MATEO, "span", MATEO, "0:01", when)], "", {"part": i}) for i, when in ((1, "morning"), (2, "evening"))],
    Talk(
        "2025-11-24", "import", "내부-전략",
        [by(MATEO, "span", f'"{MATEO}"', "0:01", "peat"), by(INES, "span", "\\u0049nes Okafor", "0:02", "loam")],
        "", {"participants": f"[\"[[{INES}]]\", '{MATEO}', 고객, B]"},
    ),
]


def source(talk):
    return "fh-" + talk.date[5:].replace("-", "")


def path(talk):
    return f"transcripts/{talk.date[:4]}/{talk.date[:7]}/{talk.date}-{talk.slug}.md"


def render(talk):
    head = {"title": talk.slug, "date": talk.date, "category": talk.category, "source_id": source(talk)} | talk.head
    lines = "".join(SHAPES[x.shape].format(**x._asdict()) for x in talk.lines)
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in head.items()) + "---\n# Talk\n" + lines + talk.after


#: All that is said: the number of its talk, and the line.
SAID = [(i, x) for i, talk in enumerate(TALKS, 1) for x in talk.lines]


REGISTRY = [
    {"name": INES, "aliases": ["Ines", "Nessa(Ines Okafor)"], "personal": ["keeps bees", {"date": "2025-08-14", "note": "moved house", "use": "사적"}]},
    {"name": MATEO, "aliases": ["Matti"], "team": "Collections", "manager": "Ines", "relationship": "apprentice"},
    {"name": PRIYA},
]


def model(key, title, evidence, holder, **more):
    return {"id": key, "title": title, "category": "growing", "evidence": evidence, "holders": [holder]} | more


ONTOLOGY = {
    "meta": {"schema_version": 2, "org": "Fernhill", "processed_source_ids": [source(TALKS[0])]},
    "meetings": [{"id": "t1", "date": TALKS[0].date, "title": TALKS[0].slug, "source_id": source(TALKS[0]), "path": path(TALKS[0])}],
    "people": [
        {"name": INES, "type": "person", "summary": "head gardener", "evidence": "high", "models": ["water-early", "peat-free"]},
        {"name": MATEO, "type": "person", "summary": "apprentice", "evidence": "mid", "models": ["label-all"]},
        {"name": TARN, "type": "org", "summary": "sells trees", "evidence": "low"},
    ],
    "models": [
        model("water-early", "Water early", "mid", INES, about=[TARN], quote=QUOTE, count=2, first_seen="2025-09-02", related=["peat-free"]),
        model("peat-free", "No peat", "high", INES, count=6, last_seen="2025-11-24"),
        model("label-all", "Label all beds", "low", MATEO, last_seen="2025-11-10"),
    ],
    "relations": [{"from": MATEO, "to": INES, "type": "tension", "topic": "compost", "note": "late", "direction": "one-way"}],
    "network": [{"a": PRIYA, "b": MATEO, "kind": "소개", "note": "cousins"}],
    "bets": [{"tag": "later", "title": "Tea room", "status": "보류"}, {"tag": "now", "title": "Seed shop", "status": "진행중", "owner": INES, "date": "2025-09-02", "source": ["t1", "t4"], "related_models": ["peat-free"]}],
    "risks": [{"level": "mid", "title": "Slugs"}, {"level": "high", "title": "Drought"}],
    "timeline": [{"date": "2025-09-02", "meeting": "t1", "change": "peat given up"}],
}


def write(folder, ontology=ONTOLOGY, registry=REGISTRY):
    files = {path(talk): render(talk).encode() for talk in TALKS} | {"transcripts/2025/unreadable.md": b"---\ntitle: \xc3\x28\n---\n"}
    files |= {name: json.dumps(doc, ensure_ascii=False).encode() for name, doc in (("_ontology/objects.json", ontology), ("_meta/speakers.json", registry))}
    for name, data in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    return str(folder)


#: Entries that each break a rule, and the findings (rule, severity, key) they must give.
FAULTS = {
    "people": [
        ({"type": "person", "summary": "x", "evidence": "low"}, [("V2", "E", "3")]),
        ({"name": "Wren", "type": "hedge", "evidence": "maybe", "models": ["lost", "peat-free"]}, [("V2", "W", "Wren"), ("V3", "E", "Wren"), ("V4", "E", "Wren"), ("V13", "E", "Wren")]),
        ({"name": "Tansy", "type": "person", "summary": "x", "evidence": "low", "models": ["lost"]}, [("V27", "W", "Tansy")]),
        ({"name": "Moss Ltd", "type": "org", "summary": "x", "evidence": "high"}, [("V18", "E", "Moss Ltd")]),
    ],
    "models": [
        (model("trade", "Trade", "high", "Moss Ltd", related=["nothing"], about=["Nobody"]), [("V11", "W", "trade"), ("V12", "E", "trade"), ("V19", "E", "trade"), ("V20", "W", "trade")]),
        ({"title": "No id", "category": "x", "evidence": "low", "holders": [INES]}, [("V5", "E", "4")]),
        ({"id": "peat-free", "evidence": "sure"}, [("V5", "E", "peat-free"), ("V6", "E", "peat-free"), ("V7", "E", "peat-free"), ("V8", "E", "peat-free"), ("V9", "E", "peat-free")]),
        (model("unsaid", "Unsaid", "low", "A Stranger", quote="dragonflies juggle violet xylophones quickly", last_seen="2023-02-01"), [("V10", "E", "unsaid"), ("V24", "W", "unsaid"), ("V25", "W", "unsaid")]),
    ],
    "relations": [({"from": PRIYA, "to": "Gone", "type": "envies"}, [("V14", "E", "to"), ("V14", "E", f"{PRIYA}→Gone")])],
    "network": [({"a": INES, "b": "Unmet"}, [("V16", "E", f"{INES}↔Unmet"), ("V16", "W", "Unmet")]), ({"a": PRIYA, "kind": "소개"}, [("V16", "E", "b")])],
    "timeline": [({"date": "2025-10-06", "meeting": "t77", "change": "x"}, [("V17", "W", "2025-10-06")])],
    "meetings": [({"id": "t2"}, [("V21", "W", "t2")]), ({"id": "t3", "source_id": "fh-0000", "path": "transcripts/nowhere.md"}, [("V21", "W", "t3")])],
}


def faulty():
    bad = copy.deepcopy(ONTOLOGY)
    for part, entries in FAULTS.items():
        bad[part] += [entry for entry, _ in entries]
    return bad
