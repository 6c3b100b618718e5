"""The windowed parser against a sequential one, on random lines."""

import random

from colloquy.operators import parse

LINES = ["", "  ", "# head", "- [ ] (a→b) do it", "- [x] done (due: 2026-01-01)", "**[A] (0:01)** said", "**[B] (0:02)**", "**C** (0:03):", "plain one", "plain two", "[0:04] x", "(0:05)", "x (0:06 broken"]


def sequential(lines):
    out, head, held = [], None, []

    def flush():
        nonlocal head, held
        if head and held:
            out.append((*head, " ".join(held)))
        head, held = None, []

    import re

    for line in map(str.strip, lines):
        if not line or re.match(r"- \[[ x]\] ", line):
            flush()
        elif m := re.match(r"\*\*\[(.)\] \((0:0\d)\)\*\* ?(.*)|\*\*(.)\*\* \((0:0\d)\):|\[(0:0\d)\] (.*)|\((0:0\d)\)$", line):
            flush()
            name, ts, text = m[1] or m[4] or "", m[2] or m[5] or m[6] or m[8], m[3] or m[7] or ""
            if text:
                out.append((name, ts, text))
            else:
                head = (name, ts)
        elif line.startswith("#"):
            flush()
        elif head:
            held.append(line)
    flush()
    return sorted(out)


def test_equal_on_random_files(spark):
    r = random.Random(1)
    cases = [[r.choice(LINES) for _ in range(r.randint(0, 25))] for _ in range(300)]
    df = spark.createDataFrame([(i, "\n".join(c)) for i, c in enumerate(cases)], "rowid long, body string")
    got = {}
    for u in parse.utterances(parse.lines(df)).collect():
        got.setdefault(u.rowid, []).append((u.speaker_raw, u.ts, u.text))
    for i, c in enumerate(cases):
        assert sorted(got.get(i, [])) == sequential(c), c
