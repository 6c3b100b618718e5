"""Erasure of many people at once: each text is read through once, whatever the number of names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .erase import MASK, _variants, is_body_safe

#: Bytes of names that are sent to every executor at most. More people are erased in several goes.
MOST_BYTES = 64 << 20
_BEFORE = re.compile(r"\*\*\[?\Z")
_AFTER = re.compile(r"\]?\s*\(", re.ASCII)

Names = list[tuple[str, list[str]]]


def tokens_of(people: list[str], registry: DataFrame) -> Names:
    """Every name variant and alias of these people, longest first and of equal length in ascending order, with the
    people it names. One job over the registry, which gives only their entries."""
    wanted = {unicodedata.normalize("NFC", p).strip(): p for p in people}
    asked = registry.sparkSession.createDataFrame([(w,) for w in wanted], "_name string")
    entries = registry.select(t.norm_ends(F.col("name")).alias("_name"), F.explode("aliases").alias("alias")).join(F.broadcast(asked), "_name")
    owners: dict[str, set[str]] = {}
    for w, p in wanted.items():
        for token in _variants(p):
            owners.setdefault(token, set()).add(w)
    for r in entries.filter("alias is not null").collect():
        owners.setdefault(unicodedata.normalize("NFC", r.alias).strip(), set()).add(r._name)
    owners.pop("", None)
    return [(token, sorted(owners[token])) for token in sorted(owners, key=lambda x: (-len(x), x))]


def _automaton(names: Names) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for rank, (token, _) in enumerate(names):
        found.add_word(token, rank)
    found.make_automaton()
    return found


def masked(text: str, names: Names, automaton: ahocorasick.Automaton, mask: str = MASK) -> tuple[str, dict[int, int]]:
    """The text in NFC with the names masked, and how often each (by its place) that is long enough stands in it.
    Labels `**[X] (` of any name go first, then names that are long enough; longer names go before shorter ones and
    take their places from left to right. What a mask is made of is not searched."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    found: list[tuple[bool, int, int, int]] = []
    counts: dict[int, int] = {}
    ends: dict[int, int] = {}
    for last, rank in automaton.iter(text):
        token = names[rank][0]
        start, end = last + 1 - len(token), last + 1
        safe = is_body_safe(token)
        if safe and start >= ends.get(rank, 0):
            counts[rank], ends[rank] = counts.get(rank, 0) + 1, end
        label = bool(_BEFORE.search(text, max(0, start - 3), start)) and bool(_AFTER.match(text, end))
        if label or safe:
            found.append((not label, rank, start, end))
    if not found:
        return text, counts
    covered, taken = bytearray(len(text)), []
    for _, _, start, end in sorted(found):
        if not any(covered[start:end]):
            covered[start:end] = b"\1" * (end - start)
            taken.append((start, end))
    out, at = [], 0
    for start, end in sorted(taken):
        out += (text[at:start], mask)
        at = end
    return "".join([*out, text[at:]]), counts


_built: list = []


def _of_worker(names: Names) -> ahocorasick.Automaton:
    """The automaton of these names, made once in a worker."""
    if not _built or _built[0] is not names:
        _built[:] = [names, _automaton(names)]
    return _built[1]


def erase_texts(df: DataFrame, column: str, names: Names, mask: str = MASK) -> DataFrame:
    """`df` with `column` masked, `mentions` (of all names) and `mentioned` (map of person to how often any of their names
    stands there; a name of two people counts for both). Null texts stay null, with no mentions; without names only NFC
    is applied. Equal to masking all names one after the other, longest first, but that masks are not searched."""
    size = sum(len(token.encode()) + sum(len(p.encode()) for p in people) for token, people in names)
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of names, more than {MOST_BYTES}: erase in several goes, the longest names first")
    sent = df.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("text string, mentions int, people array<string>, times array<int>")
    def erase(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = sent.value
        automaton = _of_worker(names) if names else None
        for batch in texts:
            rows = []
            for text in batch:
                if text is None or automaton is None:
                    rows.append((None if text is None else unicodedata.normalize("NFC", text), 0, [], []))
                    continue
                out, counts = masked(text, names, automaton, mask)
                people: dict[str, int] = {}
                for rank, n in counts.items():
                    for p in names[rank][1]:
                        people[p] = people.get(p, 0) + n
                rows.append((out, sum(counts.values()), sorted(people), [people[p] for p in sorted(people)]))
            yield pd.DataFrame(rows, columns=["text", "mentions", "people", "times"])

    done = df.withColumn("_erased", erase(F.col(column)))
    keep = [F.col("_erased.text").alias(column) if c == column else F.col(c) for c in df.columns if c not in ("mentions", "mentioned")]
    return done.select(*keep, F.col("_erased.mentions").alias("mentions"), F.map_from_arrays("_erased.people", "_erased.times").alias("mentioned"))
