"""The longest part that passages have in common with texts, exactly and without candidates.

A suffix automaton of the passages is walked by each text once: at each character it stands in the state of the
longest end of what was read that some passage holds. So the time is in proportion to the texts, however many
passages there are. Passages are split by size: an automaton is of a bounded number of characters, and the
texts are read once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage

#: Characters of the passages of one automaton, or one passage.
AT_ONCE = 200_000


class Automaton:
    """All parts of some strings. State 0 is the empty part; `longest` is the length of a state's longest
    part, `link` the state of the longest end of it that is in another one."""

    def __init__(self, strings: list[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.link, self.longest = [-1], [0]
        #: For each string the states of its beginnings; those and the states that links lead to from them
        #: are all of its parts.
        self.path = [self._add(s) for s in strings]
        self.order = sorted(range(1, len(self.arcs)), key=self.longest.__getitem__)

    def _state(self, longest: int, arcs: dict[str, int], link: int) -> int:
        self.arcs.append(arcs)
        self.longest.append(longest)
        self.link.append(link)
        return len(self.arcs) - 1

    def _split(self, at: int, c: str, to: int) -> int:
        """The part of state `to` that is no longer than `at` and c, as a state of its own."""
        own = self._state(self.longest[at] + 1, dict(self.arcs[to]), self.link[to])
        self.link[to] = own
        while at >= 0 and self.arcs[at].get(c) == to:
            self.arcs[at][c] = own
            at = self.link[at]
        return own

    def _next(self, at: int, c: str) -> int:
        to = self.arcs[at].get(c)
        if to is not None:
            # Another string has led here.
            return to if self.longest[to] == self.longest[at] + 1 else self._split(at, c, to)
        new = self._state(self.longest[at] + 1, {}, 0)
        while at >= 0 and c not in self.arcs[at]:
            self.arcs[at][c] = new
            at = self.link[at]
        if at >= 0:
            to = self.arcs[at][c]
            self.link[new] = to if self.longest[to] == self.longest[at] + 1 else self._split(at, c, to)
        return new

    def _add(self, s: str) -> list[int]:
        at, path = 0, []
        for c in s:
            at = self._next(at, c)
            path.append(at)
        return path

    def walk(self, text: str, best: dict[int, int]) -> None:
        """For each state the text comes through, the most characters of it that the text holds."""
        arcs, link, longest = self.arcs, self.link, self.longest
        at = length = 0
        for c in text:
            to = arcs[at].get(c)
            if to is None:
                while at and to is None:
                    at = link[at]
                    to = arcs[at].get(c)
                length = longest[at]
                if to is None:
                    continue
            at = to
            length += 1
            if length > best.get(at, 0):
                best[at] = length

    def parts(self, best: dict[int, int]) -> list[int]:
        """The longest part of each string that what was walked holds."""
        # A state's parts end in all those that links lead to; these are held whole.
        held = [0] * len(self.arcs)
        for state, length in best.items():
            held[state] = length
        for state in reversed(self.order):
            up = self.link[state]
            if held[state] and up:
                held[up] = self.longest[up]
        for state in self.order:
            held[state] = max(held[state], held[self.link[state]])
        return [max((held[s] for s in path), default=0) for path in self.path]

    def owners(self) -> list[list[int]]:
        """For each state, the strings it is a part of."""
        of: list[list[int]] = [[] for _ in self.arcs]
        for i, path in enumerate(self.path):
            seen = set()
            for state in path:
                while state and state not in seen:
                    seen.add(state)
                    of[state].append(i)
                    state = self.link[state]
        return of

    def parts_of_one(self, best: dict[int, int], owners: list[list[int]]) -> dict[int, int]:
        """As `parts`, for the strings that have any, by looking only at states that were walked."""
        held = dict(best)
        for state in best:
            up = self.link[state]
            while up > 0 and held.get(up, 0) < self.longest[up]:
                held[up] = self.longest[up]
                up = self.link[up]
        out: dict[int, int] = {}
        for state, length in held.items():
            for i in owners[state]:
                if length > out.get(i, 0):
                    out[i] = length
        return out


class Scorer:
    """Best score of each passage over the texts given to it: the least share over the passage's parts
    (fragments) of the longest part of it that the text holds. An empty fragment is held by any text."""

    def __init__(self, passages: list[tuple[int, list[str]]]) -> None:
        #: A passage of one fragment is as good as the best text for it: one walk over all texts tells. One of
        #: several fragments needs them in one text, so its automaton is asked after each text.
        self._whole = [(i, f) for i, f in passages if len(f) == 1]
        self._split = [(i, f) for i, f in passages if len(f) != 1]
        self._one = Automaton([f[0] for _, f in self._whole])
        self._many = Automaton([x for _, f in self._split for x in f])
        self._owners = self._many.owners()
        self._held: dict[int, int] = {}
        self._best = [0.0] * len(self._split)
        self._seen = False

    def take(self, text: str) -> None:
        self._seen = True
        self._one.walk(text, self._held)
        if not self._split:
            return
        best: dict[int, int] = {}
        self._many.walk(text, best)
        found, at = self._many.parts_of_one(best, self._owners), 0
        for k, (_, fragments) in enumerate(self._split):
            shares = [found.get(at + j, 0) / len(f) if f else 1.0 for j, f in enumerate(fragments)]
            self._best[k] = max(self._best[k], min(shares, default=1.0))
            at += len(fragments)

    def scores(self) -> list[tuple[int, float]]:
        if not self._seen:
            return []
        whole = [(i, n / len(f[0]) if f[0] else 1.0) for (i, f), n in zip(self._whole, self._one.parts(self._held), strict=True)]
        return whole + [(i, s) for (i, _), s in zip(self._split, self._best, strict=True)]


def best_shares(passages: DataFrame, texts: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """`id`, `score` of each passage over all texts. passages: `id`, `parts` (array of strings); texts: `text`.

    Passages are put in blocks by their sizes, in a written table; a block comes to the driver and goes to the
    tasks, and each partition of the texts gives one row for each of its passages. Null texts count for
    nothing; where there are no texts there are no rows. Ids of passages are unique.
    """
    spark = passages.sparkSession
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p)) + F.size("parts")
    rows, _ = storage.materialize(passages.select("id", "parts", size.alias("size")), "passages")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // at_once))
    bodies = texts.filter("text is not null").select("text")
    found = None
    for block in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "parts").collect() if blocks > 1 else rows.select("id", "parts").collect()
        given = [(i, list(r.parts)) for i, r in enumerate(mine)]

        def run(batches: Iterator[pa.RecordBatch], given: list = given) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(given)
            for batch in batches:
                for x in batch.column(0):
                    scorer.take(x.as_py())
            scores = scorer.scores()
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in scores], pa.int32()), pa.array([s for _, s in scores], pa.float64())], names=["at", "score"])

        best = bodies.mapInArrow(run, "at int, score double").groupBy("at").agg(F.max("score").alias("score"))
        ids = spark.createDataFrame([(i, r.id) for i, r in enumerate(mine)], f"at int, id {passages.schema['id'].dataType.simpleString()}")
        part = best.join(F.broadcast(ids), "at").select("id", "score")
        # Written at each block: the plan of all blocks together would grow with their number.
        part, _ = storage.materialize(part, "shares")
        found = part if found is None else found.unionByName(part)
    return found
