"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, drop_first, drop_last, fresh_name, materialize, read_table, split_words, zip_hash

GOOD, BAD, ABSTAIN = 1, -1, 0
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Rounds of expectation-maximisation, and pseudo-counts of its start values as a share of all rows.
ROUNDS = 12
PRIOR_WEIGHT = 0.02
#: Start values: the share of good texts, and how often a rule votes (good, bad) on good and on bad texts.
START_GOOD = 0.8
START_VOTES = {GOOD: (0.5, 0.01), BAD: (0.2, 0.3)}
#: A text is kept if it is good with at least this posterior probability.
KEEP_AT = 0.5

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_exclaims", "n_stops")


def add_features(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """`df` and FEATURES of its column `text`, each with `prefix` before its name.

    Every array is made once, by a projection of its own, and arrays never appear in the body of a
    lambda function: the work is n log n in the words of a text. Windows are told apart by 64-bit
    hashes. All counts are 0 for null, empty and blank texts.
    """
    names = {c: f"{prefix}{c}" for c in FEATURES}
    tmp = {c: fresh_name([*df.columns, *names.values()], f"_qr_{c}") for c in ("body", "hash", "pair", "four", "win", "rep", "lines")}
    body, col = F.col(tmp["body"]), {k: F.col(v) for k, v in tmp.items()}
    out = df.withColumn(tmp["body"], F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(tmp["hash"], F.transform(split_words(body), lambda w: F.xxhash64(w)))
    out = out.withColumn(tmp["pair"], zip_hash(col["hash"], drop_first(col["hash"], 1)))
    out = out.withColumn(tmp["four"], zip_hash(col["pair"], drop_first(col["pair"], 2)))
    out = out.withColumn(tmp["win"], drop_last(zip_hash(col["four"], drop_first(col["hash"], WINDOW_WORDS - 1)), WINDOW_WORDS - 1))
    # Only where some window occurs twice: its places, sorted by window and then put in order.
    places = F.sort_array(F.transform(col["win"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(tmp["rep"], F.when(F.size(F.array_distinct(col["win"])) < F.size(col["win"]), places))
    same = F.zip_with(col["rep"], drop_first(col["rep"], 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.withColumn(tmp["rep"], F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    # Each place adds as many words as lie before the next one, five at most.
    steps = F.zip_with(col["rep"], drop_first(col["rep"], 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS)))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda total, x: total + x), F.lit(0))
    out = out.withColumn(tmp["lines"], F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")))
    made = {
        "n_words": F.size(col["hash"]),
        "word_chars": F.length(body) - F.regexp_count(body, F.lit(f"[{SPACE_CLASS}]")),
        "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size(col["lines"]) - F.size(F.array_distinct(col["lines"])),
        "n_repeat_words": covered,
        "n_lines": F.size(col["lines"]),
        "n_distinct_words": F.size(F.array_distinct(col["hash"])),
        "n_upper": F.regexp_count(body, F.lit("[A-Z]")),
        "n_exclaims": F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit(""))),
        "n_stops": F.regexp_count(body, F.lit("[.,;:?]")),
    }
    return out.select(*df.columns, *[made[c].cast("long").alias(names[c]) for c in FEATURES])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """The two plain rules that no vote overrules."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def rules(prefix: str = "") -> dict[str, Column]:
    """The rules: each votes GOOD or BAD on a text of at least one word, or abstains."""
    f = {c: F.col(f"{prefix}{c}") for c in FEATURES}
    words = F.greatest(f["n_words"], F.lit(1))

    def share(part: str, of: Column = words) -> Column:
        return f[part] / of

    def vote(bad: Column, good: Column | None = None) -> Column:
        said = F.when(f["n_words"] == 0, ABSTAIN).when(bad, BAD)
        return (said if good is None else said.when(good, GOOD)).otherwise(ABSTAIN).cast("int")

    prose = (share("n_symbols") < 0.02) & (share("n_exclaims") < 0.1) & (share("n_stops") > 0.05) & (share("n_upper", F.greatest(f["word_chars"], F.lit(1))) < 0.2)
    return {
        "symbols": vote(share("n_symbols") > 0.1),
        "exclaims": vote(share("n_exclaims") > 0.2),
        "shouting": vote(share("n_upper", F.greatest(f["word_chars"], F.lit(1))) > 0.4),
        "repeats": vote(share("n_repeat_words") > 0.2),
        "dup_lines": vote((f["n_lines"] >= 4) & (share("n_dup_lines", F.greatest(f["n_lines"], F.lit(1))) > 0.3)),
        "vocabulary": vote((f["n_words"] >= 20) & (share("n_distinct_words") < 0.2)),
        "word_length": vote(~share("word_chars").between(2.5, 11.0)),
        "prose": vote(F.lit(False), (f["n_words"] >= MIN_WORDS) & prose),
    }


class VoteModel:
    """Two-class model of conditionally independent votes: the share of good texts, and for each rule
    how often it votes good, bad or abstains on good and on bad texts."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.good = START_GOOD
        self.votes = {(n, c): {GOOD: g, BAD: b, ABSTAIN: 1 - g - b} for n in names for c, (g, b) in START_VOTES.items()}

    def log_odds(self, columns: dict[str, Column]) -> Column:
        """Log odds that a text is good, of its vote columns."""
        total = F.lit(math.log(self.good / (1 - self.good)))
        for n in self.names:
            ratio = {v: math.log(self.votes[n, GOOD][v] / self.votes[n, BAD][v]) for v in (GOOD, BAD, ABSTAIN)}
            total = total + F.when(columns[n] == GOOD, ratio[GOOD]).when(columns[n] == BAD, ratio[BAD]).otherwise(ratio[ABSTAIN])
        return total

    def posterior(self, columns: dict[str, Column]) -> Column:
        """Probability that a text is good."""
        return 1 / (1 + F.exp(-self.log_odds(columns)))

    def accuracy(self, name: str) -> float:
        """Estimated probability that the rule is right when it votes."""
        right = self.good * self.votes[name, GOOD][GOOD] + (1 - self.good) * self.votes[name, BAD][BAD]
        wrong = self.good * self.votes[name, GOOD][BAD] + (1 - self.good) * self.votes[name, BAD][GOOD]
        return right / (right + wrong)

    def fit(self, patterns: DataFrame, rounds: int = ROUNDS) -> VoteModel:
        """Expectation-maximisation over vote patterns: columns named as the rules, and `n`.

        There are at most 3 to the power of the rules patterns, whatever the number of texts; one
        aggregation over them is a round. No rows: the start values stay.
        """
        columns = {n: F.col(n) for n in self.names}
        for _ in range(rounds):
            q = self.posterior(columns)
            sums = [F.sum("n").alias("all"), F.sum(F.col("n") * q).alias("good")]
            for n in self.names:
                for v in (GOOD, BAD):
                    hit = F.when(columns[n] == v, F.col("n")).otherwise(0)
                    sums += [F.sum(hit * q).alias(f"g_{n}_{v}"), F.sum(hit * (1 - q)).alias(f"b_{n}_{v}")]
            row = patterns.agg(*sums).first()
            if not row["all"]:
                break
            prior = PRIOR_WEIGHT * row["all"]
            of = {GOOD: row["good"], BAD: row["all"] - row["good"]}
            self.good = (of[GOOD] + prior * START_GOOD) / (row["all"] + prior)
            for n in self.names:
                for c, mark in ((GOOD, "g"), (BAD, "b")):
                    start = dict(zip((GOOD, BAD), START_VOTES[c], strict=True))
                    new = {v: (row[f"{mark}_{n}_{v}"] + prior * start[v]) / (of[c] + prior) for v in (GOOD, BAD)}
                    self.votes[n, c] = new | {ABSTAIN: max(1e-9, 1 - sum(new.values()))}
        return self


def judge(df: DataFrame, text: str = "text", prefix: str = "") -> tuple[DataFrame, VoteModel]:
    """`df` with FEATURES, `base_failed`, `quality_probability` and `kept`, and the fitted model.

    The rows with their features are written to the shared folder (select before what is not
    needed later), so texts are read once. Every row gets its own verdict; null and blank texts
    fail the base rules. Columns of `df` that clash with the new names need another `prefix`.
    """
    added = [f"{prefix}{c}" for c in (*FEATURES, "base_failed", "quality_probability", "kept")]
    if clash := {c.lower() for c in added} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already: choose a prefix")
    return _judge(materialize(add_features(df, text, prefix), "quality-features"), prefix)


def _judge(features: DataFrame, prefix: str) -> tuple[DataFrame, VoteModel]:
    votes = rules(prefix)
    patterns = features.select(*[v.alias(n) for n, v in votes.items()]).groupBy(*votes).agg(F.count("*").alias("n"))
    model = VoteModel(list(votes)).fit(materialize(patterns.coalesce(1), "quality-patterns"))
    failed = base_failed(F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words"))
    out = features.withColumn(f"{prefix}base_failed", failed).withColumn(f"{prefix}quality_probability", model.posterior(votes))
    kept = ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}quality_probability") >= KEEP_AT)
    return out.withColumn(f"{prefix}kept", kept), model


def filter_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `df` that are kept, with its columns."""
    prefix = fresh_name([c[: len("_quality")] for c in df.columns], "_quality") + "_"
    judged, _ = judge(df, text, prefix)
    return judged.filter(f"`{prefix}kept`").select(*df.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict for all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    features = materialize(add_features(docs, "text").drop("text"), "quality-features")
    judged, _ = _judge(features, "")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_probability", "kept")


__all__ = ["FEATURES", "VoteModel", "add_features", "filter_quality", "judge", "op6_quality_rules", "rules"]
QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL: dict[str, str] = {}
