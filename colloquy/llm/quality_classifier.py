"""Ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, give_back, materialize, read_table

#: The bound of the fitting sample: rated ids, those with the least hash. Everything is scored.
SAMPLE_ROWS = 16_000
BUCKETS = 1 << 22
#: Features in fewer texts of the sample than this get no weight.
MIN_TEXTS = 3
#: Nor do features whose presence says so little about the grade that chance would (likelihood-ratio
#: statistic: two in a hundred features without a meaning exceed it). The penalty does the rest.
MIN_ASSOCIATION = 8.0
ROUNDS = 300
RATE = 0.3
#: The L1 penalty: a weight leaves zero if the texts with the feature, less those that speak against
#: it, are about this many.
L1_ROWS = 2.4
#: Beginnings of words that are features too, in code points: inflected forms share them.
STEMS = (4, 5)
#: A text is kept if its grade is the highest with at least this probability.
KEEP_AT = 0.5
#: Distinct words whose features are remembered, before the memory is emptied.
MEMORY_WORDS = 300_000

_EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_"
_UPPER = bytes(range(65, 91))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _bucket(name: bytes) -> int:
    return xxhash.xxh64_intdigest(name) & (BUCKETS - 1)


def _level(share: float, edges: tuple[float, ...] = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)) -> int:
    return sum(share > e for e in edges)


def shape(body: bytes, words: list[bytes], distinct: int) -> list[bytes]:
    """Names of what holds for the form of a text, its words aside."""
    n = len(words)
    if not n:
        return [b"\x00empty"]
    chars = max(1, len(body) - body.count(b" "))
    lines = [x for x in body.split(b"\n") if x.strip()]
    size = sum(n > e for e in (5, 10, 20, 50, 200, 1000, 5000))
    same = sum(map(bytes.__eq__, words[1:], words))
    return [
        b"\x00size %d" % size,
        b"\x00upper %d" % _level((len(body) - len(body.translate(None, _UPPER))) / chars),
        b"\x00marks %d" % _level((len(body) - len(body.translate(None, _MARKS))) / chars),
        b"\x00exclaims %d" % _level(body.count(b"!") / n),
        b"\x00bars %d" % _level(body.count(b"|") / n),
        b"\x00stops %d" % _level((body.count(b".") + body.count(b",")) / n),
        b"\x00same %d" % _level(same / n),
        b"\x00distinct %d %d" % (size // 2, _level(distinct / n)),
        b"\x00lines %d" % _level(1 - len(set(lines)) / max(1, len(lines))),
        b"\x00length %d" % min(20, len(body) // n),
    ]


class Features:
    """Buckets of a text: of its distinct words, A-Z lower-cased and without marks round them, of the
    beginnings of these words, and of its shape. Words are looked up once and remembered. weights: if given, only buckets with a weight
    are returned."""

    def __init__(self, weights: dict[int, float] | None = None) -> None:
        self._weights = weights
        self._known: dict[bytes, tuple[int, ...]] = {}

    def _look_up(self, names: list[bytes]) -> tuple[int, ...]:
        return tuple(b for b in map(_bucket, names) if self._weights is None or b in self._weights)

    def _of_word(self, word: bytes) -> tuple[int, ...]:
        bare = word.lower().strip(_EDGES) or word
        letters = bare.decode("utf-8", "replace")
        return self._look_up([bare, *(b"\x00^" + letters[:n].encode() for n in STEMS if len(letters) >= n)])

    def of(self, body: bytes | None) -> set[int]:
        body = body or b""
        words = body.split()
        distinct = set(words)
        if len(self._known) > MEMORY_WORDS:
            self._known = {}
        known = self._known
        for word in distinct.difference(known):
            known[word] = self._of_word(word)
        return set(self._look_up(shape(body, words, len(distinct)))).union(*map(known.__getitem__, distinct))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - score), where score is the sum of the weights of a
    text's buckets: one set of weights for all grades, 0 to len(thresholds)."""

    weights: dict[int, float]
    thresholds: list[float]

    def scores(self, bodies: Iterator[bytes | None], features: Features) -> np.ndarray:
        w = self.weights
        return np.array([sum(sorted(w[b] for b in features.of(body))) for body in bodies], np.float64)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to the highest, a column each."""
        return _sigmoid(scores[:, None] - np.array(self.thresholds)[None, :])


def _association(at: np.ndarray, rows: np.ndarray, grades: np.ndarray, n_names: int, n_grades: int) -> np.ndarray:
    """Likelihood-ratio statistic of each feature's presence against the grades."""
    seen = np.stack([np.bincount(at[grades[rows] == k], minlength=n_names) for k in range(n_grades)], axis=1).astype(np.float64)
    of = np.bincount(grades, minlength=n_grades).astype(np.float64)
    total = np.zeros(n_names)
    for part, all_of in ((seen, seen.sum(axis=1)), (of[None, :] - seen, len(grades) - seen.sum(axis=1))):
        expected = all_of[:, None] * of[None, :] / len(grades)
        total += np.where(part > 0, part * np.log(np.maximum(part, 1e-300) / np.maximum(expected, 1e-300)), 0.0).sum(axis=1)
    return 2 * total


def loss_and_gradient(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood and its slopes by the weights and by the thresholds. Text rows[i] has
    feature cols[i]; P(grade) is the difference of two neighbouring sigmoids."""
    n = len(grades)
    score = np.bincount(rows, w[cols], n)
    below = np.concatenate((np.zeros((n, 1)), _sigmoid(theta[None, :] - score[:, None]), np.ones((n, 1))), axis=1)
    a, b = below[np.arange(n), grades + 1], below[np.arange(n), grades]
    p = np.maximum(a - b, 1e-12)
    step = np.bincount(cols, ((1 - a - b) / n)[rows], len(w))
    slope = np.zeros(len(theta) + 2)
    np.add.at(slope, grades + 1, -a * (1 - a) / p / n)
    np.add.at(slope, grades, b * (1 - b) / p / n)
    return float(-np.log(p).mean()), step, slope[1:-1]


def fit_arrays(buckets: list[np.ndarray], grades: np.ndarray, n_grades: int, min_texts: int = MIN_TEXTS, rounds: int = ROUNDS) -> OrdinalModel:
    """Proximal adaptive gradient on the mean negative log-likelihood with an L1 penalty. Grades that
    do not occur get thresholds of their neighbours; no rows give a model that is sure of the highest."""
    if not len(grades) or len(np.unique(grades)) < 2:
        sure = int(grades[0]) if len(grades) else n_grades - 1
        return OrdinalModel({}, [-20.0 if k < sure else 20.0 for k in range(n_grades - 1)])
    flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    names, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = (count >= min_texts) & (_association(at, rows, grades, len(names), n_grades) >= MIN_ASSOCIATION)
    place = np.cumsum(often) - 1
    keep = often[at]
    rows, cols, names = rows[keep], place[at[keep]], names[often]
    n = len(grades)
    w, theta = np.zeros(len(names)), np.linspace(-1.0, 1.0, n_grades - 1) if n_grades > 2 else np.zeros(1)
    share = np.clip(np.array([(grades <= k).mean() for k in range(n_grades - 1)]), 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    gw, gt = np.full(len(names), 1e-8), np.full(n_grades - 1, 1e-8)
    for _ in range(rounds):
        _, step, slope = loss_and_gradient(rows, cols, grades, w, theta)
        gw += step**2
        rate = RATE / np.sqrt(gw)
        w -= rate * step
        w = np.sign(w) * np.maximum(0.0, np.abs(w) - rate * L1_ROWS / n)
        gt += slope**2
        theta = np.maximum.accumulate(theta - RATE / np.sqrt(gt) * slope)
    return OrdinalModel({int(k): float(v) for k, v in zip(names, w, strict=True) if v}, [float(x) for x in theta])


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fits on at most `sample_rows` rated rows. ratings: `id`, `grade` (0 to n_grades - 1); null ids
    and grades are left out, of several grades of an id the least counts, of several texts of an id
    that with the least hash. Ids are sampled by their hashes, ties by the ids. Empty tables give a
    model that is sure of the highest grade. Texts, and the features that tell nothing, stay on the
    executors; the driver gets the sample's other ones as arrays."""
    rated = ratings.filter("id is not null and grade is not null").groupBy("id").agg(F.min("grade").cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = F.broadcast(materialize(sample, "classifier-sample"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("body")).join(sample, "id")
    rows = rows.groupBy("id").agg(F.min("grade").alias("grade"), F.min_by("body", F.xxhash64("body")).alias("body")).select("grade", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [sorted(features.of(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["grade", "buckets"])

    held = materialize(rows.mapInArrow(run, "grade int, buckets array<int>"), "classifier-features")
    of = {r.grade: r["count"] for r in held.groupBy("grade").count().collect()}
    telling = np.sort(telling_features(held, [of.get(k, 0) for k in range(n_grades)]).toArrow().column(0).to_numpy()).astype(np.int32)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.intersect1d(x.values.to_numpy(), telling) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["grade", "buckets"])

    small = held.mapInArrow(select, "grade int, buckets array<int>").toArrow()
    buckets = [x.values.to_numpy() for chunk in small.column("buckets").chunks for x in chunk]
    grades = small.column("grade").to_numpy().astype(np.int64)
    # The order of collected rows is the executors'; the sums should not depend on it.
    order = sorted(range(len(grades)), key=lambda i: (grades[i], buckets[i].tobytes()))
    return fit_arrays([buckets[i] for i in order], grades[order], n_grades)


def telling_features(held: DataFrame, of: list[int]) -> DataFrame:
    """`bucket` of the features that are worth a weight: in MIN_TEXTS texts and with MIN_ASSOCIATION,
    see `_association`. held: `grade`, `buckets`; of: texts of each grade."""
    total = max(1, sum(of))
    seen = [F.count_if(F.col("grade") == k).alias(f"n{k}") for k in range(len(of))]
    counts = held.select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), *seen).filter(F.col("n") >= MIN_TEXTS)
    statistic = F.lit(0.0)
    for k, all_k in enumerate(of):
        for part, of_part in ((F.col(f"n{k}"), F.col("n")), (all_k - F.col(f"n{k}"), total - F.col("n"))):
            statistic = statistic + F.when(part > 0, 2 * part * F.log(part * total / (of_part * F.lit(float(all_k or 1))))).otherwise(0.0)
    return counts.filter(statistic >= MIN_ASSOCIATION).select("bucket")


def add_grades(docs: DataFrame, model: OrdinalModel, text: str, expected: str, tail: str) -> DataFrame:
    """`docs` with the expected grade and the probability of the highest grade of each text. Null and
    blank texts have the one feature `empty`; repeated rows get equal numbers; an empty table stays
    empty. `expected` and `tail` may not be columns of `docs`, whatever their case."""
    if clash := {c.lower() for c in docs.columns} & {expected.lower(), tail.lower()}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = T.StructType([*docs.schema.fields, T.StructField(expected, T.DoubleType()), T.StructField(tail, T.DoubleType())])
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.weights)
        for batch in batches:
            tails = model.tails(model.scores((x.as_py() for x in batch.column(n)), features))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(tails.sum(axis=1)), pa.array(np.ascontiguousarray(tails[:, -1]))], names=schema.names)
            give_back()

    return docs.withColumn(fresh_name(docs.columns, "_body"), F.col(text).cast("binary")).mapInArrow(run, schema)


def document_ratings(labels: DataFrame) -> DataFrame:
    """Grades of labelled documents: 0 low quality, 1 toxic, 2 neither; a null mark counts as none."""
    bad, toxic = F.coalesce("quality", F.lit(1)) == 0, F.coalesce("toxic", F.lit(0)) == 1
    return labels.select(F.col("doc_id").alias("id"), F.when(bad, 0).when(toxic, 1).otherwise(2).alias("grade"))


def filter_by_grade(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose grade is the highest with probability KEEP_AT or more; same columns."""
    model = fit(docs, document_ratings(labels), 3, id_col, text)
    expected, tail = fresh_name(docs.columns, "_grade"), fresh_name(docs.columns, "_tail")
    return add_grades(docs, model, text, expected, tail).filter(F.col(tail) >= KEEP_AT).select(*docs.columns)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the highest grade, and verdict for all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, document_ratings(read_table(spark, sf_dir, "labels")), 3)
    graded = add_grades(docs, model, "text", "expected_grade", "top_probability")
    return graded.select("doc_id", "expected_grade", "top_probability", (F.col("top_probability") >= KEEP_AT).alias("kept"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
