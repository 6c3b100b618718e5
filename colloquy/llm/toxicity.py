"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, materialize, read_table

#: Lengths of the n-grams, in code points of a word with a space before and after it.
GRAMS = (3, 4, 5, 6)
#: Hash buckets of n-grams, as a power of two.
BUCKET_BITS = 22
#: The bound of the fitting sample: labelled ids, those with the least hash. Everything is scored.
SAMPLE_ROWS = 16_000
#: n-grams in fewer labelled texts than this have no feature.
MIN_TEXTS = 3
#: Added to the counts of which the log-count ratios are made.
SMOOTHING = 1.0
#: An n-gram whose occurrence says so little about the label that chance would has no feature
#: (likelihood-ratio statistic with one degree of freedom: one in two thousand exceed it).
MIN_ASSOCIATION = 12.0
#: Strength of the quadratic penalty on the weights.
PENALTY = 0.5
STEPS = 30
#: A text is taken to be toxic from this score on.
TOXIC_AT = 0.3
#: Distinct words whose features are remembered, before the memory is emptied, and the longest such word.
MEMORY_WORDS = 200_000
MEMORY_LENGTH = 64
#: Code points hashed at once, so that the memory of a long text is bounded.
CHUNK = 1 << 16
#: Bytes of texts, or one text, whose words are held at once.
TEXTS_AT_ONCE = 1 << 19


def words_of(text: str | None) -> set[str]:
    """Distinct words of a text, lower-cased."""
    return set((text or "").lower().split())


def gram_buckets(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of the words, and the place in `words` of the one that each is of."""
    longest = max(GRAMS)
    at = 0
    while at < len(words):
        pieces, of, held = [], [], 0
        while at < len(words) and held < CHUNK:
            padded = f" {words[at]} "
            # A word beyond the bound is cut; each n-gram is in some piece.
            for i in range(0, max(1, len(padded) - longest + 1), CHUNK):
                pieces.append(padded[i : i + CHUNK + longest - 1])
                of.append(at)
                held += len(pieces[-1])
            at += 1
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.uint64)
        piece = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
        owner = np.array(of)[piece]
        mixed, found, owners = np.zeros(len(codes), np.uint64), [], []
        for n in range(1, min(longest, len(codes)) + 1):
            mixed = (mixed[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            if n in GRAMS:
                inside = piece[: len(mixed)] == piece[n - 1 :]
                found.append(((mixed[inside] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                owners.append(owner[: len(mixed)][inside])
        yield np.concatenate(found), np.concatenate(owners)


def blocks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in order, in blocks of about TEXTS_AT_ONCE bytes."""
    block, size = [], 0
    for x in texts:
        block.append(x.as_py())
        size += len(block[-1] or "")
        if size >= TEXTS_AT_ONCE:
            yield block
            block, size = [], 0
    yield block


def distinct_buckets(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's n-grams, ascending."""
    found = [np.unique(b) for b, _ in gram_buckets(list(words_of(text)))]
    return found[0] if len(found) == 1 else np.unique(np.concatenate([np.zeros(0, np.int64), *found]))


class Features:
    """Places, among `names` (buckets, ascending), of a text's n-grams that have a feature. Words are looked
    up once and remembered."""

    def __init__(self, names: np.ndarray) -> None:
        self._place = np.full(1 << BUCKET_BITS, -1, np.int32)
        self._place[names] = np.arange(len(names), dtype=np.int32)
        self._known: dict[str, tuple[int, ...]] = {}

    def _look_up(self, words: list[str]) -> dict[str, set[int]]:
        found: dict[str, set[int]] = {}
        for buckets, owner in gram_buckets(words):
            place = self._place[buckets]
            hit = np.flatnonzero(place >= 0)
            for o, p in zip(owner[hit].tolist(), place[hit].tolist(), strict=True):
                found.setdefault(words[o], set()).add(p)
        return found

    def of(self, texts: list[str | None]) -> list[set[int]]:
        distinct = [words_of(t) for t in texts]
        if len(self._known) > MEMORY_WORDS:
            self._known = {}
        known = self._known
        new = list(set().union(*distinct).difference(known))
        looked = self._look_up(new)
        for w in new:
            if len(w) <= MEMORY_LENGTH:
                known[w] = tuple(looked.get(w, ()))
        return [set().union(*[known[w] if w in known else looked.get(w, ()) for w in words]) for words in distinct]


@dataclass
class ToxicityModel:
    """P(toxic) = sigmoid(bias + the sum of `weights` of a text's n-grams). names: their buckets, ascending. A
    weight is what the classifier learned for the n-gram times its log-count ratio; ratios: the latter alone."""

    names: np.ndarray
    weights: np.ndarray
    ratios: np.ndarray
    bias: float

    def scores(self, found: list[set[int]]) -> np.ndarray:
        """Of texts with these features. Added up in one order, so that equal texts have equal scores."""
        w = self.weights.tolist()
        total = np.array([sum(w[i] for i in sorted(f)) for f in found], np.float64) + self.bias
        return 0.5 * (1 + np.tanh(0.5 * total))


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of the share of toxic texts that have each n-gram over that of other texts, smoothed."""
    return np.log((toxic + smoothing) / (n_toxic + 2 * smoothing)) - np.log((other + smoothing) / (n_other + 2 * smoothing))


def fit_scaled(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression on features whose value is their ratio where they occur:
    the minimum of the summed log loss and penalty / 2 * |weights|^2, by Newton steps whose equations are
    solved by conjugate gradients. Text rows[i] has feature cols[i]; the bias is not penalised."""
    n, k = len(toxic), len(ratios)
    value = ratios[cols]

    def forward(w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(rows, w[cols] * value, n) + b

    def backward(of_text: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(cols, of_text[rows] * value, k), float(of_text.sum())

    def loss(w: np.ndarray, b: float) -> float:
        z = forward(w, b)
        return float((np.logaddexp(0, z) - toxic * z).sum() + penalty / 2 * (w @ w))

    share = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    at = loss(w, b)
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(0.5 * forward(w, b)))
        gw, gb = backward(p - toxic)
        gw += penalty * w
        curve = p * (1 - p) + 1e-9
        dw, db = _solve(lambda x, y, c=curve: backward(c * forward(x, y)), gw, gb, penalty)
        slope = float(gw @ dw + gb * db)
        size = 1.0
        while size > 1e-6 and loss(w - size * dw, b - size * db) > at - 1e-4 * size * slope:
            size /= 2
        if size <= 1e-6:
            break
        w, b = w - size * dw, b - size * db
        before, at = at, loss(w, b)
        if before - at < 1e-8 * (1 + at):
            break
    return w, b


def _solve(product, gw: np.ndarray, gb: float, penalty: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Conjugate gradients on (H + penalty) d = g."""
    x, r = np.zeros(len(gw) + 1), np.append(gw, gb)
    d, square = r.copy(), float(r @ r)
    goal = 1e-8 * square
    for _ in range(rounds):
        if square <= goal:
            break
        hw, hb = product(d[:-1], d[-1])
        h = np.append(hw + penalty * d[:-1], hb)
        step = square / max(float(d @ h), 1e-300)
        x += step * d
        r -= step * h
        square, last = float(r @ r), square
        d = r + (square / last) * d
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fits on at most `sample_rows` labelled ids. labels: `id`, `toxic` (0 or 1); null ids and labels are
    left out, of several labels of an id the greatest counts, of several texts of an id that with the least
    hash. Ids are sampled by their hashes, ties by the ids. One label only, or none, gives a model whose
    score is that share (smoothed) for all texts. Texts and n-grams that tell nothing stay on the
    executors; the driver gets the sample's telling ones as numbers."""
    marked = labels.filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = F.broadcast(materialize(marked.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "toxicity-sample"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body")).join(sample, "id")
    rows = rows.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min_by("body", F.xxhash64("body")).alias("body"))
    held = materialize(rows.select((F.col("toxic") == 1).cast("int").alias("toxic"), "body"), "toxicity-texts")
    of = {r.toxic: r["count"] for r in held.groupBy("toxic").count().collect()}
    n_toxic, n_other = of.get(1, 0), of.get(0, 0)
    counts = telling_grams(gram_counts(held), n_toxic, n_other).toArrow()
    order = np.argsort(counts.column("gram").to_numpy())
    names, toxic, other = (counts.column(c).to_numpy()[order].astype(np.int64) for c in ("gram", "toxic", "other"))
    if not n_toxic or not n_other:
        none = np.zeros(0)
        return ToxicityModel(none.astype(np.int64), none, none, float(np.log((n_toxic + SMOOTHING) / (n_other + SMOOTHING))))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(names)
        for batch in batches:
            found = [np.array(sorted(x), np.int32) for block in blocks(batch.column(1)) for x in features.of(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "places"])

    small = held.mapInArrow(select, "toxic int, places array<int>").toArrow()
    columns = [x.values.to_numpy() for chunk in small.column("places").chunks for x in chunk]
    marks = small.column("toxic").to_numpy().astype(np.float64)
    # The order of collected rows is the executors'; the sums should not depend on it.
    places = sorted(range(len(marks)), key=lambda i: (marks[i], columns[i].tobytes()))
    at = np.repeat(np.arange(len(places)), [len(columns[i]) for i in places])
    cols = np.concatenate([columns[i] for i in places]).astype(np.int64)
    ratios = log_count_ratios(toxic, other, n_toxic, n_other)
    weights, bias = fit_scaled(at, cols, marks[places], ratios)
    return ToxicityModel(names, weights * ratios, ratios, bias)


def gram_counts(held: DataFrame) -> DataFrame:
    """`gram`, `toxic`, `other`: texts of either label that have it. held: `toxic`, `body`. Partitions count
    by themselves, in arrays of as many numbers as there are buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for batch in batches:
            for mark, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[mark][distinct_buckets(body.as_py())] += 1
        there = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(there), CHUNK):
            grams = there[i : i + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), *(pa.array(counts[m][grams].astype(np.int64)) for m in (1, 0))], names=["gram", "toxic", "other"])

    parts = held.mapInArrow(run, "gram int, toxic long, other long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def telling_grams(counts: DataFrame, n_toxic: int, n_other: int) -> DataFrame:
    """The rows of `gram_counts` whose n-grams get a feature: in MIN_TEXTS texts and with MIN_ASSOCIATION.
    n_toxic, n_other: texts of either label."""
    seen, n = F.col("toxic") + F.col("other"), n_toxic + n_other
    parts = ((F.col("toxic"), seen, n_toxic), (F.col("other"), seen, n_other), (n_toxic - F.col("toxic"), n - seen, n_toxic), (n_other - F.col("other"), n - seen, n_other))
    statistic = F.lit(0.0)
    for part, of_row, of_column in parts:
        statistic = statistic + F.when(part > 0, 2 * part * F.log(part * float(n) / (of_row * float(max(1, of_column))))).otherwise(0.0)
    return counts.filter((seen >= MIN_TEXTS) & (statistic >= MIN_ASSOCIATION))


def add_scores(docs: DataFrame, model: ToxicityModel, text: str, out: str) -> DataFrame:
    """`docs` with the probability `out` that each whole text is toxic. Null and blank texts have no n-grams:
    the bias alone. Equal texts get equal scores; an empty table stays empty. `out` may not be a column of
    `docs`, whatever its case."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} is there already")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.names)
        for batch in batches:
            scores = np.concatenate([model.scores(features.of(block)) for block in blocks(batch.column(n))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores)], names=schema.names)

    return docs.withColumn(fresh_name(docs.columns, "_body"), F.col(text)).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether labels of the document are kept from fitting; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict for all documents, learned from the labels of those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "toxic")
    model = fit(docs, labels)
    scored = add_scores(docs, model, "text", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


QUERIES = {"op11_toxicity": op11_toxicity}
ORACLE_SQL: dict[str, str] = {}
