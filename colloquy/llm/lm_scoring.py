"""Language-model scores by a weighted backoff automaton over word pairs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared_files
from .common import fresh_path, read_table

#: Pseudo-count of every unigram.
ALPHA = 0.1
#: Pseudo-count of the unigram distribution in each state (Dirichlet smoothing).
MU = 150.0
#: Tokens after which a partition's documents are a block of their own, which bounds a task's memory.
BLOCK_TOKENS = 4_500_000
#: Tokens looked up at once.
SLICE = 1 << 19
#: Bytes of input for each range of keys, and the most ranges: a task holds the counts of one range.
RANGE_BYTES = 5 << 20
MOST_RANGES = 8192
BLOCKS = 1 << 20

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    """Every tenth document by the CRC-32 of its id as text (a null id: of an empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class BackoffAutomaton:
    """States are the word last read, and the root. A state has an arc for each word that was seen
    after it, and a failure arc to the root, which has an arc for every word. Any arc for a word
    leads to that word's state. Weights are log10 probabilities (a failure arc's: the log of the
    mass left for words without an arc).

    root: weight of each word; fail: weight of each state's failure arc; arcs: sorted codes
    state * len(root) + word, and their weights.
    """

    ROOT = -1

    def __init__(self, root: np.ndarray, fail: np.ndarray, arcs: np.ndarray, weights: np.ndarray) -> None:
        self.root, self.fail, self.arcs, self.weights = root, fail, arcs, weights

    @classmethod
    def of_counts(cls, unigrams: np.ndarray, pairs: np.ndarray, counts: np.ndarray, tokens: int, kinds: int, mu: float = MU, alpha: float = ALPHA) -> BackoffAutomaton:
        """unigrams: count of each word; pairs, counts: sorted codes first * words + second, and how
        often they were seen; tokens, kinds: all and distinct words of the training texts. What
        follows a word adds up to its count, so each state's weights are those of a distribution."""
        p = (unigrams + alpha) / (tokens + alpha * (kinds + 1))
        seen = counts > 0
        pairs, counts = pairs[seen], counts[seen]
        first, second = pairs // len(unigrams), pairs % len(unigrams)
        return cls(np.log10(p), np.log10(mu / (unigrams + mu)), pairs, np.log10((counts + mu * p[second]) / (unigrams[first] + mu)))

    def step(self, state: int, word: int) -> tuple[int, float]:
        """Next state and weight of reading `word`."""
        if state == self.ROOT:
            return word, float(self.root[word])
        code = state * len(self.root) + word
        at = int(np.searchsorted(self.arcs, code))
        if at < len(self.arcs) and self.arcs[at] == code:
            return word, float(self.weights[at])
        return word, float(self.fail[state] + self.root[word])

    def traverse(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Accumulated weight of each of several texts, that begin at `starts` in `words`, from the
        root. One pass from left to right; as each arc leads to its word's state, the states that
        the pass carries are the words one place before."""
        if not len(words):
            return np.zeros(len(starts))
        states = np.concatenate((np.array([self.ROOT], words.dtype), words[:-1]))
        states[starts] = self.ROOT
        weight = np.empty(len(words))
        for at in range(0, len(words), SLICE):
            state, word = states[at : at + SLICE].astype(np.int64), words[at : at + SLICE]
            found = self.root[word] + np.where(state == self.ROOT, 0.0, self.fail[state])
            if len(self.arcs):
                code = state * len(self.root) + word
                place = np.minimum(np.searchsorted(self.arcs, code), len(self.arcs) - 1)
                has_arc = (self.arcs[place] == code) & (state != self.ROOT)
                found[has_arc] = self.weights[place[has_arc]]
            weight[at : at + SLICE] = found
        return np.add.reduceat(weight, starts)


@dataclass
class Block:
    """Documents of a task, as numbers of the block's own words; word 0 is the end of a text."""

    number: int
    ids: list[int | None]
    words: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray

    def pairs(self, train: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct codes of the pairs within texts, and how often each begins at a place
        where `train` is true (nowhere without it)."""
        codes = self.words[:-1].astype(np.int64)
        codes *= len(self.hashes)
        codes += self.words[1:]
        codes <<= 1
        if train is not None:
            codes |= train[:-1]
        inside = np.ones(len(codes), bool)
        inside[self.starts[1:] - 1] = False
        codes = codes[inside]
        codes.sort()
        marks = (codes & 1).astype(np.int32)
        codes >>= 1
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[first], np.add.reduceat(marks, first) if len(first) else marks

    def keys(self, pairs: np.ndarray) -> np.ndarray:
        """Unsigned 64-bit keys of all words, then of the pairs; even for words, odd for pairs."""
        n = len(self.hashes)
        one = np.uint64(1)
        with np.errstate(over="ignore"):
            mixed = self.hashes[pairs // n] * np.uint64(0x9E3779B97F4A7C15) ^ (self.hashes[pairs % n] + np.uint64(0x632BE59BD9B4E019))
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        return np.concatenate((self.hashes & ~one, mixed | one))


def blocks(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[Block]:
    """A partition's documents (id, UTF-8 text or null) in blocks of BLOCK_TOKENS and at least one."""
    known: dict[bytes, int] = {b"\x00 end": 0}  # no word has a space in it
    ids: list[int | None] = []
    words: list[np.ndarray] = []
    size, number = 0, part * BLOCKS

    def block() -> Block:
        lengths = np.array([len(w) for w in words], np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        return Block(number, list(ids), np.concatenate(words), np.cumsum(lengths) - lengths, hashes)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            split = (text.as_py() or b"").lower().split()
            new = set(split).difference(known)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            found = np.zeros(len(split) + 1, np.int32)
            found[:-1] = np.fromiter(map(known.__getitem__, split), np.int32, len(split))
            ids.append(doc)
            words.append(found)
            size += len(found)
            if size >= BLOCK_TOKENS:
                yield block()
                known, ids, words, size, number = {b"\x00 end": 0}, [], [], 0, number + 1
    if ids:
        yield block()


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, small: differences and counts by planes of bytes, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [a.astype(k).view(np.uint8).reshape(len(a), 8).T.tobytes() for a, k in ((steps, "<u8"), (counts, "<u8"))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    both = raw.reshape(2, 8, -1).transpose(0, 2, 1).copy().view("<u8")[..., 0]
    return np.cumsum(both[0], dtype=np.uint64), both[1].astype(np.int64)


def _ranges(docs: DataFrame) -> int:
    """Ranges of keys for a table, of its size as the optimizer knows it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 64 if size > 1 << 55 else max(4, min(MOST_RANGES, -(-size // RANGE_BYTES)))


def _range_starts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` equal parts of all 64-bit keys begins and ends in sorted keys."""
    edges = np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _count(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Every word and pair of every block with its count in the block's training documents, packed by
    range of keys."""
    for block in blocks(batches, TaskContext.get().partitionId()):
        train = np.repeat([not is_held_out(i) for i in block.ids], np.diff(np.append(block.starts, len(block.words))))
        pairs, of_pairs = block.pairs(train)
        of_words = np.bincount(block.words[train], minlength=len(block.hashes))
        keys, counts = block.keys(pairs), np.concatenate((of_words, of_pairs))
        del pairs, of_pairs, train
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        cuts = _range_starts(keys, ranges)
        packed = [pack_counts(keys[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([block.number] * ranges, pa.int64()), pa.array(packed, pa.binary())], names=["part", "block", "counts"])


def _sum_range(key: tuple, table: pa.Table) -> pa.Table:
    """Gives every block the sums of its own keys of one range, in the order of the keys; with the
    first also the words (even keys) that were seen, and how often."""
    numbers = table.column("block").to_pylist()
    parts = [unpack_counts(x.as_py()) for x in table.column("counts")]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
    of_words = sums[keys % np.uint64(2) == 0]
    totals, start = [], 0
    for k, _ in parts:
        totals.append(zstandard.ZstdCompressor(level=1).compress(sums[at[start : start + len(k)]].astype("<i8").view(np.uint8).reshape(len(k), 8).T.tobytes()))
        start += len(k)
    rest = [0] * (len(numbers) - 1)
    columns = [[key[0].as_py()] * len(numbers), numbers, totals, [int((of_words > 0).sum()), *rest], [int(of_words.sum()), *rest]]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "block", "totals", "kinds", "tokens"])


def _file(number: int) -> str:
    return f"block-{number:013d}.zst"


def _read_totals(stream: IO[bytes]) -> Iterator[np.ndarray]:
    while head := stream.read(8):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(stream.read(int.from_bytes(head, "little"))), np.uint8)
        yield raw.reshape(8, -1).T.copy().view("<i8")[:, 0]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mu: float = MU) -> DataFrame:
    """One row per row of `docs` (columns: SCORES): tokens, tokens seen in training, the base score
    and the automaton's, both log10 probabilities of the whole text with its end.

    The model is learnt from all documents that are not held out. It is as large as they are, and
    never in one place: words and pairs are counted block by block, the counts are summed range by
    range of their keys, and each block gets back, as a file in the shared folder, the sums of its
    own words and pairs, from which its task builds the part of the automaton that its texts can
    reach.

    `docs` is read twice and its partitions must be the same both times, as those of files are; a
    block that differs fails the job. Null and blank texts are an end alone. Null ids count as held
    out; repeated rows count each. Without training texts all weights are those of no counts. An
    empty table gives an empty result.
    """
    folder = fresh_path(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    ranges = _ranges(docs)
    counted = rows.mapInArrow(lambda batches: _count(batches, ranges), "part int, block long, counts binary")
    summed = counted.groupBy("part").applyInArrow(_sum_range, "part int, block long, totals binary, kinds long, tokens long")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = None, None
        kinds = tokens = count = 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["block"] != now:
                        if out is not None:
                            out.commit()
                        now = row["block"]
                        out = shared_files.Committed(folder, _file(now))
                        count += 1
                    out.stream.write(len(row["totals"]).to_bytes(8, "little") + row["totals"])
                    kinds, tokens = kinds + row["kinds"], tokens + row["tokens"]
            if out is not None:
                out.commit()
        except BaseException:
            if out is not None:
                out.abort()
            raise
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (count, kinds, tokens)], names=["blocks", "kinds", "tokens"])

    files = summed.repartition("block").sortWithinPartitions("block", "part")
    files.mapInArrow(store, "blocks long, kinds long, tokens long").write.parquet(f"{folder}/_blocks")
    of_all = docs.sparkSession.read.parquet(f"{folder}/_blocks").agg(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens")).first()
    kinds, tokens = of_all.kinds or 0, of_all.tokens or 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, root = shared_files.at(folder)
        for block in blocks(batches, TaskContext.get().partitionId()):
            pairs, _ = block.pairs()
            keys = block.keys(pairs)
            order = np.argsort(keys, kind="stable")
            with source.open_input_stream(f"{root}/{_file(block.number)}", compression=None) as f:
                found = np.concatenate(list(_read_totals(f)))
            if len(found) != len(keys):
                raise RuntimeError(f"block {block.number} differs from the one that was counted: the input's partitions changed")
            totals = np.empty(len(keys), np.int64)
            totals[order] = found
            del keys, order, found
            n = len(block.hashes)
            model = BackoffAutomaton.of_counts(totals[:n], pairs, totals[n:], tokens, kinds, mu)
            known = np.add.reduceat((totals[:n] > 0)[block.words].astype(np.int64), block.starts)
            base = np.add.reduceat(model.root[block.words], block.starts)
            sizes = np.diff(np.append(block.starts, len(block.words)))
            out = [
                pa.array(block.ids, pa.int64()),
                pa.array([is_held_out(i) for i in block.ids]),
                pa.array(sizes),
                pa.array(known),
                pa.array(np.full(len(sizes), tokens)),
                pa.array(base),
                pa.array(model.traverse(block.words, block.starts)),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in SCORES.split(", ")])

    return rows.mapInArrow(score, SCORES)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored."""
    return score_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
