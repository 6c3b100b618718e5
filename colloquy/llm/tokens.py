"""Token ids of whole texts at memory-bounded batches, by a public tokenizer file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Bytes of text tokenized at once; a longer text is cut at white space.
BATCH_BYTES = 1 << 20
#: Distinct words, and bytes of them, that are remembered; beyond, those met once are forgotten.
MEMORY_WORDS = 200_000
MEMORY_BYTES = 4 << 20
#: Words in one request to the tokenizer.
JOINED = 64
#: Words whose ids are put together at once.
GATHERED = 1 << 17
#: Marks that such a tokenizer parts from letters before them.
MARKS = ".,;:!?"
#: Words of these letters only are one word to the tokenizer, whatever its Unicode tables: Latin (but for
#: two letters whose lower or composed form has a mark) and Cyrillic. Others are asked for one by one.
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſА-я]{1,63}$"
#: The letter of each byte in byte-level vocabularies: itself, or one past 255 where it is none that prints.
_LETTERS = np.arange(256, dtype="<u4")
_LETTERS[[*range(33), *range(127, 161), 173]] = 256 + np.arange(68)
_LETTERS[ord(" ")] = ord(" ")
#: Texts on which the shortcuts must give the ids of the whole text, or they are not taken.
_PROBES = ("One two,  three.\nFOUR five!? it's 3.14 x-y", "a\tb\r\nc \x0bd\x0ce", "Ünïcode Straße, мир. (see) [1] foo_bar", "word word. Word, WORD;", " lead and trail ")

def default_tokenizer() -> str:
    """Path of the vocabulary with word ends; a parameter of every operator that takes ids."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _strings(texts: pa.Array) -> pa.Array:
    """Bytes as strings; null is empty, and what is no UTF-8 gets replacement characters."""
    try:
        return pc.cast(texts.fill_null(b""), pa.string())
    except pa.ArrowInvalid:
        return pa.array([(x or b"").decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())


class WordTokenizer:
    """Ids of texts by a `tokenizers` file whose rules never join what white space parts.

    Such a tokenizer (it drops white space, and parts letters from marks, before it looks for pieces)
    gives a text the ids of its white-space-free runs in order, and a run of letters with marks after
    them those of both parts. So each distinct part is encoded once and remembered. Runs and parts are
    split, told apart and looked up by Arrow; only new ones are Python strings. Plain ones get their ids
    of the file's model without its rules for text, which cost more than the model. For a file that
    fails a probe of all this every text is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self._tokenizer = Tokenizer.from_file(path)
        # The same model for plain words in small letters, which the file's own rules would only look at.
        self._of_plain = Tokenizer(self._tokenizer.model)
        self._of_plain.pre_tokenizer = WhitespaceSplit()
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self._is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()
        probes = pa.array([t.encode() for t in _PROBES], pa.binary())
        self._by_word = True
        self._by_word = all(np.array_equal(a, b) for a, b in zip(self._encode(probes), self._whole(probes), strict=True))
        self._forget()

    def _forget(self) -> None:
        self._known = pa.array([], pa.string())
        self._ids = np.zeros(0, np.uint32)
        self._starts = np.zeros(0, np.int64)
        self._lengths = np.zeros(0, np.int32)
        self._uses = np.zeros(0, np.int32)

    def _trim(self) -> None:
        """Keeps the words met more than once since the last time, unless they are most of them."""
        at = np.flatnonzero(self._uses > 1)
        words, ids, lengths = self._known.take(pa.array(at)), self._gather(at), self._lengths[at]
        self._forget()
        if 2 * len(words) < MEMORY_WORDS and 2 * words.nbytes < MEMORY_BYTES:
            self._store(words, ids, lengths)

    def _store(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self._known = pa.concat_arrays([self._known, words])
        self._starts = np.concatenate((self._starts, len(self._ids) + np.cumsum(lengths, dtype=np.int64) - lengths))
        self._ids = np.concatenate((self._ids, ids))
        self._lengths = np.concatenate((self._lengths, lengths.astype(np.int32)))
        self._uses = np.concatenate((self._uses, np.zeros(len(words), np.int32)))

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of remembered parts, one after the other."""
        return _joined(self._ids, self._starts[at], self._lengths[at])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where distinct parts are remembered; new ones are encoded first."""
        found = pc.index_in(parts, value_set=self._known)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            new = parts.filter(found.is_null())
            at[at < 0] = len(self._known) + np.arange(len(new))
            self._store(new, *self._ask(new))
        return at

    def _pairs(self, words: pa.Array) -> np.ndarray:
        """Where the two parts of each distinct word are remembered: letters, in small ones, and the marks
        after them; or the whole word and an empty part."""
        stems = pc.ascii_rtrim(words, characters=MARKS)
        plain = pc.match_substring_regex(stems, _PLAIN)
        first = pc.if_else(plain, pc.utf8_lower(stems), words)
        marked = np.flatnonzero(pc.and_(plain, pc.less(pc.binary_length(stems), pc.binary_length(words))).to_numpy(zero_copy_only=False))
        tails = pc.replace_substring_regex(words.take(pa.array(marked)), pattern=f"^[^{MARKS}]+", replacement="")
        parts = pa.concat_arrays([first, tails, pa.array([""])]).dictionary_encode()
        places = self._places(parts.dictionary)[parts.indices.to_numpy()]
        out = np.full((len(words), 2), places[-1])
        out[:, 0] = places[: len(words)]
        out[marked, 1] = places[len(words) : -1]
        return out

    def _ask(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of each word, of the tokenizer. Many plain words are one request; as each
        is one word to the tokenizer, the id of its end ends it."""
        plain = pc.match_substring_regex(words, _PLAIN)
        joined, alone = np.flatnonzero(plain.to_numpy(zero_copy_only=False)), np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        ids, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(joined):
            cuts = np.append(np.arange(0, len(joined), JOINED), len(joined)).astype(np.int32)
            ids, sizes = self._flat(_byte_letters(pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words.filter(plain)), " ")), self._of_plain)
            stops = np.flatnonzero(self._is_end[ids]) + 1
            row_stops = np.cumsum(sizes)
            counts = np.diff(np.searchsorted(stops, row_stops, "right"), prepend=0)
            # A row with another number of ends than of words is asked for word by word.
            odd = (counts != np.diff(cuts)) | ~self._is_end[ids[row_stops - 1]]
            if odd.any():
                of_words = np.repeat(odd, JOINED)[: len(joined)]
                joined, alone = joined[~of_words], np.concatenate((alone, joined[of_words]))
                keep = np.repeat(~odd, sizes)
                ids = ids[keep]
                stops = np.flatnonzero(self._is_end[ids]) + 1
            lengths = np.diff(stops, prepend=0)
        more, sizes = self._flat(words.take(pa.array(alone)).to_pylist(), self._tokenizer)
        ids, lengths = np.concatenate((ids, more)), np.concatenate((lengths, sizes))
        # From "joined, then alone" back to the order of the words.
        back = np.argsort(np.concatenate((joined, alone)), kind="stable")
        starts = (np.cumsum(lengths) - lengths)[back]
        lengths = lengths[back]
        return _joined(ids, starts, lengths), lengths.astype(np.int32)

    def _flat(self, rows: list[str], by: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and their number of each."""
        found = [e.ids for e in by.encode_batch_fast(rows, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _whole(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for text in _strings(texts).to_pylist():
            yield np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each of some texts, BATCH_BYTES together at most."""
        if not self._by_word:
            yield from self._whole(texts)
            return
        if len(self._known) > MEMORY_WORDS or self._known.nbytes > MEMORY_BYTES:
            self._trim()
        lists = pc.ascii_split_whitespace(_strings(texts))
        flat = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        del lists
        pairs, at = self._pairs(flat.dictionary), flat.indices.to_numpy()
        del flat
        met = np.bincount(at, minlength=len(pairs))
        self._uses += np.bincount(pairs.ravel(), np.repeat(met, 2), len(self._uses)).astype(np.int32)
        of_words, lengths = self._gather(pairs.ravel()), self._lengths[pairs].sum(axis=1, dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + GATHERED, "right")) - 1)
            part = at[bounds[first] : bounds[last]]
            ids = _joined(of_words, starts[part], lengths[part])
            cuts = np.concatenate(([0], np.cumsum(lengths[part])))[bounds[first : last + 1] - bounds[first]]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield ids[a:b]
            first = last

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each UTF-8 text (binary) in order; none for a null or blank text."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(texts):
            if sizes[at] > BATCH_BYTES and self._by_word:
                parts = _cut(texts[at].as_py())
                yield np.concatenate([ids for p in parts for ids in self._encode(pa.array([p], pa.binary()))])
                give_back()
                at += 1
                continue
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + BATCH_BYTES, "right")))
            yield from self._encode(texts.slice(at, stop - at))
            give_back()
            at = stop


def _joined(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of `ids`, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    at = np.repeat(starts - ends + lengths, lengths)
    at += np.arange(len(at))
    return ids[at]


def _byte_letters(rows: pa.Array) -> list[str]:
    """Texts with a letter for each byte, as byte-level vocabularies write them; a space stays one."""
    bounds = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    text = _LETTERS[np.frombuffer(rows.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]].tobytes().decode("utf-32-le")
    bounds = bounds - bounds[0]
    return [text[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _cut(body: bytes) -> Iterator[bytes]:
    """A long text in parts that begin at a space or line end (as long as there is one)."""
    at = 0
    while at < len(body):
        end = at + BATCH_BYTES
        if end < len(body):
            end = max(body.rfind(b" ", at + 1, end), body.rfind(b"\n", at + 1, end))
            if end < 0:
                ahead = [x for x in (body.find(b" ", at + BATCH_BYTES), body.find(b"\n", at + BATCH_BYTES)) if x >= 0]
                end = min(ahead, default=len(body))
        yield body[at:end]
        at = end


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker and file, kept between tasks."""
    return WordTokenizer(path)
