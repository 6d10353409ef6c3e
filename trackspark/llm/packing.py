"""Packing by best-fit decreasing, with overlong documents cut into full windows first.

Tokenising and packing happen in one map task without a shuffle: full windows leave at once, the
tails of a task are pooled up to a fixed number of tokens, and each pool is packed by best-fit
decreasing. So memory is bounded by the pool and the longest text, and a lost task is redone alone.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
)
_SPLIT, _SPACE = re.compile(WORD), re.compile(r"[\x20\x09-\x0D]")
#: The pre-token pattern of the tokenizer file, as it reads for Latin text.
_FINE_FILE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BYTES_FILE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
_LETTER, _NUMBER = re.compile("[a-zªµºß-öø-\u017F]"), re.compile("[0-9²³¹¼½¾]")
#: Without the dotted capital I, which is two characters in lower case.
_NOT_LATIN = re.compile(r"[^\x09-\x0D\x20-\x7E\u00A1-\u012F\u0131-\u017F]")
_LOWER = np.array([ord(chr(c).lower()[0]) for c in range(0x180)], np.uint16)
#: 0 white space, 1 letter, 2 number, 3 other, of lower-case characters.
_KIND = np.array([0 if _SPACE.match(c) else 1 if _LETTER.match(c) else 2 if _NUMBER.match(c) else 3 for c in map(chr, range(0x180))], np.uint8)
_TOKENIZERS: dict = {}


def latin_words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pre-tokens of Latin texts in lower case, as UTF-16, and how many the texts up to each have."""
    codes = _LOWER[np.frombuffer("\n".join([*texts, ""]).encode("utf-16-le"), np.uint16)]
    kind = _KIND[codes]
    cut = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)])
    # an apostrophe that others do not precede takes s, t, m, d, re, ve or ll along
    quote = np.flatnonzero((codes == ord("'")) & cut)
    one, two = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    cut[quote[short | long] + 1] = False
    cut[quote[short] + 2] = True
    cut[quote[long] + 3] = True
    keep = kind != 0
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(np.flatnonzero(cut & keep), ends)
    codes = codes[keep]
    offsets = np.append(np.flatnonzero(cut[keep]), len(codes)) * 2
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
    return words.dictionary_encode(), upto


class WordTokenizer:
    """Token ids of whole texts, with the ids of a bounded number of words remembered.

    Exact for tokenizers in which no token, normalisation or pattern crosses ASCII white space,
    and white space itself gives no token."""

    def __init__(self, path: str, remember: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        config = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        cuts = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        # Latin text without special tokens may be cut as the tokenizer does: more words are known
        self.fine = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [x.get("pattern", {}).get("Regex") for x in cuts] == [_FINE_FILE, None]
            and cuts[1].items() >= _BYTES_FILE.items()
            and not any(x["normalized"] for x in config["added_tokens"])
        )
        self.special = [x["content"] for x in config["added_tokens"]]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # what the model gets: one character a byte of UTF-8
        latin = "".join(map(chr, chain(range(0x21, 0x7F), range(0xA1, 0x180))))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = np.zeros(256, np.uint16)
        self.as_bytes[np.frombuffer(latin.encode(), np.uint8)] = [ord(c) for mapped, _ in level.pre_tokenize_str(latin) for c in mapped]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str | bytes, int] = {}  # Latin words as UTF-16
        self.flat, self.size = np.zeros(0, self.kind), np.zeros(0, np.int64)

    def _places(self, words: list) -> np.ndarray:
        """Where these unlike words are among the known ones; new ones are encoded."""
        places = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = [words[k] for k in np.flatnonzero(places < 0).tolist()]
        if len(self.known) + len(new) > self.remember:
            self._forget()
            new, places[:] = words, -1
        flat, size, after = [self.flat], [self.size], len(self.known)
        for at in range(0, len(new), 1 << 14):
            some = new[at : at + (1 << 14)]
            if isinstance(some[0], bytes):
                found = self._latin_ids(some)
            else:
                found = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(found), self.kind))
            size.append(np.fromiter(map(len, found), np.int64, len(found)))
        self.flat, self.size = np.concatenate(flat), np.concatenate(size)
        self.known.update(zip(new, range(after, after + len(new)), strict=True))
        places[places < 0] = np.arange(after, after + len(new))
        return places

    def _latin_ids(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens, which are in lower case and whole: the model alone gives them."""
        codes = np.frombuffer(b"\0\0".join(words).decode("utf-16-le").encode(), np.uint8)
        texts, tokenize = self.as_bytes[codes].tobytes().decode("utf-16-le").split("\0"), self.tokenizer.model.tokenize
        return [[x.id for x in tokenize(w)] for w in texts]

    def _joined(self, places: np.ndarray, upto: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of the words at places, of the first upto[0], of those up to upto[1], and so on."""
        size = self.size[places]
        ends = np.cumsum(size)
        first = (np.cumsum(self.size) - self.size)[places]
        ids = self.flat[np.repeat(first - ends + size, size) + np.arange(size.sum())]
        stops = np.concatenate([[0], ends])[upto].tolist()
        return (ids[a:b] for a, b in zip([0, *stops], stops, strict=False))

    def ids(self, texts: Iterable[str], end: int, part: int = 1 << 21) -> Iterator[np.ndarray]:
        """Ids of each text, then end. Texts are worked off in runs of about part characters; a longer
        text in parts that end at white space."""
        held: list[tuple[str, bool]] = []  # parts, and whether the text ends with them
        size, begun = 0, []
        for text in chain(texts, [None]):
            at = 0
            while text is not None and (at < len(text) or not at):
                stop = at + part
                space = _SPACE.search(text, stop) if stop < len(text) else None
                stop = space.start() if space else len(text)
                held.append((text[at:stop], stop >= len(text)))
                size += stop - at + 1
                at = max(stop, 1)
                if size < part:
                    continue
                yield from self._flush(held, begun, end)
                held, size = [], 0
        yield from self._flush(held, begun, end)

    def _flush(self, held: list, begun: list, end: int) -> Iterator[np.ndarray]:
        fine = [self.fine and not _NOT_LATIN.search(text) and not any(x in text for x in self.special) for text, _ in held]
        latin = other = iter(())
        if any(fine):
            words, upto = latin_words([text for (text, _), x in zip(held, fine, strict=True) if x])
            latin = self._joined(self._places(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()], upto)
        if not all(fine):
            cut = [_SPLIT.findall(text) for (text, _), x in zip(held, fine, strict=True) if not x]
            self._places(list(set().union(*cut)))
            places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
            other = self._joined(places, np.cumsum([len(x) for x in cut]))
        for (_, last), x in zip(held, fine, strict=True):
            begun.append(next(latin if x else other))
            if last:
                yield np.concatenate([*begun, np.array([end], self.kind)])
                begun.clear()


class CapacityTree:
    """A segment tree over the capacities 0..capacity: how many open windows have just this much left.
    tightest(n) finds the smallest capacity >= n that an open window has, in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, window: int) -> None:
        self.windows[left].append(window)
        self._change(left, 1)

    def take(self, left: int) -> int:
        self._change(left, -1)
        return self.windows[left].pop()

    def _change(self, left: int, by: int) -> None:
        at = left + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1 and (at & 1 or not self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows, each a list of positions in lengths; no window holds more than capacity."""
    tree, windows = CapacityTree(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        left = tree.tightest(lengths[k])
        if left is None:
            windows.append([])
            left, window = capacity, len(windows) - 1
        else:
            window = tree.take(left)
        windows[window].append(k)
        if left > lengths[k]:
            tree.add(left - lengths[k], window)
    return windows


def _powers(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def pack_pool(tails: list[tuple[int, int, np.ndarray, int]], capacity: int, least_fill: float) -> Iterator[list[tuple]]:
    """Sequences of (doc_id, start, ids, doc_tokens, offset). A window filled less than least_fill is
    cut into sequences whose lengths are powers of two, which need no padding."""
    for window in best_fit_decreasing([len(t[2]) for t in tails], capacity):
        filled = sum(len(tails[k][2]) for k in window)
        sizes = _powers(filled) if filled < least_fill * capacity else [filled]
        sequence, offset = [], 0
        for k in window:
            doc, start, ids, total = tails[k]
            while len(ids):
                n = min(len(ids), sizes[0] - offset)
                sequence.append((doc, start, ids[:n], total, offset))
                start, ids, offset = start + n, ids[n:], offset + n
                if offset == sizes[0]:
                    yield sequence
                    sequence, offset, sizes = [], 0, sizes[1:]


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 2, pool_tokens: int = 1 << 23, least_fill: float = 0.98, remember: int = 1 << 20
) -> DataFrame:
    """Packs every document (doc_id, text) into sequences of at most capacity tokens.

    One row per piece: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens,
    sequence_id, offset, sequence_tokens. Null and empty texts hold the end token only. Repeated rows
    are packed as often as they occur, a null doc_id stays null, other columns are ignored, and an
    empty table gives no rows. A worker remembers the ids of at most remember words (about 200 bytes
    each). sequence_id is unique in the table: task number times 2^40 plus a counter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, remember) not in _TOKENIZERS:
            _TOKENIZERS[tokenizer, remember] = WordTokenizer(tokenizer, remember)
        tok = _TOKENIZERS[tokenizer, remember]
        number = TaskContext.get().partitionId() << 40
        tails: list[tuple[int, int, np.ndarray, int]] = []
        held, rows, size = 0, [], 0

        def put(sequence: list[tuple]) -> None:
            nonlocal number, size
            total = sum(len(x[2]) for x in sequence)
            for doc, start, ids, of, offset in sequence:
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), of, number, offset, total))
            size += 4 * total
            number += 1

        def out() -> pa.RecordBatch:
            nonlocal rows, size
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
            kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows, size = [], 0
            return batch

        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), tok.ids(texts, end), strict=True):
                full = len(ids) // capacity * capacity
                for at in range(0, full, capacity):
                    put([(doc, at, ids[at : at + capacity], len(ids), 0)])
                    if size > 1 << 24:
                        yield out()
                if full < len(ids):
                    tails.append((doc, full, ids[full:].copy(), len(ids)))
                    held += len(ids) - full
                if held >= pool_tokens:
                    for sequence in pack_pool(tails, capacity, least_fill):
                        put(sequence)
                        if size > 1 << 24:
                            yield out()
                    tails, held = [], 0
        for sequence in pack_pool(tails, capacity, least_fill):
            put(sequence)
            if size > 1 << 24:
                yield out()
        if rows:
            yield out()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, PIECES)
