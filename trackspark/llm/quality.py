"""Quality rules: word statistics, and the perplexity of a modified Kneser-Ney model per language.

The model is of n-grams of real characters, counted by Spark over all documents, and grows with
them: nothing of it is collected or broadcast. Texts are gathered in chunks of one language; each chunk
asks for the distinct n-grams that it holds by a join with the model, and gets their probabilities
back as sorted arrays of hashes, in which its texts are looked up. As a text is part of what the model
has counted, each n-gram is scored with one occurrence of it left out. Bands around the middle of each
language's perplexities reject documents that are too odd or too repetitive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, cut_in_buckets, cut_lineage

#: Symbols of an n-gram.
ORDER = 4
#: What stands before a text, and instead of U+0000 within it.
START = 1
#: Characters of a chunk of texts.
CHUNK = 1 << 25
SYMBOLS = "#*$%&|<>"
_WORDS = re.compile(WORD)


def symbols(text: str, order: int = ORDER) -> np.ndarray:
    """Code points of the lower-cased text, runs of white space as one space, led by order - 1 start
    symbols and followed by a space."""
    codes = np.frombuffer(f"{text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]
    return np.concatenate([np.full(order - 1, START, np.uint32), np.where(blank, np.uint32(32), np.maximum(codes, START))[keep]])


def hashed(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of n-grams."""
    x = np.zeros(len(windows), np.uint64)
    for k in range(windows.shape[1]):
        x = (x ^ windows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def ngrams(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-grams of symbols, a row each (a view)."""
    return np.lib.stride_tricks.sliding_window_view(codes, order)


class Counter:
    """Distinct n-grams and their counts, gathered text by text."""

    def __init__(self, order: int):
        self.order, self.pending, self.size = order, [], 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, text: str) -> None:
        codes = symbols(text, self.order)
        for at in range(0, len(codes) - self.order + 1, 1 << 20):  # a very long text in pieces that overlap
            self._put(codes[at : at + (1 << 20) + self.order - 1])

    def _put(self, codes: np.ndarray) -> None:
        self.pending.append(ngrams(codes, self.order))
        self.size += len(codes)
        if self.size >= 1 << 20:
            self._sum()

    def _sum(self) -> None:
        if self.pending:
            windows = np.concatenate(self.pending)
            self.parts.append(self._distinct(windows, np.ones(len(windows), np.int64)))
            self.pending, self.size = [], 0

    @staticmethod
    def _distinct(windows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = pa.array(hashed(windows)).dictionary_encode()
        at = found.indices.to_numpy()
        first = np.empty(len(found.dictionary), np.int64)
        first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
        return found.dictionary.to_numpy(), windows[first], np.bincount(at, n, len(first)).astype(np.int64)

    def counts(self) -> tuple[list[str], np.ndarray]:
        """The n-grams in the order of their hashes, and their counts."""
        self._sum()
        hashes, windows, n = self._distinct(np.concatenate([p[1] for p in self.parts]), np.concatenate([p[2] for p in self.parts]))
        order = np.argsort(hashes)
        text = windows[order].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [text[k : k + self.order] for k in range(0, len(text), self.order)], n[order]


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
    else:
        windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= again
    return int(covered.sum())


def base_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


STATISTICS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))])
_CHUNKS = "chunk long, lang string, docs binary, grams array<string>, n array<long>"


def _packed(rows: list[tuple]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DOCS, strict=True)], schema=_DOCS)
    return zstandard.ZstdCompressor(level=3).compress(batch.serialize().to_pybytes())


def chunks(docs: DataFrame, order: int, most: int) -> DataFrame:
    """_CHUNKS: texts of one language with their statistics, packed, and the distinct n-grams in them,
    in the order of their hashes, with counts. A task holds most characters of texts, and one more text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[list[tuple], Counter]] = {}
        sizes: dict[str | None, int] = {}
        number = TaskContext.get().partitionId() << 32

        def out(lang: str | None) -> pa.RecordBatch:
            nonlocal number
            rows, counter = held.pop(lang)
            sizes.pop(lang)
            grams, n = counter.counts() if counter.size or counter.parts else ([], [])
            number += 1
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((number, lang, _packed(rows), grams, n), kinds, strict=True)], [x.split()[0] for x in _CHUNKS.split(", ")])

        for batch in batches:
            for doc, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                if lang not in held:
                    held[lang], sizes[lang] = ([], Counter(order)), 0
                held[lang][0].append((doc, text, *base_statistics(text)))
                if text:
                    held[lang][1].add(text)
                sizes[lang] += len(text) + 64
                if sum(sizes.values()) >= most:
                    yield out(max(sizes, key=sizes.get))
        for lang in list(held):
            yield out(lang)

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(work, _CHUNKS)


def _discounts(c: Column) -> list[Column]:
    """The three modified Kneser-Ney discounts of an aggregation over counts c, by count 1, 2 and 3 or more."""
    n = [F.count_if(c == k) for k in range(1, 5)]
    some = n[0] * n[1] * n[2] * n[3] > 0
    y = F.try_divide(n[0], n[0] + 2 * n[1])
    return [F.when(some, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.try_divide(n[k], n[k - 1])))).otherwise(k / 2) for k in (1, 2, 3)]


def _off(c: Column) -> Column:
    """The discount of count c, from the columns d1, d2, d3."""
    return F.when(c <= 0, F.lit(0.0)).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def model(counts: DataFrame, order: int) -> DataFrame:
    """key, gram, logp of each n-gram of counts (key, gram, c): interpolated modified Kneser-Ney, one
    occurrence of the n-gram left out.

    Lower orders count the distinct symbols before an n-gram. Leaving an occurrence out takes one off its
    count, and if that was the last one, off the count of the n-gram's end in the order below, and so
    on: whole and less are a level's probabilities as it is and with one off. All joins are on
    n-grams or their contexts, and rows are distinct n-grams, so no text is a hot key."""
    levels = [counts]
    for _ in range(order - 1):
        levels.append(cut_lineage(levels[-1].groupBy("key", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("c"))))
    c, below = F.col("c"), None
    for k, level in enumerate(reversed(levels), 1):
        level = level.join(level.groupBy("key").agg(*[d.alias(f"d{j}") for j, d in enumerate(_discounts(c), 1)], F.count("*").alias("vocabulary")), "key")
        if k == 1:
            context, level = ["key"], level.withColumn("low", 1 / (F.col("vocabulary") + 1)).withColumn("less_low", F.col("low"))
        else:
            context = ["key", "context"]
            level = level.withColumns({"context": F.substring("gram", 1, k - 1), "end": F.substring("gram", 2, k)})
            level = level.join(below, ["key", "end"]).withColumn("less_low", F.when(c == 1, F.col("less_low")).otherwise(F.col("low")))
        level = level.join(level.groupBy(*context).agg(F.sum("c").alias("total"), F.sum(_off(c)).alias("mass")), context)
        whole = (c - _off(c) + F.col("mass") * F.col("low")) / F.col("total")
        mass = F.col("mass") - _off(c) + _off(c - 1)
        less = F.when(F.col("total") > 1, (c - 1 - _off(c - 1) + mass * F.col("less_low")) / (F.col("total") - 1)).otherwise(F.col("less_low"))
        if k == order:
            return level.select("key", "gram", F.log(less).cast("float").alias("logp"))
        below = cut_lineage(level.select("key", F.col("gram").alias("end"), whole.alias("low"), less.alias("less_low")))
    raise ValueError("order must be 1 at least")


def _means(texts: list[str], hashes: np.ndarray, logp: np.ndarray, order: int) -> list[float | None]:
    """The mean of logp over the n-grams of each text, by their place in the sorted hashes; None without text."""
    totals, counts = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    of: list[int] = []

    def look_up() -> None:
        found = pa.array(np.concatenate(held)).dictionary_encode()
        each = logp[np.searchsorted(hashes, found.dictionary.to_numpy())][found.indices.to_numpy()]
        np.add.at(totals, of, np.add.reduceat(each, np.cumsum([0, *map(len, held)])[:-1]))
        held.clear()
        of.clear()

    size = 0
    for k, text in enumerate(texts):
        codes = symbols(text, order) if text else np.zeros(0, np.uint32)
        for at in range(0, len(codes) - order + 1, 1 << 20):
            held.append(hashed(ngrams(codes[at : at + (1 << 20) + order - 1], order)))
            of.append(k)
            counts[k] += len(held[-1])
            size += len(held[-1])
            if size >= 1 << 20:
                look_up()
                size = 0
    if held:
        look_up()
    return [float(t / n) if n else None for t, n in zip(totals, counts, strict=True)]


def _scored(rows: DataFrame, order: int) -> DataFrame:
    """STATISTICS of the texts in rows (lang, docs, grams, found: idx and logp of each n-gram)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang, packed = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                docs = pa.ipc.read_record_batch(pa.py_buffer(zstandard.ZstdDecompressor().decompress(packed)), _DOCS)
                grams = "".join(batch.column(2)[k].as_py()).encode("utf-32-le", "surrogatepass")
                hashes = hashed(np.frombuffer(grams, np.uint32).reshape(-1, order))
                found = batch.column(3)[k].values
                logp = np.full(len(hashes), np.nan)
                if found is not None:
                    logp[found.field("idx").to_numpy()] = found.field("logp").to_numpy()
                if np.isnan(logp).any():
                    raise ValueError("n-grams of a text are missing from the model")

                values = [None if x is None else -x for x in _means(docs.column(1).to_pylist(), hashes, logp, order)]
                yield pa.RecordBatch.from_arrays([docs.column(0), pa.array([lang] * docs.num_rows, pa.string()), *(docs.column(c) for c in range(2, 7)), pa.array(values, pa.float64())], [x.split()[0] for x in STATISTICS.split(", ")])

    return rows.mapInArrow(work, STATISTICS)


def score(docs: DataFrame, order: int = ORDER, most: int = CHUNK) -> DataFrame:
    """STATISTICS of each row of docs (doc_id, lang, text); log_perplexity is null without text."""
    held = cut_in_buckets(chunks(docs, order, most), "chunk")  # so the texts in it are never shuffled
    # null is a language, and not the empty string
    key = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("-")).alias("key")
    asked = held.select("chunk", key, F.posexplode(F.arrays_zip("grams", "n")).alias("idx", "g")).select("chunk", "idx", "key", F.col("g.grams").alias("gram"), F.col("g.n").alias("n"))
    counts = cut_lineage(asked.groupBy("key", "gram").agg(F.sum("n").alias("c")))
    told = asked.join(model(counts, order), ["key", "gram"]).groupBy("chunk").agg(F.collect_list(F.struct("idx", "logp")).alias("found"))
    return _scored(held.join(told, "chunk", "left").select("lang", "docs", "grams", "found"), order)


def judge_quality(docs: DataFrame, lower: float = 4.0, upper: float = 6.0, least_words: int = 50, most_repeated: int = 50, grid: int = 512, order: int = ORDER) -> DataFrame:
    """doc_id, the statistics, base_failed, perplexity and kept of each row of docs (doc_id, lang, text).

    base_failed: fewer than least_words words, or over most_repeated per cent repeated words. kept:
    not base_failed, and the log perplexity lies within the language's band, from lower times the
    interquartile range below the lower quartile to upper times it above the upper one. Quartiles are taken
    on a grid over all documents that have not base_failed, so they are exact and the same in every
    run; the range is at least two steps of the grid. Null and empty texts have no words and fail;
    a null lang is a language; repeated rows and null ids stay; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = cut_lineage(score(docs, order).withColumn("base_failed", failed))
    steps = rows.where("not base_failed").groupBy("lang", F.round(F.col("log_perplexity") * grid).cast("long").alias("step")).count()
    bands = steps.groupBy("lang").agg(F.percentile("step", F.array(F.lit(0.25), F.lit(0.75)), F.col("count")).alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(2.0))
    bands = bands.select(F.col("lang").alias("its"), ((F.col("q")[0] - lower * spread) / grid).alias("lower"), ((F.col("q")[1] + upper * spread) / grid).alias("upper"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return rows.join(bands, F.col("lang").eqNullSafe(F.col("its")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.exp("log_perplexity").alias("perplexity"), kept.alias("kept")
    )
