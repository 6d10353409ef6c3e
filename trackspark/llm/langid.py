"""Language identification by nearest centroid.

A text is a vector of hashed character 1- to 3-grams, weighted by TF-IDF and normalised. Each language
has several centroids, clustered from a bounded sample of labelled texts; the nearest by cosine gives
the language, and a text too far from all of them is rejected.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import bounded_batches

DIMENSIONS = 1 << 12
UNKNOWN = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: ASCII letters as they are, all else in ASCII as a space.
_ASCII = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed 1-, 2- and 3-gram of the lower-cased text occurs; anything but a letter
    is a space in ASCII, runs of spaces are one."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 128, _ASCII[np.minimum(codes, 127)], codes).astype(np.uint32)
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    counts, shift = np.zeros(DIMENSIONS, np.int64), np.uint32(20)
    mixed = codes * _MIX[0]
    for n in range(3):
        if n:
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * _MIX[n] + codes[n:] * _MIX[0]
        counts += np.bincount(mixed >> shift, minlength=DIMENSIONS)
    return counts


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


@dataclass
class CentroidModel:
    """languages[of[k]] is the language of centroid k; floor[j] the least cosine of length class j."""

    languages: list[str]
    of: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine between 0 and 1, rejected) of each text."""
        out: list = [(UNKNOWN, 0.0, True)] * len(texts)
        spoken = [k for k, t in enumerate(texts) if t and has_letter(t)]
        for at in range(0, len(spoken) if self.languages else 0, 64):
            some = spoken[at : at + 64]
            counts = np.stack([ngram_counts(texts[k]) for k in some])
            cosine = self.vectors(counts) @ self.centroids.T
            best = cosine.argmax(axis=1)
            least = self.floor[length_class(counts.sum(axis=1))]
            for k, b, c, low in zip(some, best, cosine.max(axis=1), least, strict=True):
                out[k] = (self.languages[self.of[b]], float(min(max(c, 0.0), 1.0)), bool(c < low))
        return out


def length_class(ngrams: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(ngrams, 1)).astype(int), 20)


def clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts with the first row and then the row farthest from all starts."""
    centers = vectors[:1]
    while len(centers) < min(k, len(vectors)):
        centers = np.vstack([centers, vectors[(vectors @ centers.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        moved = [vectors[own == j].sum(axis=0) if (own == j).any() else centers[j] for j in range(len(centers))]
        centers = np.stack([m / max(np.linalg.norm(m), 1e-12) for m in moved])
    return centers


def sample_of(docs: DataFrame, learn_from: Column, per_language: int, most_languages: int) -> DataFrame:
    """doc_id, hash, lang, text of the rows that fit learns from."""
    rows = docs.where(learn_from).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n_languages = rows.select("lang").distinct().count()
    if n_languages > most_languages:
        per_language = max(per_language * most_languages // n_languages, 1)
    # a row is known by its id and text; those that repeat it have its rank, and count as one
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ranked = rows.select("doc_id", "hash", "lang", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.col("hash")).alias("h"))
    ranked = ranked.withColumn("n", F.dense_rank().over(Window.partitionBy("lang", F.pmod("h", F.lit(32))).orderBy("h", "doc_id", "hash")))
    ranked = ranked.where(F.col("n") <= -(-per_language // 32))
    if per_language < 32:  # fewer rows than buckets: the lowest of the buckets' rows
        ranked = ranked.withColumn("n", F.dense_rank().over(Window.partitionBy("lang").orderBy("h", "doc_id", "hash"))).where(F.col("n") <= per_language)
    # about per_language * most_languages rows at most: the bound of this broadcast
    chosen = ranked.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("lang").alias("_lang")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")) & (F.col("lang") == F.col("_lang"))
    return rows.join(F.broadcast(chosen), same, "left_semi").groupBy("doc_id", "hash", "lang").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, learn_from: Column, per_language: int = 256, most_languages: int = 64, clusters: int = 4, slack: float = 0.5) -> CentroidModel:
    """A model of the labelled rows of docs (doc_id, text, lang) for which learn_from holds.

    Every language is learned. Bounded: per_language rows of each, the ones with the lowest hash of
    doc_id (of a null id: of the text) in each of 32 hash buckets; of more than most_languages languages
    fewer rows of each, so that their product stays (but one row at least). Only their n-gram counts reach
    the driver. Rows that share an id are rows of their own, rows with the same id, text and lang are one.
    Rows with null lang, or no letter in the text, teach nothing; no rows at all give a model that
    answers "und". slack: a text is rejected if its cosine is under slack times
    the lowest one that a training text of its length class, or a longer one, has to its centroid,
    and less for the shortest texts.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.BinaryType())
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zlib.compress(ngram_counts(t).astype(np.uint32).tobytes(), 1) if has_letter(t) else None)

    # filtered and sorted here: a filter or an order on the counts would have them made once more, of all rows
    sample: dict[str, list[bytes]] = {}
    for row in sample_of(docs, learn_from, per_language, most_languages).select("lang", counted("text").alias("v")).collect():
        if row.v is not None:
            sample.setdefault(row.lang, []).append(bytes(row.v))
    if not sample:
        return CentroidModel([], np.zeros(0, int), np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS), np.zeros(21))

    def counts(name: str) -> np.ndarray:
        return np.stack([np.frombuffer(zlib.decompress(v), np.uint32) for v in sorted(sample[name])])

    languages = sorted(sample)
    having = sum((counts(name) > 0).sum(axis=0) for name in languages)
    idf = np.log((1 + sum(map(len, sample.values()))) / (1 + having)) + 1
    model = CentroidModel(languages, np.zeros(0, int), np.zeros(0), idf, np.zeros(21))
    each = [clustered(model.vectors(counts(name)), clusters) for name in languages]
    model.of, model.centroids = np.repeat(np.arange(len(each)), [len(c) for c in each]), np.concatenate(each).astype(np.float32)
    own = np.concatenate([(model.vectors(counts(name)) @ model.centroids.T).max(axis=1) for name in languages])
    size = np.concatenate([length_class(counts(name).sum(axis=1, dtype=np.int64)) for name in languages])
    lowest = np.array([own[size >= j].min() if (size >= j).any() else np.inf for j in range(21)])
    lowest = np.where(np.isinf(lowest), lowest[np.isfinite(lowest)].max(), lowest)
    seen = size.min()  # shorter than any training text: the floor falls as the square root of the length
    lowest[:seen] = lowest[seen] * np.sqrt(0.5) ** (seen - np.arange(seen))
    model.floor = slack * lowest
    return model


def predicted(docs: DataFrame, model: CentroidModel) -> Column:
    """A struct<lang_pred, score, rejected> of docs' column text. Null texts and texts without a
    letter are "und", with score 0, and rejected. Whole texts count, and nothing but the text."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict([None if t is None else t for t in texts]), columns=["lang_pred", "score", "rejected"])

    return predict(docs["text"].cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs (doc_id, text, lang), learned
    from the rows that are not held out. Repeated rows and null ids stay; other columns are ignored."""
    model = fit(docs, ~held_out(F.col("doc_id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(rows, model).alias("p")).select("doc_id", "held_out", "p.*")
