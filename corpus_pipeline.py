"""A corpus pipeline of five of the operators: language ID, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.llm import langid, linededup, mixing, neardup, packing
from trackspark.llm.common import new_folder, scratch
from trackspark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang is the language found. Null texts, texts without a
    letter and texts unlike all languages go. Labels of all rows but the held-out ones teach. If no
    row teaches, all go."""
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    rows = docs.withColumn("_found", langid.predicted(docs, model)).where("not _found.rejected")
    return rows.withColumn("lang", F.col("_found.lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before, or nearly so; a document that loses all words goes.
    Documents that had no words stay as they are."""
    before = docs.withColumn("_had", F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    after = linededup.dedup_lines(before, threshold=2, per_edit=12)
    after = after.where(~F.col("_had") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return after.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def _identity() -> dict[str, Column]:
    """Two hashes over all columns that tell nulls in different columns apart. Rows that agree in all
    columns are one another's like."""
    seen = [*COLUMNS, *[F.isnull(c) for c in COLUMNS]]
    return {"_a": F.xxhash64(*seen), "_b": F.xxhash64(F.lit(1), *seen)}


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, of rows that share
    it any one. Rows that agree in all columns become one; wordless texts stay."""
    own = _identity()
    docs = docs.withColumns(own)
    found = neardup.near_duplicates(docs, width=5, percent=80, carry=list(own)).select(*own, "doc_id", "component")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *own)
    first = found.where("component is not null").groupBy("component").agg(F.min_by(F.struct(*own), order).alias("r")).select("r.*")
    stays = first.union(found.where("component is null").select(*own)).distinct()
    rows = docs.join(stays, list(own), "left_semi")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy(*own)))
    return rows.where("_n = 1").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as the mix takes it, the copy at the end of its source's share cut
    after the words it takes. A document that the mix leaves out goes."""
    own = _identity()  # what the mix takes of any of a row's like is cut from one of them
    docs = docs.withColumns(own)
    mixed = mixing.mix(docs, carry=list(own)).where("taken > 0").select(*own, F.col("size").alias("_size"), "taken")
    rows = docs.dropDuplicates(list(own)).join(mixed, list(own))
    words = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+)"
    cut = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(words + "{"), F.col("taken").cast("string"), F.lit("}+")), F.lit(0))
    text = F.when(F.col("taken") < F.col("_size"), F.rtrim(cut)).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with their ids."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end=2, remember=1 << 18)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Clustering, edit distances, shingle similarity and tokenizers are beyond SQL; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written to the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS), new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
