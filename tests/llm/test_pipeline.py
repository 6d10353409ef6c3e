import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_langid_quality import prose


def test_stages(spark, tmp_path):
    rows = [(k, prose("aa", 60 + k, k) + "\n" + prose("aa", 30, -k), "aa", f"s{k % 3}") for k in range(40)]
    rows += [(100 + k, prose("bb", 60 + k, k), "bb", "s1") for k in range(30)]
    rows += [(200, rows[0][1], "aa", "s0"), (201, rows[1][1] + "\n" + prose("aa", 20, 99), "aa", None), (202, "### 123", "aa", "s0"), (203, None, "aa", "s0"), (204, " ".join(rows[2][1].split()[:-1] + ["x"]), "aa", "s2"), (None, prose("bb", 50, 77), None, "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before, seen = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        seen.append({r.doc_id: r for r in after.collect()})
        before = after
        assert k >= 0
    named, lines, near, mixed = seen
    assert not {202, 203} & named.keys() and {*range(40), *range(100, 130), None} <= named.keys()
    assert named[None].lang == "bb"
    assert 200 not in lines and lines[201].text == prose("aa", 20, 99) and lines[0].text == rows[0][1]
    assert near.keys() <= lines.keys() and {*range(40)} - near.keys() <= {2}
    total = sum(len(r.text.split()) for r in near.values())
    taken = spark.read.parquet(str(tmp_path / "mix_sources")).select("doc_id", F.size(F.split("text", r"\s+")).alias("n")).agg(F.sum("n")).first()[0]
    assert abs(taken - total) <= 4
    assert all(re.sub(r"\s+", " ", r.text) in re.sub(r"\s+", " ", near[k].text) for k, r in mixed.items())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert pieces and all(len(np.frombuffer(p.ids, "<u4")) == p.length for p in pieces)


def test_repeated_rows_are_mixed_as_often_as_the_mix_takes_them(spark):
    rows = [(1, "a b c d e", "en", "s", 9)] * 3 + [(1, "v w x y z", "en", "s", 9), (2, "a b c d e", "en", None, None), (3, " ".join("q" * 70), "en", "t", 1), (4, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    taken = corpus_pipeline.mixing.mix(docs).where("taken > 0").collect()
    assert len(out) == len(taken) and sum(len(r.text.split()) for r in out) == sum(t.taken for t in taken)
    assert sorted(len(r.text.split()) for r in out if r.source == "s") == sorted(t.taken for t in taken if t.source == "s")


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_judges_rows_by_their_texts(spark):
    x, y, z = (prose("aa", 80, k) for k in (1, 2, 3))
    rows = [(1, x), (None, x), (None, y), (7, z), (7, x), (7, z), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "aa", None, len(t or "")) for i, t in rows], KIND)
    out = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(1, x), (None, y), (7, z), (8, None), (9, "")], key=str)


def test_rows_that_differ_in_where_they_are_null_are_apart(spark):
    docs = spark.createDataFrame([(1, "w", "en", None, 1), (1, "w", None, "en", 1)], KIND)
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert {(r.lang, r.source) for r in out} == {("en", None), (None, "en")}


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
