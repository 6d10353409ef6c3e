import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import langid, quality
from trackspark.llm.quality import base_statistics, judge_quality, repeated_words

SYLLABLES = {"aa": "th er on an re he in ed nd ha", "bb": "sch ein ung der ich ver zu ge ß ü", "cc": "é eau ou tion è le re ç oi en"}


def prose(lang, n, seed):
    r, s = random.Random(f"{lang}{seed}"), SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(spark, n=60):
    rows = [(k, prose(l, 20 + k % 150, k), l, "x") for k in range(n) for l in SYLLABLES]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    rows += [(9000, None, "aa", "x"), (9001, "", "bb", "x"), (9002, "123 !!! ###", "cc", "x"), (9003, prose("aa", 40, "t"), None, "x"), (9004, "漢字仮名交じり文" * 30, None, "x"), (None, prose("bb", 30, "n"), "bb", "x"), rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_languages_of_held_out_texts(spark):
    docs = corpus(spark)
    out = langid.identify(docs).join(docs.select("doc_id", "lang").distinct(), "doc_id").collect()
    by = {r.doc_id: r for r in out}
    assert {by[k].lang_pred for k in (9000, 9001, 9002)} == {"und"} and by[9003].lang_pred == "aa"
    assert by[9004].rejected and not by[9003].rejected
    tested = [r for r in out if r.held_out and r.lang and r.doc_id < 9000]
    assert len(tested) > 20 and all(r.lang_pred == r.lang and not r.rejected for r in tested)
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.identify(docs).count() == docs.count()


def test_the_sample_is_bounded_and_null_ids_teach(spark):
    every = F.lit(True)
    same = [(5, prose("aa", 12, k), "aa") for k in range(700)] + [(6, prose("aa", 12, 0), "aa")] * 700
    docs = spark.createDataFrame(same, "doc_id long, text string, lang string").repartition(3)
    taken = langid.sample_of(docs, every, 256, 64)
    assert taken.count() <= 256 and taken.where("doc_id = 6").count() == 1
    nameless = spark.createDataFrame([(None, prose(l, 30, k), l) for k in range(40) for l in SYLLABLES], "doc_id long, text string, lang string")
    assert langid.sample_of(nameless, every, 256, 64).count() == 120
    model = langid.fit(nameless, ~langid.held_out(F.col("doc_id")))
    out = nameless.select("lang", langid.predicted(nameless, model).alias("p")).collect()
    assert sum(r.p.lang_pred == r.lang for r in out) >= 118


def test_nothing_to_learn_from(spark):
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    rows = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert rows[0].lang_pred == "und" and rows[0].rejected


def test_predictions_match_the_definition(spark):
    docs = corpus(spark).select("doc_id", "text", "lang")
    model = langid.fit(docs, F.lit(True))
    for r in langid.identify(docs.withColumn("rejected", F.lit("clash"))).collect()[:5]:
        assert isinstance(r.rejected, bool)
    for text in [prose("bb", 40, "new"), "a", "Thé 漢字", "x" * 200_000]:
        clean = re.sub(" +", " ", " " + "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()) + " ")
        counts = langid.ngram_counts(text)
        assert counts.sum() == sum(max(len(clean) - n, 0) for n in range(3))
        v = np.log1p(counts) * model.idf
        cosine = model.centroids @ (v / np.linalg.norm(v))
        lang, score, rejected = model.predict([text])[0]
        assert lang == model.languages[model.of[cosine.argmax()]] and abs(score - cosine.max()) < 1e-5
        assert rejected == (score < model.floor[min(int(np.log2(counts.sum())), 20)])


def test_learning_looks_at_the_sample_once(spark):
    rows = [(k, prose("aa", 30, k), "aa") for k in range(300)] + [(1000 + k, "123 ---", "zz") for k in range(50)] + [(2000, "Ωμέγα " * 20, "zz")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), per_language=8)
    assert model.languages == ["aa", "zz"]


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)


@pytest.mark.parametrize("seed", range(40))
def test_base_statistics(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a ", "b ", "c\n", "# ", " x ", "\t", "aa|", "\n"]) for _ in range(r.randint(0, 120)))
    assert base_statistics(text) == brute_statistics(text)


def test_repeated_words_with_many_words():
    words = [str(k) for k in range(1 << 20)] + ["x", "y", "z", "q", "x", "y", "z"]
    assert repeated_words(words) == 6


class BruteKneserNey:
    """The model by its definition, over dictionaries; one occurrence of the n-gram asked for is taken out."""

    def __init__(self, texts, order):
        self.order, self.levels = order, [collections.Counter()]
        for text in texts:
            chars = "\x01" * (order - 1) + re.sub(r"[ \t-\r]+", " ", text.lower() + " ")
            self.levels[0].update(chars[k : k + order] for k in range(len(chars) - order + 1))
        for _ in range(order - 1):
            self.levels.append(collections.Counter(g[1:] for g in self.levels[-1]))
        self.levels.reverse()
        self.off = []
        for level in self.levels:
            n = [sum(c == k for c in level.values()) for k in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
            d = [max(0.05, min(k - 0.05, k - (k + 1) * y * n[k] / n[k - 1])) if all(n) else k / 2 for k in (1, 2, 3)]
            self.off.append([0, *d])

    def p(self, gram, less):
        k = len(gram)
        if not k:
            return 1 / (len(self.levels[0]) + 1)
        counts, off = collections.Counter(self.levels[k - 1]), lambda c: self.off[k - 1][min(c, 3)]
        below = less and counts[gram] == 1
        counts[gram] -= less
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1] and c]
        low = self.p(gram[1:], below)
        return (counts[gram] - off(counts[gram]) + sum(map(off, same)) * low) / sum(same) if same else low


@pytest.mark.parametrize("order", [3, 5])
def test_probabilities_match_the_definition(spark, order):
    texts = [prose("aa", 30, k) for k in range(6)] + ["Ünlike  thé\nothers\x00!", " ends in blanks \n", "漢字仮名交じり文", "x"]
    brute = BruteKneserNey([t.replace("\x00", "\x01") for t in texts], order)
    rows = [(k, None, t) for k, t in enumerate(texts)]
    out = quality.score(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3), order, most=200).collect()
    assert len(out) == len(texts)
    for r in out:
        chars = "\x01" * (order - 1) + re.sub(r"[ \t-\r]+", " ", texts[r.doc_id].replace("\x00", "\x01").lower() + " ")
        grams = [chars[k : k + order] for k in range(len(chars) - order + 1)]
        want = -sum(np.log(brute.p(g, 1)) for g in grams) / len(grams)
        assert abs(r.log_perplexity - want) < 1e-5, texts[r.doc_id]
    context = "the "[-order + 1 :]
    assert abs(sum(brute.p(context + g, 0) for g in brute.levels[0]) + brute_rest(brute, context) - 1) < 1e-9


def brute_rest(brute, context):
    """What the model leaves to the one symbol not seen."""
    rest = 1 / (len(brute.levels[0]) + 1)
    for k in range(1, brute.order + 1):
        same = [c for g, c in brute.levels[k - 1].items() if g[:-1] == context[len(context) - k + 1 :]]
        if same:
            rest *= sum(brute.off[k - 1][min(c, 3)] for c in same) / sum(same)
    return rest


def test_counts_cover_all_documents_in_every_script(spark):
    texts = [prose("aa", 400, 1), "Привет, мир. " * 9, "καλημέρα κόσμε", "漢字仮名交じり文" * 3, "a" * 3_000_000]
    rows = [(k, "en" if k % 2 else None, t) for k, t in enumerate(texts)]
    found = collections.Counter()
    for r in quality.chunks(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2), 4, 1000).collect():
        found.update({(r.lang, g): n for g, n in zip(r.grams, r.n, strict=True)})
    want = collections.Counter()
    for _, lang, t in rows:
        chars = "\x01" * 3 + re.sub(r"[ \t-\r]+", " ", t.lower() + " ")
        want.update((lang, chars[k : k + 4]) for k in range(len(chars) - 3))
    assert found == want


def test_scrambled_and_gibberish_texts_are_odder(spark):
    rows = [(k, "aa", prose("aa", 80, k)) for k in range(60)]
    r = random.Random(5)
    rows += [(100, "aa", "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=400))), (101, "aa", "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(300)))]
    out = {x.doc_id: x for x in quality.score(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert min(out[k].log_perplexity for k in (100, 101)) > 1.3 * max(out[k].log_perplexity for k in range(60))


def test_verdicts(spark):
    odd = [(5000 + k, prose("aa", 60, k) + " " + "qxzjkv " * 60, "aa") for k in range(2)]
    docs = corpus(spark).select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in judge_quality(docs.withColumns({c: F.lit("clash") for c in ("kept", "chunk", "gram", "n_words")})).collect()}
    assert out[9000].base_failed and out[9001].n_words == 0 and not out[9001].kept
    assert not out[5000].kept and not out[5001].kept
    good = [r for k, r in out.items() if k is not None and k < 180 and not r.base_failed]
    assert len(good) > 50 and sum(r.kept for r in good) >= 0.97 * len(good)
    assert judge_quality(docs.where("false")).count() == 0
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out.values())
    assert F is not None


def test_languages_keep_models_and_bands_apart(spark):
    # crc32("en") and crc32("fi") agree modulo 32, as do those of null and the empty string
    rows = [("aa", "en", 300), ("bb", "fi", 12), ("aa", "", 300), ("cc", None, 12)]
    rows = [(i, prose(kind, 90, i), lang) for i, (kind, lang) in enumerate((kind, lang) for kind, lang, n in rows for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in judge_quality(docs).collect()}
    small = [out[i] for i, _, lang in rows if lang in ("fi", None)]
    assert sum(r.kept for r in small) >= 0.9 * len(small)
    alone = {r.doc_id: r.perplexity for r in judge_quality(docs.where("lang = 'fi'")).collect()}
    assert len(alone) == 12 and all(abs(out[k].perplexity - p) < 1e-9 for k, p in alone.items())


def test_rare_languages_are_learned_too(spark):
    rows = [(i, prose(kind, 60, i), kind) for i, kind in enumerate(["aa"] * 40 + ["bb"] * 40 + ["cc"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), most_languages=2)
    assert model.languages == ["aa", "bb", "cc"]
    assert [model.predict([prose(kind, 60, "new")])[0][0] for kind in model.languages] == model.languages
    assert langid.fit(docs, F.lit(True), per_language=3, most_languages=2).languages == ["aa", "bb", "cc"]
