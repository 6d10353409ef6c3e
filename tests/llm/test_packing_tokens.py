import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackspark.llm.packing import CapacityTree, WordTokenizer, best_fit_decreasing, pack_documents, pack_pool
from trackspark.llm.queries import tokenizer_path
from trackspark.llm.tokencount import RankMerger, count_tokens

TEXTS = ["", " ", "Hello, world's best 12 tests", "é" * 300, "a" * 5000, "ab" * 2000, "日本語テキスト🎉", "x <|endoftext|>y", "▁▁ x▁y", "\x00a\tb\r\n c", "<s> hi </s>", "The QUICK brown fox. " * 900]


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit_decreasing_takes_the_tightest_window(lengths):
    windows = best_fit_decreasing(lengths, 50)
    assert sorted(k for w in windows for k in w) == list(range(len(lengths)))
    left, plain = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(x, i) for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(50 - n)
    plain = sorted(50 - x for x in left)
    assert sorted(sum(lengths[k] for k in w) for w in windows) == plain


def test_tree_finds_the_smallest_capacity():
    tree = CapacityTree(10)
    tree.add(3, 0)
    tree.add(7, 1)
    assert (tree.tightest(2), tree.tightest(4), tree.tightest(8)) == (3, 7, None)
    assert tree.take(7) == 1 and tree.tightest(4) is None


def test_thin_windows_are_cut_to_powers_of_two():
    sequences = list(pack_pool([(1, 0, np.arange(13, dtype=np.uint16), 13)], 64, 0.98))
    assert [sum(len(x[2]) for x in s) for s in sequences] == [8, 4, 1]


def test_every_token_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rows = [(k, t, "other") for k, t in enumerate([*TEXTS, None])] + [(0, "", "twice")]
    pieces = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), path, capacity=256, pool_tokens=2000).collect()
    library = Tokenizer.from_file(path)
    for doc, text in enumerate([*TEXTS, None]):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        got = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in got]).tolist()
        assert ids == want * (2 if doc == 0 else 1)
        assert all(p.doc_tokens == len(want) and len(p.ids) == 4 * p.length for p in got)
        assert doc == 0 or [p.start for p in got] == np.cumsum([0, *(p.length for p in got)])[:-1].tolist()
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for own in by.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert sum(p.length for p in own) == own[0].sequence_tokens <= 256
    padding = sum((256 - n) * (n & (n - 1) != 0) for n in (sum(p.length for p in own) for own in by.values()))
    assert padding < 0.02 * sum(p.length for p in pieces)
    assert zlib.crc32(pieces[0].ids) >= 0


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    return WordTokenizer(path, remember=40), Tokenizer.from_file(path)


@given(st.lists(st.text(alphabet="stmdrevlLS''’ .-09²½éÉßŸŀĿİſŉµª\u00ad×÷¡\n\t\u00a0\u0301日<|", max_size=60), max_size=5), st.integers(1, 80))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_library(words, texts, part):
    own, library = words
    assert [x.tolist() for x in own.ids(texts, 2, part)] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_all_latin_characters_and_contractions(words):
    own, library = words
    chars = [chr(c) for c in range(0x180) if c not in (0x85, 0xA0) and not c < 9 and not 0xE <= c < 0x20]
    texts = ["".join(chars), " ".join(chars), *("a" + c + "b" + c + c for c in chars)]
    texts += [f"{a}'{b}{c}" for a in ("", "x", "'", "7", "-", " ") for b in ("s", "t", "re", "ve", "m", "ll", "d", "r", "v", "l", "é") for c in ("", "x", "'s", "'", "9", " y")]
    texts += ["x '", "s", "'", "re", "a<|endoftext|>b", "<|startoftext|", ""]
    assert [x.tolist() for x in own.ids(texts, 2)] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_latin_words_go_to_the_model_once_each_and_past_the_normalizer():
    own, asked = WordTokenizer(tokenizer_path("word_bpe_49k.json")), []

    class Seen:
        def __init__(self, tokenizer):
            self.model, plain = self, tokenizer.model.tokenize
            self.tokenize = lambda word: asked.append(word) or plain(word)

    own.tokenizer = Seen(own.tokenizer)
    assert [len(x) for x in own.ids(["The cat, the CAT's hat"] * 100, 2)] == [8] * 100
    assert sorted(asked) == ["'s", ",", "cat", "hat", "the"]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, n_tokens string, ids long")
    assert [r.n_tokens for r in count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).collect()] == [2]
    assert sum(r.length for r in pack_documents(docs, tokenizer_path("word_bpe_49k.json")).collect()) == 3


def test_packing_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert count_tokens(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0


@given(st.text(alphabet="abcthein ▁日é\n\t. ", max_size=200))
@settings(max_examples=80, deadline=None)
def test_token_counts_equal_the_library(merger, text):
    own, library = merger
    assert own.count([text]) == [len(library.encode(text))]


@given(st.lists(st.tuples(st.sampled_from([" ", " ", "-", "=", ".", "a", "x", "the", "\n", "▁", "日", "/*", "ha"]), st.integers(1, 70)), max_size=8))
@settings(max_examples=120, deadline=None)
def test_runs_count_as_in_the_library(merger, runs):
    own, library = merger
    text = "".join(x * n for x, n in runs)
    assert own.period == 16 and own.count([text]) == [len(library.encode(text))]
    long, own.most = own.most, 8  # through the queue
    own.known.clear()
    try:
        assert own.count([text]) == [len(library.encode(text))]
    finally:
        own.most = long


def test_very_long_runs(merger):
    import time

    own, library = merger
    began = time.perf_counter()
    assert own.count([" " * 1_000_000, "x" + " " * 999_999 + "y"]) == [62501, len(library.encode("x" + " " * 999_999 + "y"))]
    assert time.perf_counter() - began < 20 and max(map(len, own.known), default=0) <= 4 * own.long
    for text in ("ACGT" * 5000, "-" * 20_003, "hahaha" * 3000, "\u3000" * 5000):
        assert own.count([text]) == [len(library.encode(text))]


@pytest.fixture(scope="module")
def merger():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    return RankMerger(path, remember=50), sentencepiece.SentencePieceProcessor(model_file=path)


def test_token_counts_of_odd_texts(spark, merger):
    rows = [(k, t) for k, t in enumerate([*TEXTS, None])] + [(3, TEXTS[3]), (None, "x")]
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(out) == len(rows)
    want = {k: (len((t or "").encode()), len(merger[1].encode(t or ""))) for k, t in rows}
    assert all((r.n_bytes, r.n_tokens) == want[r.doc_id] for r in out)
