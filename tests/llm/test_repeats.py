import random
import tracemalloc

import numpy as np

from trackspark.llm import suffixdedup
from trackspark.llm.suffixes import suffix_arrays


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(5)
    for _ in range(150):
        texts = []
        for _ in range(int(rng.integers(1, 6))):
            body = rng.integers(1, 2 + int(rng.integers(1, 4)), int(rng.integers(0, 40)))
            texts.append(np.append(np.tile(body, int(rng.integers(1, 4))), 0))
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths) - lengths
        want = [int(a) + k for a, t in zip(starts, texts, strict=True) for k in sorted(range(len(t)), key=lambda k, t=t: t[k:].tolist())]
        assert suffix_arrays(np.concatenate(texts), lengths).tolist() == want
    assert len(suffix_arrays(np.zeros(0, np.int16), np.zeros(0, np.int64))) == 0
    long = np.append(np.full(3000, 1), 0)
    assert suffix_arrays(long, np.array([3001])).tolist() == list(range(3000, -1, -1))


def brute(rows, span):
    low = {}
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - span + 1):
            low[t[p : p + span]] = min(low.get(t[p : p + span], float("inf")), i)
    out = []
    for (i, t), (doc_id, _) in zip(texts, rows, strict=True):
        gone = [False] * len(t)
        for p in range(len(t) - span + 1):
            if low[t[p : p + span]] < i:
                gone[p : p + span] = [True] * span
        starts = [p for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1])]
        spans = [(p, next((q for q in range(p, len(t)) if not gone[q]), len(t)) - p) for p in starts]
        out.append((doc_id, len(t), tuple(spans), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def corpus(seed, n, words):
    rng = random.Random(seed)
    word = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(words)]
    passages = [" ".join(rng.choices(word, k=rng.randint(8, 30))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [" ".join(rng.choices(word, k=rng.randint(0, 25))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((k, "\n".join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[4][1][5:-3]), (2, rows[5][1]), (None, rows[6][1]), (None, rows[6][1]), (n + 2, None), (n + 3, ""), (n + 4, "short"), (n + 5, "a" * 700), (n + 6, "b" + "a" * 500), (n + 7, "xy" * 400), (-1, "yx" * 90)]
    rng.shuffle(rows)
    return rows


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, kept int").repartition(3)
    out = suffixdedup.remove_repeats(docs, **more).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.length) for s in r.spans), bytes(r.kept)) for r in out), key=str)


def test_repeats_against_brute_force(spark):
    rows = corpus(1, 120, 60)
    # chunks of a few documents, so that most passages span chunks
    assert found(spark, rows, chunk_bytes=1 << 11) == brute(rows, 50)


def test_crowded_anchors_and_other_spans(spark):
    rows = corpus(2, 60, 5)  # five words: anchors with many unlike segments
    assert found(spark, rows, chunk_bytes=1 << 10, crowd=3) == brute(rows, 50)
    assert found(spark, rows, span=12, gram=5, chunk_bytes=1 << 10, crowd=8) == brute(rows, 12)


def test_segments_with_many_others_are_sorted_as_strings():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    sizes = np.full(50, 80)
    keys, least = np.zeros(50, np.int64), rng.integers(0, 50, 50)
    want = suffixdedup.first_ids(data, sizes, keys, least, 12)[0]
    assert (suffixdedup.first_ids(data, sizes, keys, least, 12, crowd=2)[0] == want).all()
    windows = [(data[80 * s + p : 80 * s + p + 12].tobytes(), least[s]) for s in range(50) for p in range(69)]
    low = {}
    for w, i in windows:
        low[w] = min(low.get(w, 99), i)
    assert want.tolist() == [low[w] for w, _ in windows]


def test_anchors_are_dealt_evenly():
    data = np.random.default_rng(6).integers(97, 123, 1 << 20).astype(np.uint8)
    hashes = np.unique(suffixdedup.anchors(data, np.array([len(data)]), 50, 20)[2])
    sizes = np.bincount((suffixdedup._key(hashes, 64) >> np.uint64(32)).astype(np.int64), minlength=64)
    assert sizes.max() < 1.3 * sizes.mean()


def test_memory_does_not_grow_with_crowded_keys():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 65 * 40000).astype(np.uint8)
    sizes, keys = np.full(40000, 65), np.repeat(np.arange(400), 100)
    tracemalloc.start()
    try:
        suffixdedup.first_ids(data, sizes, keys, np.arange(40000), 50)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 640,000 windows of 50 bytes as strings would take 32 MB, and as much again twice to sort
    assert peak < 50e6


def test_no_documents(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scratch_tables_leave_the_catalog(spark):
    from trackspark.llm.common import scratch

    before = {t.name for t in spark.catalog.listTables()}
    with scratch():
        suffixdedup.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count()
    assert {t.name for t in spark.catalog.listTables()} == before
