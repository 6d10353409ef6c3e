import math
import random

import numpy as np
import pytest

from trackspark.llm import mixing
from trackspark.llm.topk import SortedLists, top_k


def vectors():
    r = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in r.normal(size=6)]) for k in range(0, 900, 3)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 5 + [None]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (1005, [1.0, 2.0]), (None, [1.0] * 6), (1100, [1.0, -2.0]), (1200, [0.0] * 6), (300, [0.5] * 6), (1300, [3e38] * 6), (1301, [1e30] * 6)]
    return rows


@pytest.mark.parametrize("block", [64, 16384])
def test_top_k_equals_brute_force(spark, block):
    rows = vectors()
    out = top_k(spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int"), block_rows=block, query_rows=2).collect()
    limit = float(1 << 62)
    good = [(i, [int(math.floor(min(max(1024 * float(np.float32(c)), -limit), limit))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    want = []
    for q, a in good:  # two rows have the id 300: both ask, and have ten places each
        if q % 100 == 0:
            scored = sorted((-min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(1 << 63)), (1 << 63) - 1), i) for i, b in good if i != q and len(a) == len(b))
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:10], 1)]
    assert sorted(map(tuple, out)) == sorted(want) and len([w for w in want if w[0] == 300]) == 20


def test_threshold_stops_early():
    r = np.random.default_rng(1)
    x = np.abs(r.normal(size=(5000, 2)) * 1000).astype(np.int64)
    lists = SortedLists(np.arange(5000), x)
    scored = []
    plain = lists.scores
    lists.scores = lambda rows, q: scored.append(len(rows)) or plain(rows, q)
    top = lists.top(np.array([500, 300]), 5, -1)
    assert top == [(-s, i) for s, i in sorted((-int(v), int(i)) for i, v in enumerate(x @ np.array([500, 300])))[:5]]
    assert sum(scored) < 2500


def test_no_vectors(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def water(sizes, cycle=3, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % cycle + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def documents(seed):
    r = random.Random(seed)
    rows = [(k, r.choice(["a", "b", "b", "b", "B", "é", "", None, "zz"]), " ".join("w" * r.randint(1, 30)) if r.random() < 0.9 else r.choice([None, "", " \n"])) for k in range(300)]
    rows += [(1000, "tiny", "one"), (1001, "empty", ""), (1002, "huge", "w " * 5000), (None, "a", "x y"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = documents(seed)
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, source string, text string, size int")
    out = mixing.mix(df).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    each = [x for x in out if (x.copy or 0) == 0]
    assert len(each) == len(rows)
    for s in sizes:
        own = [x for x in each if x.source == s]
        assert all(abs(x.target - want[s]) < 1e-6 * (1 + want[s]) and x.source_size == sizes[s] for x in own)
        assert sum(x.doc_taken for x in own) == int(math.floor(own[0].target + 0.5))
        assert all(0 <= x.doc_taken <= 3 * x.size for x in own)
    placed = sorted((x for x in out if x.copy is not None), key=lambda x: x.position)
    assert [x.position for x in placed] == np.cumsum([0, *(x.taken for x in placed)])[:-1].tolist()
    assert all(a.virtual_finish <= b.virtual_finish for a, b in zip(placed, placed[1:], strict=False))
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")).collect()
    assert [(r.target, r.doc_taken) for r in rows] == [(0.0, 0), (0.0, 0)]
