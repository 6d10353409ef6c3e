import collections
import random
from bisect import bisect_right

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackspark.llm import linededup, neardup
from trackspark.llm.components import components


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 400)] + [(None, 1), (5, None), (7, 7)]
    out = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    u = Union()
    for a, b in links:
        if a is not None and b is not None and a != b:
            u.join(a, b)
    assert out == {k: u.find(k) for k in u.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(n)]


def near_corpus():
    r, rows = random.Random(11), []
    for family in range(12):
        base = words(r, 60 + 10 * family)
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = "zzz" + str(r.randint(0, 9))
            rows.append(" ".join(w))
    rows += ["Same TEXT here now\nagain", "same text  HERE now again", "two words", "Two words", "one", "É a b c d", "é a b c d", "", "  \n", None]
    rows = [(k, t) for k, t in enumerate(rows)]
    return [*rows, (3, rows[3][1]), (500, rows[0][1] + " tail"), (None, rows[1][1]), (None, "quite alone in all this")]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rows = near_corpus()
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, class string")
    out = neardup.near_duplicates(docs, width, percent).collect()
    assert len(out) == len(rows)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    big = 10**9
    nodes = [(big if k is None else k, shingles(t)) for k, t in rows]
    u = Union()
    for i, (a, s) in enumerate(nodes):
        for j, (b, t) in enumerate(nodes[:i]):
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                u.join((a, i), (b, j))
    least = collections.defaultdict(lambda: big)
    for i, (a, _) in enumerate(nodes):
        least[u.find((a, i))] = min(least[u.find((a, i))], a)
    want = sorted((a, len(s), least[u.find((a, i))]) for i, (a, s) in enumerate(nodes))
    got = sorted((big if x.doc_id is None else x.doc_id, x.n_shingles, big if x.component_id is None else x.component_id) for x in out)
    assert got == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)


def family(r, n, length):
    """Texts that all differ from one base in some words, so that most share buckets and few are links."""
    base = words(r, length)
    return [" ".join("q" + str(r.randint(0, 10**6)) if r.random() < x else w for w in base) for x in (r.uniform(0, 0.16) for _ in range(n))]


@pytest.mark.parametrize("chunk,exact", [(16, 256), (16, 20)])
def test_a_large_family_of_unlike_texts(spark, monkeypatch, chunk, exact):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "EXACT", exact)
    r = random.Random(chunk + exact)
    texts = [*family(r, 150, 60), *family(r, 40, 500)]
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    sets = [set(zip(w, w[1:], w[2:])) for w in map(str.split, texts)]
    u = Union()
    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                u.join(i, j)
    assert got == {k: u.find(k) for k in range(len(texts))}
    assert 20 < len(set(got.values())) < len(texts) - 20


def test_overlaps_and_sketches():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 200, n).astype(np.uint64)) for n in (0, 1, 30, 80, 120)]
    x, y = np.triu_indices(5, 1)
    assert neardup.overlaps(sets, x, y).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)]
    for n in (300, 1500, 9000):
        pool = np.unique(r.integers(0, 1 << 63, 3 * n, dtype=np.uint64))
        pool = r.permutation(pool)
        for j, want in ((0.851, True), (0.87, True), (0.74, False)):
            both = int(2 * n * j / (1 + j))
            a, b = np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])
            pair = [np.frombuffer(neardup.sketch(s), np.uint64)[None] for s in (a, b)]
            assert neardup.sketches_pass(*pair, np.array([2 * n]), 85)[0] == want


def test_signature_estimates_similarity(spark):
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    rows = []
    for j in (0.2, 0.6, 0.9):
        n = int(1000 * 2 * j / (1 + j))
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - n : 2000 - n])
        rows.append((len(np.intersect1d(a, b)) / len(np.union1d(a, b)), neardup.signature(a)[1].tolist(), neardup.signature(b)[1].tolist()))
    df = spark.createDataFrame(rows, "j double, x array<long>, y array<long>")
    for x in df.select("j", neardup.estimate(df.x, df.y).alias("e")).collect():
        assert abs(x.j - x.e) < 0.13


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    assert linededup.removed_lines(empty).count() == 0


@given(st.integers(0, 4), st.text("ab", max_size=20), st.text("ab", max_size=20))
@settings(max_examples=200, deadline=None)
def test_banded_distance(threshold, a, b):
    assert linededup.within([(a, b)], threshold)[0] == (edit_distance(a, b) <= threshold)


@given(st.integers(1, 3), st.text("abc", min_size=6, max_size=30), st.data())
@settings(max_examples=150, deadline=None)
def test_segments_find_all_near_lines(threshold, a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, threshold))):
        k = data.draw(st.integers(0, len(b) - 1))
        kind = data.draw(st.sampled_from("isd"))
        b[k : k + (kind != "i")] = [] if kind == "d" and len(b) > 5 else [data.draw(st.sampled_from("abc"))]
    short, long = sorted((a, "".join(b)), key=len)
    if edit_distance(short, long) <= threshold and len(short) > threshold:
        assert set(linededup.segment_keys([short], threshold, False)[0].tolist()) & set(linededup.segment_keys([long], threshold, True)[0].tolist())


@given(st.text("abé", min_size=3, max_size=200), st.integers(1, 3))
@settings(max_examples=50, deadline=None)
def test_long_lines_have_the_same_keys(line, threshold):
    plain = linededup.segment_keys([line], threshold)
    whole, linededup.LONG = linededup.LONG, 7
    try:
        pieces = linededup.segment_keys([line], threshold)
        ids = linededup.line_ids([line])
    finally:
        linededup.LONG = whole
    if len(line) > threshold + 1:
        assert sorted(zip(*map(np.ndarray.tolist, plain), strict=True)) == sorted(zip(*map(np.ndarray.tolist, pieces), strict=True))
    assert ids == linededup.line_ids([line]) == linededup.line_ids(["x", line])[1]


def test_very_long_lines(spark):
    long = "".join(random.Random(3).choices("abcdef ", k=1_000_000))
    rows = [(1, long), (2, long[:400_000] + "X" + long[400_001:-1]), (3, "Y" + long[2:-2] + "ZZ"), *((k, f"{k} a short line beside the long ones") for k in range(10, 40))]
    out = {r.doc_id: r.removed for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out.pop(2) == [0] and 3 not in out and 1 not in out
    assert len(out) == 29


def test_many_lines_of_one_segment(spark):
    # a family in which each line is near its neighbours only, in keys of several chunks
    r, size = random.Random(8), linededup.CHUNK
    start = "the same long beginning of all these lines, "
    lines = [start + "".join(r.choices("abcdefghij", k=40)) for _ in range(150)]
    lines += [x[:-1] + "#" for x in lines[:60]] + [x[:-4] + "%" + x[-3:-1] + "#" for x in lines[:30]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    members = [(1, k, True, x) for k, x in enumerate(lines)]
    linededup.CHUNK = 1 << 13
    try:
        found = linededup._compared(spark.createDataFrame(members, "key long, id long, own boolean, line string"), 2).collect()
        gone = {x.doc_id for x in linededup.removed_lines(docs).collect()}
    finally:
        linededup.CHUNK = size
    want = Union()
    for i, x in enumerate(lines):
        for j in range(i):
            if edit_distance(x, lines[j]) <= 2:
                want.join(i, j)
    assert gone == {k for k in range(len(lines)) if want.find(k) != k}
    number = {linededup.digest(x): k for k, x in enumerate(lines)}
    have = Union()
    for link in found:
        assert edit_distance(lines[number[link.a]], lines[number[link.b]]) <= 2
        have.join(number[link.a], number[link.b])
    assert [have.find(k) for k in range(len(lines))] == [want.find(k) for k in range(len(lines))]


def line_corpus():
    r = random.Random(4)
    pool = ["".join(r.choice("abcdef ") for _ in range(r.randint(20, 60))) for _ in range(60)]
    rows = []
    for k in range(80):
        lines = []
        for _ in range(r.randint(1, 6)):
            x = r.choice(pool)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                at = r.randrange(len(x))
                x = x[:at] + r.choice("xyz") + x[at + r.randint(0, 1) :]
            lines.append(x)
        rows.append((k, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "é" * 30 + "\n" + "é" * 29 + "e"), (204, "short\nshort"), (205, "w" * 3000 + "\n" + "w" * 2999)]
    return [*rows, (None, pool[0] + "\n" + "u" * 40), (3, rows[3][1])]


def test_line_dedup_equals_brute_force(spark):
    rows = line_corpus()
    r = random.Random(9)
    rows += [(300 + k, "\n".join("".join(r.choice("ab") for _ in range(r.choice([1, 3, 11, 12, 13, 14, 22, 23, 24, 25, 26]))) for _ in range(5))) for k in range(20)]
    rows += [(400, " " * 24 + "\n" + " " * 23 + "x"), (401, " " * 24 + "\n" + " " * 30), (402, "\t" * 12)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, gone string")
    out = linededup.dedup_lines(docs, 2, 12).collect()
    assert len(out) == len(rows) and out[0].gone == "x"
    order = {k: i for i, (k, _) in enumerate(rows)}
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if x.strip()}, key=len)
    sizes, u = [len(x) for x in lines], Union()
    for i, x in enumerate(lines):
        u.find(x)
        edits = min(len(x) // 12, 2)
        for y in lines[i + 1 : bisect_right(sizes, len(x) + edits)] if edits else []:
            if len(x) > 1000 or edit_distance(x, y) <= edits:
                u.join(x, y)
    first = {}
    for k, t in sorted(dict(rows).items(), key=lambda x: (x[0] is None, x[0])):
        for n, x in enumerate((t or "").split("\n")):
            if x.strip():
                first.setdefault(u.find(x), (k, n))
    for row in out:
        t = rows[order[row.doc_id]][1]
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or first[u.find(x)] == (row.doc_id, n))
        assert row.text == want, row.doc_id


def test_short_equal_lines_go(spark, tmp_path):
    from trackspark.llm.queries import op8_line_dedup

    texts = ["Les.\n\n漢字仮名交じりの文です。\n \t\nx", "Les.\n\nMes.\n \t\nx" + " " * 40, "漢字仮名交じりの文です。\nMes.\nMes\nx\n\n", " " * 20, "\n" + " " * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    assert {k: r.removed for k, r in out.items()} == {0: "", 1: "0", 2: "0,1,3", 3: "", 4: ""}
    assert [out[k].n_removed for k in range(5)] == [0, 1, 3, 0, 0]
    cut = {r.doc_id: r.text for r in linededup.dedup_lines(docs, 2, 12).collect()}
    assert cut[2] == "Mes\n\n" and cut[0] == texts[0] and cut[4] == texts[4]


def test_lines_are_mapped_to_keys_once(spark, monkeypatch):
    plans, cut = [], linededup.cut_lineage
    monkeypatch.setattr(linededup, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        linededup.duplicate_lines(spark.createDataFrame([(1, "a line that is long enough"), (2, "a line that is long enough!")], "doc_id long, text string")).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plans[0].count("MapInArrow") == 1 and "ReusedExchange" in plans[0]
