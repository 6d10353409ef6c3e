"""Line deduplication with a segment-partition edit join.

Equal lines of any length are one class by digest. Lines may differ by an edit for so many code points of the
shorter one, up to a threshold. For these, each line is split into as many segments as edits are allowed
at its length, and one more, of which a line that near must hold one whole; the segments' hashes, with
line length and segment number, are an index that the substrings of all lines probe at the positions
that the edits before and behind allow. The lines of a key meet in tasks, in pairs of chunks if they are
many; there candidates are verified by banded bit-parallel edit distance, and of the links found those
of a spanning forest leave the task. Lines stay in the documents until then: the keys take 17
bytes each, and a Bloom filter of fixed size picks the lines whose texts are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, bounded_batches, chunk_pairs, cut_lineage, free_name, in_groups
from .components import components

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
_M = np.uint64(0xC2B2AE3D27D4EB4F)
BLOOM_BITS = 26
#: Characters of the lines, and 256 a line, that one side of a comparison in a task holds.
CHUNK = 1 << 18
#: Longer lines than this are hashed in pieces.
LONG = 1 << 18
BLANKS = " \t\n\v\f\r"


def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    step = base  # base ** have
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        have, step = have + more, step * step % (1 << 64)
    return out


def digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _group(codes: np.ndarray) -> np.ndarray:
    return (codes * 0x9E3779B1 >> 11) & 15


def line_ids(lines: list[str]) -> np.ndarray:
    """64-bit ids: 48 bits of a hash, and above them the parities of 16 groups of characters, of
    which one edit changes two at most."""
    low = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(lines) == 1:
        counts = sum(np.bincount(_group(codes[at : at + LONG].astype(np.int64)), minlength=16) for at in range(0, max(len(codes), 1), LONG)).reshape(1, 16)
    else:
        counts = np.bincount(np.repeat(np.arange(len(lines)), size) << 4 | _group(codes.astype(np.int64)), minlength=len(lines) << 4).reshape(-1, 16)
    parity = ((counts & 1) << np.arange(16)).sum(axis=1).astype(np.uint64)
    return low & np.uint64((1 << 48) - 1) | parity << np.uint64(48)


def allowed(length: np.ndarray, threshold: int, per_edit: int) -> np.ndarray:
    """The edits that a line of this length may be away from a line as long or longer."""
    return np.minimum(np.asarray(length) // per_edit, threshold)


def segments(length: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the threshold + 1 segments of lines of these lengths; the last ones are
    longer by one where they don't come out even. Both have one row per line."""
    n = threshold + 1
    size = (length[:, None] + np.arange(n)[None, :]) // n
    return np.cumsum(size, axis=1) - size, size


def _hashed(parts: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    """Keys of segments number i of lines of these lengths, from the hashes of their characters."""
    h = (parts ^ parts >> np.uint64(29)) * _M + length.astype(np.uint64) * np.uint64(64) + np.uint64(i)
    return (h ^ h >> np.uint64(32)) * np.uint64(BASE)


def _probed(size: np.ndarray, threshold: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(segment, length of the line sought, start, width, own) of the substrings that lines of these sizes probe
    shorter or equally long lines with: multi-match-aware, only positions that leave edits enough. Of a
    line's own segments, which are the index, own is true."""
    for shorter in range(threshold + 1):
        length = size - shorter
        start, width = segments(length, threshold)
        for i in range(threshold + 1):
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i))
            for shift in range(low, high + 1):
                yield i, length, start[:, i] + shift, width[:, i], shorter == shift == 0


def segment_keys(lines: list[str], threshold: int, probe: bool = True, per_edit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the positions of their lines, and whether they are of a line's own segments; just these
    if not probe. Lines are sought, and cut into segments, by the edits allowed at their own length."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    if len(lines) == 1 and size[0] > LONG:
        keys, of, owns = _long_keys(lines[0], threshold)
        return (keys, of, owns) if probe else (keys[owns], of[owns], owns[owns])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _powers(BASE, len(codes) + 1), _powers(INVERSE, len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes * _M + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    first, everyone = np.cumsum(size) - size, np.arange(len(lines))
    keys, of, owns = [], [], []
    for edits in range(1, threshold + 1):
        for i, length, at, width, own in _probed(size, edits):
            if not (own or probe):
                continue
            rows = everyone[(at >= 0) & (at + width <= size) & (length >= edits + 1) & (allowed(length, threshold, per_edit) == edits)]
            here = at[rows] + first[rows]
            keys.append(_hashed((sums[here + width[rows]] - sums[here]) * down[here], length[rows], i))
            of.append(rows)
            owns.append(np.full(len(rows), own))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(of), np.concatenate(owns)


def _long_keys(line: str, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one long line: sums are kept only where a segment begins or ends."""
    wanted = [(i, length, int(at[0]), int(width[0]), own) for i, length, at, width, own in _probed(np.array([len(line)]), threshold) if at[0] >= 0 and at[0] + width[0] <= len(line)]
    cuts = sorted({x for _, _, at, width, _ in wanted for x in (at, at + width)} | {*range(0, len(line), LONG), len(line)})
    sums, total = {0: 0}, 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        codes = np.frombuffer(line[a:b].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        part = int(((codes * _M + np.uint64(1)) * _powers(BASE, len(codes))).sum(dtype=np.uint64))
        total = (total + part * pow(BASE, a, 1 << 64)) % (1 << 64)
        sums[b] = total
    hashes = [((sums[at + width] - sums[at]) * pow(INVERSE, at, 1 << 64)) % (1 << 64) for _, _, at, width, _ in wanted]
    keys = [_hashed(np.array([h], np.uint64), length, i) for h, (i, length, *_) in zip(hashes, wanted, strict=True)]
    return np.concatenate(keys), np.zeros(len(keys), np.int64), np.array([own for *_, own in wanted])


def _same_ends(x: str, y: str) -> tuple[str, str]:
    """Two strings without what they begin and end with in common, which leaves their distance as it is."""
    n = min(len(x), len(y))
    a, b = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (x, y))
    differ = a[:n] != b[:n]
    front = int(differ.argmax()) if differ.any() else n
    differ = a[len(a) - n + front :][::-1] != b[len(b) - n + front :][::-1]
    back = int(differ.argmax()) if differ.any() else n - front
    return x[front : len(x) - back], y[front : len(y) - back]


def within(pairs: list[tuple[str, str]], threshold: int, most: int = 1 << 20) -> np.ndarray:
    """Which pairs have an edit distance of at most threshold (31 at most). Worked off by length, in
    runs of at most most characters, however long single lines are (one pair at least)."""
    pairs = [_same_ends(x, y) if len(x) > 256 else (x, y) for x, y in pairs]
    order = sorted(range(len(pairs)), key=lambda k: max(map(len, pairs[k])))
    out, at = np.zeros(len(pairs), bool), 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * max(map(len, pairs[order[upto]])) <= most:
            upto += 1
        out[order[at:upto]] = _within([pairs[k] for k in order[at:upto]], threshold)
        at = upto
    return out


def near(pairs: list[tuple[str, str]], threshold: int, per_edit: int) -> np.ndarray:
    """Which pairs are within the edits allowed at the length of the shorter one."""
    edits = allowed(np.array([min(len(x), len(y)) for x, y in pairs], int), threshold, per_edit)
    out = np.zeros(len(pairs), bool)
    for t in np.unique(edits).tolist():
        some = np.flatnonzero(edits == t)
        out[some] = within([pairs[k] for k in some], t)
    return out


def _within(pairs: list[tuple[str, str]], threshold: int) -> np.ndarray:
    """Bit-parallel along a band of 2 * threshold + 1 diagonals, one word per pair, all pairs of a column
    at once. Bits hold vertical differences down the band, so the band moves along by a shift."""
    n, one = len(pairs), np.uint64(1)
    la, lb = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    wide = int(max(la.max(), lb.max()))
    a, b = np.full((wide + 1, n), -1, np.int32), np.full((wide + 2 * threshold + 2, n), -2, np.int32)
    for k, (x, y) in enumerate(pairs):
        a[: len(x), k] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        b[threshold : threshold + len(y), k] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)
    band = 2 * threshold + 1
    # vertical differences of the column before, placed for the band of the next: rows up to 0 are
    # level, rows below rise by one each
    vp = np.full(n, sum(1 << d for d in range(threshold, band)), np.uint64)
    vn = np.zeros(n, np.uint64)
    score, every = np.zeros(n, np.int64), np.uint64((1 << band) - 1)
    middle = np.uint64(1 << threshold)
    value = np.full(n, threshold + 1, np.int64)
    rest = la == 0
    value[rest] = lb[rest]
    for j in range(wide):
        # bit d: a[j] against b[j + d - threshold]
        eq = np.zeros(n, np.uint64)
        for d in range(band):
            eq |= (a[j] == b[j + d]).astype(np.uint64) << np.uint64(d)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & every
        hp, hn = (vn | ~(d0 | vp)) & every, vp & d0
        x = d0 >> one  # the band comes down one row
        vn, vp = x & hp, hn | ~(x | hp) & every
        score += np.where(d0 & middle, 0, 1)
        last = j == la - 1
        if last.any():
            # from the diagonal at row la down or up to row lb by the vertical differences
            k = np.flatnonzero(last)
            total = score[k].copy()
            for step in range(1, threshold + 1):
                down, up = lb[k] - la[k] >= step, la[k] - lb[k] >= step
                below, above = np.uint64(threshold + step - 1), np.uint64(threshold - step)
                total += np.where(down, (vp[k] >> below & one).astype(np.int64) - (vn[k] >> below & one).astype(np.int64), 0)
                total -= np.where(up, (vp[k] >> above & one).astype(np.int64) - (vn[k] >> above & one).astype(np.int64), 0)
            value[k] = total
    return (value <= threshold) & (abs(la - lb) <= threshold)


def _lines(text: str | None, least: int) -> Iterator[tuple[int, str]]:
    """Lines of at least least characters that are not blank."""
    for k, line in enumerate((text or "").split("\n")):
        if len(line) >= least and line.strip(BLANKS):
            yield k, line


def _mapped(docs: DataFrame, schema: str, rows: Callable[[list], list[pa.Array]], least: int = 1, part: int = 1 << 19) -> DataFrame:
    """rows() over runs of lines (doc_id, doc_hash, line_no, line) of about part characters; a line longer
    than LONG is a run of its own."""
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for k, line in _lines(text.as_py(), least):
                    if len(line) > LONG:  # a run of its own
                        if held:
                            yield pa.RecordBatch.from_arrays(rows(held), names)
                        yield pa.RecordBatch.from_arrays(rows([(doc, h, k, line)]), names)
                        held, size = [], 0
                        continue
                    held.append((doc, h, k, line))
                    size += len(line)
                    if size >= part:
                        yield pa.RecordBatch.from_arrays(rows(held), names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(rows(held), names)

    return docs.mapInArrow(work, schema)


def _bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of 2^26 bits (8 MB, however many ids): words of 64 bits, two bits per id."""
    mask = (1 << BLOOM_BITS) - 1
    bits = ids.select(F.explode(F.array(F.col("id").bitwiseAND(mask), F.shiftright("id", 22).bitwiseAND(mask))).alias("bit"))
    bits = bits.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    found = bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << BLOOM_BITS - 6, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def _maybe(bloom: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the Bloom filter."""
    hit, mask = np.ones(len(ids), bool), np.uint64((1 << BLOOM_BITS) - 1)
    for shift in (0, 22):
        bit = ids >> np.uint64(shift) & mask
        hit &= (bloom[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def _compared(members: DataFrame, threshold: int, per_edit: int = 1) -> DataFrame:
    """Links (a, b: digests) between the lines of members (key, id, own, line): of each key, a line whose own
    segment it is against all others. Of what a task finds, a link that joins nothing new stays there."""
    dealt = chunk_pairs(members, ["key"], "id", F.lit(True), F.length("line") + 256, CHUNK)

    def start() -> Callable[[pa.Table | None], Iterator[pa.RecordBatch]]:
        waiting: dict[tuple[int, int], tuple[str, str]] = {}
        size = 0

        def linked(hit: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([digest(p[k]) for p in hit], pa.binary()) for k in (0, 1)], ["a", "b"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            some = list(waiting.values())
            yield linked([p for p, ok in zip(some, near(some, threshold, per_edit), strict=True) if ok])
            waiting.clear()
            size = 0

        def group(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
            nonlocal size
            if table is None:
                yield from flush()
                return
            ids = table.column("id").to_numpy().view(np.uint64)
            own, at, lines = table.column("own").to_numpy(), table.column("_at").to_numpy(), table.column("line").to_pylist()
            length = np.fromiter(map(len, lines), np.int64, len(lines))
            most = allowed(length, threshold, per_edit)
            one = table.column("_i")[0] == table.column("_j")[0]
            rows, others = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(at == at.min()), np.flatnonzero(at == at.max()))
            found = []
            for begin in range(0, len(rows), 256):
                a = rows[begin : begin + 256, None]
                apart = np.bitwise_count((ids[a] ^ ids[others]) >> np.uint64(48))
                edits = np.minimum(most[a], most[others])
                fits = (apart <= 2 * edits) & (ids[a] != ids[others]) & (abs(length[a] - length[others]) <= edits) & (own[a] | own[others])
                x, y = np.nonzero(fits & (a < others) if one else fits)
                found.append((a[x, 0], others[y], apart[x, y]))
            x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(x) <= 1 << 11:
                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    p, q = (p, q) if ids[p] < ids[q] else (q, p)
                    pair = int(ids[p]), int(ids[q])
                    if pair not in waiting:
                        waiting[pair] = lines[p], lines[q]
                        size += len(lines[p]) + len(lines[q])
                if len(waiting) >= 1 << 13 or size >= 1 << 20:
                    yield from flush()
                return
            # many: the likeliest first, and none whose lines are together already
            forest, order = Forest(len(ids)), np.argsort(apart, kind="stable")
            for begin in range(0, len(order), 1 << 11):
                root, some = forest.roots(), order[begin : begin + (1 << 11)]
                some = some[root[x[some]] != root[y[some]]]
                pairs = [(lines[x[k]], lines[y[k]]) for k in some]
                yield linked([pair for k, pair, ok in zip(some, pairs, near(pairs, threshold, per_edit), strict=True) if ok and forest.join(x[k], y[k])])

        return group

    return in_groups(dealt, ["key", "_i", "_j"], start, "a binary, b binary")


def duplicate_lines(docs: DataFrame, threshold: int = 2, per_edit: int = 12) -> DataFrame:
    """doc_id, doc_hash (of the text), line_no, class, first (doc_id, doc_hash, line_no) of every line
    whose class has more than one occurrence; classes are the components of lines that are equal, or
    within an edit for every per_edit code points of the shorter one, at most threshold edits (line feeds
    divide lines; 12 and 2: one edit from 12 code points on, two from 24 on, as two would chain shorter
    lines that are unlike). first is the occurrence that stays: by doc_id (null last), then hash of the text,
    then line. Blank lines are no lines, of whatever length. Null and empty texts have no lines.
    Occurrences in repeated rows (same id and text) can't be told apart and share their fate. Other columns
    are ignored, an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_hash"), text.alias("text"))

    def occurrences(held: list, only: np.ndarray | None) -> list[pa.Array]:
        digests = [digest(x[3]) for x in held]
        hit = range(len(held)) if only is None else np.flatnonzero(_maybe(only, np.array([int.from_bytes(d[:8]) for d in digests], np.uint64)))
        return [*(pa.array([held[k][c] for k in hit], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))), pa.array([digests[k] for k in hit], pa.binary())]

    def keys(held: list) -> list[pa.Array]:
        lines = list(dict.fromkeys(x[3] for x in held))
        key, of, own = segment_keys(lines, threshold, per_edit=per_edit)
        return [pa.array(key.view(np.int64)), pa.array(line_ids(lines)[of].view(np.int64)), pa.array(own)]

    # a frequent line leaves one row per key and run of lines
    probes = _mapped(docs, "key long, id long, own boolean", keys, per_edit).repartition("key")
    # a filter would go below the exchange, and the lines be mapped again for it; an aggregate takes the exchange as it is
    own = F.when(F.col("own"), F.col("id"))
    heads = probes.groupBy("key").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo is not null")
    apart = F.bit_count(F.shiftrightunsigned(F.col("id").bitwiseXOR(F.col("lo")), 48))
    hits = probes.join(heads, "key").where("id <> lo or id <> hi").where((F.col("lo") != F.col("hi")) | (apart <= 2 * threshold))
    hits = hits.groupBy("key", "id").agg(F.max("own").alias("own"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    # the one line whose segment a key is has been no hit; of several, all have
    hits = hits.select("key", F.explode(F.when(F.col("lo") == F.col("hi"), F.array(F.struct("id", "own"), F.struct(F.col("lo").alias("id"), F.lit(True).alias("own")))).otherwise(F.array(F.struct("id", "own")))).alias("m"))
    hits = cut_lineage(hits.select("key", "m.*").groupBy("key", "id").agg(F.max("own").alias("own")))
    ids = hits.select("id").distinct()
    bloom = _bloom(ids)

    def texts(held: list) -> list[pa.Array]:
        lines = list(dict.fromkeys(x[3] for x in held))
        found = line_ids(lines)
        hit = np.flatnonzero(_maybe(bloom, found))
        return [pa.array(found[hit].view(np.int64)), pa.array([lines[k] for k in hit], pa.string())]

    wanted = _mapped(docs, "id long, line string", texts, per_edit).join(ids, "id", "left_semi").distinct()
    links = cut_lineage(_compared(hits.join(wanted, "id"), threshold, per_edit))
    merged = components(links).withColumnRenamed("node", "line")
    lines = _mapped(docs, "doc_id long, doc_hash long, line_no int, line binary", lambda held: occurrences(held, None))
    where = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_hash", "line_no")
    each = lines.groupBy("line").agg(F.min(where).alias("first"), F.count("*").alias("n"))
    each = cut_lineage(each.join(merged, "line", "left").withColumn("class", F.coalesce("component", "line")).where("n > 1 or component is not null").select("line", "class", "first", "n"))
    whole = each.groupBy("class").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("class", "first")
    whole = each.select("line", "class").join(whole, "class")
    repeated = _bloom(whole.select(F.conv(F.hex(F.substring("line", 1, 8)), 16, -10).cast("long").alias("id")))
    again = _mapped(docs, "doc_id long, doc_hash long, line_no int, line binary", lambda held: occurrences(held, repeated))
    return again.join(whole, "line").select("doc_id", "doc_hash", "line_no", "class", "first")


def removed_lines(docs: DataFrame, threshold: int = 2, per_edit: int = 12) -> DataFrame:
    """doc_id, doc_hash and removed (sorted numbers of the lines that don't stay) of documents that lose lines."""
    lines = duplicate_lines(docs, threshold, per_edit)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("doc_hash") == F.col("first.doc_hash")) & (F.col("line_no") == F.col("first.line_no"))
    return lines.where(~stays).groupBy("doc_id", "doc_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def _without(text: Column, removed: Column) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        def one(t, gone):
            if t is None or gone is None:
                return t
            gone = set(gone)
            return "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)

        return pd.Series([one(t, gone) for t, gone in zip(texts, numbers, strict=True)], dtype=object)

    return cut(text, removed)


def dedup_lines(docs: DataFrame, threshold: int = 2, per_edit: int = 12) -> DataFrame:
    """docs with column text without its repeated lines; rows and other columns stay as they are."""
    own = [free_name(docs, c) for c in ("gone_id", "gone_hash", "gone")]
    gone = removed_lines(docs, threshold, per_edit).toDF(*own)
    text = F.col("text").cast("string")
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own[0])) & (F.xxhash64(text) == F.col(own[1])), "left")
    return joined.withColumn("text", _without(text, F.col(own[2]))).select(*docs.columns)
