"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets are one class from the start. Bands of full minima give candidates;
the low bits of all minima, packed, give a similarity estimate that corrects for chance agreement and
weeds candidates out; what is left is confirmed on full shingle sets. A bucket is first compared with
three centres, so that a large group of near copies costs as many pairs as it has members. What is
still apart in a bucket is then compared exhaustively, inside tasks: its members are dealt to chunks,
each pair of chunks meets in one task, which compares small sets whole and larger ones by a finer
estimate. Links of a spanning forest leave it; of the larger sets, in a second round, also the rest of
what the confirmed ones have not joined. So no link that would join components is lost, and no pair of
rows is ever made to be thrown away.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, bounded_batches, chunk_pairs, cut_lineage, in_groups
from .components import components

BANDS, ROWS, LOW_BITS = 32, 5, 4
HASHES = BANDS * ROWS
LONGS = HASHES * LOW_BITS // 64
#: Sets of so many shingles at most are compared whole in their buckets.
EXACT = 256
#: The estimate of larger ones: minima of so many bins of one hash, three low bits each and one that tells whether the bin is in use.
BINS = 2048
#: Members of a bucket that a chunk holds.
CHUNK = 1024
_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_BAND = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the text, A-Z lower-cased; with fewer words
    than width all words make one shingle, without words the set is empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * _C[k % 3]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (int64), and the packed low bits of the minima (int64)."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 512):
        block = shingles[at : at + 512, None] * _A[None, :] + _B[None, :]
        least = np.minimum(least, (block >> np.uint64(32)).min(axis=0))
    keys = (least.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64)
    keys = (keys ^ keys >> np.uint64(31)) * _C[0] + np.arange(BANDS, dtype=np.uint64)
    low = (least & np.uint64((1 << LOW_BITS) - 1)).reshape(LONGS, -1)
    packed = (low << (np.arange(64 // LOW_BITS, dtype=np.uint64) * np.uint64(LOW_BITS))).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def estimate(x: Column, y: Column) -> Column:
    """Similarity of two packed signatures: the share of equal low bits, less what chance makes equal."""
    ones = int("0001" * 16, 2)

    def unequal(a: Column, b: Column) -> Column:
        d = a.bitwiseXOR(b)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(ones).cast("long")))

    apart = sum((unequal(x[k], y[k]) for k in range(1, LONGS)), unequal(x[0], y[0]))
    chance = 1 / (1 << LOW_BITS)
    return (1 - apart / HASHES - chance) / (1 - chance)


def _least_estimate(percent: int) -> float:
    """What the estimate of a pair at the limit falls short of with a chance of 3e-7: five standard errors."""
    chance = 1 / (1 << LOW_BITS)
    equal = percent / 100 * (1 - chance) + chance
    return percent / 100 - 5 * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, class (128-bit digest of the shingle set), keys, low of each row of docs (doc_id,
    text, then what comes along)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, keys, low = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                k, p = signature(s) if len(s) else (None, None)
                keys.append(k)
                low.append(p)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(low, longs), *batch.columns[2:]],
                ["doc_id", "n_shingles", "class", "keys", "low", *carry],
            )

    carry = docs.columns[2:]
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    return docs.mapInArrow(work, f"doc_id long, n_shingles long, class binary, keys array<long>, low array<long>{kinds}")


def sketch(shingles: np.ndarray) -> bytes:
    """Three low bits of the least hash in each of BINS bins, and a bit that says that the bin is in use."""
    x = np.sort((shingles ^ shingles >> np.uint64(31)) * _C[1])
    place = (x >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[place[first]] = (x[first] >> np.uint64(8) & np.uint64(7)).astype(np.uint8) | 8
    return (out[::2] << 4 | out[1::2]).tobytes()


_ONES = np.uint64(int("0001" * 16, 2))


def _unequal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Marks (0001) of the four-bit fields in which packed words differ."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return d & _ONES


def sketches_pass(x: np.ndarray, y: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sketches (rows of 64-bit words) of sets with size elements together may have the
    similarity percent: whether their estimate, less chance agreements, is at most five standard errors
    short of it. Of the union the bins in use show a sample without replacement, so where nearly all
    of it shows little but chance agreements is uncertain."""
    used = lambda w: w >> np.uint64(3) & _ONES
    same = np.bitwise_count(used(x & y) & ~_unequal(x, y)).sum(axis=1, dtype=np.int64)
    both = np.bitwise_count(used(x & y)).sum(axis=1, dtype=np.int64)
    either = np.bitwise_count(used(x | y)).sum(axis=1, dtype=np.int64)
    limit = percent / 100
    union = np.maximum(size / (1 + limit), either + 1)
    error = limit * (1 - limit) * (union - either) / (union - 1) + (1 - limit) / 7
    return (same - both / 8) * 8 / 7 / either >= limit - 5 * np.sqrt(error / either) - 1 / either


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements the sets x[k] and y[k] have in common, by bit maps of the elements that more than one set has."""
    sizes = np.array([len(s) for s in sets])
    of, (_, which, times) = np.repeat(np.arange(len(sets)), sizes), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    of, which = of[times[which] > 1], place[which[times[which] > 1]]
    words = np.zeros((len(sets), (int(place[-1]) + 64) // 64 if len(place) else 1), np.uint64)
    np.bitwise_or.at(words, (of, which >> 6), np.uint64(1) << (which & 63).astype(np.uint64))
    step = max(1, (1 << 20) // words.shape[1])
    return np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(words[x[at : at + step]] & words[y[at : at + step]]).sum(axis=1, dtype=np.int64) for at in range(0, len(x), step))])


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """class, sketch and the shingle set itself, packed, of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f(s) for s in sets], pa.binary()) for f in (lambda s: xxhash.xxh3_128_digest(s.tobytes()), sketch, np.ndarray.tobytes)], ["class", "sketch", "shingles"]
            )

    return docs.mapInArrow(work, "class binary, sketch binary, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have 100 * intersection >= percent * union."""
    full = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("t")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
                both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                hit.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    return full.select("a", "b", "s", "t").mapInArrow(work, "a binary, b binary")


def _apart(at: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, large: bool) -> DataFrame:
    """Members (at: key, class, component) of buckets with several components, dealt to pairs of chunks;
    all but those of a bucket's largest component have to meet all others. If large, just members
    that may have to be compared by sketches."""
    size = F.col("n_shingles")
    if large:
        at = at.join(classes.where(100 * size > percent * EXACT).select("class"), "class", "left_semi")
    split = at.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("n")).where("n > 1").select("key", "main")
    apart = at.join(split, "key").select("key", "class", "component", "main")
    dealt = chunk_pairs(apart, ["key"], "class", F.col("component") != F.col("main"), F.lit(1), CHUNK).drop("main")
    dealt = dealt.join(classes.select("class", "n_shingles", "low", "keys"), "class")
    # whole or sketch or, where either may be needed, both
    return dealt.join(sets.select("class", "sketch", "shingles"), "class").withColumns({
        "sketch": F.when(100 * size > percent * EXACT, F.col("sketch")), "shingles": F.when((size <= EXACT) & F.lit(not large), F.col("shingles")),
    })


def _candidates(dealt: DataFrame, percent: int, large: bool) -> DataFrame:
    """Pairs (a, b) of classes of different components, each in the first bucket that the two share: small
    sets that are similar, and larger ones that both estimates pass; if large all of the latter, else
    enough of all to hold together what they would join."""
    least = _least_estimate(percent)

    def work(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
        if table is None:
            return
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
        low, keys = flat("low"), flat("keys")
        label = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        size, left, at, key = (table.column(c).to_numpy() for c in ("n_shingles", "_left", "_at", "key"))
        one = table.column("_i")[0] == table.column("_j")[0]
        rows, others = (np.flatnonzero(left), np.arange(len(at))) if one else (np.flatnonzero(at == at.min()), np.flatnonzero(at == at.max()))
        found = [(rows[:0], rows[:0])]
        for start in range(0, len(rows) if len(others) else 0, 32):
            a = rows[start : start + 32]
            differ = np.bitwise_count(_unequal(low[a][:, None, :], low[others][None, :, :])).sum(axis=2, dtype=np.int64)
            fits = (1 - differ / HASHES - 1 / (1 << LOW_BITS)) / (1 - 1 / (1 << LOW_BITS)) >= least
            fits &= label[a][:, None] != label[others][None, :]
            if one:  # a pair of two rows on the left just once
                fits &= ~left[others][None, :] | (a[:, None] < others[None, :])
            x, y = np.nonzero(fits)
            x, y = a[x], others[y]
            ok = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
            x, y = x[ok], y[ok]
            if len(x):
                ok = keys[x, (keys[x] == keys[y]).argmax(axis=1)].view(np.int64) == key[0]
                found.append((x[ok], y[ok]))
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(x):
            return
        small, good = (size[x] <= EXACT) & (size[y] <= EXACT), np.zeros(len(x), bool)
        if small.any() and not large:
            of = np.flatnonzero(size <= EXACT)
            sets, local = table.column("shingles").to_pylist(), np.cumsum(size <= EXACT) - 1
            both = overlaps([np.frombuffer(sets[k], np.uint64) for k in of], local[x[small]], local[y[small]])
            good[small] = 100 * both >= percent * (size[x[small]] + size[y[small]] - both)
        if not small.all():
            of, local = np.flatnonzero(100 * size > percent * EXACT), np.cumsum(100 * size > percent * EXACT) - 1
            sketches = table.column("sketch").to_pylist()
            whole = np.frombuffer(b"".join(sketches[k] for k in of), np.uint64).reshape(len(of), -1)
            for part in np.array_split(np.flatnonzero(~small), len(x) // 4096 + 1):
                good[part] = sketches_pass(whole[local[x[part]]], whole[local[y[part]]], size[x[part]] + size[y[part]], percent)
        x, y = x[good], y[good]
        if not large:
            first = np.argsort(~small[good], kind="stable")  # what is certain before what still has to be confirmed
            x, y = x[first], y[first]
            forest = Forest(int(label.max()) + 1)
            kept = [k for k, (p, q) in enumerate(zip(label[x].tolist(), label[y].tolist(), strict=True)) if forest.join(p, q)]
            x, y = x[kept], y[kept]
        names = table.column("class").combine_chunks()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), names.take(pa.array(y))], ["a", "b"])

    return in_groups(dealt, ["key", "_i", "_j"], lambda: work, "a binary, b binary")


def _labels(alone: DataFrame, links: DataFrame) -> DataFrame:
    """class and component of every class in alone (which is its own component if nothing links it)."""
    met = components(links)
    return cut_lineage(alone.join(met.withColumnRenamed("component", "met"), F.col("class") == F.col("node"), "left").select("class", F.coalesce("met", "component").alias("component")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Rows are linked if 100 * intersection >= percent * union of their sets of width-word shingles;
    component_id is the smallest doc_id of a connected component, and its row is kept. Null, empty
    and wordless texts have empty sets and are linked with nothing; equal sets always are linked.
    Rows that share a doc_id are judged by their own texts, so an id may be kept in one row and not
    in another; repeated rows have one verdict. A null doc_id counts as larger than any other and is
    kept only if its component has no other. Other columns are ignored, an empty table gives no rows.
    With carry, columns whose names must not clash with those above come along, and component (binary,
    null for an empty set) tells components apart, even if they share a smallest doc_id. A link at the
    limit escapes all bands with a chance of 7e-9 (percent 85; 4e-6 at 80 for a lone pair), and one of
    sets of over 256 shingles the finer sketch with a chance of about 3e-7.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    rows = cut_lineage(signatures(docs, width))
    least = F.min_by(F.struct("doc_id", "n_shingles", "keys", "low"), F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    classes = cut_lineage(rows.where("n_shingles > 0").groupBy("class").agg(least.alias("r")).select("class", "r.*"))
    banded = classes.select("class", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.min_by("class", F.xxhash64("class")).alias("c2")).where("c0 <> c1")
    members = cut_lineage(banded.join(buckets, "key"))
    some = members.select("class").distinct().join(classes.select("class", "doc_id"), "class")
    wanted = some.select(F.col("doc_id").alias("id"))
    sets = _sets(docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"), width)
    # one row per class, also where rows share a doc_id
    sets = cut_lineage(sets.join(some.select("class"), "class", "left_semi").groupBy("class").agg(F.first("sketch").alias("sketch"), F.first("shingles").alias("shingles")))

    def ordered(p: DataFrame) -> DataFrame:
        return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    alone = members.select("class").distinct().select("class", F.col("class").alias("component"))
    centre = F.explode(F.array("c0", "c1", "c2")).alias("b")
    stars = cut_lineage(ordered(members.select(F.col("class").alias("a"), centre).where("a <> b")))
    low = classes.select("class", "low")
    close = stars.join(low.withColumnsRenamed({"class": "a", "low": "x"}), "a").join(low.withColumnsRenamed({"class": "b", "low": "y"}), "b")
    close = close.where(estimate(F.col("x"), F.col("y")) >= _least_estimate(percent)).select("a", "b")
    links = cut_lineage(_confirmed(close, sets, percent))
    label = _labels(alone, links)
    for large in (False, True):
        dealt = _apart(members.select("key", "class").join(label, "class"), classes, sets, percent, large)
        pairs = ordered(_candidates(dealt, percent, large)).join(stars, ["a", "b"], "left_anti")
        more = cut_lineage(_confirmed(pairs, sets, percent))
        if more.limit(1).count():
            links = links.union(more)
            label = _labels(alone, links)
    first = classes.select("class", "doc_id").join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = first.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    first = first.join(lowest, "component").select("class", "component_id", "component")
    out = rows.select("doc_id", "n_shingles", "class", *carry).join(first, "class", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *carry, *["component"] * bool(carry))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
