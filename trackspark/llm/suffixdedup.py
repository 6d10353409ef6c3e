"""Removal of repeated byte strings: what a document shares with an earlier one, found by suffix arrays.

Every window of 50 bytes is led to where its equals are by the smallest hash of its 20-byte strings, its
anchor: equal windows have equal anchors. Documents are packed into chunks of about two megabytes. Buckets of
anchors tell each chunk which of its anchors stand elsewhere too. The windows that such an anchor leads make
a segment of text; segments are named by a hash, so that copies are settled by the smallest id of their
documents, and only one of each distinct segment is sent, and that only if its anchor has others. The
segments of an anchor are put one after the other, the suffix array of the whole is built by linear grouping
(suffixes.py), and windows that stand side by side in it and agree are one string, with the smallest id of its
documents. A bit per window goes back: whether a smaller id than the chunk's own has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut_in_buckets, cut_lineage, in_groups
from .suffixes import ranges, suffix_arrays

LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Runs of windows whose places are written out at a time.
_STEP = 1 << 14


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of data, from those of powers of two."""
    part, size, whole, done = data.astype(np.uint64), 1, None, 0
    while True:
        if k & size:
            if whole is None:
                whole = part
            else:
                m = len(part) - done
                whole = whole[:m] * np.uint64(pow(_BASE, size, _MASK + 1)) + part[done:]
            done += size
        if 2 * size > k:
            return _mixed(whole)
        m = len(part) - size
        part, size = part[:m] * np.uint64(pow(_BASE, size, _MASK + 1)) + part[size:], 2 * size


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width values in a row."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, lengths: np.ndarray, span: int, gram: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the first window of each, their number (at most as many as a
    window has grams), the anchor's hash. Windows stay within a text; lengths are those of the texts in data."""
    width, ends = span - gram + 1, np.cumsum(lengths)
    found, at = [], 0
    while at < len(lengths):
        start = int(ends[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(ends, start + block, "right")))
        part, last = data[start : int(ends[to - 1])], np.repeat(ends[at:to] - start, lengths[at:to])
        at = to
        if len(part) < span:
            continue
        least = _least_of(_gram_hashes(part, gram), width)
        place = np.flatnonzero(np.arange(len(least)) + span <= last[: len(least)])
        if not len(place):
            continue
        least = least[place]
        change = np.concatenate([[True], (least[1:] != least[:-1]) | (place[1:] != place[:-1] + 1)])
        run = np.flatnonzero(change)
        size = np.diff(np.append(run, len(place)))
        if size.max() > width:  # a text that repeats itself has one anchor over and over
            change |= (np.arange(len(place)) - np.repeat(run, size)) % width == 0
            run = np.flatnonzero(change)
            size = np.diff(np.append(run, len(place)))
        found.append((place[run] + start, size, least[run]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | the low half of the hash, mixed anew: anchors are least hashes, which crowd the lowest buckets."""
    hashes = _mixed(hashes)
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def _by_bucket(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """bucket, first, end of each bucket in sorted keys."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)).tolist() if len(bucket) else []
    for a, b in zip([0, *ends], ends, strict=False):
        yield int(bucket[a]), a, b


class Runs:
    """A chunk's runs of windows with shared anchors, and the distinct segments ("items") they are of, in
    the order of the anchors' keys."""

    #: What is kept of a chunk: where runs start and which item they are, where an item stands, its
    #: number of windows, which document of those that have it has the smallest id.
    KEPT = {"starts": np.int32, "item": np.int32, "begin": np.int32, "count": np.uint16, "least": np.int32}

    def __init__(self, **kept: np.ndarray):
        self.starts, self.item, self.begin, self.count, self.least = (kept[k].astype(np.int64) for k in self.KEPT)

    @classmethod
    def found(cls, text: bytes, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, owner: np.ndarray, more: int) -> tuple[Runs, np.ndarray, bytes]:
        """Runs that start there, of so many windows, with their keys, in the documents ranked so; also the
        keys of the items, and their names, 8 bytes each."""
        known: dict[bytes, int] = {}
        item = np.fromiter((known.setdefault(text[a:b], len(known)) for a, b in zip(starts.tolist(), (starts + sizes + more).tolist(), strict=True)), np.int64, len(starts))
        least, some = np.full(len(known), LAST), np.zeros(len(known), np.int64)
        np.minimum.at(least, item, owner)
        some[item] = np.arange(len(starts))
        by = np.argsort(keys[some], kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        names = [hashlib.blake2b(x, digest_size=8).digest() for x in known]
        runs = cls(starts=starts, item=place[item], begin=starts[some][by], count=sizes[some][by], least=least[by])
        return runs, keys[some][by], b"".join(names[k] for k in by.tolist())

    def kept(self) -> list[bytes]:
        return [getattr(self, k).astype(kind).tobytes() for k, kind in self.KEPT.items()]


class Sent:
    """The items that a chunk sends, told what buckets say of each: nothing (0), a smaller id has it (1), send
    (2), send its windows one by one (3). In the order of keys."""

    def __init__(self, data: np.ndarray, runs: Runs, keys: np.ndarray, verdict: np.ndarray, span: int, buckets: int):
        whole, single = np.flatnonzero(verdict == 2), np.flatnonzero(verdict == 3)
        at = ranges(runs.begin[single], runs.count[single])
        keys = np.concatenate([keys[whole], _key(_window_hashes(data, at, span), buckets)])
        by = np.argsort(keys, kind="stable")
        self.keys = keys[by]
        self.item = np.concatenate([whole, np.repeat(single, runs.count[single])])[by]
        self.begin = np.concatenate([runs.begin[whole], at])[by]
        self.count = np.concatenate([runs.count[whole], np.ones(len(at), np.int64)])[by]

    def earlier(self, runs: Runs, told: np.ndarray) -> np.ndarray:
        """Whether a smaller id has it, for each window of each item of runs, told it of those sent."""
        base, ends = np.cumsum(runs.count) - runs.count, np.append(0, np.cumsum(self.count))
        out = np.zeros(int(runs.count.sum()), bool)
        for i in range(0, len(self.item), _STEP):
            item, count = self.item[i : i + _STEP], self.count[i : i + _STEP]
            out[ranges(base[item] + self.begin[i : i + _STEP] - runs.begin[item], count)] = told[ends[i] : ends[i + len(item)]]
        return out


def _window_hashes(data: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    powers = np.array([pow(_BASE, i, _MASK + 1) for i in range(span)], np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(data, span) if len(at) else None
    return np.concatenate([np.zeros(0, np.uint64), *[_mixed((view[at[i : i + 65536]] * powers).sum(1, dtype=np.uint64)) for i in range(0, len(at), 65536)]])


def first_ids(data: np.ndarray, sizes: np.ndarray, keys: np.ndarray, least: np.ndarray, span: int, batch: int = 1 << 19, crowd: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each window of each of the segments in data, and where those of a segment
    begin. Segments have a key, and the smallest id of their own; equal windows are in segments of one key.
    Keys with more than crowd segments have their windows sorted as strings instead, as a suffix array takes
    as many steps as its text is long. Both are worked off in parts of whole keys, of about batch symbols, and
    windows of an eighth of that."""
    begin, count = np.cumsum(sizes) - sizes, sizes - span + 1
    base = np.cumsum(count) - count
    first = np.repeat(least, count)
    by = np.argsort(keys, kind="stable")
    run = np.flatnonzero(np.concatenate([[True], keys[by][1:] != keys[by][:-1]])) if len(by) else np.zeros(0, np.int64)
    members = np.diff(np.append(run, len(by)))
    ends = np.append(0, np.cumsum(count[by]))
    many = np.flatnonzero(members > crowd)
    part = np.cumsum(ends[run[many] + members[many]] - ends[run[many]]) // max(batch >> 3, 1)
    for pick in np.split(many, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(many) else ():
        crowded = by[ranges(run[pick], members[pick])]
        place, window = ranges(begin[crowded], count[crowded]), ranges(base[crowded], count[crowded])
        _, same = np.unique(np.ndarray(len(data) - span + 1, f"S{span}", data, 0, (1,))[place], return_inverse=True)
        low = np.full(len(place), LAST)
        np.minimum.at(low, same, first[window])
        first[window] = low[same]
    run, members = run[(members > 1) & (members <= crowd)], members[(members > 1) & (members <= crowd)]
    ends = np.append(0, np.cumsum(sizes[by]))
    length = ends[run + members] - ends[run] + members + 1
    order = np.argsort(length, kind="stable")  # texts of about one length go through the steps together
    part = np.cumsum(length[order]) // batch
    for b in np.unique(part):
        pick = order[part == b]
        segment = by[ranges(run[pick], members[pick])]
        # a separator of 1 after each segment, 0 at the end of each text; bytes are 2 and more
        cells = sizes[segment] + 1
        cells[np.cumsum(members[pick]) - 1] += 1
        at = np.cumsum(cells) - cells
        symbols = np.ones(int(cells.sum()), np.int16)
        symbols[ranges(at, sizes[segment])] = data[ranges(begin[segment], sizes[segment])].astype(np.int16) + 2
        symbols[np.cumsum(length[pick]) - 1] = 0
        window, text = np.full(len(symbols), -1), np.zeros(len(symbols), np.int64)
        window[ranges(at, count[segment])] = ranges(base[segment], count[segment])
        text[ranges(at, count[segment])] = ranges(begin[segment], count[segment])
        array = suffix_arrays(symbols, length[pick])
        array = array[window[array] >= 0]
        view, place = np.lib.stride_tricks.sliding_window_view(data, span), text[array]
        differs = np.ones(len(array), bool)
        for i in range(1, len(array), 65536):
            j = min(len(array), i + 65536)
            differs[i:j] = (view[place[i:j]] != view[place[i - 1 : j - 1]]).any(1)
        window, head = window[array], np.flatnonzero(differs)
        first[window] = np.repeat(np.minimum.reduceat(first[window], head), np.diff(np.append(head, len(array))))
    return first, base


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """chunk, ids, order (of ids, null last), lengths, texts: documents side by side, texts compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            order = np.array([LAST if i is None else i for i in ids], np.int64).tobytes()
            lengths = np.array([len(t) for t in texts], np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in (order, lengths, pa.compress(b"".join(texts), "zstd", asbytes=True))]], ["chunk", "ids", "order", "lengths", "texts"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= chunk_bytes or len(ids) >= chunk_bytes >> 6:
                    yield out()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield out()

    return docs.mapInArrow(pack, "chunk long, ids array<long>, order binary, lengths binary, texts binary")


def _rows(make: Callable[[dict], Iterator[tuple]], names: list[str], types: list[pa.DataType]) -> Callable:
    """A map over the rows of Arrow batches that yields what each row makes in batches of about a megabyte, as
    Spark takes them up beside its heap."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

        for batch in batches:
            for n in range(batch.num_rows):
                made, size = [], 0
                for row in make(batch.slice(n, 1).to_pylist()[0]):
                    made.append(row)
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    if size >= 1 << 20:
                        yield out()
                        made, size = [], 0
                if made:
                    yield out()

    return over


class Texts:
    """The documents of a chunk."""

    def __init__(self, row: dict):
        self.lengths, self.order = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["order"], np.int64)
        self.bytes = pa.decompress(row["texts"], int(self.lengths.sum()), "zstd", asbytes=True) if self.lengths.any() else b""
        self.data, self.ends = np.frombuffer(self.bytes, np.uint8), np.cumsum(self.lengths)
        # documents by the order of their ids, equal ids by the first of them
        self.ranked, self.rank = np.unique(self.order, return_inverse=True)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")


def _told(answers: list[dict] | None) -> list[bytes]:
    """What the buckets told a chunk, in the order of its keys."""
    return [a["told"] for a in sorted(answers or [], key=lambda a: a["bucket"])]


def _bits(told: list[bytes], counts: list[int]) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(bool) for t, n in zip(told, counts, strict=True)]])


def remove_repeats(docs: DataFrame, span: int = 50, gram: int = 20, chunk_bytes: int = 1 << 21, crowd: int = 4096, batch_bytes: int = 1 << 22) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, length in bytes), kept (binary): each text of docs (doc_id,
    text) in UTF-8 without the bytes covered by a string of span bytes that also starts in a document
    with a smaller doc_id. Strings are judged on the input, and never cross documents.

    Null texts are empty. A null doc_id counts as the largest id. Rows with equal ids are not smaller than
    one another and keep what they share; repeated rows so keep their text. Kept bytes may end within a
    character. Other columns are ignored, an empty table gives no rows.

    Texts are shuffled once, compressed, into a table in buckets that the steps read as it lies. Beyond that
    go 5 bytes per distinct anchor of a chunk (one in 16 of text), 20 per distinct segment of a shared anchor,
    and each distinct segment that has unlike ones beside it once. What many documents share has a row per
    chunk, no text. Anchors with more than crowd distinct segments send their windows one by one, dealt by
    their own hashes, so that no anchor gathers an unbounded text. There are two buckets per shuffle
    partition; what chunks ask of a bucket must fit in a task."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, binary = 2 * n, pa.binary()
    texts = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    chunks = _chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts), chunk_bytes)
    chunks = cut_in_buckets(chunks.repartition(n, "chunk"), "chunk")

    def answered(rows: DataFrame, start: Callable, name: str) -> DataFrame:
        """What a bucket's worker tells, as a list per chunk."""
        told = cut_lineage(in_groups(rows, ["bucket"], start, "chunk long, bucket int, told binary"))
        return told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told")).alias(name))

    def reply(rows: pa.Table, told: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("chunk").combine_chunks(), rows.column("bucket").combine_chunks(), pa.array(told, binary)], ["chunk", "bucket", "told"])

    def parts(rows: pa.Table, **kinds: type) -> list[list[np.ndarray]]:
        return [[np.frombuffer(x.as_buffer(), kind) for x in rows.column(c)] for c, kind in kinds.items()]

    # which anchors stand more than once
    def ask(row: dict) -> Iterator[tuple]:
        t = Texts(row)
        keys, times = np.unique(_key(anchors(t.data, t.lengths, span, gram)[2], buckets), return_counts=True)
        low, many = keys.astype(np.uint32), times > 1
        for bucket, a, b in _by_bucket(keys):
            yield bucket, row["chunk"], low[a:b].tobytes(), many[a:b].tobytes()

    def share() -> Callable:
        def over(rows: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if rows is None:
                return
            keys, many = parts(rows, keys=np.uint32, many=np.uint8)
            ends = np.cumsum([len(k) for k in keys]).tolist()
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            shared = (np.bincount(at, 1 + np.concatenate(many)) > 1)[at]
            yield reply(rows, [np.packbits(shared[e - len(k) : e]).tobytes() for e, k in zip(ends, keys, strict=True)])

        return over

    source = ["chunk", "order", "lengths", "texts"]
    asked = chunks.select(*source).mapInArrow(_rows(ask, ["bucket", "chunk", "keys", "many"], [pa.int32(), pa.int64(), binary, binary]), "bucket int, chunk long, keys binary, many binary")
    shared = answered(asked, share, "shared")

    # which segments of theirs are copies, which have others beside them
    names = ["chunk", "bucket", "keys", "names", "owners", *Runs.KEPT]

    def name(row: dict) -> Iterator[tuple]:
        t = Texts(row)
        starts, sizes, hashes = anchors(t.data, t.lengths, span, gram)
        keys, at = np.unique(_key(hashes, buckets), return_inverse=True)
        pick = np.flatnonzero(_bits(_told(row["shared"]), [b - a for _, a, b in _by_bucket(keys)])[at])
        runs, keys, called = Runs.found(t.bytes, starts[pick], sizes[pick], keys[at[pick]], t.rank[t.document(starts[pick])], span - 1)
        low, owners = keys.astype(np.uint32), t.ranked[runs.least] if len(keys) else keys
        yield row["chunk"], -1, keys.tobytes(), None, None, *runs.kept()
        for bucket, a, b in _by_bucket(keys):
            yield row["chunk"], bucket, low[a:b].tobytes(), called[8 * a : 8 * b], owners[a:b].tobytes(), *[None] * len(Runs.KEPT)

    def judge() -> Callable:
        def over(rows: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if rows is None:
                return
            keys, called, owners = parts(rows, keys=np.uint32, names=np.uint64, owners=np.int64)
            ends, key, owner = np.cumsum([len(k) for k in keys]).tolist(), np.concatenate(keys), np.concatenate(owners)
            by = np.lexsort((np.concatenate(called), key))
            new = np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (np.concatenate(called)[by][1:] != np.concatenate(called)[by][:-1])])
            segment = np.empty(len(by), np.int64)
            segment[by] = np.cumsum(new) - 1
            least = np.full(int(new.sum()), LAST)
            np.minimum.at(least, segment, owner)
            _, of = np.unique(key[by][new], return_inverse=True)
            others = np.bincount(of)[of][segment]
            verdict = np.where(owner > least[segment], 1, np.where(others > crowd, 3, np.where(others > 1, 2, 0))).astype(np.uint8).tobytes()
            yield reply(rows, [verdict[e - len(k) : e] for e, k in zip(ends, keys, strict=True)])

        return over

    kinds = [pa.int64(), pa.int32(), *[binary] * 8]
    schema = "chunk long, bucket int, keys binary, names binary, owners binary, " + ", ".join(f"{k} binary" for k in Runs.KEPT)
    named = cut_in_buckets(chunks.join(shared, "chunk", "left").select(*source, "shared").mapInArrow(_rows(name, names, kinds), schema), "chunk")
    verdicts = answered(named.where("bucket >= 0").select("chunk", "bucket", "keys", "names", "owners"), judge, "verdicts")
    known = chunks.join(named.where("bucket = -1").select("chunk", "keys", *Runs.KEPT), "chunk").join(verdicts, "chunk", "left")
    source = ["chunk", "ids", "order", "lengths", "texts", "keys", *Runs.KEPT, "verdicts"]

    def taken_up(row: dict) -> tuple[Texts, Runs, np.ndarray, Sent]:
        t, runs = Texts(row), Runs(**{k: np.frombuffer(row[k], kind) for k, kind in Runs.KEPT.items()})
        verdict = np.frombuffer(b"".join(_told(row["verdicts"])), np.uint8)
        return t, runs, verdict, Sent(t.data, runs, np.frombuffer(row["keys"], np.uint64), verdict, span, buckets)

    # the strings that unlike segments share
    def send(row: dict) -> Iterator[tuple]:
        t, runs, _, sent = taken_up(row)
        low, sizes = sent.keys.astype(np.uint32), (sent.count + span - 1).astype(np.uint16)
        owners = t.ranked[runs.least[sent.item]] if len(low) else sent.item
        for bucket, a, b in _by_bucket(sent.keys):
            yield bucket, row["chunk"], low[a:b].tobytes(), sizes[a:b].tobytes(), t.data[ranges(sent.begin[a:b], sizes[a:b].astype(np.int64))].tobytes(), owners[a:b].tobytes()

    def resolve() -> Callable:
        held: list[pa.Table] = []

        def over(rows: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if rows is not None:
                held.append(rows)
            if not held or rows is not None and sum(t.nbytes for t in held) < batch_bytes:
                return
            table = pa.concat_tables(held)
            held.clear()
            keys, sizes, segments, owners = parts(table, keys=np.uint32, sizes=np.uint16, segments=np.uint8, owners=np.int64)
            many = [len(k) for k in keys]
            key = np.repeat(table.column("bucket").to_numpy().astype(np.uint64) << np.uint64(32), many) | np.concatenate(keys)
            size, owner = np.concatenate(sizes).astype(np.int64), np.concatenate(owners)
            first, _ = first_ids(np.concatenate(segments), size, key, owner, span)
            earlier = first < np.repeat(owner, size - span + 1)
            ends = np.cumsum([int(s.sum(dtype=np.int64)) - (span - 1) * len(s) for s in sizes]).tolist()
            yield reply(table, [np.packbits(earlier[a:b]).tobytes() for a, b in zip([0, *ends], ends, strict=False)])

        return over

    sent = known.select(*source).mapInArrow(_rows(send, ["bucket", "chunk", "keys", "sizes", "segments", "owners"], [pa.int32(), pa.int64(), *[binary] * 4]), "bucket int, chunk long, keys binary, sizes binary, segments binary, owners binary")
    earlier = answered(sent, resolve, "earlier")

    def cut(row: dict) -> Iterator[tuple]:
        t, runs, verdict, sent = taken_up(row)
        told = _bits(_told(row["earlier"]), [int(sent.count[a:b].sum()) for _, a, b in _by_bucket(sent.keys)])
        windows, base = sent.earlier(runs, told), np.cumsum(runs.count) - runs.count
        count, whole = runs.count[runs.item], (verdict == 1)[runs.item] | (t.rank[t.document(runs.starts)] > runs.least[runs.item])
        gone = np.zeros(len(t.data), bool)  # where windows start that go
        for i in range(0, len(count), _STEP):
            some, item = slice(i, i + _STEP), runs.item[i : i + _STEP]
            places = ranges(runs.starts[some], count[some])
            gone[places[np.repeat(whole[some], count[some]) | windows[ranges(base[item], count[some])]]] = True
        starts = np.cumsum(gone, dtype=np.int32)
        starts[span:] -= starts[:-span].copy()
        out, start = starts > 0, 0
        for doc_id, length in zip(row["ids"], t.lengths.tolist(), strict=True):
            data, g = t.data[start : start + length], out[start : start + length]
            start += length
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))).reshape(-1, 2)
            yield doc_id, length, [{"start": a, "length": b - a} for a, b in edge.tolist()], data[~g].tobytes() if len(edge) else data.tobytes()

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    whole = known.join(earlier, "chunk", "left").select(*source, "earlier")
    return whole.mapInArrow(_rows(cut, ["doc_id", "n_bytes", "spans", "kept"], [pa.int64(), pa.int64(), kind, binary]), "doc_id long, n_bytes long, spans array<struct<start: long, length: long>>, kept binary")
