"""Token counts by rank-synchronous merging of ragged numpy arrays.

A text is cut into pre-tokens where no piece of the vocabulary can span the cut. The pre-tokens of a
batch that are new stand end to end in one array of symbols; each round looks up the rank of every
adjacent pair, finds each sequence's lowest rank and merges it in all sequences at once. Two things keep
long sequences from taking a round per merge: runs of the space mark, whose pieces all share the last
rank, are counted by a rule, and a sequence of thousands of symbols without a cut goes through a queue.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SPACE = "▁"
NONE = np.iinfo(np.int32).max
_MODELS: dict = {}


class RankMerger:
    """The merges of a sentencepiece BPE model with byte fallback and no normalisation but the space mark."""

    def __init__(self, path: str, remember: int = 1 << 19, long: int = 48, most: int = 4096):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        pieces = {p.piece: p.score for p in model.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL}
        if (
            spec.model_type != pb.TrainerSpec.BPE
            or not spec.byte_fallback
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not (norm.add_dummy_prefix and norm.escape_whitespaces)
            or any(SPACE in p.lstrip(SPACE) for p in pieces)
            or any(p.type in (4, 5) for p in model.pieces)
        ):
            raise ValueError(f"{path}: not a BPE model of the supported kind")
        self.remember, self.long, self.most, self.known, self.pairs = remember, long, most, {}, None
        self.bigrams = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        chars = sorted({c for p in pieces for c in p})
        self.symbol = {s: k for k, s in enumerate(dict.fromkeys([*chars, *pieces]))}
        self.char_of = np.array([ord(c) for c in chars], np.int64)  # sorted; symbol number = place
        level = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        keys, ranks, made = [], [], []
        early = np.zeros(len(self.symbol), bool)  # a merge with it may come before its own
        for p, score in pieces.items():
            for i in range(1, len(p)):
                a, b = p[:i], p[i:]
                if a in self.symbol and b in self.symbol:
                    keys.append(self.symbol[a] << 32 | self.symbol[b])
                    ranks.append(level[score])
                    made.append(self.symbol[p])
                    for x in (a, b):
                        if x in pieces and len(x) > 1 and level[pieces[x]] >= level[score]:
                            early[self.symbol[x]] = True
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = (np.array(x)[order] for x in (keys, ranks, made))
        self.ranks, self.made, self.early = self.ranks.astype(np.int32), self.made.astype(np.int64), early
        self.blank, self.period, self.runs = self.symbol.get(SPACE, -1), 0, np.zeros(0, np.int64)
        self._learn_runs(pieces)
        # tokens that a symbol gives if it survives: one, or its bytes if the vocabulary lacks it
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in self.symbol], np.int64)

    def _learn_runs(self, pieces: dict[str, float]) -> None:
        """If the pieces of the last rank are just the runs of space marks, how many tokens short runs give;
        longer ones give one more for each period, as a longest run joins nothing."""
        spaces = [p for p in pieces if p.startswith(SPACE * 2)]
        last = self.ranks.max(initial=-1)
        made = {self.symbol[p] for p in spaces}
        period = max(map(len, spaces), default=0)
        if not spaces or {*self.made[self.ranks == last].tolist()} != made or any(p.strip(SPACE) for p in spaces):
            return
        pairs = {(int(k) >> 32, int(k) & 0xFFFFFFFF): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made, strict=True) if r == last}
        runs = np.array([len(self._queued([self.blank] * n, pairs)) for n in range(4 * period)])
        if (runs[period:] == runs[:-period] + 1).all():
            self.period, self.runs = period, runs[: 2 * period]
            keep = self.ranks != last
            self.keys, self.ranks, self.made = self.keys[keep], self.ranks[keep], self.made[keep]

    @staticmethod
    def _queued(symbols: list[int], pairs) -> list[int]:
        """What is left of one sequence after all merges, by a queue of pairs in the order of rank and place."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        queue = [(*found, i, i + 1, x, y) for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if (found := pairs.get((x, y)))]
        queue = [(rank, i, made, j, x, y) for rank, made, i, j, x, y in queue]
        heapq.heapify(queue)
        while queue:
            _, i, made, j, x, y = heapq.heappop(queue)
            if symbols[i] != x or j >= len(symbols) or after[i] != j or symbols[j] != y:
                continue
            symbols[i], symbols[j], after[i] = made, -2, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(symbols) and (found := pairs.get((symbols[a], symbols[b]))):
                    heapq.heappush(queue, (found[0], a, found[1], b, symbols[a], symbols[b]))
        return [x for x in symbols if x != -2]

    def pretokens(self, text: str) -> list[str]:
        """Parts of the text that no merge can join; a space stands for the space mark."""
        if not text:
            return []
        found = re.findall(r" +[^ \n]*|[^ \n]+|\n", " " + text.replace(SPACE, " "))
        if max(map(len, found)) <= self.long:
            return found
        out = []
        for x in found:
            if len(x) <= self.long:
                out.append(x)
                continue
            marked, at = x.replace(" ", SPACE), 0
            for i in range(1, len(x)):
                if marked[i - 1 : i + 1] not in self.bigrams:
                    out.append(x[at:i])
                    at = i
            out.append(x[at:])
        return out

    def merged(self, words: list[str]) -> np.ndarray:
        """Tokens that each of these pre-tokens gives."""
        size = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        place = np.minimum(np.searchsorted(self.char_of, codes), len(self.char_of) - 1)
        known = self.char_of[place] == codes
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        of = np.repeat(np.arange(len(words)), size)
        total = np.bincount(of, np.where(known, 0, width), len(words)).astype(np.int64)
        symbols = np.where(known, place, -1)
        if size.max(initial=0) > self.most:
            if self.pairs is None:
                self.pairs = {(int(k) >> 32, int(k) & 0xFFFFFFFF): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made, strict=True)}
            ends, parts = np.cumsum(size), []
            for end, n in zip(ends.tolist(), size.tolist(), strict=True):
                part = symbols[end - n : end]
                parts.append(part if n <= self.most else np.array(self._queued(part.tolist(), self.pairs), np.int64))
            symbols, of = np.concatenate(parts), np.repeat(np.arange(len(words)), [len(p) for p in parts])
        while len(symbols) > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = (self.keys[near] == key) & (of[:-1] == of[1:])
            rank = np.where(fits, self.ranks[near], NONE)
            lowest = np.full(len(words), NONE, np.int32)
            np.minimum.at(lowest, of[:-1][fits], rank[fits])
            pick = fits & (rank == lowest[of[:-1]])
            if not pick.any():
                break
            # of overlapping pairs the leftmost, third, fifth ... of a run merge; if a piece may join
            # on before its own turn is over, just the leftmost pair of the sequence
            at = np.flatnonzero(pick)
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 1
            lead = np.diff(of[at], prepend=-1) != 0
            alone = self.early[self.made[near[at]]]
            only = np.zeros(len(words), bool)
            only[of[at[alone]]] = True
            at = at[np.where(only[of[at]], lead, ~odd)]
            symbols[at] = self.made[near[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, of = symbols[keep], of[keep]
            # a sequence without a pair that fits is done
            live = lowest[of] != NONE
            if np.count_nonzero(live) < 0.7 * len(live):
                total += self._costs(symbols[~live], of[~live], len(words))
                symbols, of = symbols[live], of[live]
        return total + self._costs(symbols, of, len(words))

    def _costs(self, symbols: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        out = np.bincount(of, np.where(symbols < 0, 0, self.cost[symbols]), n).astype(np.int64)
        blank = symbols == self.blank
        if self.period and blank.any():
            at = np.flatnonzero(blank)
            start = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(of[at], prepend=-1) != 0))
            long = np.diff(np.append(start, len(at)))
            whole = np.maximum(long // self.period - 1, 0)
            tokens = whole + self.runs[long - whole * self.period]
            out -= np.bincount(of[at[start]], long - tokens, n).astype(np.int64)
        return out

    def count(self, texts: list[str], part: int = 1 << 22) -> list[int]:
        """Tokens of each text."""
        out, at = [], 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= part):
                chars += len(texts[upto])
                upto += 1
            cut = [self.pretokens(t) for t in texts[at:upto]]
            words = set().union(*cut)
            new = [w for w in words if w not in self.known]
            if len(self.known) + len(new) > self.remember:
                self.known, new = {}, list(words)
            if new:
                self.known.update(zip(new, self.merged(new).tolist(), strict=True))
            out += [sum(map(self.known.__getitem__, x)) for x in cut]
            for w in new:  # long ones are not worth the memory
                if len(w) > 4 * self.long:
                    del self.known[w]
            at = upto
        return out


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text, as the library counts them without begin and end.

    Null and empty texts have 0 bytes and 0 tokens; special strings are ordinary text. Repeated rows
    and null ids are kept, other columns ignored; an empty table gives no rows. Memory: a batch of
    texts plus a bounded number of remembered pre-tokens.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _MODELS:
            _MODELS[model] = RankMerger(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_MODELS[model].count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
