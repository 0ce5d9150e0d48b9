"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Items and documents are sequences of lower-cased words; words that no item has are one symbol.
The CGK random walk copies a sequence while it stays on a symbol or steps on by a random bit of
(step, symbol), so that a small edit distance becomes a small Hamming distance. Several walks run
from each start of an item-sized window; in each, a few sampled steps form a hash key. An
item has windows all along it, every half of WALKED words, as a walk that has lost step with an
edited passage seldom finds it again: some window of a passage within the limit has few edits at
its beginning. Windows of a text that share a key with one of an item are verified with the whole
item: the edit distance in words of the item to the best part of the text around must be at most
20 % of its words (a similarity of 0.8).

Windows that cannot match are not walked: with e edits an item of L words keeps a run of at least
ceil((L - e) / (e + 1)) words, and L - q + 1 - q * e of its runs of q words, so windows with fewer
such runs (q is 3 at most) than every item needs are passed over, which loses nothing.

Null and empty texts hold nothing, and null or wordless items are never found. Repeated rows give
equal results. Empty tables give empty results, or no match. Further columns are not read. Items
are broadcast in blocks of at most BLOCK_ITEMS; a larger benchmark takes a pass for each block.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.shared import short_batches

WORDS = re.compile(r"[^\W_]+")
BLOCK_ITEMS = 1_000
FOUND = "array<struct<item_id:long,distance:int,at:int>>"
#: Words of a window that a walk may cover. Windows start every half of that in an item, all along it.
WALKED = 16
#: Words of one block of a text; blocks overlap by the longest item.
CHUNK = 200_000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Index:
    """Keys of a block of items. samples symbols form a key; walks is the number of repetitions."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, walks: int = 16, samples: int = 3, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.items = [(i, w) for i, t in sorted(items) if (w := words_of(t))]
        self.vocab = {w: k + 1 for k, w in enumerate(dict.fromkeys(x for _, ws in self.items for x in ws))}
        self.coded = [np.array([self.vocab[x] for x in ws]) for _, ws in self.items]
        self.edits = [int((1 - similarity) * len(ws) + 1e-9) for _, ws in self.items]
        self.walks, self.samples, v = walks, samples, len(self.vocab) + 1
        runs = [math.ceil((len(w) - e) / (e + 1)) for (_, w), e in zip(self.items, self.edits, strict=True)]
        self.run = min([3, *runs])
        self.shared = max(1, min([len(w) - self.run + 1 - self.run * e for (_, w), e in zip(self.items, self.edits, strict=True)], default=1))
        self.reach = max([0, *(len(w) + e for (_, w), e in zip(self.items, self.edits, strict=True))])
        self.mul = np.array([1, 2_654_435_761, 40_503 * 65_537][: self.run], np.uint64)
        self.gate = np.zeros(1 << 22, bool)
        for c in self.coded:
            if len(c) >= self.run:
                self.gate[self._runs(c)] = True
        # length classes, so that items of similar length sample the same steps
        self.classes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, c in enumerate(self.coded):
            for at in range(0, max(1, len(c) - WALKED // 2 + 1), WALKED // 2):
                n = min(len(c) - at, WALKED)
                self.classes[2 ** int(math.log2(n)) if n < 8 else 4 * (n // 4)].append((k, at))
        self.steps = max([2, *(n + 1 for n in self.classes)])
        self.bits = rng.integers(0, 2, (walks, self.steps, v), dtype=np.int8)
        self.picked = {n: np.sort(rng.integers(0, n, (walks, samples)), axis=1) for n in self.classes}
        self.salt = rng.integers(1, 1 << 62, samples, dtype=np.uint64) | np.uint64(1)
        self.keys: list[dict[int, np.ndarray]] = []
        self.owner: list[dict[int, dict[int, list[tuple[int, int]]]]] = []
        for r in range(walks):
            keys, owner = {}, {}
            for n, members in self.classes.items():
                own = defaultdict(list)
                for k, at in members:
                    seq = np.concatenate([self.coded[k][at:], np.zeros(self.steps + 1, np.int64)])
                    own[int(self._keys(self._walk(seq, np.array([0]), r, n), r, n)[0])].append((k, at))
                owner[n], keys[n] = own, np.array(sorted(own), np.uint64)
            self.keys.append(keys)
            self.owner.append(owner)

    def _runs(self, seq: np.ndarray) -> np.ndarray:
        h = np.zeros(len(seq) - self.run + 1, np.uint64)
        for k in range(self.run):
            h += seq[k : len(seq) - self.run + 1 + k].astype(np.uint64) * self.mul[k]
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _walk(self, seq: np.ndarray, starts: np.ndarray, r: int, n: int) -> list[np.ndarray]:
        """The symbols at the sampled steps of walk r for windows of class n."""
        at, out, bits = starts.copy(), [], self.bits[r]
        want = self.picked[n][r].tolist()
        for j in range(want[-1] + 1):
            sym = seq[at]
            out += [sym] * want.count(j)
            at += bits[j][sym]
        return out

    def _keys(self, symbols: list[np.ndarray], r: int, n: int) -> np.ndarray:
        h = np.full(len(symbols[0]), np.uint64((r * 1_000_003 + n) & 0xFFFFFFFF))
        for s, m in zip(symbols, self.salt, strict=True):
            h = (h ^ s.astype(np.uint64)) * m
            h ^= h >> np.uint64(29)
        return h

    def starts(self, seq: np.ndarray) -> np.ndarray:
        """Starts of windows that have enough runs of words that some item has."""
        if len(seq) < self.run:
            return np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(self.gate[self._runs(seq)])])
        last = len(upto) - 1
        at = np.arange(len(seq))
        return np.flatnonzero(upto[np.minimum(at + self.reach, last)] - upto[np.minimum(at, last)] >= self.shared)

    def candidates(self, seq: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(item's number, place where its start would be) of windows that share a key with an item."""
        padded, out = np.concatenate([seq, np.zeros(self.steps + 1, np.int64)]), set()
        starts = starts[seq[starts] > 0]  # a window may as well start at its first word that an item has
        if not len(starts):
            return out
        for r in range(self.walks):
            # one walk serves all classes: the steps are the same, only the sampled ones differ
            wanted = defaultdict(list)
            for n, p in self.picked.items():
                for s, j in enumerate(p[r].tolist()):
                    wanted[j].append((n, s))
            at, bits, got = starts.copy(), self.bits[r], {n: [None] * self.samples for n in self.picked}
            for j in range(max(wanted) + 1):
                sym = padded[at]
                for n, s in wanted.get(j, ()):
                    got[n][s] = sym
                at += bits[j][sym]
            for n, symbols in got.items():
                h = self._keys(symbols, r, n)
                known = self.keys[r][n]
                place = np.searchsorted(known, h)
                place[place == len(known)] = 0
                for k in np.flatnonzero(known[place] == h).tolist():
                    out.update((item, int(starts[k]) - at) for item, at in self.owner[r][n][int(h[k])])
        return out

    def best(self, item: int, seq: np.ndarray, near: int, last: int | None = None) -> tuple[int, int]:
        """Smallest edit distance of the item to a part of the text around the place, or the places from near to last, and the end of that part (bit-parallel)."""
        pattern, e = self.coded[item], self.edits[item]
        m = len(pattern)
        low, high = max(0, near - 2 * e - 2), min(len(seq), (near if last is None else last) + m + 2 * e + 2)
        peq: dict[int, int] = {}
        for k, s in enumerate(pattern.tolist()):
            peq[s] = peq.get(s, 0) | 1 << k
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, least = full, 0, m, (m, low)
        for k, s in enumerate(seq[low:high].tolist(), low):
            eq = peq.get(s, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            least = min(least, (score, k))
        return least

    def _blocks_of(self, texts: list[str | None]) -> list[tuple[int, int, np.ndarray]]:
        """(text's number, place of the block in it, symbols); blocks of one text overlap by more than any match."""
        get, out = self.vocab.get, []
        for k, text in enumerate(texts):
            words = words_of(text)
            for begin in range(0, len(words), CHUNK):
                part = words[begin : begin + CHUNK + 2 * self.reach]
                out.append((k, begin, np.fromiter([get(w, 0) for w in part], np.int64, len(part))))
        return out

    def matches(self, texts: list[str | None]) -> list[list[dict]]:
        """The items that each text holds. Texts of one batch are walked together, with gaps between that no walk crosses."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        blocks = self._blocks_of(texts) if self.items else []
        if blocks:
            gap = np.zeros(self.steps + self.reach + 2, np.int64)
            seq = np.concatenate([x for _, _, part in blocks for x in (part, gap)])
            begins = np.cumsum([0, *(len(part) + len(gap) for _, _, part in blocks[:-1])])
            # places of one item in one block whose surroundings touch are looked at together
            ranges: list[list[int]] = []
            for item, near in sorted(self.candidates(seq, self.starts(seq))):
                b = max(0, int(np.searchsorted(begins, near, side="right")) - 1)
                near -= int(begins[b])
                if ranges and ranges[-1][:2] == [item, b] and near - ranges[-1][3] <= len(self.coded[item]) + 4 * self.edits[item] + 4:
                    ranges[-1][3] = near
                else:
                    ranges.append([item, b, near, near])
            for item, b, near, last in ranges:
                k, at, part = blocks[b]
                distance, end = self.best(item, part, near, last)
                if distance <= self.edits[item]:
                    found[k][item] = min(found[k].get(item, (distance, at + end)), (distance, at + end))
        return [[{"item_id": self.items[i][0], "distance": d, "at": end} for i, (d, end) in sorted(x.items())] for x in found]


def _blocks(benchmark: DataFrame, size: int) -> list[DataFrame]:
    n = max(1, -(-benchmark.count() // size))
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [benchmark]


def _finder(index):
    @F.pandas_udf(FOUND)
    def found(part: pd.Series) -> pd.Series:
        return pd.Series(index.value.matches(part.tolist()), dtype=object)

    return found


def leaked(docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = 0.8, block_items: int = BLOCK_ITEMS) -> Column:
    """array<struct<item_id, distance, at>>: the items that each whole text holds; at is the word where the best match ends.

    One map over the documents, without a shuffle.
    """
    spark = docs.sparkSession
    short_batches(spark)
    out = []
    for block in _blocks(benchmark.select(F.col("item_id").cast("long"), "text"), block_items):
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in block.where("item_id is not null").collect()], similarity))
        out.append(_finder(index)(F.col(text)))
    return F.concat(*out) if len(out) > 1 else out[0]


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the documents that hold an item."""
    return docs.where(F.size(leaked(docs, benchmark, text)) == 0)
