"""Finding held-out passages inside a large corpus.

Every stretch of ``window`` words of the items, and of each document, is fingerprinted with a 64-bit SimHash of its words.
The fingerprints of the items are cut into ``radius + 1`` blocks; two fingerprints within the radius agree in at least one
block, so looking up each block finds every item window within the radius of a document window. Candidates are then
compared exactly: the weighted Jaccard index of their five-word shingles (a shingle's weight falls with the number of items
that hold it; one in no item weighs most), and word for word.

A document window with two or more words that no item has cannot reach a shingle similarity of 0.8, nor be equal to an item
window, so it needs no fingerprint; that test loses nothing. Documents are read once, whole, and never shuffled: the index of
the items travels to them. Its size is checked; beyond ``ITEM_BLOCK`` items it travels in blocks, one pass each.

``near_leaks`` finds whole items that were edited a little. Its windows are as long as the item they are held against: for
each length of an item, every stretch of a document of that length is fingerprinted (from running sums, so a window costs the
same whatever its length), looked up in the blocks of the items of that length within ``WIDE_RADIUS``, and verified by the
weighted similarity of the shingles. A stretch with more than a fifth of shingles that no item has cannot be similar enough and
is not fingerprinted; that loses nothing.

Defined results: null or short texts (fewer words than the window) and empty tables match nothing; a document that is there
twice comes out twice; several windows of one item in one document are one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.runtime import spread

WINDOW, RADIUS, SIMILARITY, SHINGLE = 12, 3, 0.8, 5
#: Bits in which the fingerprints of two stretches as long as an item may differ.
WIDE_RADIUS = 13
ITEM_BLOCK, TOKENS = 20_000, 60_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words, and a stable 64-bit hash per code."""
    codes, kinds = pd.factorize(np.array(words, object)) if words else (np.array([], np.int64), np.array([], object))
    return codes, pd.util.hash_array(kinds, categorize=False) if len(kinds) else np.array([], np.uint64)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """Each hash as a row of 64 votes of +1 and -1."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def fingerprints(votes: np.ndarray, codes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """SimHash of the words codes[s : s + window] for each start."""
    total = np.zeros((len(starts), 64), np.int16)
    for k in range(window):
        total += votes[codes[starts + k]]
    return np.packbits(total > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _shingles(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of consecutive words, one per start."""
    n = len(word_hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = (out ^ word_hashes[k : k + max(n, 0)]) * _MIX + np.uint64(k)
    return out


class Blocks:
    """Fingerprints in radius + 1 blocks of bits: two within the radius agree in one block at least."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.blocks = prints, radius, []
        edges = np.linspace(0, 64, radius + 2).astype(int)
        for lo, hi in zip(edges[:-1], edges[1:]):
            values = self.block(prints, lo, hi)
            order = np.argsort(values, kind="stable")
            self.blocks.append((lo, hi, values[order], order))

    @staticmethod
    def block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (prints >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (number of a print asked, number of one held) within the radius."""
        found = []
        for lo, hi, values, order in self.blocks:
            mine = self.block(prints, lo, hi)
            a, b = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            n = b - a
            left = np.repeat(np.arange(len(prints)), n)
            right = order[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            near = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
            found.append(left[near] * np.int64(max(1, len(self.prints))) + right[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


class ItemIndex:
    """The windows of the items: fingerprints in blocks, word hashes, shingles and their weights."""

    def __init__(self, ids: list[int], texts: list[str], window: int = WINDOW, radius: int = RADIUS, shingle: int = SHINGLE):
        self.window, self.radius, self.shingle = window, radius, shingle
        split = [words_of(t) for t in texts]
        codes, kinds = _hashes([w for ws in split for w in ws])
        sizes = np.array([len(ws) for ws in split], np.int64)
        first = np.cumsum(sizes) - sizes
        starts = np.concatenate([np.arange(f, f + max(0, n - window + 1)) for f, n in zip(first, sizes)] or [np.array([], np.int64)]).astype(np.int64)
        self.item = np.repeat(np.array(ids, np.int64), np.maximum(0, sizes - window + 1))
        self.vocabulary = np.sort(kinds)
        self.words = kinds[codes] if len(codes) else np.array([], np.uint64)
        self.starts = starts
        self.prints = fingerprints(_votes(kinds), codes, starts, window) if len(starts) else np.array([], np.uint64)
        held: dict[int, set] = {}
        for i, (f, n) in enumerate(zip(first.tolist(), sizes.tolist())):
            for s in _shingles(self.words[f : f + n], shingle).tolist():
                held.setdefault(s, set()).add(i)
        n_items = max(1, len(ids))
        self.weight = {s: float(np.log1p(n_items / len(of))) for s, of in held.items()}
        self.most = float(np.log1p(n_items))
        self.blocks = Blocks(self.prints, radius)

    def similarity(self, one: np.ndarray, other: np.ndarray) -> float:
        """Weighted Jaccard index of the shingles of two stretches of word hashes."""
        a, b = set(_shingles(one, self.shingle).tolist()), set(_shingles(other, self.shingle).tolist())
        weigh = lambda xs: sum(self.weight.get(x, self.most) for x in xs)
        return weigh(a & b) / (weigh(a | b) or 1.0)

    def search(self, ids: list[int], split: list[list[str]]) -> list[tuple[int, int, int, float, bool]]:
        """(document, item, windows, best similarity, whether a window is equal word for word) of some documents."""
        codes, kinds = _hashes([w for ws in split for w in ws])
        sizes = np.array([len(ws) for ws in split], np.int64)
        if not len(self.prints) or not len(codes):
            return []
        doc = np.repeat(np.arange(len(ids)), sizes)
        at = np.searchsorted(self.vocabulary, kinds)
        known = (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == kinds)[codes]
        total = np.concatenate([[0], np.cumsum(known)])
        starts = np.arange(len(codes) - self.window + 1)
        if not len(starts):
            return []
        ends = starts + self.window
        starts = starts[(total[ends] - total[starts] >= self.window - 1) & (doc[starts] == doc[ends - 1])]
        if not len(starts):
            return []
        prints = fingerprints(_votes(kinds), codes, starts, self.window)
        left, right = self.blocks.candidates(prints)
        words = kinds[codes]
        best: dict[tuple[int, int], list] = {}
        w = np.arange(self.window)
        equal = (words[starts[left][:, None] + w] == self.words[self.starts[right][:, None] + w]).all(axis=1)
        for d, s, r, same in zip(doc[starts[left]].tolist(), starts[left].tolist(), right.tolist(), equal.tolist()):
            q = self.starts[r]
            score = 1.0 if same else self.similarity(words[s : s + self.window], self.words[q : q + self.window])
            if score >= SIMILARITY:
                e = best.setdefault((d, int(self.item[r])), [0, 0.0, False])
                e[0] += 1
                e[1] = max(e[1], score)
                e[2] |= same
        return [(ids[d], i, *e) for (d, i), e in best.items()]


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item, n_windows, similarity, exact) for every document that shares a stretch of an item."""
    return _scan(
        documents, items, lambda ids, texts: ItemIndex(ids, texts, window, radius), lambda index, ids, split: index.search(ids, split), "n_windows long, similarity double, exact boolean", doc, item, text
    )


def _scan(documents: DataFrame, items: DataFrame, build, search, found: str, doc: str, item: str, text: str) -> DataFrame:
    """One pass over the documents for each block of items; an index is a few times its items' texts."""
    whole = items.filter(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t"))
    blocks = max(1, -(-whole.count() // ITEM_BLOCK))
    source = spread(documents.filter(F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")))
    columns = ["doc_id", "item_id", *[c.split()[0] for c in found.split(", ")]]
    out = None
    for b in range(blocks):
        rows = sorted(tuple(r) for r in (whole if blocks == 1 else whole.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)).collect())
        index = documents.sparkSession.sparkContext.broadcast(build([r[0] for r in rows], [r[1] for r in rows]))

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                got, ids, split, size = [], [], [], 0
                for d, t in zip(batch["d"].tolist(), batch["t"].tolist()):
                    ids.append(d)
                    split.append(words_of(t))
                    size += len(split[-1])
                    if size > TOKENS:
                        got += search(index.value, ids, split)
                        ids, split, size = [], [], 0
                got += search(index.value, ids, split) if ids else []
                yield pd.DataFrame(got, columns=columns)

        part = source.mapInPandas(scan, f"doc_id long, item_id long, {found}")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"doc_id": doc, "item_id": item})


class WholeItems:
    """The items by their number of words, each length with its fingerprints in blocks."""

    def __init__(self, ids: list[int], texts: list[str], radius: int = WIDE_RADIUS, shingle: int = SHINGLE):
        self.shingle, self.lengths = shingle, {}
        split = [(i, words_of(t)) for i, t in zip(ids, texts)]
        split = [(i, ws) for i, ws in split if len(ws) >= shingle]
        of: dict[int, list] = {}
        held: dict[int, int] = {}
        for i, ws in split:
            codes, kinds = _hashes(ws)
            mine = frozenset(_shingles(kinds[codes], shingle).tolist())
            for x in mine:
                held[x] = held.get(x, 0) + 1
            total = _votes(kinds)[codes].sum(axis=0, dtype=np.int64)
            of.setdefault(len(ws), []).append((i, mine, np.packbits(total > 0).view(">u8").astype(np.uint64)[0]))
        n = max(1, len(split))
        self.weight, self.most = {x: float(np.log1p(n / k)) for x, k in held.items()}, float(np.log1p(n))
        self.known = np.sort(np.array(list(held), np.uint64))
        for length, rows in sorted(of.items()):
            self.lengths[length] = [r[0] for r in rows], [r[1] for r in rows], [self._weigh(r[1]) for r in rows], Blocks(np.array([r[2] for r in rows], np.uint64), radius)

    def _weigh(self, xs) -> float:
        return sum(self.weight.get(x, self.most) for x in xs)

    def search(self, ids: list[int], split: list[list[str]], similarity: float = SIMILARITY) -> list[tuple[int, int, float]]:
        """(document, item, best similarity) of some documents."""
        codes, kinds = _hashes([w for ws in split for w in ws])
        k = self.shingle
        if not len(self.known) or len(codes) < k:
            return []
        doc = np.repeat(np.arange(len(ids)), [len(ws) for ws in split])
        shingles = _shingles(kinds[codes], k)
        at = np.searchsorted(self.known, shingles)
        known = self.known[np.minimum(at, len(self.known) - 1)] == shingles
        some = np.zeros(len(ids), bool)
        some[doc[np.flatnonzero(known)]] = True
        if not some.any():
            return []
        mine = some[doc]  # of the other documents no window can be like an item
        codes, doc, shingles, known = codes[mine], doc[mine], np.append(shingles, np.zeros(k - 1, np.uint64))[mine], np.append(known, np.zeros(k - 1, bool))[mine]
        # shingles that no item has and that stand in one place only: as many different ones as places
        _, where, often = np.unique(shingles, return_inverse=True, return_counts=True)
        strange = np.concatenate([[0], np.cumsum(~known & (often[where] == 1))])
        usual = np.concatenate([[0], np.cumsum(known)])
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_votes(kinds)[codes], axis=0, dtype=np.int32)])
        best: dict[tuple[int, int], float] = {}
        for length, (items, sets, weights, blocks) in self.lengths.items():
            starts, wide = np.arange(max(0, len(codes) - length + 1)), length - k + 1
            ok = (doc[starts] == doc[starts + length - 1]) & (usual[starts + wide] > usual[starts]) & (strange[starts + wide] - strange[starts] <= wide * (1 - similarity) + 1e-9)
            starts = starts[ok]
            if not len(starts):
                continue
            prints = np.packbits(sums[starts + length] - sums[starts] > 0, axis=1).view(">u8").ravel().astype(np.uint64)
            for left, right in zip(*(x.tolist() for x in blocks.candidates(prints))):
                s = int(starts[left])
                mine = set(shingles[s : s + wide].tolist())
                both = self._weigh(mine & sets[right])
                score = both / ((self._weigh(mine) + weights[right] - both) or 1.0)
                if score >= similarity:
                    key = int(doc[s]), items[right]
                    best[key] = max(score, best.get(key, 0.0))
        return [(ids[d], i, s) for (d, i), s in best.items()]


def near_leaks(documents: DataFrame, items: DataFrame, radius: int = WIDE_RADIUS, similarity: float = SIMILARITY, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item, similarity) for every document with a stretch that is a whole item, as it is or edited a little."""
    return _scan(documents, items, lambda ids, texts: WholeItems(ids, texts, radius), lambda index, ids, split: index.search(ids, split, similarity), "similarity double", doc, item, text)
