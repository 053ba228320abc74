"""Near-duplicate names within a block, by a size-aware heavy-light join of their substring sets.

Two names are alike when the Jaccard index of their sets of three-character substrings reaches the threshold t. A block is cut
into chunks of ``CHUNK`` names; each two chunks are a tile, and a tile is one task's work (one tile for most blocks).

Within a tile the substrings are ordered from the rarest to the most frequent. Sets x and y with |x| <= |y| that are alike have
t / (1 + t) * (|x| + |y|) elements in common, so the first |x| - ceil(2 t / (1 + t) |x|) + 2 elements of x and the first
|y| - ceil(t |y|) + 2 of y have two in common. *Small* sets therefore enumerate the subsets of two elements of that beginning
and meet in them; *large* sets are held against the sets of all others, kept as bitmaps, in the range of sizes that can reach
t. A set's subsets grow with the square of its size, a scan with the number of sets, so the boundary between small and large
is the size at which the sum of both costs, in nanoseconds, is least (``boundary``). How often two sets meet in a subset is
estimated on ``PROBE`` names of the tile; should it be so often that a scan is cheaper (large families of copies), all sets of
the tile are scanned. Either way every pair is found; no list is capped and nothing is left out for being frequent.

The scan takes 64 sets in one machine word. Of the sets of a part of the tile (``PART``) there is a bitmap for each substring:
which of them have it. If y is to be alike, at most d = |x| - ceil(t / (1 + t) * (|x| + |y|)) elements of x are not in y. So of
d + 1 groups of elements of x, without common elements, y has at least one whole; which sets do is an *or* over groups of an
*and* over their elements. The groups are made of the rarest elements, as deep as their frequencies ask for.

In both ways sizes and sketches of 192 and then 1,024 bits leave few pairs before the exact count. Two sketches differ in at most
as many bits as the sets in elements, so a pair of sketches too far apart is dropped without loss.

Copies of one name in one block are one class, joined once; pairs of records are expanded only at the end.

Defined results: null blocks, null, placeholder and blank names, and names of fewer than three characters after
normalising have no set and match nothing; repeated rows pair with each other; a pair comes out once, smaller id first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.runtime import is_placeholder, materialize, small_side

THRESHOLD = 0.65
#: Names in a chunk; pairs counted exactly at a time; subsets held at a time; names whose substrings are listed at a time.
CHUNK, AT_ONCE, SUBSETS, SLICE = 196_608, 1 << 14, 1 << 22, 1 << 13
#: Sets in a part that is scanned at once; words of the bitmaps worked on at a time; share of the pairs a scan may leave, were
#: the elements independent, before its groups are made deeper.
PART, WORDS, LEFT = 4096, 1 << 16, 3e-4
#: Nanoseconds to scan one pair, to enumerate one subset, to look at one pair of sets in a subset, measured; and the names on
#: which a tile's share of meeting pairs is estimated. They decide which way is taken, not what is found.
SCAN_NS, SUBSET_NS, MEET_NS, PROBE = 1.1, 150.0, 40.0, 256
#: 64-bit words of the first and the second sketch.
SKETCHES = (3, 16)


def normal_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def _substring_codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(name number, code) of every three-character substring of the names, distinct per name."""
    data = np.frombuffer("\0".join(names).encode("ascii"), np.uint8).astype(np.int64)
    which = np.repeat(np.arange(len(names)), [len(x) + 1 for x in names])[:-1]
    a, b, c = data[:-2], data[1:-1], data[2:]
    inside = (a > 0) & (b > 0) & (c > 0)
    key = np.sort((which[:-2][inside] << 24) | (a[inside] << 16) | (b[inside] << 8) | c[inside])
    key = key[np.diff(key, prepend=-1) != 0]
    return key >> 24, key & 0xFFFFFF


def _sketch(n: int, which: np.ndarray, codes: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros((n, 64 * words), bool)
    bits[which, (codes * 0x9E3779B1 >> 7) % (64 * words)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def sketches(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the substring sets, and their sketches as n x 3 int64."""
    which, codes = _substring_codes(names) if names else (np.array([], np.int64), np.array([], np.int64))
    return np.bincount(which, minlength=len(names)), _sketch(len(names), which, codes, SKETCHES[0])


def _beginnings(sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """How many of its rarest elements a set needs as the smaller and as the larger of two, to have two in common."""
    need = lambda share: np.ceil(share * sizes - 1e-9).astype(np.int64)
    return np.minimum(sizes - need(2 * threshold / (1 + threshold)) + 2, sizes), np.minimum(sizes - need(threshold) + 2, sizes)


def boundary(sizes: np.ndarray, threshold: float, meeting: float) -> int:
    """How many of the smallest sets are small, by the sum of costs; sizes ascend. meeting: common subsets per pair of sets."""
    n = len(sizes)
    long = _beginnings(sizes, threshold)[1]
    light = np.concatenate([[0], np.cumsum(long * (long - 1) / 2 * SUBSET_NS)]) + meeting * np.arange(n + 1.0) ** 2 / 2 * MEET_NS
    # a large set is scanned against all sets before it in size that can reach it
    span = np.arange(n) - np.searchsorted(sizes, sizes * threshold - 1e-6)
    heavy = np.concatenate([np.cumsum(span[::-1])[::-1] * SCAN_NS, [0]])
    ends = np.concatenate([[0], np.flatnonzero(np.diff(sizes)) + 1, [n]]).astype(np.int64)
    return int(ends[np.argmin(light[ends] + heavy[ends])])


class Sets:
    """The substring sets of a tile's names, ordered by size; left: which of them come from the first of two chunks."""

    def __init__(self, names: list[str], side: np.ndarray, threshold: float):
        n, self.threshold, self.names = len(names), threshold, names
        sizes, sketched = np.zeros(n, np.int64), [np.zeros((n, words), np.int64) for words in SKETCHES]
        self.often, parts = np.zeros(1 << 21, np.int64), []
        for k in range(0, n, SLICE):
            some = names[k : k + SLICE]
            which, codes = _substring_codes(some)
            sizes[k : k + SLICE] = np.bincount(which, minlength=len(some))
            for words, to in zip(SKETCHES, sketched):
                to[k : k + SLICE] = _sketch(len(some), which, codes, words)
            codes = codes >> 16 << 14 | (codes >> 8 & 127) << 7 | codes & 127
            self.often += np.bincount(codes, minlength=len(self.often))
            parts.append(codes.astype(np.int32))
        self.parts, self._ranks = parts, None
        self.order = np.argsort(sizes, kind="stable")
        self.begins = np.concatenate([[0], np.cumsum(sizes)])[self.order]
        self.sizes = sizes[self.order]
        self.words, self.more = (np.ascontiguousarray(x[self.order].view(np.uint64).T) for x in sketched)
        self.left = side[self.order] == (side.min() if len(side) else 0)
        self.two = bool(len(side)) and not self.left.all()

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """The elements of all sets as ranks, each set's rarest first, at ``begins``; and the share of the sets that have each."""
        if self._ranks is not None:
            return self._ranks
        kinds = np.flatnonzero(self.often)
        kinds = kinds[np.argsort(self.often[kinds], kind="stable")]
        place = np.zeros(len(self.often), np.int64)
        place[kinds] = np.arange(len(kinds))
        ranks, sizes = [np.zeros(0, np.uint16 if len(kinds) <= 1 << 16 else np.uint32)], np.empty_like(self.sizes)
        sizes[self.order] = self.sizes
        for k, codes in enumerate(self.parts):
            which = np.repeat(np.arange(SLICE), np.pad(sizes[k * SLICE : (k + 1) * SLICE], (0, max(0, SLICE * (k + 1) - len(sizes)))))
            ranks.append((np.sort(which << 21 | place[codes]) & ((1 << 21) - 1)).astype(ranks[0].dtype))
        self.parts, self._ranks = [], (np.concatenate(ranks), self.often[kinds] / max(1, len(sizes)))
        return self._ranks

    def _elements(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``sets``, rank) of the elements of some sets."""
        n = self.sizes[sets]
        at = np.repeat(self.begins[sets] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.repeat(np.arange(len(sets)), n), self.ranked()[0][at]

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs the sizes and sketches leave."""
        most = (self.sizes[i] + self.sizes[j]) * ((1 - self.threshold) / (1 + self.threshold)) + 1e-6
        ok = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in self.words) <= most
        at = np.flatnonzero(ok)
        ok[at] = sum(np.bitwise_count(w[i[at]] ^ w[j[at]]).astype(np.int16) for w in self.more) <= most[at]
        return ok

    def count(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, likeness) of the pairs at the threshold, counted exactly."""
        out, width = [], -(-len(self.ranked()[1]) // 64) * 64
        for k in range(0, len(i), AT_ONCE):
            a, b = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            both = np.zeros(len(a), np.int64)
            for m in range(0, len(a), 1024):
                used, at = np.unique(np.concatenate([a[m : m + 1024], b[m : m + 1024]]), return_inverse=True)
                bits = np.zeros((len(used), width), bool)
                bits[self._elements(used)] = True
                sets, half = np.packbits(bits, axis=1).view(np.uint64), len(at) // 2
                both[m : m + 1024] = np.bitwise_count(sets[at[:half]] & sets[at[half:]]).sum(axis=1, dtype=np.int64)
            value = both / (self.sizes[a] + self.sizes[b] - both)
            ok = value >= self.threshold
            out.append((a[ok], b[ok], value[ok]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.array([], np.int64), np.array([], np.int64), np.array([], float))

    def scan(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, whose larger set j is at ``first`` or behind, by holding parts of these against all smaller ones."""
        if first >= len(self.sizes):
            return np.array([], np.int64), np.array([], np.int64)
        ranks, share = self.ranked()
        sides = [np.flatnonzero(self.left), np.flatnonzero(~self.left)]
        found = [(np.array([], np.int64), np.array([], np.int64))]
        for xs, ys in (sides, sides[::-1]) if self.two else ((sides[0], sides[0]),):
            ys, sizes = ys[ys >= first], self.sizes[ys[ys >= first]]
            lo = 0
            while lo < len(ys):  # sets of about the same size
                hi = min(lo + PART, int(np.searchsorted(sizes, sizes[lo] * 1.1, "right")))
                self._scan_part(xs, ys[lo:hi], ranks, share, found)
                lo = hi
        return tuple(np.concatenate(c) for c in zip(*found))

    def _bitmaps(self, ys: np.ndarray, kinds: int) -> np.ndarray:
        """For each substring which of ys have it, 64 in a word."""
        out = np.zeros((kinds, -(-len(ys) // 64)), np.uint64)
        for k in range(0, len(ys), 512):
            some = ys[k : k + 512]
            which, rank = self._elements(some)
            bits = np.zeros((kinds, -(-len(some) // 64) * 64), bool)
            bits[rank, which] = True
            out[:, k // 64 : k // 64 + bits.shape[1] // 64] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        return out

    def _scan_part(self, xs: np.ndarray, ys: np.ndarray, ranks: np.ndarray, share: np.ndarray, found: list) -> None:
        """Adds the pairs (x, y), x < y, that have enough elements in common; groups of elements and the sketches leave few to count."""
        t, least = self.threshold, int(self.sizes[ys[0]])
        sizes = self.sizes[xs]
        u, end = int(np.searchsorted(sizes, least * t - 1e-6)), int(np.searchsorted(xs, ys[-1]))
        if u >= end:
            return
        has = self._bitmaps(ys, len(share))
        width = has.shape[1]
        step = max(1, min(PART, WORDS // width))
        one, two, some = (np.empty((step, width), np.uint64) for _ in range(3))
        while u < end:
            v = min(u + step, end, int(np.searchsorted(sizes, sizes[u] * 1.06, "right")))
            # so many elements of the largest x may be missing in the smallest y, and one more
            groups = int(sizes[v - 1] - np.ceil(t / (1 + t) * (sizes[v - 1] + least) - 1e-9)) + 1
            if groups > 0:
                begins = self.begins[xs[u:v]]
                # group g takes every second time the next, every other time the last of the next elements, so that rare ones meet frequent ones
                order = lambda depth: np.concatenate([np.arange(groups)[:: -1 if k % 2 else 1] + k * groups for k in range(depth)])
                deepest = max(1, int(sizes[u]) // groups)
                shares = share[ranks[begins[: 64 : 8, None] + order(min(deepest, 8))]].reshape(-1, min(deepest, 8), groups)
                enough = np.flatnonzero(shares.cumprod(axis=1).sum(axis=2).mean(axis=0) <= LEFT)
                depth = int(enough[0]) + 1 if len(enough) else min(deepest, 8)
                rows = ranks[order(depth)[:, None] + begins].astype(np.intp).reshape(depth, groups, v - u)
                a, b, hits = one[: v - u], two[: v - u], some[: v - u]
                hits[:] = 0
                for g in range(groups):
                    has.take(rows[0, g], axis=0, out=a, mode="clip")
                    for k in range(1, depth):
                        has.take(rows[k, g], axis=0, out=b, mode="clip")
                        np.bitwise_and(a, b, out=a)
                    np.bitwise_or(hits, a, out=hits)
                flat = hits.reshape(-1)
                at = np.flatnonzero(flat)
                bit = np.flatnonzero(np.unpackbits(flat[at].astype("<u8", copy=False).view(np.uint8), bitorder="little").view(bool))
                at, bit = at[bit >> 6], bit & 63
                i, y = xs[u + at // width], at % width * 64 + bit
                ok = np.flatnonzero(i < ys[y])
                ok = ok[self.near(i[ok], ys[y[ok]])]
                for k in range(0, len(ok), AT_ONCE):  # those left are counted in the bitmaps
                    p, q = i[ok[k : k + AT_ONCE]], y[ok[k : k + AT_ONCE]]
                    which, rank = self._elements(p)
                    both = np.bincount(which[has[rank, q[which] >> 6] >> (q[which] & 63).astype(np.uint64) & np.uint64(1) == 1], minlength=len(p))
                    q = ys[q]
                    reach = both >= (self.sizes[p] + self.sizes[q]) * (t / (1 + t)) - 1e-6
                    if reach.any():
                        found.append((p[reach], q[reach]))
            u = v

    def meetings(self) -> int:
        """How often two sets meet in a subset."""
        seen = [0]
        self.meet(len(self.sizes), np.inf, seen)
        return seen[0]

    def meet(self, last: int, budget: float, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (i, j), i < j < last, that have a subset of two rare elements in common; None if that costs more than
        ``budget`` nanoseconds. With ``seen`` the meetings are only counted."""
        which, codes = _substring_codes([self.names[i] for i in self.order[:last]])
        kinds, codes, often = np.unique(codes, return_inverse=True, return_counts=True)
        place = np.empty(len(kinds), np.int64)
        place[np.argsort(often, kind="stable")] = np.arange(len(kinds))
        which, rank = np.divmod(np.sort(which * len(kinds) + place[codes]), max(1, len(kinds)))
        starts = np.searchsorted(which, np.arange(last))
        at = np.arange(len(which)) - starts[which]
        short, long = _beginnings(self.sizes[:last], self.threshold)
        keep = at < long[which] - 1  # the first elements of subsets; the second ones follow in the same set
        first = np.flatnonzero(keep)
        first = first[np.argsort(rank[first], kind="stable")]
        each = long[which[first]] - 1 - at[first]
        total = np.cumsum(each)
        cuts = np.searchsorted(total, np.arange(SUBSETS, int(total[-1]) + SUBSETS if len(total) else 0, SUBSETS))
        cuts = np.unique(np.searchsorted(rank[first], rank[first][np.minimum(cuts, len(first) - 1)])) if len(first) else np.array([], np.int64)  # whole ranks
        found, spent = [], 0.0
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(first)]])):
            f, e = first[lo:hi], each[lo:hi]
            if not len(f):
                continue
            step = np.arange(int(e.sum())) - np.repeat(np.cumsum(e) - e, e) + 1
            one = np.repeat(f, e)
            other, of = one + step, which[one]
            key = (rank[one] * len(kinds) + rank[other]).astype(np.uint64)
            packed = (key << np.uint64(24) | of.astype(np.uint64)) << np.uint64(1) | (at[other] < short[of]).astype(np.uint64)
            packed.sort()
            key, of, is_short = packed >> np.uint64(25), (packed >> np.uint64(1) & np.uint64(0xFFFFFF)).astype(np.int64), packed & np.uint64(1) == 1
            ends = np.concatenate([np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            group = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            here = np.flatnonzero(is_short)
            n = ends[group[here]] - here - 1  # of every two the smaller set must have it in its short beginning
            here, n = here[n > 0], n[n > 0]
            spent += len(key) * SUBSET_NS + float(n.sum()) * MEET_NS
            if spent > budget:
                return None
            if seen is not None:
                seen[0] += int(n.sum())
                continue
            for a in range(0, len(here), SUBSETS // 64):
                h, c = here[a : a + SUBSETS // 64], n[a : a + SUBSETS // 64]
                i = np.repeat(of[h], c)
                j = of[np.repeat(h, c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + 1]
                ok = self.sizes[i] >= self.sizes[j] * self.threshold - 1e-6
                if self.two:
                    ok &= self.left[i] != self.left[j]
                i, j = i[ok], j[ok]
                ok = self.near(i, j)
                found.append(np.unique(i[ok] * np.int64(last) + j[ok]))
        pairs = np.unique(np.concatenate(found)) if found else np.array([], np.int64)
        return pairs // max(1, last), pairs % max(1, last)


def alike(names: list[str], side: np.ndarray, threshold: float, ways: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, likeness) of all pairs of names at the threshold: of the two sides if there are two, else of all names.
    ways, if given, receives how many sets were small and how many large."""
    sets = Sets(names, side, threshold)
    n = len(names)
    probe = np.unique(np.linspace(0, n - 1, PROBE).astype(int)) if n else np.array([], int)
    tried = Sets([names[i] for i in probe], np.zeros(len(probe), int), threshold)
    small = boundary(sets.sizes, threshold, tried.meetings() / max(1, len(probe) * (len(probe) - 1) / 2))
    span = np.arange(small) - np.searchsorted(sets.sizes, sets.sizes[:small] * threshold - 1e-6)
    none = np.array([], np.int64), np.array([], np.int64)
    met = sets.meet(small, 2 * float(span.sum()) * SCAN_NS) if small else none
    if met is None:  # more sets share their rarest elements than the estimate says: all are scanned
        small, met = 0, none
    if ways is not None:
        ways.update(small=small, large=n - small)
    i, j, value = sets.count(*(np.concatenate(c) for c in zip(met, sets.scan(small))))
    return sets.order[i], sets.order[j], value


def classes_of(records: DataFrame, block: str, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The distinct names per block with their least record, sketch and number of copies; and all (hash, record) rows."""
    rows = records.filter(F.col(block).isNotNull() & F.col(name).isNotNull() & ~is_placeholder(F.col(name))).select(
        F.col(key).cast("long").alias("rid"), F.lower(F.regexp_replace(block, r"^\s+|\s+$", "")).alias("block"), normal_name(F.col(name)).alias("norm")
    )
    rows = rows.filter(F.length("norm") >= 3)
    counted = rows.groupBy("block", "norm").agg(F.min("rid").alias("cid"), F.count("*").alias("copies")).select("cid", "block", "norm", "copies")
    names = materialize(counted, "names")
    sizes = small_side(names.groupBy("block").agg(F.count("*").alias("bn")))
    return names.join(sizes, "block"), rows


def class_pairs(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness) of all classes alike within their blocks."""
    chunks = F.ceil(F.col("bn") / CHUNK).cast("int")
    cut = names.select("cid", "block", "norm", chunks.alias("chunks"), F.pmod(F.xxhash64("cid"), chunks).cast("int").alias("chunk"))
    tiles = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("block", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "cid", "chunk", "norm")

    def scan(tile: pd.DataFrame) -> pd.DataFrame:
        cid, chunk = tile["cid"].to_numpy(np.int64), tile["chunk"].to_numpy(np.int64)
        if tile["lo"].iat[0] != tile["hi"].iat[0] and len(np.unique(chunk)) < 2:  # one of the chunks is empty
            cid = cid[:0]
        i, j, value = alike(tile["norm"].tolist() if len(cid) else [], chunk[: len(cid)], threshold)
        return pd.DataFrame({"a": np.minimum(cid[i], cid[j]), "b": np.maximum(cid[i], cid[j]), "likeness": value})

    return tiles.groupBy("block", "lo", "hi").applyInPandas(scan, "a long, b long, likeness double")


def record_pairs(records: DataFrame, block: str = "district", name: str = "work_name", key: str = "record_id", threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of records alike within their block, copies expanded: ``record_a`` < ``record_b``."""
    names, rows = classes_of(records, block, name, key)
    pairs = materialize(class_pairs(names, threshold).select("a", "b"), "class-pairs")
    copied = small_side(names.filter("copies > 1").select(F.xxhash64("block", "norm").alias("h"), F.xxhash64("norm", "block").alias("g"), "cid"))
    members = materialize(rows.select("rid", F.xxhash64("block", "norm").alias("h"), F.xxhash64("norm", "block").alias("g")).join(copied, ["h", "g"]).select("cid", "rid"), "copies")
    left, right = members.select(F.col("cid").alias("a"), F.col("rid").alias("ra")), members.select(F.col("cid").alias("b"), F.col("rid").alias("rb"))
    wide = pairs.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
    inside = left.join(right, F.col("a") == F.col("b")).filter("ra < rb").select(F.col("ra").alias("x"), F.col("rb").alias("y"))
    return wide.unionByName(inside).select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))
