"""Filling containers of fixed capacity with texts measured in tokens, in as few containers as possible.

The sizes are spread over partitions of a bounded number of texts, and each is packed by best-fit decreasing. Dual feasible
functions give each partition a lower bound on its bins: for any of them, the sum over the sizes cannot exceed the bins of any
packing, so a partition whose bins equal its bound is *certified* and done. Of the others, the emptiest bins (as many as the
gap, and ``SPARE`` more) give their texts into a pool; pools of ``FAN_IN`` partitions are put together and packed again, until
no gap is left or there is one pool. Only sizes move, never texts; a pool shrinks with each round and is bounded by ``PER_PART``.

A text larger than the capacity is cut into pieces of the capacity and a rest, which is packed like any text; no other text
is cut. ``certificate`` holds the bins against a lower bound over all sizes.

Defined results: null texts and texts without tokens need no container and give no row; special-token strings in a text are
ordinary text; repeated rows are packed each; containers with a null or non-positive capacity are left out.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.runtime import materialize, spread

#: Where the tokenizers' files are, which one counts, and how it cuts a text before merging (a fixed value of the vocabulary).
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PER_PART, FAN_IN, SPARE = 20_000, 8, 4


@lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, tokens) of every text that has tokens."""
    path = os.path.join(folder, vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(path)
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) for t in b["t"].tolist()]
            yield pd.DataFrame({"d": b["d"], "n": n})

    source = spread(documents.filter(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(doc).alias("d"), F.col(text).alias("t")))
    kind = source.schema["d"].dataType.simpleString()
    return source.mapInPandas(count, f"d {kind}, n long").filter("n > 0").select(F.col("d").alias(doc), F.col("n").alias("tokens"))


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions (Fekete and Schepers' u(k) and cuts at small sizes)."""
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 12):
        times = (k + 1) * sizes
        whole = times % capacity == 0
        best = max(best, -(-int((np.where(whole, sizes * k, times // capacity * capacity) * counts).sum()) // (k * capacity)))
    for small in np.unique(np.concatenate([sizes[sizes * 2 <= capacity], [0]])):
        # sizes above capacity - small count as a whole bin, those under small as nothing
        value = np.where(sizes > capacity - small, capacity, np.where(sizes < small, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, sizes taken from the largest down, each into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins, out = 0, 0, [0] * len(sizes)  # bit r of open_rooms: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        rest = open_rooms >> size
        if rest:
            r = size + (rest & -rest).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, bins
            bins += 1
        out[i] = b
        r -= size
        if r:
            if not room[r]:
                open_rooms |= 1 << r
            room[r].append(b)
    return out


def _pack_part(pdf: pd.DataFrame, capacity: int, stage: int, part: int, last: bool) -> pd.DataFrame:
    """A partition packed: rows of kept bins with a bin number, rows of the pool without."""
    sizes = pdf["size"].to_numpy(np.int64)
    bins = np.array(best_fit_decreasing(sizes.tolist(), capacity), np.int64)
    kinds, counts = np.unique(sizes, return_counts=True)
    n = int(bins.max()) + 1 if len(bins) else 0
    gap = n - lower_bound(kinds, counts, capacity)
    pool = np.zeros(n, bool)
    if gap > 0 and not last:
        filled = np.bincount(bins, weights=sizes, minlength=n)
        pool[np.argsort(filled, kind="stable")[: gap + SPARE]] = True
    number = (np.int64(stage) << 56) | (np.int64(part) << 32) | bins
    out = pdf[["container", "capacity", "doc", "piece", "size"]].copy()
    out["bin"] = pd.array(np.where(pool[bins], -1, number) if n else [], "Int64")
    return out


def _packer(stage: int, parts: dict[str, int]):
    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_part(pdf, int(pdf["capacity"].iat[0]), stage, int(key[1]), parts[key[0]] == 1)

    return group


def pack_all(sizes: DataFrame, containers: DataFrame, doc: str = "doc_id", per_part: int = PER_PART) -> DataFrame:
    """(container, capacity, doc, piece, tokens, bin) for each container of a small table of capacities, all at once."""
    wanted = containers.filter(F.col("capacity_tokens") > 0).orderBy("container").limit(1001).collect()
    if len(wanted) > 1000:
        raise ValueError("more than 1,000 containers")
    kind = sizes.schema[doc].dataType.simpleString()
    if not wanted:
        return sizes.sparkSession.createDataFrame([], f"container string, capacity int, `{doc}` {kind}, piece int, tokens long, bin long")
    each = F.explode(F.array(*[F.struct(F.lit(r["container"]).alias("container"), F.lit(int(r["capacity_tokens"])).alias("capacity")) for r in wanted]))
    cut = sizes.filter(F.col("tokens") > 0).select(F.col(doc).alias("doc"), "tokens", each.alias("c")).select("c.container", "c.capacity", "doc", "tokens")
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr("cast((tokens - 1) div capacity as int)"))))
    pieces = cut.select("container", "capacity", "doc", "piece", F.when(F.col("piece") < F.expr("tokens div capacity"), F.col("capacity")).otherwise(F.col("tokens") % F.col("capacity")).cast("long").alias("size"))
    full = pieces.filter("size = capacity").withColumn("bin", F.monotonically_increasing_id())
    schema = f"container string, capacity int, doc {kind}, piece int, size long, bin long"
    rest, stage, kept, before = pieces.filter("size < capacity"), 1, [], {}
    while True:
        held = {r["container"]: r["n"] for r in rest.groupBy("container").agg(F.count("*").alias("n")).collect()}  # a row per container
        if not held:
            break
        # fewer partitions each round, so that the texts of several meet
        parts = {c: max(1, min(-(-n // per_part), before.get(c, FAN_IN * -(-n // per_part)) // FAN_IN)) if stage > 1 else max(1, -(-n // per_part)) for c, n in held.items()}
        number = F.create_map(*[x for c, p in parts.items() for x in (F.lit(c), F.lit(p))])
        spread = rest.withColumn("part", F.pmod(F.xxhash64("doc", "piece", F.lit(stage)), number[F.col("container")]))
        solved = materialize(spread.groupBy("container", "part").applyInPandas(_packer(stage, parts), schema), "packed")
        kept.append(solved.filter("bin >= 0"))
        rest, stage, before = solved.filter("bin < 0").drop("bin"), stage + 1, parts
        if all(p == 1 for p in parts.values()):
            break
    out = full
    for k in kept:
        out = out.unionByName(k)
    return out.select("container", "capacity", F.col("doc").alias(doc), "piece", F.col("size").alias("tokens"), "bin")


def pack(sizes: DataFrame, capacity: int, doc: str = "doc_id", per_part: int = PER_PART) -> DataFrame:
    """(doc, piece, tokens, bin) for one capacity."""
    one = sizes.sparkSession.createDataFrame([("one", int(capacity))], "container string, capacity_tokens long")
    return pack_all(sizes, one, doc, per_part).select(doc, "piece", "tokens", "bin")


def promises(packed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(container, texts, overfull, torn, above): texts packed, bins beyond their capacity, texts whose pieces are not just as
    many as they must be, and bins in use beyond one per cent over the lower bound."""
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("t")).groupBy("container").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    texts = packed.groupBy("container", "capacity", doc).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    whole = texts.groupBy("container").agg(F.count("*").alias("texts"), F.count_if(F.col("n") != F.ceil(F.col("t") / F.col("capacity"))).alias("torn"))
    above = certificate(packed).select("container", F.greatest(F.lit(0), F.col("bins") - F.floor(F.col("least") * 1.01) - 1).cast("long").alias("above"))
    return bins.join(whole, "container").join(above, "container").select("container", "texts", "overfull", "torn", "above")


def certificate(packed: DataFrame) -> DataFrame:
    """(container, bins, least, fill): the bins used, a lower bound on those of any packing, and the share of room in use.
    The histogram of sizes behind the bound has at most as many rows as the capacity."""
    used = packed.groupBy("container", "capacity").agg(F.countDistinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    sizes = packed.groupBy("container", "capacity", "tokens").agg(F.count("*").alias("n"))

    def bound(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"container": [key[0]], "least": [lower_bound(pdf["tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(key[1]))]})

    bounds = sizes.groupBy("container", "capacity").applyInPandas(bound, "container string, least long")
    return used.join(bounds, "container").select("container", "bins", "least", (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("fill"))
