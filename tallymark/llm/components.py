"""Consolidating pairwise matches into groups.

Union-find runs inside each partition of the edges and keeps a spanning forest only: every node with the least node of its
tree. Forests are then merged level by level through fewer and larger partitions, of at most ``BOUND`` edges each. A forest
that is still larger than ``BOUND`` when nothing more can be merged is contracted in distributed rounds (small star, then
large star, each followed by union-find in the partitions), until every tree is a star around its least node; such rounds
move only keys, never a whole group, so no task and no driver ever holds a component.

Defined results: null ends, self matches, repeated and turned pairs add nothing; a null key links nothing; empty input gives
no rows; a node without a link gives no row; the group identifier is the least node of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.runtime import materialize

#: Edges one task may hold, and how many partitions are merged into one per level.
BOUND, FAN_IN = 2_000_000, 8
PAIR = "u long, v long"


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges: each node that is not the least of its tree, with that least node."""
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in zip(codes[: len(u)].tolist(), codes[len(u) :].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    root = np.array(parent, np.int64)
    while (up := root[root]).tobytes() != root.tobytes():
        root = up
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of a partition; over BOUND edges it is thinned as it grows, so memory follows its nodes, not its edges."""
    held, size = [], 0
    for b in batches:
        held.append((b["u"].to_numpy(), b["v"].to_numpy()))
        size += len(b)
        if size > BOUND:
            held = [forest(*(np.concatenate(x) for x in zip(*held)))]
            size = 0
    if held:
        u, v = forest(*(np.concatenate(x) for x in zip(*held)))
        for at in range(0, len(u), 100_000):
            yield pd.DataFrame({"u": u[at : at + 100_000], "v": v[at : at + 100_000]})


def links_by_key(records: DataFrame, node: str, key: str) -> DataFrame:
    """Edges between the records of one key: stars around the least node of a key within a partition, and one star over
    those. A key held by a third of all rows shrinks to one row per partition before the shuffle."""
    kind = records.schema[key].dataType.simpleString()

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict = {}
        for b in batches:
            u, v = [], []
            for n, k in zip(b["u"].tolist(), b["k"].tolist()):
                m = least.setdefault(k, n)
                if m != n:
                    u.append(n)
                    v.append(m)
            yield pd.DataFrame({"u": u, "v": v, "k": None}, dtype=object)
        items = list(least.items())
        for at in range(0, len(items), 100_000):
            part = items[at : at + 100_000]
            yield pd.DataFrame({"u": [n for _, n in part], "v": None, "k": [k for k, _ in part]}, dtype=object)

    rows = records.filter(F.col(key).isNotNull() & F.col(node).isNotNull()).select(F.col(node).cast("long").alias("u"), F.col(key).alias("k"))
    part = materialize(rows.mapInPandas(local, f"u long, v long, k {kind}"), "links")
    heads = part.filter("k IS NOT NULL").groupBy("k").agg(F.min("u").alias("v"), F.collect_set("u").alias("us"))  # a set of one node per partition
    across = heads.filter(F.size("us") > 1).select(F.explode("us").alias("u"), "v").filter("u != v")
    return part.filter("k IS NULL").select("u", "v").unionByName(across)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round: links each node's larger (or else its smaller) neighbours to the least node it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.filter("v < u")
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    moved = seen.join(least, "u")
    if large:
        return moved.filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.filter("u != m").select("u", F.col("m").alias("v")))


def spanning_stars(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """(u, v) for every node u of a component but its least node v."""
    spark = edges.sparkSession
    edges = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    trees = materialize(edges.mapInPandas(_forests, PAIR), "forest")
    parts = max(1, len(trees.inputFiles()))
    while True:
        n = trees.count()
        if n <= bound:
            return trees.coalesce(1).mapInPandas(_forests, PAIR) if n else spark.createDataFrame([], PAIR)
        fewer = max(-(-n // bound), parts // FAN_IN)
        if fewer >= parts:
            break
        merged = materialize(trees.coalesce(fewer).mapInPandas(_forests, PAIR), "forest")
        parts, trees = fewer, merged
    before = None
    while True:
        trees = materialize(_star(_star(trees, large=True).distinct(), large=False).distinct().mapInPandas(_forests, PAIR).distinct(), "stars")
        now = trees.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return trees
        before = now


def groups(edges: DataFrame, node: str = "record_id", group: str = "group_id", bound: int = BOUND) -> DataFrame:
    """Each node of a group of two or more, with the least node of the group."""
    stars = materialize(spanning_stars(edges, bound), "groups")
    heads = stars.select(F.col("v").alias("u"), "v").distinct()
    return stars.unionByName(heads).select(F.col("u").alias(node), F.col("v").alias(group))


def match_groups(records: DataFrame, matches: DataFrame) -> DataFrame:
    """Groups over matches with the verdict ``same`` and over shared work identifiers."""
    same = matches.filter(F.col("verdict") == "same").select(F.col("record_a").alias("u"), F.col("record_b").alias("v"))
    return groups(same.unionByName(links_by_key(records, "record_id", "work_id")))
