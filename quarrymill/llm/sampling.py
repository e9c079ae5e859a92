"""A uniform sample of fixed size from data that arrives in pieces of unknown number and size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quarrymill.plans.skew import attach
from quarrymill.plans.shipping import ship
from quarrymill.plans.storage import materialize

FAN_OUT = 256


def fixed_size_sample(rows: DataFrame, piece: str, ident: list[str], k: int = 100, seed: int = 0, leaf_rows: int = 50_000) -> DataFrame:
    """Exactly k rows (all, if there are fewer), every row equally likely, jointly without replacement.

    The partition tree is root -> FAN_OUT nodes -> leaves. A leaf is a chunk of a piece, cut by a hash of
    `ident` so that a piece however large gives chunks of about `leaf_rows` rows, and lies in a node by a hash
    of piece and chunk, so that the chunks of a large piece are spread over all nodes. Rows are counted per
    leaf after arrival. k is split over the children of each node by hypergeometric draws, top down; at most
    k leaves get a quota. Sequential selection sampling then runs through each of these leaves with its exact
    quota, and the places chosen are looked up among the rows in the order of a hash of `ident`. Only the
    totals of the nodes reach the driver, whatever k.

    `ident` must identify a row but for exact repetitions, which count as rows of their own. A null piece is
    a piece. The same seed and rows give the same sample whatever the partitioning. An empty table or k = 0
    gives no row. Columns of the result are those of `rows`.
    """
    ship(rows.sparkSession)
    if k <= 0 or rows.isEmpty():
        return rows.limit(0)
    name = F.coalesce(F.col(piece).cast("string"), F.lit("\0null"))
    keyed = rows.select(F.struct(*rows.columns).alias("_row"), name.alias("_piece"), F.xxhash64(*ident).alias("_h"))
    sizes = keyed.groupBy("_piece").agg(F.count("*").alias("t"))
    large = sizes.where(F.col("t") > leaf_rows).select("_piece", F.ceil(F.col("t") / leaf_rows).alias("_chunks"))
    cut = attach(keyed, materialize(large, "large-pieces"), ["_piece"], "left", ["_h"])
    cut = cut.withColumn("_leaf", F.pmod("_h", F.coalesce("_chunks", F.lit(1)))).drop("_chunks")
    node = F.pmod(F.xxhash64("_piece", "_leaf", F.lit(seed)), F.lit(FAN_OUT)).cast("int")
    leaves = materialize(cut.groupBy("_piece", "_leaf").agg(F.count("*").alias("n")).withColumn("_node", node), "sample-leaves")

    totals = {r["_node"]: r["n"] for r in leaves.groupBy("_node").agg(F.sum("n").alias("n")).collect()}  # at most FAN_OUT rows
    nodes = sorted(totals)
    quotas = {x: q for x, q in zip(nodes, split(k, [totals[x] for x in nodes], _rng(seed, "root"))) if q}
    chosen = leaves.where(F.col("_node").isin(list(quotas))).repartition(len(quotas), "_node").sortWithinPartitions("_node", "_piece", "_leaf")
    drawn = chosen.mapInPandas(_descend(quotas, totals, seed), "_piece string, _leaf long, n long, q long")
    places = materialize(drawn.repartition("_piece", "_leaf").mapInPandas(_selected(seed), "_piece string, _leaf long, _at int"), "sample-places")

    # a leaf has about leaf_rows rows at most, so these keys are even; Spark broadcasts what its own sizes allow
    leaf = ["_piece", "_leaf"]
    order = Window.partitionBy(*leaf).orderBy("_h", *[F.col(f"_row.{c}") for c in ident])
    placed = cut.join(places.select(*leaf).distinct(), leaf, "left_semi").withColumn("_at", F.row_number().over(order))
    return placed.join(places, [*leaf, "_at"], "left_semi").select("_row.*")


def split(k: int, sizes: list[int], rng: np.random.Generator) -> list[int]:
    """Numbers to draw from each of several sets when k are drawn from their union, by halves."""
    k = min(k, sum(sizes))
    if len(sizes) < 2 or k == 0:
        return [k] * len(sizes) if k else [0] * len(sizes)
    half = len(sizes) // 2
    left = hypergeometric(sum(sizes[:half]), sum(sizes[half:]), k, rng)
    return split(left, sizes[:half], rng) + split(k - left, sizes[half:], rng)


def hypergeometric(good: int, bad: int, k: int, rng: np.random.Generator, at_once: int = 1_000_000) -> int:
    """How many of k draws fall into `good`: numpy's own up to its limit of 10**9, beyond it `at_once` places drawn
    at a time, without repetition, from what the draws before left."""
    got = 0
    while k and good and bad:
        if good + bad < 10**9:
            return got + int(rng.hypergeometric(good, bad, k))
        take = min(k, at_once)
        places = np.zeros(0, np.int64)
        while len(places) < take:  # a place drawn again does not count
            more = rng.integers(0, good + bad, take - len(places))
            fresh = np.unique(more, return_index=True)[1]
            more = more[np.sort(fresh)]
            places = np.concatenate([places, more[~np.isin(more, places)]])
        hit = int((places < good).sum())
        got, good, bad, k = got + hit, good - hit, bad - (take - hit), k - take
    return got + (k if good else 0)


def positions(n: int, q: int, rng: np.random.Generator) -> Iterator[int]:
    """Sequential selection: each of n places in turn is taken with probability (still wanted) / (still to come)."""
    for at, u in enumerate(rng.random(n) if q else ()):
        if u * (n - at) < q:
            yield at
            q -= 1
            if not q:
                return


def _rng(seed: int, *path: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr((seed, *path)).encode(), digest_size=16).digest(), "big"))


def _descend(quotas: dict[int, int], totals: dict[int, int], seed: int):
    """The leaves of each node in turn: draw from this leaf against what is left of the node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, k, left, rng = None, 0, 0, None
        for pdf in batches:
            q = np.zeros(len(pdf), np.int64)
            for i, (x, n) in enumerate(zip(pdf["_node"].tolist(), pdf["n"].tolist())):
                if x != node:
                    node, k, left, rng = x, quotas[x], totals[x], _rng(seed, "node", x)
                left -= n
                q[i] = hypergeometric(n, left, k, rng)
                k -= q[i]
            yield pdf.assign(q=q).loc[q > 0, ["_piece", "_leaf", "n", "q"]]

    return run


def _selected(seed: int):
    """The places to take in each leaf, counted from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for piece, leaf, n, q in pdf.itertuples(index=False):
                at = np.fromiter(positions(n, q, _rng(seed, "leaf", piece, leaf)), np.int32) + 1
                yield pd.DataFrame({"_piece": piece, "_leaf": leaf, "_at": at})

    return run
