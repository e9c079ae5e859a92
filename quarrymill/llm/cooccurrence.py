"""Items that appear together: pair counts as a blocked Gram matrix of the basket-item matrix."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymill.plans.skew import attach
from quarrymill.plans.shipping import ship
from quarrymill.plans.storage import materialize

#: A record block is expanded at most so many pairs at a time.
PAIRS_AT_ONCE = 4_000_000
#: Rows in a batch that goes back to Spark.
ROWS_OUT = 100_000
#: Up to so many distinct items, a record block is multiplied as a dense matrix.
DENSE_ITEMS = 768


def cooccurrence(rows: DataFrame, basket: str, item: str, min_both: int = 1, min_lift: float = 0.0, block_items: int = 1024) -> DataFrame:
    """Count the baskets holding both items of a pair and compare with chance.

    The binary basket-item matrix X is cut into sparse blocks: records by Arrow batch, and the items of a
    basket with more than `block_items` items by the low bits of their code. Each block pair gives its
    transpose-product X_I' X_J, computed in numpy, and the products are summed over record blocks with
    map-side combining. So no task holds a whole long basket or all baskets of an item.

    Result: item_1 < item_2 (string order), n_1, n_2, n_both, n_baskets, lift = n_both * N / (n_1 * n_2),
    for pairs with n_both >= min_both and lift >= min_lift (compared in exact integers if min_lift is whole).
    Rows with a null basket or item are ignored, repeated rows count once, other columns are not used; an
    empty table gives no pair. Items are strings.
    """
    ship(rows.sparkSession)
    held = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()
    held = materialize(held, "baskets")
    items = materialize(held.groupBy("item").agg(F.count("*").alias("n")), "items")
    n_baskets = held.select("basket").distinct().count()
    code = _code(items)
    segments = _segments(held.withColumn("code", code), block_items)
    sums = segments.mapInArrow(_gram, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n_both"))
    sums = sums.where(F.col("n_both") >= min_both)
    named = lambda c, k: items.select(code.alias(c), F.col("item").alias(f"i{k}"), F.col("n").alias(f"m{k}"))
    # an item that pairs with nearly all others stays spread
    pairs = attach(attach(sums, named("a", 1), ["a"], "inner", ["b"]), named("b", 2), ["b"], "inner", ["a"])
    swap = F.col("i1") > F.col("i2")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = pairs.select(either("i1", "i2").alias("item_1"), either("i2", "i1").alias("item_2"), either("m1", "m2").alias("n_1"), either("m2", "m1").alias("n_2"), "n_both", F.lit(n_baskets).cast("long").alias("n_baskets"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    bound = F.lit(int(min_lift)).cast("decimal(9,0)") if float(min_lift).is_integer() else F.lit(float(min_lift))
    pairs = pairs.where(wide("n_both") * wide("n_baskets") >= wide("n_1") * wide("n_2") * bound)
    return pairs.withColumn("lift", F.col("n_both").cast("double") * F.col("n_baskets") / (F.col("n_1").cast("double") * F.col("n_2")))


def _code(items: DataFrame):
    """A 64-bit code of the item that is distinct for every item present; checked, and salted until it is."""
    for salt in range(100):
        code = F.xxhash64(F.col("item"), F.lit(salt))
        if items.groupBy(code.alias("c")).count().where("count > 1").isEmpty():
            return code
    raise ValueError("no collision-free code found")


def _segments(held: DataFrame, block_items: int) -> DataFrame:
    """(left, right): the items of a basket, or two item blocks of a long basket; right is null if it is left itself."""
    sizes = held.groupBy("basket").agg(F.count("*").alias("n"))
    long = materialize(sizes.where(F.col("n") > block_items).select("basket", F.expr(f"cast(shiftleft(1L, cast(ceil(log2(n / {block_items}d)) as int)) as bigint)").alias("blocks")), "long-baskets")
    cut = attach(held, long, ["basket"], "left", ["code"]).withColumn("block", F.coalesce(F.expr("code & (blocks - 1)"), F.lit(0)))
    blocks = cut.groupBy("basket", "block", F.coalesce("blocks", F.lit(1)).alias("blocks")).agg(F.collect_list("code").alias("codes"))
    whole = blocks.select(F.col("codes").alias("left"), F.lit(None).cast("array<bigint>").alias("right"))
    if long.isEmpty():
        return whole
    several = materialize(blocks.where("blocks > 1"), "item-blocks")
    other = several.select("basket", F.col("block").alias("block2"), F.col("codes").alias("right"))
    # each block names the later blocks it must meet, so the join key is (basket, block) and never the basket alone
    wanted = several.withColumn("block2", F.explode(F.expr("filter(sequence(block, blocks - 1), x -> x > block)")))
    across = wanted.join(other, ["basket", "block2"]).select(F.col("codes").alias("left"), "right")
    return whole.unionByName(across)


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(0), batch.column(1)
        both = np.asarray(right.is_valid())
        alone = left.filter(pa.array(~both))
        across = _between(left.filter(pa.array(both)), right.filter(pa.array(both)))
        for a, b, n in chain(_within(alone), across):
            sums = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])
            for k in range(0, len(sums), ROWS_OUT):
                yield sums.slice(k, ROWS_OUT)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    values = np.asarray(lists.flatten())
    return values, np.asarray(lists.value_lengths()).astype(np.int64)


def _within(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Upper triangle of X'X for one record block."""
    if not len(lists):
        return
    values, lengths = _flat(lists)
    codes, local = np.unique(values, return_inverse=True)
    if 0 < len(codes) <= DENSE_ITEMS and len(lengths) < 2**24:
        x = np.zeros((len(lengths), len(codes)), np.float32)
        x[np.repeat(np.arange(len(lengths)), lengths), local] = 1
        gram = np.triu(x.T @ x, 1)
        i, j = np.nonzero(gram)
        yield codes[i], codes[j], gram[i, j].astype(np.int64)
        return
    starts, parts, held = np.cumsum(lengths) - lengths, [], 0
    for k in np.unique(lengths[lengths > 1]):
        i, j = np.triu_indices(k, 1)
        at = starts[lengths == k]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for s in range(0, len(at), step):
            block = np.sort(local[at[s : s + step, None] + np.arange(k)], axis=1)
            parts.append((block[:, i] * len(codes) + block[:, j]).ravel())
            held += len(parts[-1])
            if held >= PAIRS_AT_ONCE:
                yield _summed(parts, codes)
                parts, held = [], 0
    if parts:
        yield _summed(parts, codes)


def _between(lefts: pa.ListArray, rights: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """X_I'X_J of two disjoint item blocks of the same records."""
    for x, y in zip(lefts, rights):
        x, y = np.asarray(x.values), np.asarray(y.values)
        a, b = np.repeat(x, len(y)), np.tile(y, len(x))
        yield np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64)


def _summed(parts: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells, n = np.unique(np.concatenate(parts), return_counts=True)
    return codes[cells // len(codes)], codes[cells % len(codes)], n.astype(np.int64)
