"""Frequent itemsets by levels, in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quarrymill.plans.skew import attach, block_join
from quarrymill.plans.storage import materialize


def _names(k: int) -> list[str]:
    return [f"i{j}" for j in range(1, k + 1)]


def frequent_itemsets(held: DataFrame, support: int, max_k: int | None = None) -> list[DataFrame]:
    """Level k of the result has (i1 < ... < ik, support) of the itemsets in at least `support` baskets.

    held has (basket, item), each once. A level joins the surviving occurrences (basket, i1..ik) of the same
    basket that differ in their last item only, in blocks where a basket is long, counts with map-side
    combining, and keeps the frequent ones; so no itemset with an infrequent prefix of either kind is ever
    generated, and nothing passes the driver but the question whether a level is empty. Without max_k the
    levels end with the first empty one; with it there are max_k levels, empty ones included.
    """
    singles = held.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    singles = materialize(singles.select(F.col("item").alias("i1"), "support"), "itemsets-1")
    seen = attach(held.withColumnRenamed("item", "i1"), singles.select("i1"), ["i1"], "left_semi", ["basket"])
    levels, k, empty = [singles], 1, False
    while max_k is None or k < max_k:
        if not empty:
            seen = materialize(seen, f"occurrences-{k}")
            longer = block_join(seen, seen.withColumnRenamed(f"i{k}", f"i{k + 1}"), ["basket", *_names(k - 1)], f"i{k}", f"i{k + 1}").where(F.col(f"i{k}") < F.col(f"i{k + 1}"))
            level = longer.groupBy(*_names(k + 1)).agg(F.count("*").alias("support")).where(F.col("support") >= support)
            level = materialize(level, f"itemsets-{k + 1}")
            empty = level.isEmpty()
            seen = attach(longer, level.select(*_names(k + 1)), _names(k + 1), "left_semi", ["basket"])
        else:
            level = held.select(*[F.col("item").alias(c) for c in _names(k + 1)], F.lit(0).cast("long").alias("support")).limit(0)
        if empty and max_k is None:
            break
        k += 1
        levels.append(level)
    return levels


def candidates(level: DataFrame, k: int, held: DataFrame | None = None) -> DataFrame:
    """Candidates of k + 1 items from the frequent k-itemsets: joined on the first k - 1, every k-subset frequent.

    For k = 1 all pairs of items would be candidates, so those of frequent items that some basket of `held`
    has together are given.
    """
    if k < 2:
        if k < 1 or held is None:
            raise ValueError("pairs come from the baskets, not from all pairs of items")
        seen = attach(held, level.select(F.col("i1").alias("item")), ["item"], "left_semi", ["basket"])
        one, two = (seen.select("basket", F.col("item").alias(c)) for c in ("i1", "i2"))
        return block_join(one, two, "basket", "i1", "i2").where("i1 < i2").select("i1", "i2").distinct()
    names = _names(k + 1)
    left = level.select(*names[:k])
    right = left.withColumnRenamed(f"i{k}", f"i{k + 1}")
    out = left.join(right, names[: k - 1]).where(F.col(f"i{k}") < F.col(f"i{k + 1}"))
    for dropped in names[: k - 1]:
        rest = [n for n in names if n != dropped]
        out = out.join(left.toDF(*rest), rest, "left_semi")
    return out.select(*names)


def itemset_report(levels: list[DataFrame]) -> DataFrame:
    """(size, line): for each size the sorted itemsets as one comma-joined line, as ('a'),('b') or ('a', 'b'),('a', 'c')."""
    lines = None
    for k, level in enumerate(levels, 1):
        text = F.concat(F.lit("('"), F.concat_ws("', '", *_names(k)), F.lit("')"))
        one = level.select(F.struct(*_names(k), text.alias("t")).alias("s")).agg(F.sort_array(F.collect_list("s")).alias("a"))
        one = one.where(F.size("a") > 0).select(F.lit(k).alias("size"), F.array_join(F.transform("a", lambda s: s["t"]), ",").alias("line"))
        lines = one if lines is None else lines.unionByName(one)
    return lines


def itemset_lines(levels: list[DataFrame]) -> DataFrame:
    """(size, items, support): every itemset as one row, for results that one line of the report cannot hold."""
    lines = [level.select(F.lit(k).alias("size"), F.array(*_names(k)).alias("items"), "support") for k, level in enumerate(levels, 1)]
    return reduce(DataFrame.unionByName, lines)
