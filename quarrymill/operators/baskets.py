"""Filter joins, baskets and co-occurrence graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.operators.common import common_pairs
from quarrymill.operators.pair_sums import common_whole, fits_whole


def filter_join(dimension: DataFrame, facts: DataFrame, key: str, keep: Column) -> DataFrame:
    """Rows of `facts` whose key has a dimension row passing `keep`, once for each such row.

    The filter and the one column reach the scan; Spark broadcasts the dimension where its size allows.
    """
    return facts.join(dimension.where(keep).select(key), key)


def baskets(rows: DataFrame, basket: str, item: str, larger_than: int | None = None) -> DataFrame:
    """(basket, item), each once; only baskets with more than `larger_than` items if that is given. Nulls are left out."""
    held = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()
    if larger_than is None:
        return held
    sizes = held.groupBy("basket").count().where(F.col("count") > larger_than)
    return held.join(sizes, "basket", "left_semi")


def market_baskets(rows: DataFrame, user: str, business: str, case: int, larger_than: int | None = None) -> DataFrame:
    """Case 1: users are baskets of businesses; case 2: businesses are baskets of users."""
    if case not in (1, 2):
        raise ValueError(f"case is 1 or 2, not {case}")
    return baskets(rows, *((user, business) if case == 1 else (business, user)), larger_than)


def shared_counts(rows: DataFrame, node: str, via: str, min_common: int = 1) -> DataFrame:
    """(src, dst, n): how many distinct `via` values two nodes share, for src < dst and n >= min_common. Rows that fit
    travel whole to the tasks."""
    if fits_whole(rows, node, via):
        return common_whole(rows, node, via, max(1, min_common)).toDF("src", "dst", "n")
    return common_pairs(rows, node, via, min_common).toDF("src", "dst", "n")


def cooccurrence_edges(rows: DataFrame, node: str, via: str, min_common: int) -> DataFrame:
    """Undirected edges (src < dst) between nodes sharing at least `min_common` distinct values; no loops."""
    return shared_counts(rows, node, via, min_common).select("src", "dst")
