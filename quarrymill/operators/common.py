"""Pairs of ids by the values they have in common, exact and without a task for all ids of a hot value."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.plans.skew import attach, attach_counts, attach_rows, block_join
from quarrymill.plans.storage import materialize

#: Ids with at most so many values are held as arrays; larger ones stay rows of single values.
ARRAY_VALUES = 50_000


def coding(different: DataFrame, column: str) -> Callable[[str], Column]:
    """A 64-bit hash that differs between all values of a table of different ones; checked, and salted until it does."""
    for salt in range(100):
        if different.groupBy(F.xxhash64(column, F.lit(salt)).alias("c")).count().where("count > 1").isEmpty():
            return lambda c: F.xxhash64(c, F.lit(salt))
    raise ValueError("no collision-free code found")


def encoded(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None]:
    """rows with codes for a column of strings, which makes pairs of them small, and the table (code, name); rows with
    a null there are left out. Other types stay as they are, without a table."""
    rows = rows.where(F.col(column).isNotNull())
    if rows.schema[column].dataType.simpleString() != "string":
        return rows, None
    names = materialize(rows.select(F.col(column).alias("name")).distinct(), "names")
    code = coding(names, "name")
    return rows.withColumn(column, code(column)), names.select(code("name").alias("code"), "name")


def decoded(pairs: DataFrame, names: DataFrame | None) -> DataFrame:
    """Pairs (id1, id2, ..) of codes with their names, the smaller name first."""
    if names is None:
        return pairs
    rest = [c for c in pairs.columns if c not in ("id1", "id2")]
    side = lambda k: names.select(F.col("code").alias(f"id{k}"), F.col("name").alias(f"name{k}"))
    met = attach_rows(attach_rows(materialize(pairs, "coded-pairs"), side(1), "id1", ["id2"]), side(2), "id2", ["id1"])
    return met.select(F.least("name1", "name2").alias("id1"), F.greatest("name1", "name2").alias("id2"), *rest)


class Common:
    """The values of each id, ready to count those that two ids share.

    Rows with a null are left out, repeated ones count once, ids with fewer than `min_common` values are not
    searched. held: (id, value). sizes: (id, n). arrays: (id, n, codes) with the codes of the values that
    several ids have, the rarest first, for ids of up to `max_array` values; long: (id, n, code) of larger ids.
    A code is a 64-bit hash, checked to differ between all values present.
    """

    def __init__(self, rows: DataFrame, ident: str, value: str, min_common: int = 1, max_array: int = ARRAY_VALUES):
        self.min_common, self.max_array = min_common, max_array
        self.held = materialize(rows.select(F.col(ident).alias("id"), F.col(value).alias("value")).dropna().distinct(), "held-values")
        self.sizes = materialize(self.held.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= min_common), "held-sizes")

    @cached_property
    def _codes(self) -> DataFrame:
        kept = attach_counts(self.held, self.sizes, "id", "n", ["value"])
        freq = materialize(kept.groupBy("value").agg(F.count("*").alias("f")).where("f > 1"), "value-counts")
        freq = freq.select("value", "f", coding(freq, "value")("value").alias("code"))
        return attach_counts(kept, freq, "value", "f", ["id"]).select("id", "n", "f", "code")

    @cached_property
    def arrays(self) -> DataFrame:
        small = self._codes.where(F.col("n") <= self.max_array).groupBy("id", "n")
        small = small.agg(F.sort_array(F.collect_list(F.struct("f", "code"))).alias("c"))
        return materialize(small.select("id", "n", F.col("c.code").alias("codes")), "value-arrays")

    @cached_property
    def large(self) -> DataFrame | None:
        """Ids with more than `max_array` values, None without any."""
        large = materialize(self.sizes.where(F.col("n") > self.max_array).select("id"), "large-ids")
        return None if large.isEmpty() else large

    @cached_property
    def long(self) -> DataFrame:
        return materialize(self._codes.where(F.col("n") > self.max_array).select("id", "n", "code"), "large-values")

    def pairs(self) -> DataFrame:
        """(id1 < id2, n_both): all pairs with at least `min_common` values in common.

        Of two ids with m values in common, one of these is among the first k - m + 1 of each id's k shared
        values, rarest first; so the m - 1 most used values of an id make no candidates, and hot values
        hardly any. Candidates are then counted exactly. With min_common = 1 the values themselves are counted.
        """
        if self.min_common <= 1:
            one, two = (self.held.select("value", F.col("id").alias(c)) for c in ("id1", "id2"))
            met = block_join(one, two, "value", "id1", "id2").where("id1 < id2")
            return met.groupBy("id1", "id2").agg(F.count("*").alias("n_both"))
        first = F.slice("codes", 1, F.size("codes") - self.min_common + 1)
        rare = materialize(self.arrays.where(F.size("codes") >= self.min_common).select("id", F.explode(first).alias("code")), "rare-values")
        one, two = (rare.select("code", F.col("id").alias(c)) for c in ("id1", "id2"))
        met = block_join(one, two, "code", "id1", "id2").where("id1 < id2").select("id1", "id2").distinct()
        out = self._small(materialize(met, "candidates")).where(F.col("n_both") >= self.min_common)
        return out.unionByName(self._of_large()) if self.large is not None else out

    def count(self, pairs: DataFrame) -> DataFrame:
        """Pairs (id1, id2) with n_both, for pairs with any value in common."""
        pairs = materialize(pairs.select("id1", "id2"), "pairs")
        if self.large is None:
            return self._small(pairs).where("n_both > 0")
        mark = lambda k: self.large.select(F.col("id").alias(f"id{k}"), F.lit(1).alias(f"large{k}"))
        known = attach(attach(pairs, mark(1), ["id1"], "left", ["id2"]), mark(2), ["id2"], "left", ["id1"])
        known = materialize(known, "marked-pairs")
        small = self._small(known.where("large1 is null and large2 is null").select("id1", "id2")).where("n_both > 0")
        some = known.where("large1 is not null or large2 is not null")
        # the smaller id first, so that few values are spread over the pairs
        swap = F.col("large2").isNull() & F.col("large1").isNotNull()
        some = some.select(F.when(swap, F.col("id2")).otherwise(F.col("id1")).alias("a"), F.when(swap, F.col("id1")).otherwise(F.col("id2")).alias("b"))
        every = self.arrays.select("id", F.explode("codes").alias("code")).unionByName(self.long.select("id", "code"))
        mine = block_join(every.withColumnRenamed("id", "a"), some, "a", "code", "b", 10_000)
        shared = mine.join(every.withColumnRenamed("id", "b"), ["b", "code"]).groupBy("a", "b").agg(F.count("*").alias("n_both"))
        return small.unionByName(shared.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "n_both"))

    def _small(self, pairs: DataFrame) -> DataFrame:
        side = lambda k: self.arrays.select(F.col("id").alias(f"id{k}"), F.col("codes").alias(f"c{k}"))
        both = attach_rows(attach_rows(pairs, side(1), "id1", ["id2"]), side(2), "id2", ["id1"])
        return both.select("id1", "id2", F.size(F.array_intersect("c1", "c2")).cast("long").alias("n_both"))

    def _of_large(self) -> DataFrame:
        """Pairs with a large id, of which there are few: counted by the values themselves."""
        every = self.arrays.select("id", F.explode("codes").alias("code"), F.lit(False).alias("is_large")).unionByName(self.long.select("id", "code", F.lit(True).alias("is_large")))
        met = block_join(self.long.select("code", F.col("id").alias("a")), every.withColumnRenamed("id", "b"), "code", "a", "b")
        met = met.where("not is_large and a != b or a < b")
        shared = met.groupBy("a", "b").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= self.min_common)
        return shared.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "n_both")


def common_pairs(rows: DataFrame, ident: str, value: str, min_common: int = 1) -> DataFrame:
    """(id1 < id2, n_both): pairs of ids that share at least `min_common` distinct values."""
    coded, names = encoded(rows.select(ident, value), ident)
    return decoded(Common(coded, ident, value, min_common).pairs(), names)
