"""Joins that hold when one key carries a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrymill.plans.storage import materialize

#: What may be broadcast: so many rows, and so many bytes of them written as JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: A key with more rows than this is hot.
HOT_ROWS = 100_000
SALTS = 32


def fits(small: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough to be broadcast; reads at most limit + 1 of its rows."""
    row = small.limit(limit + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count("*"), F.sum("b")).first()
    return row[0] <= limit and (row[1] or 0) <= size


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str, salt: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table with few rows per key onto rows whose keys may be very uneven.

    `small` should be cheap to count (a materialized table). Within `limit` rows and BROADCAST_BYTES it is
    broadcast; beyond that its rows are repeated for each of SALTS salts and the rows of `big`, salted by a
    hash of the columns `salt`, meet them in a shuffle in which no hot key stays whole.
    """
    if fits(small, limit):
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = big.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*on, "_salt"], how).drop("_salt")


def attach_counts(rows: DataFrame, counts: DataFrame, on: str | list[str], count: str, salt: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of `rows` with a table of one row per key, whose column `count` says how many rows the key has.

    Keys counted at most `hot_rows` times meet in a plain shuffle; the rows of hotter keys, of which there
    are at most (all rows / hot_rows), go through `attach`.
    """
    on = [on] if isinstance(on, str) else on
    hot = counts.where(F.col(count) > hot_rows)
    if hot.isEmpty():
        return rows.join(counts, on)
    known = attach(rows, hot, on, "left", salt)
    cold = known.where(F.col(count).isNull()).select(*rows.columns).join(counts.where(F.col(count) <= hot_rows), on)
    return cold.unionByName(known.where(F.col(count).isNotNull()))


def attach_rows(rows: DataFrame, small: DataFrame, on: str, salt: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of (materialized) `rows` with a table of one row per key, whatever number of rows a key has."""
    if fits(small):
        return rows.join(F.broadcast(small), on)
    hot = materialize(rows.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows), "hot-keys")
    if hot.isEmpty():
        return rows.join(small, on)
    known = attach(rows, hot, [on], "left", salt)
    cold = known.where("_n is null").drop("_n").join(small, on)
    of_hot = materialize(small.join(hot.select(on), on, "left_semi"), "rows-of-hot-keys")
    return cold.unionByName(attach(known.where("_n is not null").drop("_n"), of_hot, [on], "inner", salt))


def block_join(left: DataFrame, right: DataFrame, key: str | list[str], left_id: str, right_id: str, block: int = 1000) -> DataFrame:
    """Inner join on `key` where both sides may have very many rows of one key.

    A key with more than `block` rows on a side is cut on that side into blocks by a hash of the id, and
    every block of one side meets every block of the other in a join of its own (key, block, block). Both
    sides are read twice, once to count.
    """
    key = [key] if isinstance(key, str) else key
    count = lambda d, c: d.groupBy(*key).agg(F.ceil(F.count("*") / block).alias(c))
    parts = count(left, "_cl").join(count(right, "_cr"), key).where("_cl > 1 or _cr > 1")
    parts = materialize(parts, "join-blocks")
    if parts.isEmpty():
        return left.join(right, key)
    one = lambda c: F.coalesce(c, F.lit(1))
    mine = lambda i, c: F.pmod(F.xxhash64(i), one(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c).cast("int") - 1))
    a = attach(left, parts, key, "left", [left_id]).withColumn("_i", mine(left_id, "_cl")).withColumn("_j", every("_cr")).drop("_cl", "_cr")
    b = attach(right, parts, key, "left", [right_id]).withColumn("_j", mine(right_id, "_cr")).withColumn("_i", every("_cl")).drop("_cl", "_cr")
    return a.join(b, [*key, "_i", "_j"]).drop("_i", "_j")
