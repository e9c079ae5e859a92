"""Exact per-key quantiles from histograms, without ever gathering the values of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarrymill.plans.skew import HOT_ROWS, attach_counts, fits
from quarrymill.plans.storage import discard, materialize

NULL_VALUE = -(2**63)
_STATE = ["n", "k", "v0", "v1", "i0", "i1"]


def keyed_median(rows: DataFrame, keys: list[str], value: str, ident: str, min_rows: int = 1, hot_rows: int = HOT_ROWS, bin_bits: int = 8, rounds: list[int] | None = None) -> DataFrame:
    """The row at position floor((n + 1) / 2) of each key, ordered by (`value`, `ident`).

    All keys go the same way. A round counts the rows of each key in at most 2**(bin_bits + 1) bins of `value`,
    map-side first, with the least and greatest value and ident of a bin; the first round has the same bins
    for all keys. The counts, added up, name the bin that holds the wanted position. A bin of one or two rows,
    or of equal ones, gives the row itself; the rows of all other wanted bins, and only these, go into the
    next round, in bins of the interval that they span, by `ident` once their values are equal. So a task
    holds the bins of a key at most, never its rows; rounds needed: log(range / bins), few for any data.
    The rows of wanted bins are found by (key, bin); bins of more than `hot_rows` rows are split off.

    `value` and `ident` are bigint; a null value comes first, a null ident before others; rows with a null
    in any key are left out. Repeated rows count each. Keys with fewer than `min_rows` rows give nothing,
    an empty table gives none. Other columns are ignored. Result: the keys, `ident`, `value`, n.
    `rounds`, if given, takes the number of keys left after each round.
    """
    low = F.lit(NULL_VALUE)
    names, keys = keys, [f"_k{i}" for i in range(len(keys))]  # free of clashes with the columns below
    base = rows.select(*[F.col(c).alias(k) for c, k in zip(names, keys)], F.coalesce(value, low).alias("_v"), F.coalesce(ident, low).alias("_i")).dropna(subset=keys)
    ends = base.where(F.col("_v") != low).agg(F.min("_v"), F.max("_v")).first()
    lo, hi = (e if e is not None else 0 for e in ends)
    whole = {"n": None, "k": None, "v0": lo, "v1": hi, "i0": 0, "i1": 0}
    left = base.select("*", *[F.lit(x).cast("long").alias(c) for c, x in whole.items()])
    found, held, first = None, None, True
    while True:
        left = left.withColumn("_bin", _bin(bin_bits, first))
        state = materialize(_chosen(left, keys, min_rows), "quantile-state")
        done = state.where("done").select(*keys, F.expr("case when v0 != v1 then if(k = 1, a, b) when k = 1 then i0 else i1 end").alias("_i"), F.expr("if(k = 1, v0, v1)").alias("_v"), "n")
        found = done if found is None else found.unionByName(done)
        going = state.where("not done").select(*keys, "_bin", "c", *_STATE)
        number = going.count()
        if rounds is not None:
            rounds.append(number)
        if not number:
            break
        bare, on = left.select(*keys, "_v", "_i", "_bin"), [*keys, "_bin"]
        inside = bare.join(F.broadcast(going), on) if fits(going) else attach_counts(bare, going, on, "c", ["_i"], hot_rows)
        before, held = held, materialize(inside.select(*keys, "_v", "_i", *_STATE), "wanted-rows")
        if before is not None:
            discard(before)
        left, first = held, False
    if held is not None:
        discard(held)
    out = lambda c: F.nullif(c, low)
    return found.select(*[F.col(k).alias(c) for c, k in zip(names, keys)], out(F.col("_i")).alias(ident), out(F.col("_v")).alias(value), "n")


def _bin(bits: int, first: bool):
    """A number for the row's place in its interval, ascending; nulls have a bin of their own in the first round."""
    wide = lambda a, b: f"greatest(0, cast(floor(log2(greatest(1d, cast({b} as double) - cast({a} as double)))) as int) - {bits})"
    by_value = f"shiftright(_v, {wide('v0', 'v1')})"
    if first:
        return F.expr(f"if(_v = {NULL_VALUE + 1} - 1, {NULL_VALUE + 1} - 1, {by_value})")
    return F.expr(f"if(v0 < v1, {by_value}, shiftright(_i, {wide('i0', 'i1')}))")


def _chosen(rows: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """The bin of each key that holds the wanted position, which becomes the position inside it.

    All aggregates are single numbers, so partial ones are hashed and added before the shuffle. `a` and `b` are
    idents at the least and the greatest value, exact where the bin has two rows.
    """
    parts = {"v0": F.min("_v"), "v1": F.max("_v"), "i0": F.min("_i"), "i1": F.max("_i"), "a": F.min_by("_i", "_v"), "b": F.max_by("_i", "_v"), "n": F.max("n"), "k": F.max("k")}
    bins = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("c"), *[e.alias(c) for c, e in parts.items()])
    of_key = Window.partitionBy(*keys)
    upto = F.sum("c").over(of_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumn("upto", upto).withColumn("n", F.coalesce("n", F.sum("c").over(of_key))).withColumn("k", F.coalesce("k", F.expr("floor((n + 1) / 2)")))
    hit = bins.where(f"n >= {min_rows} and upto >= k and upto - c < k").withColumn("k", F.expr("k - (upto - c)"))
    return hit.withColumn("done", F.expr("c <= 2 or v0 = v1 and (i0 = i1 or k = 1 or k = c)")).drop("upto")
