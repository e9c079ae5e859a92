"""Set membership, distinct counting, fixed-size samples and trending values."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrymill.plans.shipping import ship
from quarrymill.plans.storage import materialize

#: The multipliers and shifts of the ten membership hashes, their modulus and the number of positions.
BLOOM_HASHES = [(18124, 99463), (71730, 39428), (13483, 99262), (90482, 9985), (13453, 90097), (25413, 40901), (69022, 50309), (6275, 68046), (27354, 50241), (14428, 51089)]
BLOOM_MODULUS = 10039
BLOOM_POSITIONS = 10000
#: Modulus and range of the distinct-count hashes.
FM_MODULUS = 10000000343
FM_RANGE = 10**10
#: Values hashed at once, and groups whose maxima a task holds.
FM_AT_ONCE, FM_GROUPS = 2000, 1000


def text_number(text: str, modulus: int) -> Column:
    """The big-endian number of the text's UTF-8 bytes, modulo `modulus`."""
    digits = f"hex(encode({text}, 'UTF-8'))"
    byte = f"cast(conv(substr({digits}, 2 * i - 1, 2), 16, 10) as bigint)"
    return F.expr(f"aggregate(transform(sequence(1, octet_length({text})), i -> {byte}), 0L, (a, b) -> (a * 256 + b) % {modulus})")


def bloom_positions(values: DataFrame, column: str) -> DataFrame:
    """(value, pos): the positions of each distinct, non-empty value."""
    distinct = values.select(F.col(column).alias("value")).where("value is not null and value != ''").distinct()
    x = distinct.withColumn("x", text_number("value", BLOOM_MODULUS))
    spots = F.array(*[(a % BLOOM_MODULUS * F.col("x") + b) % BLOOM_MODULUS % BLOOM_POSITIONS for a, b in BLOOM_HASHES])
    return x.select("value", F.explode(spots).alias("pos"))


def bloom_build(values: DataFrame, column: str) -> DataFrame:
    """(pos): the set positions, at most BLOOM_POSITIONS rows."""
    return bloom_positions(values, column).select("pos").distinct()


def bloom_probe(values: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """values with `member`: 1 if all positions of the value are set, else 0; 0 for an empty or null value.

    The bits, of a fixed greatest number, stand as a constant in the plan, so rows are tested where they are.
    """
    words = [0] * (BLOOM_POSITIONS // 64 + 1)
    for r in bits.select("pos").distinct().collect():  # at most BLOOM_POSITIONS rows
        words[r[0] // 64] |= 1 << r[0] % 64
    table = F.array(*[F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words])

    def is_set(x: Column) -> Column:
        held = F.lit(True)
        for a, b in BLOOM_HASHES:
            p = (a % BLOOM_MODULUS * x + b) % BLOOM_MODULUS % BLOOM_POSITIONS
            word = F.element_at(table, F.floor(p / 64).cast("int") + 1)
            held = held & (F.call_function("shiftright", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return held

    text = F.col(column)
    member = F.forall(F.array(text_number(f"`{column}`", BLOOM_MODULUS)), is_set)  # the number is computed once a row
    return values.withColumn("member", F.when(text != "", member.cast("int")).otherwise(0))


def bloom_report(probed: DataFrame, order: str) -> DataFrame:
    """One line of the bits separated by spaces, in the order given; for probes that fit in one line."""
    bits = probed.agg(F.sort_array(F.collect_list(F.struct(order, "member"))).alias("a"))
    return bits.select(F.array_join(F.transform("a", lambda s: s["member"].cast("string")), " ").alias("line"))


def fm_parameters(hashes: int, seed: int = 0) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(FM_RANGE), draw.randrange(FM_RANGE)) for _ in range(hashes)]


def fm_zeros(values: DataFrame, column: str, hashes: int, seed: int = 0, groups: list[str] | None = None) -> DataFrame:
    """(groups, hash_no, zeros): the most trailing zeros of any value, for each hash function.

    Maxima do not mind repetition, so nothing is made distinct first: a task hashes the different values of a
    batch and keeps one list of maxima for each group, and the lists of all tasks are merged.
    """
    groups = groups or []
    ship(values.sparkSession)
    rows = values.select(*[F.col(g).alias(f"g{k}") for k, g in enumerate(groups)], F.col(column).cast("string").alias("v")).where("v is not null")
    names = rows.columns[:-1]
    a, b = (np.array(x, np.uint64) for x in zip(*fm_parameters(hashes, seed)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def packed() -> pa.RecordBatch:
            keys = [pa.array([g[k] for g in held], schema.field(n).type) for k, n in enumerate(names)]
            batch = pa.RecordBatch.from_arrays([*keys, pa.array([z.tolist() for z in held.values()], pa.list_(pa.int32()))], [*names, "zeros"])
            held.clear()
            return batch

        schema = None
        for batch in batches:
            schema = schema or batch.schema
            once = pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([])
            known = {v: k for k, v in enumerate(dict.fromkeys(once.column("v").to_pylist()))}
            x = np.array([int.from_bytes(v.encode(), "big") % FM_MODULUS for v in known], np.uint64)
            at = np.array([known[v] for v in once.column("v").to_pylist()], np.int64)
            members: dict[tuple, list[int]] = {}
            for row, g in enumerate(zip(*[once.column(n).to_pylist() for n in names]) if names else [()] * len(once)):
                members.setdefault(g, []).append(at[row])
            for g, own in members.items():
                for k in range(0, len(own), FM_AT_ONCE):
                    most = _trailing_zeros(a, b, x[own[k : k + FM_AT_ONCE]])
                    held[g] = np.maximum(held[g], most) if g in held else most
            if len(held) >= FM_GROUPS:
                yield packed()
        if held:
            yield packed()

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    lists = rows.mapInArrow(sketch, f"{kinds}zeros array<int>").select(*[F.col(n).alias(g) for n, g in zip(names, groups)], F.posexplode("zeros").alias("hash_no", "z"))
    return lists.groupBy(*groups, "hash_no").agg(F.max("z").alias("zeros"))


def _trailing_zeros(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The most trailing zeros of (a * x + b) % FM_MODULUS % FM_RANGE over the numbers x, for each (a, b); a zero has one.

    The factors have 34 bits; a is cut at 17 so that no product passes 64.
    """
    p, low = np.uint64(FM_MODULUS), np.uint64(17)
    high, rest = (a % p >> low)[:, None], (a % p & np.uint64((1 << 17) - 1))[:, None]
    h = (((high * x % p) << low) + rest * x + (b % p)[:, None]) % p % np.uint64(FM_RANGE)
    lowest = h & (~h + np.uint64(1))
    zeros = np.where(h == 0, 1, np.bitwise_count(lowest - np.uint64(1)).astype(np.int32))
    return zeros.max(axis=1).astype(np.int32)


def fm_distinct(values: DataFrame, column: str, hashes: int = 1000, group: int = 100, seed: int = 0, groups: list[str] | None = None, clamp: bool = False) -> DataFrame:
    """(groups, estimate): the median of the means of the sorted estimates 2 ** zeros, in runs of `group`.

    clamp=True also needs the true number: an estimate outside 0.5 to 1.5 times it becomes 0.85 times it.
    """
    if not groups:
        return fm_distinct(values.withColumn("_all", F.lit(0)), column, hashes, group, seed, ["_all"], clamp).drop("_all")
    zeros = fm_zeros(values, column, hashes, seed, groups).withColumn("e", F.pow(F.lit(2.0), "zeros"))
    # as many rows as hash functions in each group
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("e", "hash_no")) - 1
    runs = zeros.withColumn("run", F.floor(place / group)).where(F.col("run") < hashes // group)
    means = runs.groupBy(*groups, "run").agg(F.avg("e").alias("mean"))
    out = means.groupBy(*groups).agg(F.percentile("mean", F.lit(0.5)).alias("estimate"))
    if not clamp:
        return out
    truth = values.where(F.col(column).isNotNull()).groupBy(*groups).agg(F.count_distinct(column).alias("truth"))
    out = out.join(truth, groups)
    outside = (F.col("estimate") <= 0.5 * F.col("truth")) | (F.col("estimate") >= 1.5 * F.col("truth"))
    return out.select(*groups, F.when(outside, 0.85 * F.col("truth")).otherwise(F.col("estimate")).alias("estimate"))


def reservoir(rows: DataFrame, ident: list[str], n: int = 100, seed: str = "0") -> DataFrame:
    """n rows of least seeded hash of their `ident`: uniform, whatever the order, and mergeable between parts."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *ident)), *ident).limit(n)


def top_levels(values: DataFrame, column: str, levels: int = 3) -> DataFrame:
    """(value, count) of the `levels` highest different counts, all ties kept."""
    counts = materialize(values.groupBy(column).agg(F.count("*").alias("count")), "value-counts")
    highest = counts.select("count").distinct().orderBy(F.desc("count")).limit(levels)
    return counts.join(F.broadcast(highest), "count", "left_semi").select(column, "count")  # `levels` rows
