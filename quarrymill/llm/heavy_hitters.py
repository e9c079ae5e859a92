"""The most frequent values of a column in bounded memory: a hierarchical count-sketch and a second scan."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymill.plans.shipping import ship
from quarrymill.plans.skew import attach

#: Lengths of the hash prefixes that have a sketch each; a child of a prefix has 8 more bits.
LEVELS = (8, 16, 24, 32, 40, 48, 56, 64)
#: The widest sketch: 335 MB with 5 rows of counters.
MAX_BITS = 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2127599BF4325C37)


def _mixed(prefix: np.ndarray, row: int) -> np.ndarray:
    """A 64-bit hash of each prefix, another for each row of the sketch."""
    x = (prefix + np.uint64(row + 1)) * np.uint64(_ODD[row % len(_ODD)])
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


class Sketch:
    """For each level, `depth` rows of 2**width_bits signed counters. Its size does not depend on the data."""

    def __init__(self, depth: int = 5, width_bits: int = 15):
        self.depth, self.width_bits = depth, width_bits
        self.cells = np.zeros((len(LEVELS), depth, 1 << width_bits), np.int64)

    def _place(self, prefix: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
        x = _mixed(prefix, row)
        return (x >> np.uint64(64 - self.width_bits)).astype(np.int64), 1 - 2 * (x & np.uint64(1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        values, n = np.unique(hashes, return_counts=True)
        for k, bits in enumerate(LEVELS):
            prefix = values >> np.uint64(64 - bits)
            for row in range(self.depth):
                bucket, sign = self._place(prefix, row)
                self.cells[k, row] += np.bincount(bucket, sign * n, 1 << self.width_bits).astype(np.int64)

    def estimate(self, level: int, prefix: np.ndarray) -> np.ndarray:
        rows = []
        for row in range(self.depth):
            bucket, sign = self._place(prefix, row)
            rows.append(self.cells[level, row][bucket] * sign)
        return np.median(rows, axis=0)

    def heavy(self, at_least: float) -> np.ndarray:
        """Full hashes reached from the root through prefixes whose estimates are at least `at_least`."""
        found = np.zeros(1, np.uint64)
        for level in range(len(LEVELS)):
            found = ((found[:, None] << np.uint64(8)) + np.arange(256, dtype=np.uint64)).ravel()
            found = found[self.estimate(level, found) >= at_least]
        return found


def sketch_bits(share: float, slack: float) -> int:
    """The least width for values with `share` of the rows: three standard errors of a row of counters, sqrt(share / width)
    of all rows once heavier values are found, within slack * share; doubled twice."""
    if not 0 < share <= 1 or not 0 < slack < 1:
        raise ValueError("share must lie in (0, 1], slack in (0, 1)")
    bits = max(10, math.ceil(math.log2(36 / (slack * slack * share))))
    if bits > MAX_BITS:
        raise ValueError(f"a share of {share} needs counters of 2**{bits}; the least share is {36 / (slack * slack * 2**MAX_BITS):.2g}, or give width_bits")
    return bits


def heavy_hitters(rows: DataFrame, value: str, share: float = 0.005, slack: float = 0.5, depth: int = 5, width_bits: int | None = None) -> DataFrame:
    """Values holding at least `share` of all non-null rows: `value`, approx_count, count.

    First scan: every task adds the 64-bit hashes of its values to a count-sketch for each prefix length
    in LEVELS (signed counters in `depth` rows); the sketches, of fixed size, are summed. The driver then
    descends from the root through the prefixes whose estimated count is at least slack * share of all rows,
    so at most about 1 / (slack * share) of them a level. Second scan: exact counts of the candidates only,
    which decide. Memory in any place is 8 * levels * depth * 2**width_bits bytes (10 MB at a share of 0.005),
    however many distinct values there are. The width follows `share`, see sketch_bits; a share too small for
    MAX_BITS raises a ValueError before anything is read.

    A value with at least `share` of the rows is missed only if its estimate falls short by the factor
    `slack` at some level: the median of `depth` rows, each off by about sqrt(F2 of the light values / width).
    Nulls are not counted. Ties all appear. An empty table gives no row. Other columns are not used.
    """
    width_bits = sketch_bits(share, slack) if width_bits is None else width_bits
    values = rows.select(F.col(value).alias("v")).where("v is not null").withColumn("h", F.xxhash64("v"))
    sketch, total = build_sketch(values.select("h"), depth, width_bits)
    if not total:
        return values.select(F.col("v").alias(value), F.lit(0).cast("long").alias("approx_count"), F.lit(0).cast("long").alias("count")).limit(0)
    codes = sketch.heavy(slack * share * total)
    approx = sketch.estimate(len(LEVELS) - 1, codes)
    known = rows.sparkSession.createDataFrame([(int(c), int(a)) for c, a in zip(codes.view(np.int64), approx)], "h long, approx_count long")
    # about 1 / (slack * share) rows; attach measures them before it broadcasts
    counted = attach(values, known, ["h"], "inner", ["v"]).groupBy("v", "approx_count").agg(F.count("*").alias("count"))
    return counted.where(F.col("count") >= F.lit(share) * F.lit(total)).select(F.col("v").alias(value), "approx_count", "count")


def build_sketch(hashes: DataFrame, depth: int, width_bits: int) -> tuple[Sketch, int]:
    """The sum of the tasks' sketches, and the number of rows. Sums travel as one packed row of counters each."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = Sketch(depth, width_bits), 0
        for b in batches:
            sketch.add(np.asarray(b.column(0)).view(np.uint64))
            n += len(b)
        if n:
            yield from _packed(sketch.cells, n)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n = 0
        for b in batches:
            for part, data, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                cells = np.frombuffer(zlib.decompress(data), np.int64)
                total[part] = total[part] + cells if part in total else cells
                n += rows
        if total:
            yield _rows([(p, zlib.compress(c.tobytes(), 1), n * (i == 0)) for i, (p, c) in enumerate(total.items())])

    ship(hashes.sparkSession)
    schema = "part int, cells binary, n long"
    parts = len(LEVELS) * depth
    # one row of counters per part: a task adds up whatever number of them, holding at most the whole sketch
    once = hashes.mapInArrow(local, schema)
    merged = once.repartition(len(LEVELS), "part").mapInArrow(summed, schema)
    sketch, n = Sketch(depth, width_bits), 0
    flat = sketch.cells.reshape(parts, -1)
    for r in merged.toLocalIterator(prefetchPartitions=True):  # `parts` rows of fixed size
        flat[r["part"]] += np.frombuffer(zlib.decompress(r["cells"]), np.int64)
        n += r["n"]
    return sketch, n


def _packed(cells: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    for part, row in enumerate(cells.reshape(-1, cells.shape[-1])):
        yield _rows([(part, zlib.compress(row.tobytes(), 1), n * (part == 0))])


def _rows(rows: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
    part, data, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary()), pa.array(n, pa.int64())], ["part", "cells", "n"])
