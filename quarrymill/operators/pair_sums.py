"""Sums over the values that two ids have in common, for all pairs of ids at once, by tasks that hold the table in arrays.

Nothing is shuffled and no candidate is written: the values of very many ids are multiplied as a matrix, the
others are added from their lists of ids, and a pair that passes leaves the task that found it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymill.operators.common import coding
from quarrymill.plans.shipping import ship
from quarrymill.plans.storage import materialize

#: A table of up to so many rows, with names of up to so many bytes, travels whole to every task.
WHOLE_ROWS, NAME_BYTES = 8_000_000, 128 << 20
#: Cells of the matrix of one step; bytes of the matrix of hot values; these have more than an id in so many.
CELLS, HOT_BYTES, HOT_SHARE = 4_000_000, 192 << 20, 20
FIELDS = ("sx", "sy", "sxx", "syy", "sxy", "n")


class Names:
    """The different values of a column, numbered in ascending order."""

    def __init__(self, rows: DataFrame, column: str):
        different = materialize(rows.select(F.col(column).alias("name")).distinct(), "names")
        self.code = coding(different, "name")
        got = different.select(self.code("name").alias("code"), "name").toArrow()
        self.names = got["name"].combine_chunks()
        order = pc.sort_indices(self.names).to_numpy()
        self.names, codes = self.names.take(pa.array(order)), got["code"].to_numpy()[order]
        self._order = np.argsort(codes)
        self._codes = codes[self._order]

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of codes, -1 of unknown ones."""
        if not len(self._codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self._codes, codes), len(self._codes) - 1)
        return np.where(self._codes[at] == codes, self._order[at], -1)


def fits_whole(rows: DataFrame, *columns: str) -> bool:
    """Whether a table of these columns travels whole; names are counted once for each row, so never too low."""
    n = rows.count()
    if n > WHOLE_ROWS:
        return False
    different = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("name")).distinct()
    return (different.agg(F.sum(F.octet_length("name"))).first()[0] or 0) <= NAME_BYTES


class Held:
    """(id, value, x) by id and by value; x are whole numbers, or None for sets. Rows with nulls are left out, of repeated ones the highest x counts."""

    def __init__(self, rows: DataFrame, ident: str, value: str, x: str | None = None):
        rows = rows.select(F.col(ident).alias("id"), F.col(value).alias("value"), (F.lit(0) if x is None else F.col(x)).cast("long").alias("x")).dropna()
        self.ids, self.values = Names(rows, "id"), Names(rows, "value")
        got = rows.select(self.ids.code("id").alias("i"), self.values.code("value").alias("v"), "x").toArrow()
        i, v, xs = self.ids.numbers(got["i"].to_numpy()), self.values.numbers(got["v"].to_numpy()), got["x"].to_numpy()
        order = np.lexsort((-xs, v, i))
        i, v, xs = i[order], v[order], xs[order]
        once = np.ones(len(i), bool)
        once[1:] = (i[1:] != i[:-1]) | (v[1:] != v[:-1])
        i, v, xs = i[once].astype(np.int32), v[once].astype(np.int32), xs[once]
        self.with_x = x is not None
        self.xs = xs.astype(np.int8) if np.abs(xs).max(initial=0) < 100 else xs
        self.v = v
        self.by_id = np.searchsorted(i, np.arange(len(self.ids.names) + 1))
        order = np.argsort(v, kind="stable")
        self.i, self.ys = i[order], self.xs[order]
        self.by_value = np.searchsorted(v[order], np.arange(len(self.values.names) + 1))

    def arrays(self) -> dict:
        return {"names": self.ids.names, "with_x": self.with_x, **{k: getattr(self, k) for k in ("v", "xs", "by_id", "i", "ys", "by_value")}}


class Sums:
    """What a task makes of the arrays of a table.

    Of two ids one of which has at most `cap` values, all sums lie in the 53 bits of one number; pairs of larger
    ids are added up one by one. Without x only the numbers of common values are counted.
    """

    def __init__(self, a: dict):
        self.__dict__ |= a
        self.size = np.diff(self.by_id)
        total, most = len(self.size), int(self.xs.max(initial=0))
        if self.with_x:
            wide = lambda cap: [(cap * m).bit_length() for m in (most, most, most**2, most**2, most**2, 1)]
            self.cap = next((c for c in range(1000, 0, -1) if sum(wide(c)) <= 53), 0) if self.xs.min(initial=0) >= 0 else 0
            self.bits, kind = wide(self.cap), np.float64
        else:
            self.cap, self.bits, kind = 1 << 24, [0, 0, 0, 0, 0, 24], np.float32
        self.shift = np.cumsum([0, *self.bits[:-1]])
        spread = np.diff(self.by_value)
        columns = min(32, HOT_BYTES // max(1, total * (24 if self.with_x else 4)))
        hot = np.argsort(-spread, kind="stable")[:columns]
        hot = hot[spread[hot] * HOT_SHARE > total]
        cold = np.ones(len(spread), bool)
        cold[hot] = False
        self.cold = cold[self.v]
        held, x = np.zeros((len(hot), total), kind), np.zeros((len(hot), total), kind)
        for k, v in enumerate(hot):
            at = slice(self.by_value[v], self.by_value[v + 1])
            held[k, self.i[at]], x[k, self.i[at]] = 1, self.ys[at]
        if self.with_x:
            u = [float(1 << int(s)) for s in self.shift]
            self.left = np.concatenate([held, x, x * x]).T.copy()
            self.right = np.concatenate([held * u[5] + x * u[1] + x * x * u[3], held * u[0] + x * u[4], held * u[2]])
        else:
            self.left, self.right = held.T.copy(), held
        self.large = np.flatnonzero(self.size > self.cap)
        if len(self.large):
            into = np.full(total, -1)
            into[self.large] = np.arange(len(self.large))
            of_large = into[self.i] >= 0
            self.large_i, self.large_ys = into[self.i[of_large]], self.ys[of_large].astype(np.int64)
            self.large_by_value = np.concatenate([[0], np.cumsum(of_large)])[self.by_value]

    def pairs(self, left: np.ndarray, least: int, after: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(place in left, j, *FIELDS) of ascending ids `left` and all others, or those after them, with `least` common values at least; of sets only the number."""
        lo, total = int(left[0]) + 1 if after else 0, len(self.size)
        if lo < total:
            cells = self.left[left] @ self.right[:, lo:]
            width, flat = cells.shape[1], cells.ravel()
            mine, at = _spans(self.by_id, left)
            mine, at = mine[self.cold[at]], at[self.cold[at]]
            which, to = _spans(self.by_value, self.v[at])
            j = self.i[to]
            if lo:
                which, to, j = which[j >= lo], to[j >= lo], j[j >= lo]
            place = mine[which] * width + (j - lo)
            if self.with_x:
                x, y, s = self.xs[at][which].astype(np.int64), self.ys[to].astype(np.int64), self.shift
                np.add.at(flat, place, ((1 << s[5]) + (x << s[0]) + (y << s[1]) + (x * x << s[2]) + (y * y << s[3]) + (x * y << s[4])).astype(np.float64))
            else:
                np.add.at(flat, place, np.float32(1))
            big = np.flatnonzero(self.size[left] > self.cap)
            if len(big):
                beyond = self.large[self.large >= lo] - lo
                cells[np.ix_(big, beyond)] = 0
            found = np.flatnonzero(flat >= least * float(1 << int(self.shift[5])))
            r, j = found // width, found % width + lo
            keep = j > left[r] if after else j != left[r]
            r, j, got = r[keep], j[keep], flat[found[keep]].astype(np.int64)
            yield r, j, *((got >> s & (1 << b) - 1) for s, b in zip(self.shift, self.bits) if b or self.with_x)
        for r in np.flatnonzero(self.size[left] > self.cap):
            at = np.arange(self.by_id[left[r]], self.by_id[left[r] + 1])
            which, to = _spans(self.large_by_value, self.v[at])
            j, x, y = self.large_i[to], self.xs[at][which].astype(np.int64), self.large_ys[to]
            n = np.bincount(j, minlength=len(self.large))
            ok = (n >= least) & (self.large > left[r] if after else self.large != left[r])
            sums = [np.rint(np.bincount(j, w, len(self.large))[ok]).astype(np.int64) for w in (x, y, x * x, y * y, x * y)]
            yield np.full(ok.sum(), r), self.large[ok], *(sums if self.with_x else []), n[ok]


def _spans(starts: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the picked spans one after another, and which span each belongs to."""
    n = starts[pick + 1] - starts[pick]
    return np.repeat(np.arange(len(pick)), n), np.repeat(starts[pick] - np.cumsum(n) + n, n) + np.arange(n.sum())


def run_blocks(spark: SparkSession, shared: dict, rows: np.ndarray, total: int, work: Callable[[dict], Callable[[np.ndarray], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """work(shared) makes a function of a block of the ascending `rows`; the blocks are dealt to the tasks, so that each has early and late ones."""
    ship(spark)
    step = max(1, min(128, CELLS // max(1, total)))
    blocks = -(-len(rows) // step)
    sent = spark.sparkContext.broadcast({"shared": shared, "rows": rows, "deal": np.random.default_rng(0).permutation(blocks)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do, here = None, sent.value
        for b in batches:
            for k in b.column(0).to_pylist():
                do = do or work(here["shared"])
                at = int(here["deal"][k]) * step
                yield from do(here["rows"][at : at + step])

    parts = max(1, min(blocks, 6 * spark.sparkContext.defaultParallelism))
    return spark.range(0, blocks, 1, parts).mapInArrow(run, schema)


def same_band(signatures: np.ndarray, width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the signatures of ids (a row for each hash) agree on all values of some band of `width` hashes."""
    out, open_ = np.zeros(len(a), bool), np.arange(len(a))
    for k in range(len(signatures) // width):
        if not len(open_):
            break
        one, two, same = a[open_], b[open_], True
        for row in signatures[k * width : k * width + width]:
            same = same & (row[one] == row[two])
        out[open_[same]] = True
        open_ = open_[~same]
    return out


def signatures(h: Held, hashes: int, modulus: int) -> np.ndarray:
    """The MinHash signatures of lsh.minhash, a row for each hash."""
    n = max(1, len(h.values.names))
    x = np.arange(n, dtype=np.int64)
    g = (3 * x + 2) % n + (5 * x + 3) % n
    small = np.uint16 if min(n, modulus) < 1 << 16 else np.int64
    out = [np.minimum.reduceat(((i * g + i * i) % modulus % n).astype(small)[h.v], h.by_id[:-1]) for i in range(1, hashes + 1) if len(h.v)]
    return np.array(out, small).reshape(hashes, -1)


def slices(names: pa.Array, a: np.ndarray, b: np.ndarray, columns: list[str], *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of ids with their names and other columns, in batches of bounded size."""
    for at in range(0, len(a), 1 << 18):
        cut = slice(at, at + (1 << 18))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(a[cut])), names.take(pa.array(b[cut])), *(pa.array(m[cut]) for m in more)], columns)


def common_whole(rows: DataFrame, ident: str, value: str, least: int) -> DataFrame:
    """(id1 < id2, n_both) of the pairs with `least` values in common, of a table that travels whole."""
    h = Held(rows, ident, value)

    def work(shared: dict) -> Callable[[np.ndarray], Iterator[pa.RecordBatch]]:
        sums, names = Sums(shared), shared["names"]

        def block(left: np.ndarray) -> Iterator[pa.RecordBatch]:
            for r, j, n in sums.pairs(left, least, True):
                yield from slices(names, left[r], j, ["id1", "id2", "n_both"], n.astype(np.int64))

        return block

    kind, total = rows.schema[ident].dataType.simpleString(), len(h.ids.names)
    return run_blocks(rows.sparkSession, h.arrays(), np.arange(total), total, work, f"id1 {kind}, id2 {kind}, n_both long")
