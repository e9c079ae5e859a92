import random

import pytest

from quarrymill.operators.keyed_quantile import keyed_median
from tests.conftest import rows

SCHEMA = "k string, at long, id long, n long"


def brute(data, min_rows):
    low, by, out = -(2**63), {}, []
    for k, at, i, *_ in data:
        if k is not None:
            by.setdefault(k, []).append((low if at is None else at, low if i is None else i))
    for k, v in by.items():
        if len(v) >= min_rows:
            at, i = sorted(v)[(len(v) + 1) // 2 - 1]
            out.append((k, None if i == low else i, None if at == low else at, len(v)))
    return out


def check(spark, data, min_rows=1, **how):
    found = keyed_median(spark.createDataFrame(data, SCHEMA), ["k"], "at", "id", min_rows, **how).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(brute(data, min_rows), key=key)


@pytest.mark.parametrize("hot_rows", [3, 50, 10**6])
def test_equals_sorting_at_any_bound(spark, hot_rows):
    draw = random.Random(1)
    data = [(f"k{min(9, int(draw.expovariate(0.7)))}", draw.randrange(-(10**15), 10**15), i, 0) for i in range(900)]
    check(spark, data, 3, hot_rows=hot_rows, bin_bits=3)


def test_ties_nulls_repeats_and_far_values(spark):
    draw = random.Random(2)
    data = [("a", draw.choice([None, 5, 5, 6]), draw.choice([1, 2, None, -(2**62), 2**62]), 7) for _ in range(200)]
    data += [("b", 1, 1, 7)] * 150 + [(None, 1, 1, 7)] * 20 + [("c", 2**62, 1, 7), ("c", -(2**62), 2, 7)] * 30
    check(spark, data, hot_rows=10, bin_bits=2)


def test_small_keys_and_empty_tables(spark):
    check(spark, [("a", 1, 1, 0), ("a", 2, 2, 0), ("b", 1, 3, 0)], min_rows=3)
    check(spark, [], hot_rows=1)


def test_clashing_column_names(spark):
    df = spark.createDataFrame([("x", 1, 2, 3), ("x", 4, 5, 6), ("x", 7, 8, 9)], "n string, _v long, k long, lo long")
    assert rows(keyed_median(df, ["n"], "_v", "k", hot_rows=1, bin_bits=1)) == [("x", 5, 4, 3)]


def test_every_key_is_found_by_histograms(spark):
    draw = random.Random(5)
    data = [(f"k{min(9, int(draw.expovariate(0.7)))}", draw.randrange(-(10**15), 10**15), i, 0) for i in range(900)]
    rounds = []
    check(spark, data, 3, bin_bits=1, rounds=rounds)
    assert len(rounds) >= 3 and rounds[0] >= 4 and rounds[-1] == 0  # nothing is sorted: the hot keys take several rounds
    rounds = []
    check(spark, [("a", 5, i, 0) for i in range(500)], bin_bits=1, rounds=rounds)  # one value: the rounds go over the ids
    assert len(rounds) > 3


def test_found_rows_take_rounds_at_a_small_scale(spark):
    from quarrymill.plans import catalog_p6

    rounds = []
    assert catalog_p6.p6_found(spark, "/root/testdata/sf0.01", rounds=rounds).count() > 1000 and len(rounds) >= 2
