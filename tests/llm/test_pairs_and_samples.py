import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarrymill.llm import catalog, cooccurrence as co, heavy_hitters as hh, sampling as sa, set_join as sj
from tests.conftest import rows


def skewed(seed, n, items=40, baskets=60):
    draw = random.Random(seed)
    data = [(f"u{draw.randrange(baskets)}", f"i{int(draw.expovariate(0.12)) % items}", draw.random()) for _ in range(n)]
    data += [("big", f"i{k}", 0.0) for k in range(items)] * 2
    return data + [(None, "i1", 0.0), ("u1", None, 0.0), ("u1", "", 0.0)]


def brute_pairs(data, min_both, min_lift):
    sets = {}
    for u, i, _ in data:
        if u is not None and i is not None:
            sets.setdefault(u, set()).add(i)
    n = Counter(i for s in sets.values() for i in s)
    both = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    return sorted((a, b, n[a], n[b], c, len(sets)) for (a, b), c in both.items() if c >= min_both and c * len(sets) >= min_lift * n[a] * n[b])


@pytest.mark.parametrize("block, dense", [(1024, 768), (5, 0), (5, 768)])
def test_pair_counts_equal_brute_force(spark, monkeypatch, block, dense):
    monkeypatch.setattr(co, "DENSE_ITEMS", dense)
    data = skewed(1, 500)
    df = spark.createDataFrame(data, "n string, code string, block double")  # names used inside
    got = co.cooccurrence(df, "n", "code", min_both=2, min_lift=1, block_items=block)
    assert [r[:6] for r in rows(got)] == brute_pairs(data, 2, 1)
    assert all(abs(r[6] - r[4] * r[5] / (r[2] * r[3])) < 1e-12 for r in rows(got))


def test_sparse_product_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(co, "DENSE_ITEMS", 0)
    monkeypatch.setattr(co, "PAIRS_AT_ONCE", 3)
    lists = [[5, 9, 2], [9, 2], [], [7], [2, 5, 9, 7]]
    total = Counter()
    for a, b, n in co._within(pa.array(lists, pa.list_(pa.int64()))):
        total.update({(min(x, y), max(x, y)): int(c) for x, y, c in zip(a, b, n)} if len(a) == len({*zip(a, b)}) else {})
    assert total == Counter(p for s in lists for p in itertools.combinations(sorted(s), 2))


def test_no_pairs_in_an_empty_table(spark):
    assert rows(co.cooccurrence(spark.createDataFrame([], "u string, i string"), "u", "i")) == []


def test_every_pair_with_a_common_user_comes_out(spark, tmp_path):
    data = [("u1", "a"), ("u1", "b"), (" u2", "b"), ("u2", "c\t"), ("u2", "b"), ("user_id", "business_id"), (None, "a"), ("u3", " ")]
    spark.createDataFrame(data, "user_id string, business_id string").write.parquet(f"{tmp_path}/preprocess.parquet")
    assert rows(catalog.p1_pairs(spark, str(tmp_path))) == [("a", "b", 1, 1.0), ("b", "c", 1, 1.0)]
    assert rows(catalog.p1_found(spark, str(tmp_path))) == []


PIECES = "piece int, id long, _row string, _piece string"


def pieces(n):
    return [(None if k % 11 == 0 else min(3, k % 5), k, "x", "y") for k in range(n)]


def test_sample_is_exact_and_repeats(spark):
    df = spark.createDataFrame(pieces(400), PIECES)
    got = rows(sa.fixed_size_sample(df, "piece", ["id"], 37, seed=4, leaf_rows=30).select("id"))
    assert len(set(got)) == 37 and got == rows(sa.fixed_size_sample(df.repartition(7), "piece", ["id"], 37, seed=4, leaf_rows=30).select("id"))
    assert sa.fixed_size_sample(df, "piece", ["id"], 37, seed=4).columns == df.columns
    assert sa.fixed_size_sample(df.limit(20), "piece", ["id"], 37).count() == 20
    assert rows(sa.fixed_size_sample(df.limit(0), "piece", ["id"], 5)) == [] == rows(sa.fixed_size_sample(df, "piece", ["id"], 0))
    twice = spark.createDataFrame([(1, 1)] * 5, "piece int, id long")
    assert len(rows(sa.fixed_size_sample(twice, "piece", ["id"], 3))) == 3


def test_sampling_probabilities_are_equal():
    """The tree and the skips alone, many times: every place equally often, quotas hypergeometric."""
    sizes, hits, runs = [3, 1, 9, 27], Counter(), 4000
    for seed in range(runs):
        rng = np.random.default_rng(seed)
        for piece, (n, q) in enumerate(zip(sizes, sa.split(8, sizes, rng))):
            hits.update((piece, at) for at in sa.positions(n, q, rng))
    want = runs * 8 / 40
    assert sum(hits.values()) == runs * 8 and len(hits) == 40
    assert sum((c - want) ** 2 / want for c in hits.values()) < 85  # 39 degrees of freedom


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 300), st.integers(0, 99))
def test_positions_are_distinct_and_ascending(n, q, seed):
    got = list(sa.positions(n, min(n, q), np.random.default_rng(seed)))
    assert got == sorted(set(got)) and len(got) == min(n, q) and all(0 <= p < n for p in got)


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(1)
    draws = [sa.hypergeometric(3 * 10**9, 10**9, 20, rng) for _ in range(400)]
    assert abs(np.mean(draws) - 15) < 0.4 and sa.hypergeometric(5, 0, 3, rng) == 3 and sa.hypergeometric(0, 5, 3, rng) == 0


def test_hypergeometric_in_portions_keeps_the_variance():
    rng = np.random.default_rng(2)
    draws = np.array([sa.hypergeometric(2 * 10**9, 2 * 10**9, 100, rng, at_once=7) for _ in range(3000)])
    assert abs(draws.mean() - 50) < 0.5 and abs(draws.var() - 25) < 2.5
    assert sum(sa.split(10**6, [10**9] * 5, rng)) == 10**6 and sa.split(9, [2, 3], rng) == [2, 3]


def test_a_sample_larger_than_a_leaf(spark):
    df = spark.createDataFrame(pieces(600), PIECES)
    got = rows(sa.fixed_size_sample(df, "piece", ["id"], 450, seed=4, leaf_rows=40).select("id"))
    assert len(set(got)) == 450


def brute_similar(data, threshold, min_items):
    sets = {}
    for r, i, *_ in data:
        if r is not None and i is not None:
            sets.setdefault(r, set()).add(i)
    sets = {r: s for r, s in sets.items() if len(s) >= min_items}
    out = []
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both / len(sets[a] | sets[b]) >= threshold:
            out.append((a, b, len(sets[a]), len(sets[b]), both))
    return out


def clustered(seed, n=90):
    draw = random.Random(seed)
    data = []
    for k in range(n):
        base = [f"g{k % 6}-{j}" for j in range(12)]
        s = [x for x in base if draw.random() < 0.85] + [f"r{draw.randrange(200)}" for _ in range(draw.randrange(4))]
        data += [(f"r{k}", x, "e") for x in (base if k % 9 == 0 else s)] + [(f"r{k}", "everyone", "e")] * 2
    data += [("wide", f"g{a}-{j}", "e") for a in range(6) for j in range(12)] + [("wide2", f"g{a}-{j}", "e") for a in range(6) for j in range(11)]
    return data + [(None, "x", "e"), ("r1", None, "e"), ("tiny", "x", "e")]


@pytest.mark.parametrize("threshold, max_array, share", [(0.5, 4096, 16), (0.5, 10, 4), (0.8, 4096, 2), (0.3, 4096, 3)])
def test_similar_sets_equal_brute_force(spark, threshold, max_array, share):
    data = clustered(2)
    df = spark.createDataFrame(data, "item string, rec string, tok string")  # names used inside, crossed
    got = sj.similar_sets(df, "item", "rec", threshold, 2, share, max_array)
    assert [r[:5] for r in rows(got)] == brute_similar(data, threshold, 2)


def test_similar_classes_name_copies_once(spark):
    data = [(f"c{k}", x) for k in range(30) for x in "abcd"] + [("z", x) for x in "abcde"]
    pairs, classes = sj.similar_classes(spark.createDataFrame(data, "r string, i string"), "r", "i")
    assert rows(pairs) == [("c0", "z", 4, 5, 4)] and {c for c, *_ in rows(classes.select("cls"))} == {"c0"} and classes.count() == 30
    none = spark.createDataFrame([], "r string, i string")
    assert rows(sj.similar_sets(none, "r", "i")) == []


def test_heavy_hitters_equal_counting(spark):
    draw = random.Random(7)
    data = [(f"t{int(draw.paretovariate(0.8))}",) for _ in range(4000)] + [("ünï",)] * 60 + [("tie1",)] * 30 + [("tie2",)] * 30 + [(None,)] * 500 + [("",)] * 45
    counts = Counter(v for (v,) in data if v is not None)
    bound = 0.005 * sum(counts.values())
    df = spark.createDataFrame(data, "h string").repartition(5)
    got = hh.heavy_hitters(df, "h", share=0.005, width_bits=12).collect()
    assert sorted((r[0], r[2]) for r in got) == sorted((v, n) for v, n in counts.items() if n >= bound)
    assert all(abs(r[1] - r[2]) < bound / 2 for r in got)
    assert rows(hh.heavy_hitters(df.limit(0), "h")) == []


def test_sketch_finds_what_a_third_of_rows_hides():
    rng = np.random.default_rng(3)
    light = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    heavy = np.repeat(rng.integers(0, 2**63, 20, dtype=np.uint64), 2000)
    third = np.full(120_000, 12345, np.uint64)
    sketch = hh.Sketch(5, 12)
    for part in (light, heavy, third):
        sketch.add(part)
    found = set(sketch.heavy(0.5 * 0.005 * (len(light) + len(heavy) + len(third))).tolist())
    assert set(heavy.tolist()) | {12345} <= found and len(found) < 400


def test_the_sketch_is_as_wide_as_the_share_needs(spark):
    assert hh.sketch_bits(0.005, 0.5) == 15 and hh.sketch_bits(0.001, 0.5) == 18
    df = spark.createDataFrame([("a",)], "v string")
    for share in (1e-6, 0, 2):
        with pytest.raises(ValueError):
            hh.heavy_hitters(df, "v", share=share)
    assert rows(hh.heavy_hitters(df, "v", share=1.0)) == [("a", 1, 1)]
