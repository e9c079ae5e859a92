import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarrymill.operators import clustering as cl, sketches as sk
from tests.conftest import rows


def test_mahalanobis_by_hand():
    s = cl.Summaries([4], [[4, 8]], [[8, 20]])
    assert s.centroid.tolist() == [[1, 2]] and s.mahalanobis(np.array([[2.0, 4.0]]))[0, 0] == 5


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=40), st.integers(1, 5))
def test_lloyd_puts_each_point_to_its_nearest_mean(points, k):
    x = np.array(points, float)
    label = cl.lloyd(x, np.arange(len(x)), k)
    assert label.max() < k and len(label) == len(x)


def blobs(spark, n=300, rounds=3):
    draw = np.random.default_rng(4)
    centers = np.array([[0, 0], [30, 0], [0, 30]])
    data = [(i, [float(v) for v in centers[i % 3] + draw.normal(0, 1, 2)], i // 3 % rounds) for i in range(n)]  # every round has points of every blob
    data += [(n + 1, [500.0, 500.0], 1), (n + 2, [500.5, 500.0], 1), (n + 3, [-900.0, 40.0], 2)]
    return spark.createDataFrame(data, "id long, features array<double>, round int")


def test_bfr_conserves_points_and_finds_blobs(spark):
    points = blobs(spark)
    fit = cl.Bfr(3).fit(points)
    seen = 0
    for r in sorted(fit.rounds().collect()):
        seen = r.nof_point_discard + r.nof_point_compression + r.nof_point_retained
        assert seen == points.where(F.col("round") < r.round_id).count()
    label = dict(rows(fit.labels()))
    assert len(label) == 303 and fit.labels().count() == 303
    assert all(len({label[i] for i in range(k, 300, 3)}) == 1 for k in range(3)) and len({label[k] for k in range(3)}) == 3


def test_reclustering_in_memory_and_by_spark_is_the_same(spark, monkeypatch):
    from quarrymill.plans import storage

    before = len(storage._written)
    here = cl.Bfr(3).fit(blobs(spark))
    monkeypatch.setattr(cl, "DRIVER_POINTS", 0)
    there = cl.Bfr(3).fit(blobs(spark))
    assert rows(here.rounds()) == rows(there.rounds()) and rows(here.labels()) == rows(there.labels())
    assert len(storage._written) - before <= 12  # kept and retained tables of two fits; those of rounds and k-means are gone


def test_distributed_kmeans_and_summaries(spark):
    label = dict(rows(cl.kmeans(blobs(spark).where("id < 300"), 3, seed=2)))
    assert len(label) == 300 and len(set(label.values())) == 3
    one = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [3.0, 4.0], "x")], "id long, features array<double>, g string")
    assert rows(cl.summarize(one, "g")) == [("x", 0, 2, 4.0, 10.0), ("x", 1, 2, 6.0, 20.0)]


def test_bloom_positions_by_hand(spark):
    df = spark.createDataFrame([("Las Vegas",), ("Zürich",), ("A",), ("",), (None,)], "c string")
    x = df.where("c != ''").select("c", sk.text_number("c", sk.BLOOM_MODULUS).alias("x"))
    a, b = sk.BLOOM_HASHES[0]
    assert {c: (a * x + b) % sk.BLOOM_MODULUS % sk.BLOOM_POSITIONS for c, x in rows(x)} == {"Las Vegas": 7289, "Zürich": 6238, "A": 2570}


def test_sketches_shuffle_no_values(spark):
    df = spark.createDataFrame([("a", "g")], "c string, g string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(sk.bloom_probe(df, "c", sk.bloom_build(df, "c")))
    assert plan(sk.fm_zeros(df, "c", 4)).count("Aggregate") == 1 and "Join" not in plan(sk.fm_zeros(df, "c", 4))


def test_fm_groups_with_a_null_key_and_far_numbers(spark):
    data = [("x", "a"), ("x", "b"), (None, "a"), ("y", "\U0001f600" * 30), ("y", None)]
    df = spark.createDataFrame(data, "hash_no string, v string").withColumnRenamed("hash_no", "g")
    got = {(g, k): z for g, k, z in sk.fm_zeros(df, "v", 5, 1, ["g"]).collect()}
    for g in ("x", None, "y"):
        for k, (a, b) in enumerate(sk.fm_parameters(5, 1)):
            h = [(a * int.from_bytes(v.encode(), "big") + b) % sk.FM_MODULUS % sk.FM_RANGE for w, v in data if w == g and v]
            assert got[g, k] == max(1 if x == 0 else (x & -x).bit_length() - 1 for x in h)
    assert rows(sk.fm_distinct(df.limit(0), "v", 8, 2)) == []


def test_bloom_has_no_false_negative(spark):
    build = spark.createDataFrame([(f"city {k} é",) for k in range(40)], "c string")
    probe = spark.createDataFrame([(k, f"city {k} é") for k in range(60)] + [(98, ""), (99, None)], "i long, c string")
    got = {r["i"]: r["member"] for r in sk.bloom_probe(probe, "c", sk.bloom_build(build, "c")).collect()}
    assert all(got[k] for k in range(40)) and got[98] == got[99] == 0 and sum(got[k] for k in range(40, 60)) < 5
    line = sk.bloom_report(sk.bloom_probe(probe.where("i in (1, 98)"), "c", sk.bloom_build(build, "c")), "i").first()[0]
    assert line == "1 0"


def test_fm_equals_python_integers(spark):
    values = [f"user {k}" for k in range(50)] + ["é" * 20]
    df = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "v string")
    zeros = []
    for a, b in sk.fm_parameters(8, 3):
        hashes = [(a * int.from_bytes(v.encode(), "big") + b) % sk.FM_MODULUS % sk.FM_RANGE for v in values]
        zeros.append(max(1 if h == 0 else (h & -h).bit_length() - 1 for h in hashes))
    assert [z for _, z in rows(sk.fm_zeros(df, "v", 8, 3))] == zeros
    e = sorted(2.0**z for z in zeros)
    means = [sum(e[i : i + 2]) / 2 for i in range(0, 8, 2)]
    assert sk.fm_distinct(df, "v", 8, 2, 3).first()[0] == np.median(means)
    assert sk.fm_distinct(df.where("v = 'user 1'"), "v", 8, 2, 3, clamp=True).first()[0] in (0.85, 1.0)


def test_union_of_parts_is_the_maximum(spark):
    df = spark.createDataFrame([(f"{k}",) for k in range(60)], "v string")
    half = [dict(rows(sk.fm_zeros(df.where(c), "v", 6))) for c in ("v < '3'", "v >= '3'")]
    assert dict(rows(sk.fm_zeros(df, "v", 6))) == {k: max(h[k] for h in half) for k in range(6)}


def test_reservoir_merges_and_is_fair(spark):
    df = spark.createDataFrame([(k,) for k in range(200)], "id long")
    whole = rows(sk.reservoir(df, ["id"], 20, "s"))
    parts = [sk.reservoir(df.where(f"id % 3 = {k}"), ["id"], 20, "s") for k in range(3)]
    assert whole == rows(sk.reservoir(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["id"], 20, "s"))
    assert len(rows(sk.reservoir(df.limit(5), ["id"], 20))) == 5


def test_top_levels_keep_ties(spark):
    df = spark.createDataFrame([(c,) for c in "aaaaabbbbbcccdde"], "t string")
    assert rows(sk.top_levels(df, "t")) == [("a", 5), ("b", 5), ("c", 3), ("d", 2)]


def test_trailing_zeros_of_small_numbers(spark):
    random.seed(0)
    df = spark.createDataFrame([(h,) for h in (0, 1, 8, 12)], "h long")
    assert [r[0] for r in df.select(F.expr("if(h = 0, 1, bit_count((h & -h) - 1))")).collect()] == [1, 0, 3, 2]
