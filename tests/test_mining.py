import itertools

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from quarrymill.operators import lsh, ratings as cf, text_profiles as tp
from quarrymill.operators.baskets import baskets, cooccurrence_edges, market_baskets
from quarrymill.operators.ids import dense_ids
from quarrymill.operators.itemsets import candidates, frequent_itemsets, itemset_report
from quarrymill.functions.text import clean_id, clean_tag, letters_only_words
from tests.conftest import rows

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def held(spark, sets):
    return baskets(spark.createDataFrame([(b, i) for b, s in enumerate(sets) for i in s], "b long, i string"), "b", "i")


def test_frequent_itemsets_by_hand(spark):
    sets = ["abc", "ab", "ac", "bc", "abcd"]
    ones, twos = frequent_itemsets(held(spark, sets), 3)
    assert rows(ones) == [("a", 4), ("b", 4), ("c", 4)] and rows(twos) == [("a", "b", 3), ("a", "c", 3), ("b", "c", 3)]
    assert rows(frequent_itemsets(held(spark, sets), 2)[2]) == [("a", "b", "c", 2)]


def test_four_items_are_found(spark):
    assert [len(rows(x)) for x in frequent_itemsets(held(spark, ["abcd"] * 3), 3)] == [4, 6, 4, 1]


@QUICK
@given(st.lists(st.sets(st.sampled_from("abcdef"), min_size=1), min_size=1, max_size=12), st.integers(1, 4))
def test_itemsets_equal_brute_force(spark, sets, support):
    found = {tuple(r[:-1]): r[-1] for level in frequent_itemsets(held(spark, sets), support) for r in rows(level)}
    every = {c: sum(set(c) <= s for s in sets) for k in range(1, 7) for c in itertools.combinations("abcdef", k)}
    assert found == {c: n for c, n in every.items() if n >= support}
    assert all(found[c[:-1]] >= n for c, n in found.items() if len(c) > 1)


def test_fpgrowth_agrees(spark):
    from pyspark.ml.fpm import FPGrowth

    sets = ["abc", "abd", "acd", "bcd", "ab", "abcd", "ce"]
    model = FPGrowth(itemsCol="items", minSupport=3 / len(sets)).fit(spark.createDataFrame([(list(s),) for s in sets], "items array<string>"))
    other = {tuple(sorted(r["items"])): r["freq"] for r in model.freqItemsets.collect()}
    assert {tuple(r[:-1]): r[-1] for level in frequent_itemsets(held(spark, sets), 3) for r in rows(level)} == other


def test_candidates_and_report(spark):
    level = spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("b", "d", 1)], "i1 string, i2 string, support long")
    assert rows(candidates(level, 2)) == [("a", "b", "c")]
    with pytest.raises(ValueError):
        candidates(level, 1)
    report = rows(itemset_report(frequent_itemsets(held(spark, ["abc", "ab"]), 2)))
    assert report == [(1, "('a'),('b')"), (2, "('a', 'b')")]


def test_basket_sizes_cases_and_nulls(spark):
    df = spark.createDataFrame([("u", "x"), ("u", "x"), ("u", "y"), ("v", "x"), (None, "x"), ("v", None)], "u string, b string")
    assert rows(market_baskets(df, "u", "b", 1, larger_than=1)) == [("u", "x"), ("u", "y")]
    assert rows(market_baskets(df, "u", "b", 2)) == [("x", "u"), ("x", "v"), ("y", "u")]
    with pytest.raises(ValueError):
        market_baskets(df, "u", "b", 3)


def test_repeated_visits_make_no_loop(spark):
    df = spark.createDataFrame([("u", "x"), ("u", "x"), ("v", "x")], "u string, b string")
    assert rows(cooccurrence_edges(df, "u", "b", 1)) == [("u", "v")]


def test_text_functions(spark):
    df = spark.createDataFrame([(" \ta\r\n", "## Tag# ", "x-ray 12 A"), ("  ", " # ", ""), (None, None, None)], "i string, t string, w string")
    got = df.select(clean_id("i"), clean_tag("t"), letters_only_words("w")).collect()
    assert [tuple(r) for r in got] == [("a", "tag#", ["x", "ray", "a"]), (None, None, []), (None, None, None)]


def test_dense_ids(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 9, 3, None, 7]], "x long")
    assert rows(dense_ids(df, "x")) == [(3, 0), (5, 1), (7, 2), (9, 3)]


def test_hash_family_collapses_on_four_rows(spark):
    sets = spark.createDataFrame([(i, i) for i in range(4)], "id long, m long")
    assert {r["signature"][0] for r in lsh.minhash(sets, "id", "m", 1).collect()} == {2}


def test_similar_pairs_are_brute_force_pairs_with_an_equal_band(spark):
    import random

    draw = random.Random(3)
    sets = {i: {draw.randrange(25) for _ in range(draw.randrange(1, 9))} for i in range(30)}
    df = spark.createDataFrame([(i, m) for i, s in sets.items() for m in s], "id long, m long")
    found = {(a, b): s for a, b, _, s in rows(lsh.similar_pairs(df, "id", "m", 12, 6, 0.3))}
    cand = {tuple(r) for r in lsh.lsh_candidates(lsh.minhash(df, "id", "m", 12), 12, 6).collect()}
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    assert found == {p: j for p, j in jaccard.items() if j >= 0.3 and p in cand}


def test_profiles_by_hand(spark):
    counts = spark.createDataFrame([("b1", "good", 6), ("b1", "food", 5), ("b2", "good", 5), ("b2", "rare", 4)], "b string, word string, f long")
    best = tp.profiles(counts, "b", 2)
    assert [tuple(r)[:2] for r in best.orderBy("b", best.score.desc()).collect()] == [("b1", "food"), ("b1", "good"), ("b2", "good")]
    seen = spark.createDataFrame([("u", "b1"), ("u", "b1"), (None, "b1")], "u string, b string")
    users = tp.user_profiles(seen, "u", "b", best)
    assert rows(tp.content_predict(spark.createDataFrame([("u", "b2"), ("x", "b2")], "u string, b string"), "u", "b", users, best)) == [("u", "b2", 0.05)]


def test_pearson_by_hand(spark):
    rated = cf.ratings(spark.createDataFrame([(1, "A", 5.0), (1, "B", 4.0), (2, "A", 3.9), (2, "B", 2.0), (3, "A", 1.0), (3, "B", 3.0), (3, "B", 1.0), (None, "B", 1.0), (4, "A", None)], "u long, i string, s double"), "u", "i", "s")
    assert rows(rated)[-1] == (3, "B", 3)
    assert [(a, b, round(s, 9)) for a, b, s in rows(cf.item_similarity(rated))] == [("A", "B", 0.5)]


def test_item_predictions_by_hand(spark):
    rated = spark.createDataFrame([(1, "A", 5), (1, "B", 3), (2, "T", 4), (3, "T", 5)], "user long, item string, stars int")
    model = spark.createDataFrame([("A", "T", 0.5), ("B", "T", 0.25)], "id1 string, id2 string, sim double")
    test = spark.createDataFrame([(1, "T"), (9, "T"), (9, "Z")], "user long, item string")
    assert [(u, i, round(s, 6)) for u, i, s in rows(cf.predict_item(test, rated, model))] == [(1, "T", 4.333333), (9, "T", 4.5)]


def test_user_predictions_by_hand(spark):
    rated = spark.createDataFrame([(1, "A", 4), (2, "T", 5), (2, "A", 3), (3, "T", 1)], "user long, item string, stars int")
    model = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9)], "id1 long, id2 long, sim double")
    test = spark.createDataFrame([(1, "T"), (1, "Z"), (9, "T")], "user long, item string")
    # rater 3 has no other rating; rater 2 lies 2 above the mean of their other rating; 4 + 2 is cut at 5
    assert rows(cf.predict_user(test, rated, model)) == [(1, "T", 5.0), (1, "Z", 4.0)]
