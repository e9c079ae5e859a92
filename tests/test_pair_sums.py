import random

import pytest

from quarrymill.operators import baskets, lsh, pair_sums, ratings as cf
from quarrymill.plans import storage
from tests.conftest import rows


def ratings(spark, seed, star=lambda d: d.randint(1, 5)):
    """70 users, of whom two rated most items and two items were rated by most: beyond and within the 53 bits."""
    draw = random.Random(seed)
    pairs = {(u, i) for u in range(70) for i in draw.sample(range(90), 80 if u < 2 else draw.randint(1, 9))} | {(u, i) for u in range(60) for i in (3, 4)}
    return spark.createDataFrame([(f"u{u}", f"i{i}", star(draw)) for u, i in sorted(pairs)], "user string, item string, stars int")


def near(rows_):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows_]


def tables(before):
    return {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage._written if p not in before}


def both(monkeypatch, query):
    """The result by arrays and by joins, and the kinds of tables that the first one wrote."""
    before = {*storage._written}
    whole = near(rows(query()))
    wrote = tables(before)
    monkeypatch.setattr(pair_sums, "WHOLE_ROWS", 0)
    assert near(rows(query())) == whole and whole
    return wrote


@pytest.mark.parametrize("star", [lambda d: d.randint(1, 5), lambda d: d.randint(-9, 300)], ids=["stars", "any numbers"])
def test_users_without_tables_of_pairs(spark, monkeypatch, star):
    rated = ratings(spark, 1, star)
    assert not both(monkeypatch, lambda: cf.user_similarity(rated)) & {"common-pairs", "candidates", "rated-pairs", "coded-pairs"}


def test_predictions_of_users_without_a_model(spark, monkeypatch):
    rated = ratings(spark, 2)
    test = spark.createDataFrame([(f"u{u}", f"i{i}") for u in range(72) for i in (u % 7, 20 + u % 9, 95)], "user string, item string")
    train = rated.join(test, ["user", "item"], "left_anti")
    assert not both(monkeypatch, lambda: cf.predict_user(test, train)) & {"common-pairs", "candidates", "rated-pairs", "coded-pairs"}


def test_items_without_tables_of_pairs(spark, monkeypatch):
    assert not both(monkeypatch, lambda: cf.item_similarity(ratings(spark, 3))) & {"candidates", "counted-pairs", "rated-pairs", "coded-pairs"}


def test_predictions_of_items_without_a_model(spark, monkeypatch):
    rated = ratings(spark, 4)
    test = spark.createDataFrame([(f"u{u}", f"i{i}") for u in range(72) for i in (u % 7, 20 + u % 9, 95)], "user string, item string")
    train = rated.join(test, ["user", "item"], "left_anti")
    assert not both(monkeypatch, lambda: cf.predict_item(test, train)) & {"candidates", "counted-pairs", "rated-pairs", "coded-pairs"}


def test_edges_without_tables_of_candidates(spark, monkeypatch):
    seen = ratings(spark, 5)
    query = lambda: baskets.cooccurrence_edges(seen, "user", "item", 2)
    assert not both(monkeypatch, query) & {"rare-values", "candidates", "coded-pairs"}


def test_candidates_without_tables_of_buckets(spark, monkeypatch):
    seen = ratings(spark, 6)
    for bands, threshold in ((12, 0.0), (4, 0.5)):
        before = {*storage._written}
        found = lambda: rows(lsh.lsh_candidates(lsh.minhash(seen, "item", "user", 12), 12, bands, threshold))  # noqa: B023, E731
        whole = found()
        assert whole and "lsh-buckets" not in tables(before)
        with monkeypatch.context() as m:
            m.setattr(lsh, "WHOLE_VALUES", 0)
            assert found() == whole


def test_similar_sets_without_tables_of_candidates(spark, monkeypatch):
    seen = ratings(spark, 7)
    query = lambda: lsh.similar_pairs(seen, "item", "user", 12, 12, 0.1)
    assert not both(monkeypatch, query) & {"lsh-buckets", "pairs", "counted-pairs", "coded-pairs"}
