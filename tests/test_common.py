import itertools
import random
from types import SimpleNamespace

import pytest

from quarrymill.operators import ratings as cf
from quarrymill.operators.common import Common, common_pairs
from quarrymill.operators.itemsets import frequent_itemsets, itemset_lines, itemset_report
from quarrymill.plans import skew, storage
from tests.conftest import rows


def table(spark, sets):
    data = [(i, v, "x") for i, s in sets.items() for v in s] + [(None, "v1", "x"), (1, None, "x")] + [(0, v, "x") for v in sets[0]]
    return spark.createDataFrame(data, "code long, n string, id string")  # names that the operator uses itself


def random_sets(seed, n=40):
    draw = random.Random(seed)
    # one value in nearly every set, some sets much larger
    return {i: {f"v{draw.randrange(30)}" for _ in range(draw.choice([1, 3, 6, 20]))} | ({"hot"} if i % 7 else set()) for i in range(n)}


@pytest.mark.parametrize("least", [1, 2, 4])
@pytest.mark.parametrize("max_array", [6, 50_000])
def test_common_pairs_equal_brute_force(spark, least, max_array):
    sets = random_sets(least)
    true = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2)}
    index = Common(table(spark, sets), "code", "n", least, max_array)
    assert {(a, b): m for a, b, m in rows(index.pairs())} == {p: m for p, m in true.items() if m >= least}
    if least == 1:
        some = spark.createDataFrame([p for k, p in enumerate(true) if k % 3 == 0], "id1 long, id2 long")
        assert {(a, b): m for a, b, m in rows(index.count(some))} == {p: m for k, (p, m) in enumerate(true.items()) if k % 3 == 0 and m}


def test_common_pairs_of_nothing(spark):
    assert rows(common_pairs(spark.createDataFrame([], "a long, b string"), "a", "b", 2)) == []
    assert rows(common_pairs(spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string"), "a", "b", 1)) == []


def test_hot_values_are_joined_in_blocks(spark, monkeypatch):
    sets = {i: {"hot", f"v{i % 5}", f"w{i % 3}"} for i in range(60)}
    true = sorted((a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 2)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(skew.block_join, "__defaults__", (4,))
    monkeypatch.setattr(skew.attach_counts, "__defaults__", (5,))
    monkeypatch.setattr(skew.attach_rows, "__defaults__", (5,))
    monkeypatch.setattr(skew.attach, "__defaults__", (3,))
    monkeypatch.setattr(skew.fits, "__defaults__", (3, 100))
    assert rows(common_pairs(table(spark, sets), "code", "n", 2)) == true


def test_item_and_user_models_equal_pearson(spark):
    import numpy as np

    draw = random.Random(4)
    rated = {(u, i): draw.randrange(1, 6) for u in range(12) for i in range(10) if i == 0 or draw.random() < 0.6}
    df = spark.createDataFrame([(u, i, s) for (u, i), s in rated.items()], "user long, item long, stars int")
    for at, found in ((1, cf.item_similarity(df)), (0, cf.user_similarity(df))):
        by = {}
        for key, s in rated.items():
            by.setdefault(key[at], {})[key[1 - at]] = s
        true = {}
        for a, b in itertools.combinations(sorted(by), 2):
            both = sorted(by[a].keys() & by[b].keys())
            x, y = np.array([by[a][k] for k in both], float), np.array([by[b][k] for k in both], float)
            if len(both) >= 3 and x.std() and y.std() and (r := np.corrcoef(x, y)[0, 1]) > 1e-9:
                true[a, b] = r
        got = {(a, b): s for a, b, s in rows(found)}
        assert set(got) <= set(true) if at == 0 else set(got) == set(true)
        assert len(got) >= 0.9 * len(true) and all(abs(true[p] - s) < 1e-9 for p, s in got.items())


def test_levels_after_an_empty_one(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "basket long, item string")
    levels = frequent_itemsets(held, 2, 3)
    assert [x.columns for x in levels] == [["i1", "support"], ["i1", "i2", "support"], ["i1", "i2", "i3", "support"]]
    assert rows(itemset_report(levels)) == [(1, "('a')")] and rows(itemset_lines(levels)) == [(1, ["a"], 2)]
    assert [rows(x) for x in frequent_itemsets(held, 9, 2)] == [[], []]


def test_broadcast_is_bound_by_bytes(spark):
    wide = spark.createDataFrame([(1, "x" * 1000)], "k long, v string")
    assert skew.fits(wide) and not skew.fits(wide, size=500) and not skew.fits(wide.unionByName(wide), limit=1)


def session(master, given=None, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
    conf = {"spark.checkpoint.dir": given, "spark.sql.warehouse.dir": "file:/w"}
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k) or d))


def test_the_shared_folder_is_the_clusters_own():
    assert storage.shared_dir(session("spark://h:1", "hdfs://n/d/")) == "hdfs://n/d"
    assert storage.shared_dir(session("yarn", None, "hdfs://n/e")) == "hdfs://n/e"
    assert storage.shared_dir(session("local[4]")) == "file:/w/_shared"
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master))


def test_a_session_without_the_setting(tmp_path):
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession; from quarrymill.plans.storage import materialize\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.sql.warehouse.dir', '{tmp_path}/w').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "d = materialize(s.range(3), 'x'); assert d.count() == 3 and '/_shared/' in d.written_to, d.written_to"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=".", env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)}).returncode == 0
