from quarrymill.plans.skew import attach, attach_counts, block_join
from tests.conftest import rows


def test_attach_is_the_same_join_beyond_the_broadcast_bound(spark):
    big = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)], "k long, v long")
    small = spark.createDataFrame([(k, k * 10) for k in range(5)], "k long, w long")
    for how in ("inner", "left", "left_anti"):
        assert str(rows(attach(big, small, ["k"], how, ["v"], limit=2).fillna(-1))) == str(rows(big.join(small, "k", how).fillna(-1)))


def test_counts_of_hot_and_cold_keys(spark):
    big = spark.createDataFrame([("hot" if v % 2 else f"c{v}", v) for v in range(100)], "k string, v long")
    counts = big.groupBy("k").count().withColumnRenamed("count", "c")
    assert rows(attach_counts(big, counts, "k", "c", ["v"], hot_rows=10)) == rows(big.join(counts, "k"))


def test_block_join_equals_join(spark):
    left = spark.createDataFrame([("hot" if v % 3 else f"c{v}", v) for v in range(90)], "k string, a long")
    right = spark.createDataFrame([("hot" if v % 2 else f"c{v}", v) for v in range(60)], "k string, b long")
    assert rows(block_join(left, right, "k", "a", "b", block=7)) == rows(left.join(right, "k"))
    assert rows(block_join(left, right, "k", "a", "b")) == rows(left.join(right, "k"))
