"""Problem 6: a result for every key although a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymill.operators.keyed_quantile import keyed_median
from quarrymill.plans.storage import materialize
from quarrymill.sources.tables import counted_reviews, table


def p6_found(spark: SparkSession, folder: str, rounds: list[int] | None = None) -> DataFrame:
    """The median review of every business and every user with at least 3 counted reviews."""
    once = counted_reviews(table(spark, folder, "review"), "user_id", "business_id", "created_at")
    once = materialize(once.select("review_id", "user_id", "business_id", F.unix_micros("created_at").alias("at")), "counted-reviews")
    field = lambda c: F.struct(F.lit(c).alias("key_field"), F.col(c).alias("key_value"))
    rows = once.select("review_id", "at", F.inline(F.array(field("business_id"), field("user_id"))))
    return keyed_median(rows, ["key_field", "key_value"], "at", "review_id", min_rows=3, rounds=rounds).select("key_field", "key_value", "review_id")


QUERIES = {"p6_found": p6_found}
ORACLES = {
    "p6_found": r"""
with once as (
  select review_id, nullif(trim(user_id, E' \t\r\n'), '') user_id, nullif(trim(business_id, E' \t\r\n'), '') business_id, created_at
  from review where review_id is not null
  qualify row_number() over (partition by review_id order by ingested_at desc nulls last) = 1),
k as (select 'business_id' key_field, business_id key_value, created_at, review_id from once where business_id is not null
  union all select 'user_id', user_id, created_at, review_id from once where user_id is not null)
select key_field, key_value, review_id from k
qualify count(*) over (partition by key_field, key_value) >= 3
  and row_number() over (partition by key_field, key_value order by created_at nulls first, review_id)
    = (count(*) over (partition by key_field, key_value) + 1) // 2""",
}
