"""Tables of the project and the cleaned views that its queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymill.functions.text import clean_id, clean_tag


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """`preprocess` with clean ids, without header lines and unusable rows; repeated rows stay."""
    u, b = clean_id("user_id"), clean_id("business_id")
    rows = table(spark, folder, "preprocess").select(u.alias("user_id"), b.alias("business_id"))
    return rows.where("user_id is not null and business_id is not null and not (user_id = 'user_id' and business_id = 'business_id')")


def counted_reviews(reviews: DataFrame, *columns: str) -> DataFrame:
    """One row for each review_id, its latest by ingested_at, with clean ids.

    A null ingested_at counts as the earliest; rows without review_id are no review and are left out.
    The maximum is taken map-side first, so many deliveries of one review stay a small group.
    """
    values = [clean_id(c).alias(c) if c in ("user_id", "business_id") else F.col(c) for c in columns]
    latest = F.max(F.struct("ingested_at", *values)).alias("r")
    return reviews.where("review_id is not null").groupBy("review_id").agg(latest).select("review_id", *[F.col(f"r.{c}") for c in columns])


def counted_tags(tweets: DataFrame) -> DataFrame:
    """(tweet_id, batch_no, pos, tag): the tag occurrences of each tweet, once however often it was delivered.

    batch_no is the piece of the first delivery. Null and empty tags are no occurrences; rows without
    tweet_id are no tweets.
    """
    tags = F.transform(F.col("entities.hashtags"), lambda h: clean_tag(h["text"]))
    rows = tweets.where("tweet_id is not null").select("tweet_id", "batch_no", F.filter(tags, lambda t: t.isNotNull()).alias("tags"))
    once = rows.groupBy("tweet_id").agg(F.min(F.struct(F.coalesce("batch_no", F.lit(2**31 - 1)).alias("batch_no"), "tags")).alias("t"))
    return once.select("tweet_id", "t.batch_no", F.posexplode("t.tags").alias("pos", "tag"))
