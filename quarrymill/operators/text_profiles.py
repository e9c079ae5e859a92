"""Content profiles: term frequencies, inverse document frequencies, top words, and the cosine of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrymill.plans.skew import attach, attach_counts, attach_rows
from quarrymill.plans.storage import materialize


def term_counts(texts: DataFrame, record: str, words: str, stop: DataFrame | None = None) -> DataFrame:
    """(record, word, f) from rows with an array of words; a record may have many rows. Stop words are left out."""
    counts = texts.select(record, F.explode(words).alias("word")).where(f"word is not null and {record} is not null")
    counts = counts.groupBy(record, "word").agg(F.count("*").alias("f"))
    # a word stands in one row of each record, so a common one in very many
    return attach(counts, stop.select("word").dropna().distinct(), ["word"], "left_anti", [record]) if stop is not None else counts


def counted_terms(texts: DataFrame, record: str, words: str, stop: DataFrame | None = None) -> tuple[DataFrame, int]:
    """term_counts, written once, and the number of its texts, from the same aggregation.

    Every text adds one empty word to its record; the counts of these are taken out again.
    """
    marked = texts.select(record, F.array_append(words, F.lit("")).alias(words)).where(F.col(words).isNotNull())
    counts = materialize(term_counts(marked, record, words, stop), "term-counts")
    n = counts.where("word = ''").agg(F.sum("f")).first()[0] or 0
    return counts.where("word != ''"), n


def tf_words(counts: DataFrame, record: str, min_f: int = 5) -> DataFrame:
    """(record, word, tf): f over the largest f of the record, for words used at least min_f times."""
    kept = counts.where(F.col("f") >= min_f)
    most = kept.groupBy(record).agg(F.max("f").alias("most"))
    return kept.join(most, record).select(record, "word", (F.col("f") / F.col("most")).alias("tf"))


def idf_words(counts: DataFrame, n_docs: int) -> DataFrame:
    """(word, idf): log2 of n_docs over the number of records using the word."""
    return counts.groupBy("word").agg(F.log2(F.lit(float(n_docs)) / F.count("*")).alias("idf"))


def rounded(c: Column) -> Column:
    """To six decimals, in a way that any engine repeats bit for bit."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def profiles(counts: DataFrame, record: str, n_docs: int, min_f: int = 5, top: int = 200) -> DataFrame:
    """(record, word, score): the `top` words of each record by tf * idf, equal ones (to six decimals) by word."""
    used = materialize(counts.groupBy("word").agg(F.count("*").alias("d")), "word-records")
    scored = attach_counts(tf_words(counts, record, min_f), used, "word", "d", [record]).withColumn("idf", F.log2(F.lit(float(n_docs)) / F.col("d")))
    scored = scored.withColumn("score", rounded(F.col("tf") * F.col("idf")))
    best = Window.partitionBy(record).orderBy(F.desc("score"), "word")
    return scored.withColumn("at", F.row_number().over(best)).where(F.col("at") <= top).select(record, "word", "score")


def word_lists(words: DataFrame, record: str) -> DataFrame:
    """(record, words): a profile as one array; at most as long as the profile."""
    return words.groupBy(record).agg(F.collect_set("word").alias("words"))


def user_profiles(visits: DataFrame, user: str, record: str, words: DataFrame) -> DataFrame:
    """(user, word, times): the profile words of the distinct records of a user, with how many of these have the word.

    Profiles travel as one array a record; the words of a user's records are counted map-side first.
    """
    lists = materialize(word_lists(words, record), "word-lists")
    seen = attach(visits.select(user, record).dropna().distinct(), lists, [record], "inner", [user])
    return seen.select(user, F.explode("words").alias("word")).groupBy(user, "word").agg(F.count("*").alias("times"))


def content_predict(pairs: DataFrame, user: str, record: str, of_user: DataFrame, of_record: DataFrame, top: int = 200, min_sim: float = 0.01) -> DataFrame:
    """(user, record, sim): hits / sqrt(length of the user's profile with repeats * top), at least min_sim.

    A hit is a word of the record's profile that the user's has. Pairs without a profile on either side give
    nothing. A profile is one array, met once for each pair.
    """
    pairs = pairs.select(user, record).dropna().distinct()
    users = of_user.groupBy(user).agg(F.sum("times").alias("length"), F.collect_set("word").alias("words"))
    records = materialize(word_lists(of_record, record).withColumnRenamed("words", "_r"), "word-lists")
    met = materialize(attach(pairs, records, [record], "inner", [user]), "pairs-with-profiles")
    met = attach_rows(met, materialize(users.withColumnRenamed("words", "_u"), "user-words"), user, [record])
    hits = met.select(user, record, "length", F.size(F.array_intersect("_r", "_u")).alias("hits")).where("hits > 0")
    sim = F.col("hits") / F.sqrt(F.col("length") * F.lit(float(top)))
    return hits.withColumn("sim", sim).where(F.col("sim") >= min_sim).select(user, record, "sim")
