"""Queries of the training-data problems over the project's tables, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarrymill.functions.text import letters_only_words
from quarrymill.llm.contamination import RUN, leaked_items
from quarrymill.llm.cooccurrence import cooccurrence
from quarrymill.llm.distinctive_terms import distinctive_terms
from quarrymill.llm.heavy_hitters import heavy_hitters
from quarrymill.llm.packing import pack_documents
from quarrymill.llm.sampling import fixed_size_sample
from quarrymill.llm.set_join import similar_sets
from quarrymill.llm.stuffing import stuffed_pages
from quarrymill.operators.ids import dense_ids
from quarrymill.operators.text_profiles import counted_terms, rounded
from quarrymill.plans.skew import attach
from quarrymill.plans.storage import materialize
from quarrymill.sources.tables import counted_reviews, counted_tags, table, visits


#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of businesses that five users or more visited both, at least five times as often as by chance."""
    pairs = cooccurrence(visits(spark, folder), "user_id", "business_id", min_both=5, min_lift=5)
    return pairs.select(F.col("item_1").alias("business_id_1"), F.col("item_2").alias("business_id_2"))


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of businesses with a common user, with counts and lift."""
    pairs = cooccurrence(visits(spark, folder), "user_id", "business_id")
    return pairs.select(F.col("item_1").alias("business_id_1"), F.col("item_2").alias("business_id_2"), "n_both", "lift")


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    """100 tag occurrences of the counted tweets, each equally likely."""
    tags = materialize(counted_tags(table(spark, folder, "tweet")), "tag-occurrences")
    return fixed_size_sample(tags, "batch_no", ["tweet_id", "pos"], k=100, seed=7)


def p2_size(spark: SparkSession, folder: str) -> DataFrame:
    """How many different, true occurrences the sample has, with the tags they should have."""
    sample = p2_sample(spark, folder).select("tweet_id", "pos", "tag").distinct()
    tags = counted_tags(table(spark, folder, "tweet")).select("tweet_id", "pos", F.col("tag").alias("true_tag"))
    return sample.join(tags, ["tweet_id", "pos"]).where("tag = true_tag").agg(F.count("*").alias("occurrences"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of businesses whose sets of users overlap at 0.5 or more."""
    return p3_pairs(spark, folder).select("business_id_1", "business_id_2")


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with the size of the overlap."""
    held = counted_reviews(table(spark, folder, "review"), "user_id", "business_id")
    pairs = similar_sets(held, "business_id", "user_id", threshold=0.5, min_items=4)
    return pairs.select(F.col("record_1").alias("business_id_1"), F.col("record_2").alias("business_id_2"), "n_both", "similarity")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Tags with at least 0.5 % of all occurrences."""
    return p4_counts(spark, folder).select("tag")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same tags with their counts."""
    tags = materialize(counted_tags(table(spark, folder, "tweet")).select("tag"), "tags")
    return heavy_hitters(tags, "tag", share=0.005).select("tag", "count")


def review_words(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(business_id, word, f) of the counted reviews with a business and a text, and the number of these reviews."""
    texts = counted_reviews(table(spark, folder, "review"), "business_id", "text").where("business_id is not null and text is not null")
    words = texts.select("business_id", letters_only_words("text").alias("words"))
    return counted_terms(words, "business_id", "words", table(spark, folder, "stopword"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three most distinctive words of each business among those used five times or more."""
    counts, m = review_words(spark, folder)
    return distinctive_terms(counts, "business_id", m, min_f=5, top=3).select("business_id", "word")


def p5_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of every business, scored with smoothed idf and length normalisation."""
    counts, m = review_words(spark, folder)
    scores = distinctive_terms(counts, "business_id", m, norm="l2", smooth=True)
    return scores.withColumn("score", rounded(F.col("score")))


def p7_pack(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    return pack_documents(table(spark, folder, "documents"), tokenizers, capacity=2048)


def p7_filled(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Of every packed document, whether its pieces are numbered and cut as they should be, and whether each of their
    containers is within 2,048 tokens without an overlap."""
    packed = materialize(p7_pack(spark, folder, tokenizers), "packed")
    after = Window.partitionBy("container").orderBy("at", "doc_id", "piece")
    placed = packed.withColumn("next", F.lead("at").over(after)).withColumn("fits", F.expr("at >= 0 and at + tokens <= coalesce(next, 2048) and tokens > 0"))
    whole = F.expr("max(piece) = count(*) - 1 and max(token_from + tokens) = sum(tokens) and count_if(tokens < 2048) <= 1 and max(token_from) = max(piece) * 2048")
    return placed.groupBy("doc_id").agg(whole.alias("whole"), F.bool_and("fits").alias("within"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents holding 12 consecutive words of an item, or the whole of a shorter one."""
    leaks = p8_leaks(spark, folder).where(F.col("run") >= F.least(F.lit(RUN), "item_words"))
    return leaks.select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and edited leaks with their alignment scores."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


#: One word in so many is changed.
EDITS = (5, 6, 8, 12)


def p8_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Edited copies planted at the end of every document, one item after the other: how many there are and how many
    are found, by the rate of the edits.

    A copy of rate r has every r-th word changed, which leaves no run of 12 words. Items of fewer words are not
    planted; only the pair of a document and the item planted in it counts.
    """
    words = F.expr(r"regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', ' ')), '[a-z0-9]+', 0)")
    items = materialize(table(spark, folder, "eval_item").select("item_id", words.alias("w")).where("size(w) >= 12"), "items-to-plant")
    rows = materialize(dense_ids(items, "item_id"), "item-rows")
    n = max(1, rows.count())
    texts = [F.struct(F.lit(r).alias("rate"), F.array_join(F.expr(f"transform(w, (x, k) -> if(k % {r} = {r - 1}, concat('edited', k), x))"), " ").alias("copy")) for r in EDITS]
    copies = items.join(rows, "item_id").select("item_id", "row", F.posexplode(F.array(*texts)).alias("turn", "c")).select("item_id", "row", "turn", "c.*")
    docs = table(spark, folder, "documents").where("doc_id is not null").select("doc_id", "text", F.expr(f"pmod(doc_id, {n})").alias("row"), F.expr(f"cast(pmod(doc_id div {n}, {len(EDITS)}) as int)").alias("turn"))
    planted = attach(docs, materialize(copies, "edited-copies"), ["row", "turn"], "inner", ["doc_id"])
    planted = materialize(planted.select("doc_id", "item_id", "rate", F.concat_ws(" ", "text", "copy").alias("text")), "planted")
    found = leaked_items(planted, table(spark, folder, "eval_item")).select("doc_id", "item_id", F.lit(1).alias("hit"))
    both = planted.select("doc_id", "item_id", "rate").join(found, ["doc_id", "item_id"], "left")
    return both.groupBy("rate").agg(F.count("*").alias("copies"), F.count("hit").alias("found"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents more than half of whose words are keyword repetition or lists."""
    return p9_scores(spark, folder).where("2 * stuffed_words > words").select("doc_id")


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The share of stuffed words and the mean mutual information of every document."""
    return stuffed_pages(table(spark, folder, "documents"), table(spark, folder, "page_label"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_sample, p2_size, p3_found, p3_pairs, p4_found, p4_counts, p5_found, p5_scores, p7_pack, p7_filled, p8_found, p8_leaks, p8_edited, p9_found, p9_scores)}

_BASKETS = r"""
with v as (
  select distinct trim(user_id, E' \t\r\n') u, trim(business_id, E' \t\r\n') b from preprocess
  where trim(user_id, E' \t\r\n') <> '' and trim(business_id, E' \t\r\n') <> ''
    and not (trim(user_id, E' \t\r\n') = 'user_id' and trim(business_id, E' \t\r\n') = 'business_id')),
n as (select b, count(*) c from v group by b),
p as (select x.b b1, y.b b2, count(*) c from v x join v y on x.u = y.u and x.b < y.b group by 1, 2),
t as (select count(distinct u) big from v)
"""
_REVIEWS = r"""
with once as (
  select review_id, nullif(trim(user_id, E' \t\r\n'), '') u, nullif(trim(business_id, E' \t\r\n'), '') b, text
  from review where review_id is not null
  qualify row_number() over (partition by review_id order by ingested_at desc nulls last) = 1)
"""
_SIMILAR = _REVIEWS + """
, s as (select distinct b, u from once where b is not null and u is not null),
n as (select b, count(*) c from s group by b having count(*) >= 4),
p as (select x.b b1, y.b b2, count(*) c from s x join s y on x.u = y.u and x.b < y.b group by 1, 2),
r as (select b1, b2, p.c n_both, p.c / (n1.c + n2.c - p.c) similarity
  from p join n n1 on b1 = n1.b join n n2 on b2 = n2.b where 2 * p.c >= n1.c + n2.c - p.c)
"""
_TAGS = r"""
with once as (
  select tweet_id, any_value(entities.hashtags) h from tweet
  where tweet_id is not null and entities.hashtags is not null group by tweet_id),
raw as (select unnest(h).text t from once),
occ as (select nullif(lower(trim(ltrim(trim(t, E' \t\r\n'), '#'), E' \t\r\n')), '') tag from raw),
c as (select tag, count(*) "count" from occ where tag is not null group by tag)
"""
_WORDS = _REVIEWS + """
, docs as (select b, text from once where b is not null and text is not null),
m as (select count(*) m from docs),
raw as (select b, unnest(string_split(lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g')), ' ')) word from docs),
tf as (select b, word, count(*) f from raw where word <> '' and word not in (select word from stopword) group by 1, 2),
df as (select word, count(*) d from tf group by 1),
sz as (select b, max(f) fmax, sqrt(sum(f * f)::double) norm from tf group by 1)
"""
_RUNS = r"""
with w as (
  select doc_id id, true is_doc, regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', ' ', 'g')), '[a-z0-9]+') w from documents where text is not null
  union all
  select item_id, false, regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', ' ', 'g')), '[a-z0-9]+') from eval_item where text is not null),
i as (select id, w, least(12, len(w)) n from w where not is_doc and len(w) > 0),
g as (select distinct id item_id, n, array_to_string(w[k : k + n - 1], ' ') g from (select *, unnest(range(1, len(w) - n + 2)) k from i)),
k as (select distinct n from g),
d as (select distinct id doc_id, n, array_to_string(w[p : p + n - 1], ' ') g from (select id, w, n, unnest(range(1, len(w) - n + 2)) p from w, k where is_doc))
"""
ORACLES = {
    "p1_found": _BASKETS + "select b1 business_id_1, b2 business_id_2 from p join n n1 on b1 = n1.b join n n2 on b2 = n2.b, t where p.c >= 5 and p.c * big >= 5 * n1.c * n2.c",
    "p1_pairs": _BASKETS + "select b1 business_id_1, b2 business_id_2, p.c n_both, p.c::double * big / (n1.c::double * n2.c::double) lift from p join n n1 on b1 = n1.b join n n2 on b2 = n2.b, t",
    "p2_size": _TAGS + 'select least(100, coalesce(sum("count"), 0))::bigint occurrences from c',
    "p7_filled": "select doc_id, true whole, true \"within\" from documents where regexp_matches(text, '[^\\s]')",
    "p3_found": _SIMILAR + "select b1 business_id_1, b2 business_id_2 from r",
    "p3_pairs": _SIMILAR + "select b1 business_id_1, b2 business_id_2, n_both, similarity from r",
    "p4_found": _TAGS + 'select tag from c where "count" >= 0.005 * (select sum("count") from c)',
    "p4_counts": _TAGS + 'select tag, "count" from c where "count" >= 0.005 * (select sum("count") from c)',
    "p5_found": _WORDS + """select b business_id, word from (
  select b, word, f / fmax * log2(m / d) score from tf join df using (word) join sz using (b), m where f >= 5)
qualify row_number() over (partition by b order by score desc, word) <= 3""",
    "p5_scores": _WORDS + "select b business_id, word, f, d, floor(f / norm * log2(m / d + 1) * 1e6 + 0.5) / 1e6 score from tf join df using (word) join sz using (b), m",
    "p8_edited": _RUNS
    + f""", n as (select greatest(1, count(*)) n from w where not is_doc and len(w) >= 12)
select [{", ".join(map(str, EDITS))}][(doc_id // n % {len(EDITS)} + 1)::int]::int rate, count(*) copies, count(*) found from documents, n where doc_id is not null group by 1""",
    "p8_found": _RUNS + "select distinct doc_id, item_id from d join g using (n, g)",
}
