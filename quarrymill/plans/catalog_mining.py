"""Queries of baskets, itemsets, similar items, content profiles and collaborative filtering."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymill.functions.text import clean_id, letters_only_words
from quarrymill.operators import lsh, ratings as cf, text_profiles as tp
from quarrymill.operators.baskets import baskets, filter_join, market_baskets
from quarrymill.operators.itemsets import candidates, frequent_itemsets, itemset_lines, itemset_report
from quarrymill.plans.storage import materialize
from quarrymill.sources.tables import counted_reviews, table, visits


def prep_filter_join(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, business_id) of the reviews of businesses in NV, repeated rows kept."""
    business = table(spark, folder, "business").select(clean_id("business_id").alias("business_id"), "state")
    review = table(spark, folder, "review").select(clean_id("user_id").alias("user_id"), clean_id("business_id").alias("business_id"))
    return filter_join(business, review, "business_id", F.upper(F.trim("state")) == "NV").select("user_id", "business_id")


def baskets_sized(spark: SparkSession, folder: str) -> DataFrame:
    """Users with more than 5 businesses, and theirs (case 1)."""
    return market_baskets(visits(spark, folder), "user_id", "business_id", 1, larger_than=5)


def baskets_by_business(spark: SparkSession, folder: str) -> DataFrame:
    """Businesses with more than 20 users, and theirs (case 2)."""
    return market_baskets(visits(spark, folder), "user_id", "business_id", 2, larger_than=20)


def brand_baskets(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The brands of each order, and the number of orders with lines."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    held = baskets(lines.join(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey"), "l_orderkey", "p_brand")
    return held, held.select("basket").distinct().count()


def brand_itemsets(spark: SparkSession, folder: str, k: int, share: float) -> list[DataFrame]:
    held, n = brand_baskets(spark, folder)
    return frequent_itemsets(held, math.ceil(share * n), k)


def itemsets_1(spark: SparkSession, folder: str) -> DataFrame:
    """Brands in 2 % of all orders."""
    return brand_itemsets(spark, folder, 1, 0.02)[0]


def itemsets_2(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of brands in 2 % of all orders."""
    return brand_itemsets(spark, folder, 2, 0.02)[1]


def itemsets_3(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of brands in 0.3 % of all orders."""
    return brand_itemsets(spark, folder, 3, 0.003)[2]


def itemsets_4(spark: SparkSession, folder: str) -> DataFrame:
    """Four brands in 0.04 % of all orders."""
    return brand_itemsets(spark, folder, 4, 0.0004)[3]


def pair_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of brands that are each in 2 % of the orders and are together in some order."""
    held, n = brand_baskets(spark, folder)
    singles = frequent_itemsets(held, math.ceil(0.02 * n), 1)[0]
    return candidates(singles, 1, held)


def itemset_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Triples whose pairs are all in 2 % of the orders."""
    return candidates(brand_itemsets(spark, folder, 2, 0.02)[1], 2)


def itemset_report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The report of brands, pairs and triples in 0.3 % of the orders."""
    return itemset_report(brand_itemsets(spark, folder, 3, 0.003))


def itemsets_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of up to three businesses that 1 % of all users visited, where one business holds a tenth of the visits."""
    held = materialize(market_baskets(visits(spark, folder), "user_id", "business_id", 1), "visit-baskets")
    support = math.ceil(0.01 * held.select("basket").distinct().count())
    found = itemset_lines(frequent_itemsets(held, support, 3))
    return found.select("size", F.array_join("items", ",").alias("items"), "support")


def visitors(spark: SparkSession, folder: str) -> DataFrame:
    """(business, user): who reviewed what; one business holds a tenth of the rows."""
    seen = counted_reviews(table(spark, folder, "review"), "user_id", "business_id")
    return seen.select(F.col("business_id").alias("business"), F.col("user_id").alias("user"))


def minhash_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """35 hash minima of each business's set of users."""
    signatures = lsh.minhash(visitors(spark, folder), "business", "user", 35)
    return signatures.select("id", F.posexplode("signature").alias("pos", "least")).select("id", (F.col("pos") + 1).alias("hash_no"), "least")


def lsh_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of businesses in a common bucket of 35 bands of one hash."""
    return lsh.lsh_candidates(lsh.minhash(visitors(spark, folder), "business", "user", 35), 35, 35)


def similar_items(spark: SparkSession, folder: str) -> DataFrame:
    """Businesses with Jaccard similarity of users >= 0.05 among the candidates of 35 bands of one hash."""
    return lsh.similar_pairs(visitors(spark, folder), "business", "user", 35, 35, 0.05).select("id1", "id2", "sim")


def _counts(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    return tp.counted_terms(review_texts(spark, folder), "business_id", "words", table(spark, folder, "stopword"))


def review_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(business_id, words) of the counted reviews with a business and a text."""
    texts = counted_reviews(table(spark, folder, "review"), "business_id", "text").where("business_id is not null and text is not null")
    return texts.select("business_id", letters_only_words("text").alias("words"))


def tf_words(spark: SparkSession, folder: str) -> DataFrame:
    return tp.tf_words(_counts(spark, folder)[0], "business_id")


def idf_words(spark: SparkSession, folder: str) -> DataFrame:
    words = tp.idf_words(*_counts(spark, folder))
    return words.select("word", tp.rounded(F.col("idf")).alias("idf"))


def business_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 best words of every business."""
    counts, n_docs = _counts(spark, folder)
    return tp.profiles(counts, "business_id", n_docs)


def content_profiles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    of_business = materialize(business_profile(spark, folder), "business-profiles")
    seen = counted_reviews(table(spark, folder, "review"), "user_id", "business_id")
    return seen, tp.user_profiles(seen, "user_id", "business_id", of_business), of_business


def user_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The words of the businesses each user reviewed."""
    return content_profiles(spark, folder)[1]


def content_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of users and businesses for the pairs of the visits."""
    _, users, businesses = content_profiles(spark, folder)
    out = tp.content_predict(visits(spark, folder), "user_id", "business_id", materialize(users, "user-profiles"), businesses)
    return out.select("user_id", "business_id", tp.rounded(F.col("sim")).alias("sim"))


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    """Users rate businesses by the whole stars of their counted reviews."""
    once = counted_reviews(table(spark, folder, "review"), "user_id", "business_id", "stars")
    return materialize(cf.ratings(once, "user_id", "business_id", "stars"), "ratings")


#: An eighth of all pairs, the same ones in any engine.
_HELD_OUT = "substr(md5(concat(user, ':', item)), 1, 1) in ('0', '1')"


def item_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return cf.item_similarity(_rated(spark, folder)).withColumn("sim", tp.rounded(F.col("sim")))


def user_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return cf.user_similarity(_rated(spark, folder)).withColumn("sim", tp.rounded(F.col("sim")))


def predict_item(spark: SparkSession, folder: str) -> DataFrame:
    """Stars of the held-out eighth of all pairs from the other ratings."""
    rated = _rated(spark, folder)
    train = rated.where(f"not ({_HELD_OUT})")
    return cf.predict_item(rated.where(_HELD_OUT), train).withColumn("stars", tp.rounded(F.col("stars")))


def predict_user(spark: SparkSession, folder: str) -> DataFrame:
    rated = _rated(spark, folder)
    train = rated.where(f"not ({_HELD_OUT})")
    return cf.predict_user(rated.where(_HELD_OUT), train).withColumn("stars", tp.rounded(F.col("stars")))


QUERIES = {f.__name__: f for f in (prep_filter_join, baskets_sized, baskets_by_business, itemsets_1, itemsets_2, itemsets_3, itemsets_4, pair_candidates, itemset_candidates, itemset_report_lines, itemsets_visits, minhash_signatures, lsh_candidates, similar_items, tf_words, idf_words, business_profile, user_profile, content_predict, item_similarity, user_similarity, predict_item, predict_user)}

_W = r"E' \t\r\n'"
_VISITS = f"""with v as (
  select distinct trim(user_id, {_W}) u, trim(business_id, {_W}) b from preprocess
  where trim(user_id, {_W}) <> '' and trim(business_id, {_W}) <> '' and not (trim(user_id, {_W}) = 'user_id' and trim(business_id, {_W}) = 'business_id'))
"""
_BRANDS = """with h as (select distinct l_orderkey o, p_brand b from lineitem join part on l_partkey = p_partkey where l_orderkey is not null and p_brand is not null),
t as (select count(distinct o) n from h)
"""
_PAIRS2 = _BRANDS + """, p2 as (select x.b i1, y.b i2, count(*) support from h x join h y on x.o = y.o and x.b < y.b group by 1, 2
  having count(*) >= (select ceil(0.02 * n) from t))
"""


def _levels(k: int, share: str) -> str:
    """k-itemsets as a k-fold self-join; every subset of a frequent set is frequent, so no pruning is needed."""
    cols = ", ".join(f"h{j}.b i{j}" for j in range(1, k + 1))
    joins = "h h1" + "".join(f" join h h{j} on h1.o = h{j}.o and h{j - 1}.b < h{j}.b" for j in range(2, k + 1))
    groups = ", ".join(str(j) for j in range(1, k + 1))
    return f"select {cols}, count(*) support from {joins} group by {groups} having count(*) >= (select ceil({share} * n) from t)"


_ONCE = f"""with once as (
  select review_id, nullif(trim(user_id, {_W}), '') u, nullif(trim(business_id, {_W}), '') b, stars, text from review where review_id is not null
  qualify row_number() over (partition by review_id order by ingested_at desc nulls last) = 1)
"""
_VISITORS = _ONCE + """, h as (select distinct b id, u c from once where b is not null and u is not null),
r as (select c, row_number() over (order by c) - 1 x from (select distinct c from h)),
n as (select count(*) n from r),
g as (select id, (3 * x + 2) % n + (5 * x + 3) % n g, n from h join r using (c), n),
s as (select id, i hash_no, min((i * g + i * i) % 33569 % n) least from g, range(1, 36) f(i) group by 1, 2)
"""
_RATED = _ONCE + """, rated as (select u, b i, max(trunc(stars)::int) stars from once where u is not null and b is not null and stars is not null group by 1, 2)
"""
_TRAIN = _RATED + """, test as (select u, i from rated where substr(md5(u || ':' || i), 1, 1) in ('0', '1')),
train as (select * from rated where substr(md5(u || ':' || i), 1, 1) not in ('0', '1'))
"""


def _model(of: str, via: str, source: str, name: str) -> str:
    return f""", {name}_all as (
  select a.{of} id1, b.{of} id2, count(*) n, sum(a.stars)::bigint sx, sum(b.stars)::bigint sy, sum(a.stars * b.stars)::bigint sxy, sum(a.stars * a.stars)::bigint sxx, sum(b.stars * b.stars)::bigint syy
  from {source} a join {source} b on a.{via} = b.{via} and a.{of} < b.{of} group by 1, 2 having count(*) >= 3),
{name} as (select id1, id2, n, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) sim
  from {name}_all where n * sxy - sx * sy > 0 and n * sxx - sx * sx > 0 and n * syy - sy * sy > 0)
"""


def _user_bands(source: str) -> str:
    """user_model cut to pairs with an equal MinHash value and a Jaccard similarity of 0.01."""
    return f""", ri as (select i, row_number() over (order by i) - 1 x from (select distinct i from {source})), rn as (select count(*) n from ri),
ug as (select u, (3 * x + 2) % n + (5 * x + 3) % n g, n from {source} join ri using (i), rn),
us as (select u, k, min((k * g + k * k) % 33569 % n) least from ug, range(1, 24) f(k) group by 1, 2),
un as (select u, count(*) c from {source} group by 1),
bm as (select m.id1, m.id2, m.sim from user_model m join un a on m.id1 = a.u join un b on m.id2 = b.u
  where m.n / (a.c + b.c - m.n) >= 0.01 and exists (select 1 from us x join us y on x.k = y.k and x.least = y.least where x.u = m.id1 and y.u = m.id2))
"""


_TEXT = _ONCE + f""", docs as (select b, text from once where b is not null and text is not null),
m as (select count(*) m from docs),
raw as (select b, unnest(string_split(lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g')), ' ')) word from docs),
c as (select b, word, count(*) f from raw where word <> '' and word not in (select word from stopword) group by 1, 2),
tf as (select b, word, f / max(f) over (partition by b) tf from c where f >= 5),
idf as (select word, log2(m / count(*)) idf from c, m group by word, m),
bp as (select b, word, floor(tf * idf * 1e6 + 0.5) / 1e6 score from tf join idf using (word)
  qualify row_number() over (partition by b order by score desc, word) <= 200),
up as (select u, word, count(*) times from (select distinct u, b from once where u is not null and b is not null) join bp using (b) group by 1, 2)
"""
_R = lambda e, a: f"floor({e} * 1e6 + 0.5) / 1e6 {a}"

ORACLES = {
    "prep_filter_join": f"""select nullif(trim(r.user_id, {_W}), '') user_id, nullif(trim(r.business_id, {_W}), '') business_id from review r
join business b on nullif(trim(r.business_id, {_W}), '') = nullif(trim(b.business_id, {_W}), '') where upper(trim(b.state)) = 'NV'""",
    "baskets_sized": _VISITS + "select u basket, b item from v qualify count(*) over (partition by u) > 5",
    "baskets_by_business": _VISITS + "select b basket, u item from v qualify count(*) over (partition by b) > 20",
    "itemsets_1": _BRANDS + _levels(1, "0.02"),
    "itemsets_2": _BRANDS + _levels(2, "0.02"),
    "itemsets_3": _BRANDS + _levels(3, "0.003"),
    "itemsets_4": _BRANDS + _levels(4, "0.0004"),
    "pair_candidates": _BRANDS + f", s as ({_levels(1, '0.02')}) select distinct x.b i1, y.b i2 from h x join h y on x.o = y.o and x.b < y.b where x.b in (select i1 from s) and y.b in (select i1 from s)",
    "itemset_candidates": _PAIRS2 + "select a.i1, a.i2, b.i2 i3 from p2 a join p2 b on a.i1 = b.i1 and a.i2 < b.i2 join p2 c on c.i1 = a.i2 and c.i2 = b.i2",
    "itemset_report_lines": _BRANDS
    + f""", s1 as ({_levels(1, "0.003")}), s2 as ({_levels(2, "0.003")}), s3 as ({_levels(3, "0.003")})
select 1 size, string_agg('(''' || i1 || ''')', ',' order by i1) line from s1
union all select 2, string_agg('(''' || i1 || ''', ''' || i2 || ''')', ',' order by i1, i2) from s2
union all select 3, string_agg('(''' || i1 || ''', ''' || i2 || ''', ''' || i3 || ''')', ',' order by i1, i2, i3) from s3""",
    "itemsets_visits": _VISITS
    + """, k as (select ceil(0.01 * count(distinct u)) k from v), f as (select b, count(*) n from v group by 1 having count(*) >= (select k from k)),
w as (select u, b from v where b in (select b from f)),
t2 as (select x.b b1, y.b b2, count(*) n from w x join w y on x.u = y.u and x.b < y.b group by 1, 2 having count(*) >= (select k from k)),
t3 as (select x.b b1, y.b b2, z.b b3, count(*) n from w x join w y on x.u = y.u and x.b < y.b join w z on z.u = x.u and z.b > y.b group by 1, 2, 3 having count(*) >= (select k from k))
select 1 size, b items, n support from f union all select 2, b1 || ',' || b2, n from t2 union all select 3, b1 || ',' || b2 || ',' || b3, n from t3""",
    "minhash_signatures": _VISITORS + "select id, hash_no, least from s",
    "lsh_candidates": _VISITORS + "select distinct a.id id1, b.id id2 from s a join s b on a.hash_no = b.hash_no and a.least = b.least and a.id < b.id",
    "similar_items": _VISITORS
    + """, z as (select id, count(*) c, (select list(least order by hash_no) from s where s.id = h.id) sig from h group by id),
p as (select a.id id1, b.id id2, count(*) c from h a join h b on a.c = b.c and a.id < b.id group by 1, 2)
select id1, id2, p.c / (a.c + b.c - p.c) sim from p join z a on id1 = a.id join z b on id2 = b.id
where p.c / (a.c + b.c - p.c) >= 0.05 and list_bool_or(list_transform(list_zip(a.sig, b.sig), lambda q: q[1] = q[2]))""",
    "tf_words": _TEXT + "select b business_id, word, tf from tf",
    "idf_words": _TEXT + f"select word, {_R('idf', 'idf')} from idf",
    "business_profile": _TEXT + "select b business_id, word, score from bp",
    "user_profile": _TEXT + "select u user_id, word, times from up",
    "content_predict": _TEXT
    + f""", p as (select distinct trim(user_id, {_W}) u, trim(business_id, {_W}) b from preprocess),
h as (select u, b, count(*) hits from p join bp using (b) join up using (u, word) group by 1, 2),
l as (select u, sum(times)::bigint n from up group by 1)
select u user_id, b business_id, {_R('hits / sqrt(n * 200.0::double)', 'sim')} from h join l using (u) where hits / sqrt(n * 200.0::double) >= 0.01""",
    "item_similarity": _RATED + _model("i", "u", "rated", "m") + f"select id1, id2, {_R('sim', 'sim')} from m",
    "user_similarity": _RATED + _model("u", "i", "rated", "user_model") + _user_bands("rated") + f"select id1, id2, {_R('sim', 'sim')} from bm",
    "predict_item": _TRAIN
    + _model("i", "u", "train", "m")
    + f""", w as (select id1 i, id2 o, sim from m union all select id2, id1, sim from m),
near as (select t.u, t.i, r.stars, w.sim from test t join train r on r.u = t.u join w on w.i = t.i and w.o = r.i
  qualify row_number() over (partition by t.u, t.i order by sim desc, r.i) <= 5),
p as (select u, i, sum(stars * sim) / sum(abs(sim)) s from near group by 1, 2),
a as (select i, avg(stars) s from train group by 1)
select test.u "user", test.i item, {_R('coalesce(p.s, a.s)', 'stars')} from test left join p using (u, i) left join a on a.i = test.i where coalesce(p.s, a.s) is not null""",
    "predict_user": _TRAIN
    + _model("u", "i", "train", "user_model")
    + _user_bands("train")
    + f""", w as (select id1 u, id2 o, sim from bm union all select id2, id1, sim from bm),
a as (select u, avg(stars) s, sum(stars)::bigint t, count(*) n from train group by 1),
near as (select t.u, t.i, r.stars - (a.t - r.stars) / nullif(a.n - 1, 0) above, w.sim from test t join train r on r.i = t.i join a on a.u = r.u join w on w.u = t.u and w.o = r.u
  qualify row_number() over (partition by t.u, t.i order by sim desc, r.u) <= 15),
p as (select u, i, sum(above * sim) / sum(abs(sim)) s from near where above is not null group by 1, 2)
select test.u "user", test.i item, {_R('case when p.s is null then a.s else least(a.s + p.s, 5) end', 'stars')} from test join a on a.u = test.u left join p on p.u = test.u and p.i = test.i""",
}
