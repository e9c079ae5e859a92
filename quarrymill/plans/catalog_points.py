"""Queries of clustering, sketches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymill.operators import clustering as cl, sketches as sk
from quarrymill.operators.text_profiles import rounded
from quarrymill.plans.storage import materialize
from quarrymill.sources.readers import stream_folder
from quarrymill.sources.tables import counted_tags, table
from quarrymill.streaming import windows as win


def points(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label", (F.col("vec_id") % 5).cast("int").alias("round"))


def cluster_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """N, SUM and SUMSQ of the labelled groups, by dimension."""
    return cl.summarize(points(spark, folder), "label").select("label", "pos", "n", rounded(F.col("total")).alias("total"), rounded(F.col("squares")).alias("squares"))


def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled group whose centroid is nearest to each point."""
    return _assigned(spark, folder, "euclidean").select("id", "nearest")


def mahalanobis_assign(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest group by squared Mahalanobis distance, and whether it is below 3 * dim."""
    near = _assigned(spark, folder, "mahalanobis")
    return near.select("id", "nearest", (F.col("distance") < 3 * F.size("features")).alias("inside"))


def _assigned(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    rows = materialize(points(spark, folder), "points")
    labels, sums = cl.group_summaries(rows, "label")
    names = F.array(*[F.lit(int(x)) for x in labels])
    return cl.nearest(rows.select("id", "features"), sums, metric).withColumn("nearest", F.element_at(names, F.col("cluster") + 1))


def kmeans_labels(spark: SparkSession, folder: str) -> DataFrame:
    return cl.kmeans(points(spark, folder), 10)


def bfr_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return cl.Bfr(10).fit(points(spark, folder)).rounds()


def bfr_labels(spark: SparkSession, folder: str) -> DataFrame:
    return cl.Bfr(10).fit(points(spark, folder)).labels()


def bfr_conserved(spark: SparkSession, folder: str) -> DataFrame:
    """After each round, the points in all three sets, which must be all points so far, and those that got a label."""
    fit = cl.Bfr(10).fit(points(spark, folder))
    held = fit.rounds().select("round_id", F.expr("nof_point_discard + nof_point_compression + nof_point_retained").alias("points"))
    labelled = fit.labels().agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.sum(F.expr("cast(cluster between 0 and 9 as int)")).alias("in_range")).first()
    return held.select("*", *[F.lit(v).cast("long").alias(c) for c, v in labelled.asDict().items()])


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")


def _members(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).where("ts < timestamp'2024-01-01 12:00:00'").select(F.col("user_id").cast("string").alias("u"))


def bloom_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Positions set by the users of the first half day."""
    return sk.bloom_build(_members(spark, folder), "u")


def bloom_probe(spark: SparkSession, folder: str) -> DataFrame:
    """For each event, whether its user may have been among them."""
    probe = _events(spark, folder).select("event_id", F.col("user_id").cast("string").alias("u"))
    return sk.bloom_probe(probe, "u", sk.bloom_build(_members(spark, folder), "u")).select("event_id", "member")


#: As the operators have them: 1,000 hash functions, estimates averaged in runs of 100.
HASHES, GROUP = 1000, 100


def _local(windows: DataFrame) -> DataFrame:
    return windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def fm_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated number of distinct users."""
    return sk.fm_distinct(_events(spark, folder), "user_id", HASHES, GROUP)


def fm_windows(spark: SparkSession, folder: str) -> DataFrame:
    """True and estimated numbers of users in windows of 3 days by 1 day."""
    return _local(win.fm_windows(_events(spark, folder), "ts", "user_id", "3 days", "1 day", HASHES, GROUP))


def distinct_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _local(win.distinct_windows(_events(spark, folder), "ts", "user_id", "3 days", "1 day"))


def stream_distinct_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows closed by a watermark of one day, from the events as a stream."""
    closed = win.stream_distinct_windows(event_stream(spark, folder), "ts", "user_id", "3 days", "1 day", "1 day")
    return _local(win.run_to_end(closed))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream, their time as a timestamp."""
    fields = table(spark, folder, "events").schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    events = stream_folder(spark, folder, schema, "parquet", "events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def reservoir_sample(spark: SparkSession, folder: str) -> DataFrame:
    """100 tag occurrences by seeded hash."""
    return sk.reservoir(counted_tags(table(spark, folder, "tweet")).select("tweet_id", "pos", "tag"), ["tweet_id", "pos"], 100, "7")


def trending_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The three highest counts among the sampled tags, ties kept."""
    return sk.top_levels(reservoir_sample(spark, folder), "tag", 3)


QUERIES = {f.__name__: f for f in (cluster_summaries, nearest_centroid, mahalanobis_assign, kmeans_labels, bfr_rounds, bfr_labels, bfr_conserved, bloom_bits, bloom_probe, fm_estimate, fm_windows, distinct_windows, stream_distinct_windows, reservoir_sample, trending_tags)}

_SUMS = """with x as (select vec_id id, label, unnest(embedding)::double v, unnest(range(len(embedding))) pos from embeddings),
s as (select label, pos::int pos, count(*) n, sum(v) total, sum(v * v) squares from x group by 1, 2)
"""
_NUMBER = "list_reduce(list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substr(hex(encode({0})), (2 * i - 1)::int, 2))::bigint), lambda a, b: (a * 256 + b) % {1})"
_SPOTS = "unnest([" + ", ".join(f"({a % sk.BLOOM_MODULUS} * x + {b}) % {sk.BLOOM_MODULUS} % {sk.BLOOM_POSITIONS}" for a, b in sk.BLOOM_HASHES) + "])"
# the first byte of a one-byte text is not reduced by the fold
_BLOOM = f"""with u as (select distinct user_id::varchar u, ts < '2024-01-01 12:00:00' early from events where user_id is not null),
x as (select u, early, {_NUMBER.format("u", sk.BLOOM_MODULUS)} % {sk.BLOOM_MODULUS} x from u),
bits as (select distinct {_SPOTS} pos from x where early)
"""


def _kmeans(k: int, rounds: int) -> str:
    """Lloyd's rounds unrolled; those after convergence change nothing."""
    parts = [f"c0 as materialized (select row_number() over (order by md5('0:' || vec_id), vec_id) - 1 c, embedding::double[] e from embeddings qualify c < {k})"]
    near = lambda i: f"(select id, arg_min(c, (d, c)) c from (select x.id, c.c, sum((x.v - c.v) ** 2) d from pt x join f{i} c using (pos) group by 1, 2) group by 1)"
    parts.append("pt as materialized (select vec_id id, unnest(embedding)::double v, unnest(range(len(embedding))) pos from embeddings)")
    parts.append("f0 as materialized (select c, unnest(e) v, unnest(range(len(e))) pos from c0)")
    for i in range(rounds):
        parts.append(f"n{i} as materialized {near(i)}")
        parts.append(f"f{i + 1} as materialized (select c, avg(v) v, pos from pt join n{i} using (id) group by c, pos)")
    return "with " + ", ".join(parts) + f" select id, c::int cluster from {near(rounds)}"


def _fm(source: str, keys: str) -> str:
    family = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(sk.fm_parameters(HASHES)))
    group = f"{keys}, " if keys else ""
    return f"""x as (select distinct {group}{_NUMBER.format("u", sk.FM_MODULUS)} % {sk.FM_MODULUS} x from {source}),
f(k, a, b) as (values {family}),
h as (select {group}k, ((a::hugeint * x::hugeint + b) % {sk.FM_MODULUS} % {sk.FM_RANGE})::bigint h from x, f),
z as (select {group}k, max(case when h = 0 then 1 else bit_count(xor(h, h - 1)) - 1 end) z from h group by {group}k),
r as (select {group}pow(2, z) e, (row_number() over ({'partition by ' + keys if keys else ''} order by z, k) - 1) // {GROUP} g from z),
m as (select {group}g, avg(e) e from r group by {group}g),
est as (select {group}quantile_cont(e, 0.5) estimate from m {'group by ' + keys if keys else ''})
"""


_WINDOWS = """w as (select u, time_bucket(interval '1 day', ts, timestamp '1970-01-01') - o.d * interval '1 day' window_start
  from (select ts, user_id::varchar u from events where user_id is not null), (values (0), (1), (2)) o(d)),
t as (select window_start, count(distinct u) distinct_values from w group by 1)
"""
_TAGS = r"""with once as (select tweet_id, any_value(entities.hashtags) h from tweet where tweet_id is not null and entities.hashtags is not null group by tweet_id),
occ as (select tweet_id, list_filter(list_transform(h, lambda q: nullif(lower(trim(ltrim(trim(q.text, E' \t\r\n'), '#'), E' \t\r\n')), '')), lambda q: q is not null) tags from once),
o as (select tweet_id, unnest(tags) tag, unnest(range(len(tags)))::int pos from occ),
s as (select * from o order by md5('7:' || tweet_id || ':' || pos), tweet_id, pos limit 100)
"""
ORACLES = {
    "cluster_summaries": _SUMS + "select label, pos, n, floor(total * 1e6 + 0.5) / 1e6 total, floor(squares * 1e6 + 0.5) / 1e6 squares from s",
    "nearest_centroid": _SUMS + ", d as (select x.id, s.label, sum((v - total / n) ** 2) d from x join s using (pos) group by 1, 2) select id, arg_min(label, d)::int nearest from d group by 1",
    "mahalanobis_assign": _SUMS
    + ", d as (select x.id, s.label, sum((v - total / n) ** 2 / (squares / n - (total / n) ** 2)) d, count(*) dim from x join s using (pos) group by 1, 2) select id, arg_min(label, d)::int nearest, min(d) < 3 * any_value(dim) inside from d group by 1",
    "kmeans_labels": _kmeans(10, 30),
    "bfr_conserved": "select round_id, points, t as rows, t ids, t in_range from (select label round_id, sum(count(*)) over (order by label)::bigint points from (select vec_id % 5 + 1 as label from embeddings) group by label), (select count(*) t from embeddings)",
    "bloom_bits": _BLOOM + "select pos from bits",
    "bloom_probe": _BLOOM
    + f""", p as (select u, {_SPOTS} pos from x), m as (select u, bool_and(pos in (select pos from bits)) i from p group by 1)
select event_id, coalesce(i::int, 0) member from events left join m on u = user_id::varchar""",
    "fm_estimate": "with src as (select user_id::varchar u from events where user_id is not null), " + _fm("src", "") + "select estimate from est",
    "distinct_windows": "with " + _WINDOWS + "select window_start, distinct_values from t",
    "fm_windows": "with " + _WINDOWS + ", " + _fm("w", "window_start") + "select t.window_start, distinct_values, estimate from t join est using (window_start)",
    "stream_distinct_windows": "with " + _WINDOWS + "select window_start, distinct_values from t where window_start + interval '3 days' <= (select max(ts) - interval '1 day' from events)",
    "reservoir_sample": _TAGS + "select tweet_id, pos, tag from s",
    "trending_tags": _TAGS + """, c as (select tag, count(*) "count" from s group by 1) select tag, "count" from c qualify dense_rank() over (order by "count" desc) <= 3""",
}
