"""Streams: sliding distinct counts, samples and sinks by micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymill.operators.sketches import fm_distinct, reservoir, top_levels
from quarrymill.plans.storage import children, discard, materialize, remove, shared_dir


def windowed(rows: DataFrame, ts: str, length: str, slide: str) -> DataFrame:
    """rows once for each window they lie in, with `window_start` and `window_end`."""
    w = rows.withColumn("_w", F.window(ts, length, slide))
    return w.withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.col("_w.end")).drop("_w")


def distinct_windows(rows: DataFrame, ts: str, value: str, length: str, slide: str) -> DataFrame:
    """Batch: (window_start, distinct_values) for each sliding window."""
    w = windowed(rows.where(F.col(value).isNotNull()), ts, length, slide)
    return w.groupBy("window_start").agg(F.count_distinct(value).alias("distinct_values"))


def fm_windows(rows: DataFrame, ts: str, value: str, length: str, slide: str, hashes: int = 1000, group: int = 100) -> DataFrame:
    """Batch: (window_start, distinct_values, estimate)."""
    w = windowed(rows.where(F.col(value).isNotNull()), ts, length, slide)
    return distinct_windows(rows, ts, value, length, slide).join(fm_distinct(w, value, hashes, group, groups=["window_start"]), "window_start")


def stream_distinct_windows(stream: DataFrame, ts: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    """Streaming: the same once the watermark has passed a window's end; rows later than `late` are dropped.

    Values are made distinct within a window first, so the state holds each once and no set of them.
    """
    marked = stream.where(F.col(value).isNotNull()).withWatermark(ts, late)
    w = F.window(ts, length, slide)
    once = marked.select(w.alias("w"), value).groupBy("w", value).count()
    return once.groupBy("w").agg(F.count("*").alias("distinct_values")).select(F.col("w.start").alias("window_start"), "distinct_values")


def session_windows(rows: DataFrame, ts: str, value: str, gap: str) -> DataFrame:
    """(session_start, session_end, distinct_values): runs of rows that follow each other within `gap`."""
    w = rows.where(F.col(value).isNotNull()).groupBy(F.session_window(ts, gap).alias("w")).agg(F.count_distinct(value).alias("distinct_values"))
    return w.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "distinct_values")


def fm_stream(stream: DataFrame, write: Callable[[DataFrame, int], None], ts: str, value: str, length: str, slide: str, late: str, checkpoint: str, hashes: int = 1000, group: int = 100, every: str | None = None):
    """A query, to be started, that hands (window_start, distinct_values, estimate, time) of each closed window to `write`.

    `time` is the clock at the batch. `every` is the interval of batches, such as "5 seconds"; without it what
    is there is read once. Tumbling windows have slide = length.
    """
    marked = stream.where(F.col(value).isNotNull()).withWatermark(ts, late)
    closed = marked.groupBy(F.window(ts, length, slide).alias("w"), value).count()

    def batch(df: DataFrame, number: int) -> None:
        rows = materialize(df.select(F.col("w.start").alias("window_start"), value), "closed-windows")
        truth = rows.groupBy("window_start").agg(F.count("*").alias("distinct_values"))
        estimate = fm_distinct(rows, value, hashes, group, groups=["window_start"])
        write(truth.join(estimate, "window_start").withColumn("time", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")), number)
        discard(rows)

    query = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return query.trigger(processingTime=every) if every else query.trigger(availableNow=True)


class StreamSample:
    """A uniform sample of fixed size over all batches so far, and the values trending in it.

    Pass `add` to foreachBatch. The sample after each batch is a table in `folder` under the number of the
    batch, so a query restarted from its checkpoint goes on from it; a batch delivered again starts from the
    table before it and changes nothing. Rows with an equal `ident` count once. Of the tables only the last
    two stay.
    """

    def __init__(self, spark: SparkSession, ident: list[str], n: int = 100, seed: str = "0", folder: str | None = None):
        self.spark, self.ident, self.n, self.seed = spark, ident, n, seed
        self.folder = (folder or f"{shared_dir(spark)}/quarrymill/sample-{uuid.uuid4().hex}").rstrip("/")

    def _numbers(self) -> list[int]:
        """Batches whose table was written whole."""
        names = (c for c in children(self.spark, self.folder) if c.startswith("batch-"))
        return sorted(int(c[6:]) for c in names if "_SUCCESS" in children(self.spark, f"{self.folder}/{c}"))

    def _read(self, number: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/batch-{number}")

    def add(self, batch: DataFrame, number: int) -> None:
        before = [k for k in self._numbers() if k < number]
        rows = self._read(before[-1], batch.schema).unionByName(batch) if before else batch
        kept = reservoir(rows.dropDuplicates(self.ident), self.ident, self.n, self.seed)
        kept.write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
        for k in before[:-1]:
            remove(self.spark, f"{self.folder}/batch-{k}")

    @property
    def sample(self) -> DataFrame | None:
        """The sample after the last batch, None before the first."""
        held = self._numbers()
        return self.spark.read.parquet(f"{self.folder}/batch-{held[-1]}") if held else None

    def trending(self, column: str, levels: int = 3) -> DataFrame:
        return top_levels(self.sample, column, levels)


def tracked(stream: DataFrame, text: str, lang: str, words: list[str], languages: list[str]) -> DataFrame:
    """Messages in one of the languages that hold one of the words, in any case."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(text), F.lit(w.lower()))
    return stream.where(hit & F.col(lang).isin(languages))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming result over all that is there now and read it back; raises if the query failed."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/quarrymill/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    rows = materialize(spark.read.schema(stream.schema).parquet(f"{out}/rows"), "stream-rows")
    remove(spark, out)
    return rows
