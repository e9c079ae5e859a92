"""How distinctive a term is of its record, against the whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarrymill.plans.skew import attach_counts
from quarrymill.plans.storage import materialize


def distinctive_terms(counts: DataFrame, record: str, n_docs: int, min_f: int = 1, top: int | None = None, norm: str = "max", smooth: bool = False) -> DataFrame:
    """Score = normalised frequency times logarithmic inverse document frequency.

    counts has (record, word, f), one row for each distinct term of a record. d, the number of records using
    a word, comes from those distinct rows and is joined back; the rows of very common words are split off
    and meet their count by broadcast. norm: "max" divides f by the largest f of the record, "length" by the
    sum of its f, "l2" by the root of the sum of squares. smooth=False takes log2(n_docs / d), smooth=True
    log2(1 + n_docs / d), which stays positive for a word that every record uses.

    min_f drops terms from the result only; lengths, maxima and d count all terms. `top` keeps the highest
    scores of a record, equal ones by word. Nulls in record or word are ignored; a record without words gives
    nothing; an empty table gives nothing. counts is read several times and should be a written table. Result: record, word, f, d, score.
    """
    counts = counts.dropna(subset=[record, "word"]).select(record, "word", "f")
    size = {"max": F.max("f").cast("double"), "length": F.sum("f").cast("double"), "l2": F.sqrt(F.sum(F.col("f") * F.col("f")).cast("double"))}[norm]
    sizes = counts.groupBy(record).agg(size.alias("size"))
    kept = counts.where(F.col("f") >= min_f)
    used = counts.groupBy("word").agg(F.count("*").alias("d"))
    used = materialize(used.join(kept.select("word").distinct(), "word", "left_semi") if min_f > 1 else used, "term-records")
    ratio = F.lit(float(n_docs)) / F.col("d")
    scored = attach_counts(kept, used, "word", "d", [record]).join(sizes, record)
    scored = scored.withColumn("score", F.col("f") / F.col("size") * F.log2(ratio + 1 if smooth else ratio))
    if top is not None:
        best = Window.partitionBy(record).orderBy(F.desc("score"), "word")
        scored = scored.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= top)
    return scored.select(record, "word", "f", "d", "score")
