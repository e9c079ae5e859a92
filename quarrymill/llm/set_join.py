"""All pairs of set-valued records above a Jaccard similarity, by metric pivot partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from quarrymill.plans.skew import attach, attach_counts, block_join
from quarrymill.plans.storage import materialize

#: Sets of at most so many items are held as arrays; larger ones stay rows of single items everywhere.
ARRAY_ITEMS = 4096


class Sets:
    """Set-valued records, indexed for overlap search.

    Records with the same set form a class, named by its smallest id, and only that one is searched.
    classes: (rec, cls) of the records in classes of several. sizes: (rec, n) of the searched records.
    small: (rec, n, toks) with the tokens of sets of up to max_array items, rarest first;
    large: (rec, n, tok) in long form. Items of a single record meet no other and are no tokens.
    """

    def __init__(self, rows: DataFrame, record: str, item: str, min_items: int, max_array: int = ARRAY_ITEMS):
        self.max_array = max_array
        held = rows.select(F.col(record).alias("rec"), F.col(item).alias("item")).dropna().distinct()
        held = materialize(held, "set-items")
        # 128 bits and the size stand for the set
        prints = held.groupBy("rec").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64("item", F.lit(1))).alias("y"))
        prints = materialize(prints.where(F.col("n") >= min_items), "set-prints")
        same = ["n", "x", "y"]
        several = prints.groupBy(*same).agg(F.min("rec").alias("cls"), F.count("*").alias("c")).where("c > 1").drop("c")
        several = materialize(several, "set-classes")
        self.classes = materialize(attach(prints, several, same, "inner", ["rec"]).select("rec", "cls"), "class-members")
        self.sizes = materialize(prints.select("rec", "n").join(self.classes.where("rec != cls"), "rec", "left_anti"), "set-sizes")
        large = materialize(self.sizes.where(F.col("n") > max_array), "large-sets")
        small = held.join(self.sizes.where(F.col("n") <= max_array), "rec")
        kept = small.unionByName(attach(held, large, ["rec"], "inner", ["item"]))
        freq = materialize(kept.groupBy("item").agg(F.count("*").alias("f")), "item-counts")
        tokens = materialize(attach_counts(kept, freq.where("f > 1"), "item", "f", ["rec"]), "set-tokens")
        small = tokens.where(F.col("n") <= max_array).groupBy("rec", "n").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("t"))
        self.small = materialize(small.select("rec", "n", F.col("t.item").alias("toks")), "small-sets")
        self.large = tokens.where(F.col("n") > max_array).select("rec", "n", F.col("item").alias("tok"))
        self.any_large = not large.isEmpty()

    def prefix(self, threshold: float, only: DataFrame | None = None) -> DataFrame:
        """(rec, n, band, tok, at): tokens of which any record within `threshold` must share one.

        Of a small set the n - ceil(threshold * n) + 1 rarest items (those of a single record stand before
        all others and are skipped); of a large one all, so that none has to be sorted as a whole. `at` is
        the token's place in its set, null for large ones.
        """
        pick = (lambda d: d.join(only, "rec", "left_semi")) if only is not None else (lambda d: d)
        single = F.col("n") - F.size("toks")
        length = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - single).cast("int")
        cut = pick(self.small).select("rec", "n", single.alias("_s"), F.posexplode(F.slice("toks", 1, length)).alias("_p", "tok"))
        out = cut.select("rec", "n", "tok", (F.col("_p") + F.col("_s") + 1).cast("long").alias("at"))
        if self.any_large:
            out = out.unionByName(pick(self.large).select("rec", "n", "tok", F.lit(None).cast("long").alias("at")))
        return out.withColumn("band", F.floor(F.log2("n")).cast("int"))

    def within(self, threshold: float, queries: DataFrame, answers: DataFrame | None = None, ordered: bool = False) -> DataFrame:
        """(p, s, n_p, n_s, both, d): exact pairs with Jaccard >= threshold, p of `queries`, s of `answers`.

        Candidates share a prefix token and lie in neighbouring bands of size, so a token that a third of
        the records hold is met only by sets of like size; the overlap that their places still allow is
        tested before anything is gathered. ordered=True gives p < s only.
        """
        span = math.ceil(-math.log2(threshold))
        p = self.prefix(threshold, queries).select(F.col("rec").alias("p"), F.col("n").alias("n_p"), "tok", F.col("at").alias("at_p"), F.explode(F.sequence(F.col("band") - span, F.col("band") + span)).alias("band"))
        s = self.prefix(threshold, answers).select(F.col("rec").alias("s"), F.col("n").alias("n_s"), "tok", F.col("at").alias("at_s"), "band")
        left = 1 + F.least(F.col("n_p") - F.col("at_p"), F.col("n_s") - F.col("at_s"))
        room = F.when(F.col("at_p").isNull() | F.col("at_s").isNull(), F.least("n_p", "n_s")).otherwise(left)
        met = p.join(s, ["tok", "band"]).where(F.col("p") < F.col("s") if ordered else F.col("p") != F.col("s"))
        pairs = met.where(room >= needed(threshold)).select("p", "s", "n_p", "n_s").distinct()
        return self.overlaps(pairs).where(F.col("both") >= needed(threshold))

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """Exact overlap of each pair (p, s, n_p, n_s), and the distance d."""
        sets = lambda c: self.small.select(F.col("rec").alias(c), F.col("toks").alias(f"toks_{c}"))
        if self.any_large:
            pairs = materialize(pairs, "candidates")
        small = pairs.where((F.col("n_p") <= self.max_array) & (F.col("n_s") <= self.max_array))
        out = small.join(sets("p"), "p").join(sets("s"), "s").select("p", "s", "n_p", "n_s", F.size(F.array_intersect("toks_p", "toks_s")).cast("long").alias("both"))
        if self.any_large:
            mixed = pairs.where((F.col("n_p") > self.max_array) | (F.col("n_s") > self.max_array))
            long = self.small.join(mixed.select(F.explode(F.array("p", "s")).alias("rec")).distinct(), "rec", "left_semi")
            long = long.select("rec", F.explode("toks").alias("tok")).unionByName(self.large.select("rec", "tok"))
            mine = block_join(long.withColumnRenamed("rec", "p"), mixed, "p", "tok", "s", 100_000)
            shared = mine.join(long.withColumnRenamed("rec", "s"), ["s", "tok"])
            out = out.unionByName(shared.groupBy("p", "s", "n_p", "n_s").agg(F.count("*").alias("both")))
        return out.withColumn("d", 1 - F.col("both") / (F.col("n_p") + F.col("n_s") - F.col("both")))


def needed(threshold: float):
    """The overlap from which sets of n_p and n_s items are at least `threshold` similar."""
    return F.ceil((F.col("n_p") + F.col("n_s")) * F.lit(threshold / (1 + threshold)) - 1e-9)


def similar_classes(rows: DataFrame, record: str, item: str, threshold: float = 0.5, min_items: int = 1, pivot_share: int = 4, max_array: int = ARRAY_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets with Jaccard similarity >= threshold, and the classes of equal sets.

    With tau = 1 - threshold and rho = min(tau, threshold) / 2, the largest radius of a cell:
    1. one record of `pivot_share`, by a hash of its id, is a pivot; every other record within rho of a pivot
       joins the cell of its nearest one. A record that no pivot reaches, as most are in sparse data, is the
       pivot of a cell of its own, of radius 0, so that the cells cover all records.
    2. A record s is replicated to a cell of radius R if its distance to the pivot is at most R + tau. By the
       triangle inequality no record farther off is within tau of a member of the cell.
    3. Within a cell each member is joined exactly with the cell's replicas, in blocks; those whose distances
       to the pivot differ by more than tau are skipped, again by the triangle inequality. For a cell of
       radius 0 the search of step 2 is that join already. A pair met in several cells is kept once.
    Distances to pivots come from an exact overlap search (prefix tokens, size bands), see Sets.

    Returns (record_1, record_2, n_1, n_2, n_both) with record_1 < record_2, between the smallest ids of
    their classes, and (rec, cls) for the records of classes of several.
    """
    sets = Sets(rows, record, item, min_items, max_array)
    tau = 1 - threshold
    rho = min(tau, threshold) / 2
    pivots = sets.sizes.where(F.pmod(F.xxhash64("rec"), F.lit(pivot_share)) == 0).select("rec")
    near = sets.within(1 - rho, pivots).select("p", "s", "d").join(pivots.withColumnRenamed("rec", "s"), "s", "left_anti")
    nearest = near.groupBy("s").agg(F.min(F.struct("d", "p")).alias("m"))
    member = materialize(nearest.select(F.col("m.p").alias("p"), F.col("s").alias("r"), F.col("m.d").alias("d_r")), "pivot-members")
    cells = materialize(member.groupBy("p").agg(F.max("d_r").alias("radius")), "pivot-cells")
    covered = member.select(F.col("r").alias("rec")).unionByName(cells.select(F.col("p").alias("rec")))
    alone = materialize(sets.sizes.select("rec").join(covered, "rec", "left_anti"), "lone-pivots")
    # two lone pivots find each other from both sides: one is enough
    out = sets.within(threshold, alone, alone, ordered=True).select("p", "s", "n_p", "n_s", "both")
    if not cells.isEmpty():
        reach = sets.within(1 - rho - tau, cells.select(F.col("p").alias("rec"))).join(cells, "p")
        reach = reach.where(F.col("d") <= F.col("radius") + F.lit(tau + 1e-9)).select("p", "s", "n_s", "d")
        sized = lambda d, c: d.join(sets.sizes.select(F.col("rec").alias(c), F.col("n").alias(f"n_{c}")), c)
        own = cells.withColumn("s", F.col("p")).select("p", "s", F.lit(0.0).alias("d"))
        visitors = materialize(reach.unionByName(sized(own, "s")), "cell-replicas")
        members = materialize(sized(member.unionByName(own.toDF("p", "r", "d_r")), "r"), "cell-members")
        met = block_join(visitors, members, "p", "s", "r").where("r != s")
        met = met.where((F.abs(F.col("d") - F.col("d_r")) <= tau + 1e-9) & (F.least("n_r", "n_s") >= F.lit(threshold) * F.greatest("n_r", "n_s") - 1e-9))
        first = F.col("r") < F.col("s")
        pairs = met.select(F.least("r", "s").alias("p"), F.greatest("r", "s").alias("s"), F.when(first, F.col("n_r")).otherwise(F.col("n_s")).alias("n_p"), F.when(first, F.col("n_s")).otherwise(F.col("n_r")).alias("n_s"))
        out = out.unionByName(sets.overlaps(pairs.distinct()).where(F.col("both") >= needed(threshold)).select("p", "s", "n_p", "n_s", "both"))
    return out.toDF("record_1", "record_2", "n_1", "n_2", "n_both"), sets.classes.join(sets.sizes.select(F.col("rec").alias("cls"), "n"), "cls")


def similar_sets(rows: DataFrame, record: str, item: str, threshold: float = 0.5, min_items: int = 1, pivot_share: int = 4, max_array: int = ARRAY_ITEMS) -> DataFrame:
    """All pairs of records whose item sets have Jaccard similarity >= threshold: similar_classes with every
    class written out. Use similar_classes itself where copies are many.

    Rows with a null record or item are ignored, repeated rows count once; sets with fewer than `min_items`
    items are no record, and empty sets do not exist. Equally near pivots: the smaller id. Equal sets are
    similar (1.0). Other columns are not used; an empty table gives no pair. Ids and items are strings.
    Result: record_1 < record_2, n_1, n_2, n_both, similarity.
    """
    pairs, classes = similar_classes(rows, record, item, threshold, min_items, pivot_share, max_array)
    members = lambda k: classes.select(F.col("cls").alias(f"record_{k}"), F.col("rec").alias(f"m{k}"))
    if not classes.isEmpty():
        a = pairs.join(members(1), "record_1", "left").withColumn("m1", F.coalesce("m1", "record_1"))
        b = a.join(members(2), "record_2", "left").withColumn("m2", F.coalesce("m2", "record_2"))
        wide = b.select("m1", "m2", "n_1", "n_2", "n_both")
        within = block_join(classes.select("cls", "n", F.col("rec").alias("m1")), classes.select("cls", F.col("rec").alias("m2")), "cls", "m1", "m2").where("m1 < m2")
        wide = wide.unionByName(within.select("m1", "m2", F.col("n").alias("n_1"), F.col("n").alias("n_2"), F.col("n").alias("n_both")))
        first = F.col("m1") < F.col("m2")
        pairs = wide.select(F.least("m1", "m2").alias("record_1"), F.greatest("m1", "m2").alias("record_2"), F.when(first, F.col("n_1")).otherwise(F.col("n_2")).alias("n_1"), F.when(first, F.col("n_2")).otherwise(F.col("n_1")).alias("n_2"), "n_both")
    return pairs.withColumn("similarity", F.col("n_both") / (F.col("n_1") + F.col("n_2") - F.col("n_both")))
