"""Joins of positions and half-open intervals on one number line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins that make an overlap join an equi-join; near the usual interval length.
BIN = 64


def _binned(intervals: DataFrame, bin_width: int) -> DataFrame:
    first, last = F.floor(F.col("start_pos") / bin_width), F.floor((F.col("end_pos") - 1) / bin_width)
    return intervals.filter("end_pos > start_pos").withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(points: DataFrame, intervals: DataFrame, how: str = "inner", bin_width: int = BIN, bounds: bool = True) -> DataFrame:
    """Points with the intervals that hold them: start_pos <= pos < end_pos on the same chromosome.

    A point lies in one bin, so each match is found once; intervals are repeated for the bins they
    touch.  ``how`` may be inner, left, left_semi or left_anti.  Without ``bounds`` the intervals' start_pos and end_pos
    are left out, so that points may have columns of these names.
    """
    left = points.withColumn("_bin", F.floor(F.col("pos") / bin_width))
    names = {"chrom": "_chrom", "_bin": "_ibin", "start_pos": "_from", "end_pos": "_to"}
    right = _binned(intervals, bin_width).withColumnsRenamed(names)
    if how in ("left_semi", "left_anti"):
        right = right.select(*names.values())
    match = (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_ibin")) & (F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to"))
    out = left.join(right, match, how).drop("_bin", "_ibin", "_chrom")
    return out.withColumnsRenamed({"_from": "start_pos", "_to": "end_pos"}) if bounds else out.drop("_from", "_to")


def nearest(points: DataFrame, intervals: DataFrame, stretch: int = 1 << 20) -> DataFrame:
    """Adds the distance to the nearest interval: 0 inside, 1 adjacent, -1 if the chromosome has none or a null place.

    Positions that many samples share are ordered once: distances are those of the distinct places, joined
    back to the points (a hot place splits, as it has one row of distances).
    """
    at = distances(points.select("chrom", "pos").distinct(), intervals, stretch).select(F.col("chrom").alias("_of_chrom"), F.col("pos").alias("_of_pos"), F.col("distance").alias("_of_distance"))
    joined = points.join(at, (F.col("chrom") == F.col("_of_chrom")) & (F.col("pos") == F.col("_of_pos")), "left")
    return joined.select(*points.columns, F.coalesce("_of_distance", F.lit(-1).cast("long")).alias("distance"))


def distances(points: DataFrame, intervals: DataFrame, stretch: int = 1 << 20) -> DataFrame:
    """As ``nearest``, but each row of ``points`` is ordered: for rows whose places are distinct, or nearly.

    Points and intervals are put on one line.  The largest end before a point and the smallest start
    after it decide; both are running values within stretches of ``stretch`` positions, and carried
    into each stretch from a table with one row per stretch of the chromosomes.  The points are read once.
    """
    columns = points.columns
    marks = intervals.filter("end_pos > start_pos").select("chrom", F.col("start_pos").alias("pos"), F.lit(0).alias("_kind"), F.col("start_pos").alias("_start"), F.col("end_pos").alias("_end"))
    ends = marks.groupBy("chrom", F.floor(F.col("pos") / stretch).alias("_s")).agg(F.max("_end").alias("_e"), F.min("_start").alias("_b"))
    tops = ends.groupBy("chrom").agg((F.max("_s") + 1).alias("_top"))  # all that lies behind the last interval is one stretch
    line = points.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True).join(tops, "chrom", "left")
    line = line.withColumn("_s", F.coalesce(F.least(F.floor(F.col("pos") / stretch), F.col("_top")), F.lit(0)))
    known = tops.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top"))).alias("_s")).join(ends, ["chrom", "_s"], "left")
    up, down = Window.partitionBy("chrom").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("chrom").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select("chrom", "_s", F.max("_e").over(up).alias("_e"), F.min("_b").over(down).alias("_b"))
    before = Window.partitionBy("chrom", "_s").orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("chrom", "_s").orderBy(F.desc("pos"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = line.withColumn("_pe", F.max("_end").over(before)).withColumn("_nx", F.min("_start").over(after)).filter("_kind = 1").join(carried, ["chrom", "_s"], "left")
    pe, nx = F.greatest("_pe", "_e"), F.least("_nx", "_b")
    distance = F.when(pe > F.col("pos"), 0).otherwise(F.coalesce(F.least(F.col("pos") - pe + 1, nx - F.col("pos")), F.lit(-1)))
    return both.withColumn("distance", distance.cast("long")).select(*columns, "distance")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals of each chromosome with those that overlap or touch made one; empty ones are left out."""
    before = Window.partitionBy("chrom").orderBy("start_pos", "end_pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("chrom").orderBy("start_pos", "end_pos").rowsBetween(Window.unboundedPreceding, 0)
    known = intervals.filter("end_pos > start_pos").select("chrom", "start_pos", "end_pos").distinct()
    opens = known.withColumn("_new", F.coalesce(F.col("start_pos") > F.max("end_pos").over(before), F.lit(True)).cast("int"))
    return opens.withColumn("_k", F.sum("_new").over(upto)).groupBy("chrom", "_k").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("_k")


def map_intervals(intervals: DataFrame, values: DataFrame, agg: Column, key: list[str]) -> DataFrame:
    """An aggregate of the rows of ``values`` inside each interval; intervals without rows are kept."""
    inside = overlap_join(values, intervals.select(*{*key, "chrom", "start_pos", "end_pos"})).groupBy(*key).agg(agg)
    return intervals.select(*key).join(inside, key, "left")


def interval_coverage(intervals: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """Hits, covered positions, length and covered share of each interval, also of those without hits."""
    inside = overlap_join(points.select("chrom", "pos"), intervals.select(*{*key, "chrom", "start_pos", "end_pos"})).groupBy(*key).agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("pos").alias("covered"))
    length = F.col("end_pos") - F.col("start_pos")
    every = intervals.select(*key, length.alias("length")).join(inside, key, "left").fillna(0, ["hits", "covered"])
    return every.withColumn("share", F.col("covered") / F.col("length"))


def expand(intervals: DataFrame, upstream: int, downstream: int) -> DataFrame:
    """Intervals widened towards their 5' and 3' ends by strand; starts stay at 1 or more."""
    minus = F.col("strand") == "-"
    start = F.greatest(F.lit(1).cast("long"), F.col("start_pos") - F.when(minus, downstream).otherwise(upstream))
    return intervals.withColumn("end_pos", F.col("end_pos") + F.when(minus, upstream).otherwise(downstream)).withColumn("start_pos", start)


def genes_near(variants: DataFrame, genes: DataFrame, window: int) -> DataFrame:
    """Genes within ``window`` of a variant, with the distance to the transcription start by strand."""
    tss = genes.withColumn("tss", F.when(F.col("strand") == "-", F.col("end_pos") - 1).otherwise(F.col("start_pos")))
    wide = tss.withColumn("start_pos", F.col("start_pos") - window).withColumn("end_pos", F.col("end_pos") + window)
    toward = F.when(F.col("strand") == "-", F.col("tss") - F.col("pos")).otherwise(F.col("pos") - F.col("tss"))
    return overlap_join(variants, wide, bin_width=max(BIN, window)).withColumn("tss_distance", toward).drop("start_pos", "end_pos")


def last_interval(intervals: DataFrame, key: str = "gene_id") -> DataFrame:
    """Each gene's last interval in the direction of its strand."""
    pick = F.when(F.first("strand") == "-", F.min_by(F.struct("chrom", "start_pos", "end_pos", "strand"), "start_pos")).otherwise(F.max_by(F.struct("chrom", "start_pos", "end_pos", "strand"), "start_pos"))
    return intervals.groupBy(key).agg(pick.alias("i")).select(key, "i.*")


def drop_positions(calls: DataFrame, listed: DataFrame, on: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """Calls without those at listed positions (or alleles)."""
    return calls.join(listed.select(*on).distinct(), list(on), "left_anti")
