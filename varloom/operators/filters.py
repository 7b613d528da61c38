"""Labels of likely artefacts, and rows and samples to leave out.

Labels are kept in ``filters``, an array that is empty for a call that passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.scalars import error_probability, mutation_id
from varloom.functions.tails import binomial_upper
from varloom.operators.intervals import merge_intervals, overlap_join

BIAS = {"vdb": 0.05, "rpb": 0.05, "mqb": 0.05, "bqb": 0.05, "mqsb": 0.05}


def no_labels(calls: DataFrame) -> DataFrame:
    return calls if "filters" in calls.columns else calls.withColumn("filters", F.expr("cast(array() as array<string>)"))


def label(calls: DataFrame, name: str, failed: Column) -> DataFrame:
    """Adds a label to calls for which ``failed`` holds (null: not)."""
    more = F.when(failed, F.array(F.lit(name))).otherwise(F.expr("cast(array() as array<string>)"))
    return no_labels(calls).withColumn("filters", F.concat("filters", more))


def filter_string() -> Column:
    """The labels joined by semicolons, or PASS."""
    return F.when(F.size("filters") == 0, "PASS").otherwise(F.concat_ws(";", "filters"))


def label_near(calls: DataFrame, intervals: DataFrame, cutoff: int, name: str) -> DataFrame:
    """Labels calls whose nearest interval is closer than ``cutoff`` (0 inside, 1 adjacent); a chromosome without intervals passes.

    Intervals are widened by the cutoff and merged, so each call meets one at the most, and one join on bins
    decides; calls are neither sorted nor, where the intervals are few, shuffled.
    """
    near = _widened(intervals, cutoff).withColumn("_near", F.lit(True))
    return label(overlap_join(calls, near, "left", bounds=False), name, F.col("_near")).drop("_near")


def _widened(intervals: DataFrame, cutoff: int) -> DataFrame:
    """The places closer than ``cutoff`` to an interval, as intervals that do not overlap."""
    wide = intervals.filter("end_pos > start_pos").select("chrom", (F.col("start_pos") - (cutoff - 1)).alias("start_pos"), (F.col("end_pos") + (cutoff - 1)).alias("end_pos"))
    return merge_intervals(wide).select("chrom", "start_pos", "end_pos")


def keep_far(calls: DataFrame, intervals: DataFrame, cutoff: int) -> DataFrame:
    """Calls farther than ``cutoff`` (0 or more) from the nearest interval; none remain on chromosomes without intervals.

    As in ``label_near`` one join on bins decides, so calls are not sorted."""
    if cutoff < 0:
        raise ValueError("cutoff must be 0 or more")
    far = overlap_join(calls, _widened(intervals, cutoff + 1), "left_anti")
    return far.filter("pos is not null").join(intervals.filter("end_pos > start_pos").select("chrom").distinct(), "chrom", "left_semi").select(*calls.columns)


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(X > k) of n trials, for any n; to be used on distinct values."""
    return binomial_upper(n.cast("double"), k.cast("double"), p)


def label_seq_error(calls: DataFrame, p: float = 1e-4, qual: float = 30.0, name: str = "sequencing_error") -> DataFrame:
    """Labels calls that sequencing errors explain: P(more than n_support errors in coverage) is not below ``p``.

    The tail is worked out once for each distinct pair of coverage and support.
    """
    pairs = calls.select("coverage", "n_support").distinct()
    tails = pairs.withColumn("error_p", binomial_tail(F.col("coverage"), F.col("n_support"), error_probability(qual)))
    return label(calls.join(tails, ["coverage", "n_support"]), name, F.col("error_p") >= p).drop("error_p")


def label_clustered(calls: DataFrame, window: int = 100, min_calls: int = 3, name: str = "clustered_mutation") -> DataFrame:
    """Labels calls with ``min_calls`` or more calls of their sample within ``window`` positions, themselves included."""
    around = Window.partitionBy("sample_id", "chrom").orderBy("pos").rangeBetween(-window, window)
    return label(calls.withColumn("_n", F.count(F.lit(1)).over(around)), name, F.col("_n") >= min_calls).drop("_n")


def label_bias(calls: DataFrame, stats: DataFrame | None = None, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """One label for each bias statistic below its cutoff; missing statistics count as 1."""
    out = calls if stats is None else calls.join(stats, ["sample_id", "chrom", "pos"], "left")
    return reduce(lambda df, kv: label(df, f"{kv[0]}_bias", F.coalesce(F.col(kv[0]), F.lit(1.0)) < kv[1]), (cutoffs or BIAS).items(), out)


def keep_clean(calls: DataFrame, tolerate: tuple[str, ...] = ("clustered_mutation",)) -> DataFrame:
    """Calls without labels other than those tolerated."""
    return calls.filter(F.size(F.array_except("filters", F.array(*map(F.lit, tolerate)))) == 0)


def fix_reference(calls: DataFrame) -> DataFrame:
    """Makes ref the middle of the context: swaps the alleles where alt is it, drops calls where neither
    is, and alleles of more than one base."""
    middle = F.substring("context", ((F.length("context") + 1) / 2).cast("int"), F.lit(1))
    swap = F.col("alt") == middle
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    return calls.filter(single & ((F.col("ref") == middle) | swap)).withColumns(
        {"ref": F.when(swap, F.col("alt")).otherwise(F.col("ref")), "alt": F.when(swap, F.col("ref")).otherwise(F.col("alt"))}
    )


def drop_low_coverage_pairs(pairs: DataFrame, min_expected: float = 8.0) -> DataFrame:
    """Pairs in which the second experiment should show the first one's alternate at least ``min_expected`` times."""
    return pairs.filter(F.col("alt_n1") / F.col("cov1") * F.col("cov2") >= min_expected)


def count_outliers(calls: DataFrame, lo: int = 15, hi: int = 7500) -> DataFrame:
    """Samples with too few or too many calls, and why."""
    counts = calls.groupBy("tissue", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("reason", F.when(F.col("n") < lo, "few").when(F.col("n") > hi, "many")).filter("reason is not null")


def recurrence_in_gene(calls: DataFrame) -> DataFrame:
    """Adds how often the mutation comes relative to the distinct mutations of its gene."""
    return _with_recurrence(calls, None)


def recurrent_in_gene(calls: DataFrame, cutoff: float) -> DataFrame:
    """Calls of mutations with a recurrence of ``cutoff`` or more; the others leave before the calls are joined."""
    return _with_recurrence(calls, cutoff)


def _with_recurrence(calls: DataFrame, cutoff: float | None) -> DataFrame:
    keyed = calls.withColumn("_m", mutation_id())
    times = keyed.filter(F.col("_m").isNotNull()).groupBy("gene_id", "_m").agg(F.count(F.lit(1)).alias("_n"))
    distinct = times.groupBy("gene_id").agg(F.count(F.lit(1)).alias("_d"))
    known = times.join(distinct, "gene_id").select("gene_id", "_m", (F.col("_n") / F.col("_d")).alias("recurrence"))
    return keyed.join(known if cutoff is None else known.filter(F.col("recurrence") >= cutoff), ["gene_id", "_m"]).select(*calls.columns, "recurrence")


def dominant_in_gene(calls: DataFrame) -> DataFrame:
    """Mutations that make up too much of their gene: over 30% of more than 10 calls, or over 10% of more than 1000."""
    counts = calls.groupBy("gene_id", mutation_id().alias("mutation")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("gene_id").agg(F.sum("n").alias("gene_n"))
    share, size = F.col("n") / F.col("gene_n"), F.log10("gene_n")
    return counts.join(total, "gene_id").filter(((size > 1) & (share > 0.3)) | ((size > 3) & (share > 0.1))).withColumn("share", share)


def exclude_listed(calls: DataFrame, listed: DataFrame, on: tuple[str, ...] = ("chrom", "pos", "ref", "alt")) -> DataFrame:
    return calls.join(listed.select(*on).distinct(), list(on), "left_anti")


def restrict_genes(calls: DataFrame, other: DataFrame) -> DataFrame:
    """Calls in genes that a second set of calls has too."""
    return calls.join(other.select("gene_id").distinct(), "gene_id", "left_semi")


def expressed_genes(expression: DataFrame, above: float = 1.0, share: float = 0.2) -> DataFrame:
    """Genes above a level in at least a share of samples."""
    found = expression.groupBy("gene_id").agg(F.avg((F.col("tpm") > above).cast("double")).alias("share"))
    return found.filter(F.col("share") >= share)


def usable_covariates(table: DataFrame, covariates: list[str], most_common: float = 0.95) -> DataFrame:
    """Covariates without nulls whose most common value has less than a share of the rows."""
    long = table.select(*(F.col(c).cast("string").alias(c) for c in covariates)).unpivot([], covariates, "covariate", "value")
    counts = long.groupBy("covariate", "value").agg(F.count(F.lit(1)).alias("n"))
    summed = counts.groupBy("covariate").agg((F.max("n") / F.sum("n")).alias("top_share"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    return summed.filter((F.col("n_null") == 0) & (F.col("top_share") < most_common)).select("covariate", "top_share")


def common_variants(genotypes: DataFrame, maf: float = 0.1) -> DataFrame:
    """Variants with more than one genotype class, of which the rarest has at least maf * n samples."""
    counts = genotypes.filter("dosage is not null").groupBy("variant_id", "dosage").agg(F.count(F.lit(1)).alias("n"))
    summed = counts.groupBy("variant_id").agg(F.min("n").alias("rarest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))
    return summed.filter((F.col("classes") > 1) & (F.col("rarest") >= maf * F.col("n")))


def prune_collinear(table: DataFrame, columns: list[str], limit: float = 0.8) -> list[str]:
    """Columns left after dropping, in order, each that correlates above ``limit`` with one kept before.

    The correlations are aggregates in Spark; only that small matrix reaches the driver.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = table.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else ()
    high = {p for p, r in zip(pairs, row, strict=True) if r is not None and abs(r) > limit}
    kept: list[str] = []
    for c in columns:
        if not any((k, c) in high for k in kept):
            kept.append(c)
    return kept
