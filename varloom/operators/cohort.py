"""What a whole cohort says of a mutation: frequencies, panels, overlaps, controls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.scalars import mutation_type
from varloom.operators.intervals import overlap_join
from varloom.operators.windows import exact_quantiles, number_rows

ALLELE = ["chrom", "pos", "ref", "alt"]


def population_frequency(calls: DataFrame, by: str | None = "tissue", samples: DataFrame | None = None) -> DataFrame:
    """Samples that have each mutation, out of all samples (of the tissue); ``samples`` lists them if some have no call."""
    group = [by] if by else []
    every = (samples or calls).groupBy(*group).agg(F.countDistinct("sample_id").alias("n_samples"))
    count = calls.groupBy(*group, *ALLELE).agg(F.countDistinct("sample_id").alias("n_with"))
    joined = count.join(every, group) if group else count.join(F.broadcast(every), how="cross")  # one row
    return joined.withColumn("freq", F.col("n_with") / F.col("n_samples"))


def panel_of_normals(calls: DataFrame, min_freq: float = 0.4, match: str = "position") -> DataFrame:
    """Distinct positions (or alleles) that reach a frequency in any tissue."""
    keys = ALLELE[:2] if match == "position" else ALLELE
    return population_frequency(calls).filter(F.col("freq") >= min_freq).select(*keys).distinct()


def drop_panel(calls: DataFrame, panel: DataFrame) -> DataFrame:
    return calls.join(panel, panel.columns, "left_anti")


def drop_recurrent(calls: DataFrame, min_freq: float = 0.04) -> DataFrame:
    """One row per call whose allele is rarer than ``min_freq`` over all samples."""
    common = population_frequency(calls, by=None).filter(F.col("freq") >= min_freq).select(*ALLELE)
    return calls.join(common, ALLELE, "left_anti")


def drop_panel_and_recurrent(calls: DataFrame, min_freq: float = 0.4, recurrent: float = 0.04) -> DataFrame:
    """What ``drop_recurrent`` leaves of the calls that ``drop_panel`` leaves with their own panel of normals, by position.

    Both look at the calls of one position, so calls are moved and ordered by position once; the samples there are, of
    each tissue and of the calls beyond the panel, are counted by a reading of their own."""
    samples = F.countDistinct("sample_id").alias("_samples")
    place, allele = ["chrom", "pos"], ["chrom", "pos", "ref", "alt"]
    with_it = lambda key: F.size(F.collect_set("sample_id").over(Window.partitionBy(*key)))  # noqa: E731  a position has no more samples than there are
    known = lambda key: reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key))
    # dealt by position, which serves each of the windows
    seen = calls.join(F.broadcast(calls.groupBy("tissue").agg(samples)), "tissue", "left").select(*calls.columns, "_samples").repartition(*place)
    often = F.coalesce(known([*allele, "tissue"]) & (with_it([*allele, "tissue"]) / F.col("_samples") >= min_freq), F.lit(False))
    left = seen.withColumn("_often", often).withColumn("_panel", F.max("_often").over(Window.partitionBy(*place))).filter("not _panel").drop("_samples", "_often", "_panel")
    every = left.agg(samples)  # one row
    shared = F.coalesce(known(allele) & (with_it(allele) / F.col("_samples") >= recurrent), F.lit(False))
    return left.join(F.broadcast(every), how="cross").withColumn("_shared", shared).filter("not _shared").select(*calls.columns)


def distinct_mutations(calls: DataFrame) -> DataFrame:
    return calls.select(*ALLELE).distinct()


def in_several_tissues(calls: DataFrame, n: int) -> DataFrame:
    """Mutations in more than n tissues."""
    return calls.groupBy(*ALLELE).agg(F.countDistinct("tissue").alias("n_tissues")).filter(F.col("n_tissues") > n)


def frequency_summary(frequencies: DataFrame, by: str = "tissue") -> DataFrame:
    return frequencies.groupBy(by).agg(
        F.avg("freq").alias("mean_freq"), F.min("freq").alias("min_freq"), F.max("freq").alias("max_freq"), F.max("n_samples").alias("n_samples"), F.count(F.lit(1)).alias("n_mutations")
    )


def vaf_quantiles(calls: DataFrame, probabilities: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    vaf = F.col("n_support") / F.col("coverage")
    values = exact_quantiles(calls, vaf, [], list(probabilities), "v")
    return values.select(F.explode(F.arrays_zip(F.array(*map(F.lit, probabilities)).alias("p"), F.col("v"))).alias("z")).select(F.col("z.p").alias("p"), F.col("z.v").alias("vaf"))


def filter_waterfall(labelled: DataFrame, order: list[str]) -> DataFrame:
    """For each label in order the mean share of a sample's calls that remain after it; each call counts
    where its first matching label stands."""
    first = F.array_min(F.filter(F.transform("filters", lambda x: F.array_position(F.array(*map(F.lit, order)), x)), lambda i: i > 0))
    staged = labelled.select("sample_id", F.coalesce(first, F.lit(0)).cast("int").alias("stage"))
    lost = staged.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("stage") == i + 1).alias(f"l{i}") for i in range(len(order))])
    left = [(F.col("n") - sum((F.col(f"l{j}") for j in range(i + 1)), F.lit(0))) / F.col("n") for i in range(len(order))]
    means = lost.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(left)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("stage"), F.lit(name).alias("filter"), F.col(f"m{i}").alias("share_left")) for i, name in enumerate(order)])
    return means.select(F.explode(rows).alias("r")).select("r.*")


def type_share_by_frequency(frequencies: DataFrame, bands: tuple[float, ...] = (0, 0.05, 0.1, 0.2, 0.5, 1)) -> DataFrame:
    """Share of each mutation type among the mutations in each band (lo, hi] of frequency."""
    band: Column = F.lit(None).cast("int")
    for i in range(len(bands) - 1, 0, -1):
        band = F.when((F.col("freq") > bands[i - 1]) & (F.col("freq") <= bands[i]), i).otherwise(band)
    counts = frequencies.groupBy(band.alias("band"), mutation_type().alias("mut_type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("band")))


def sample_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tissue", "sample_id").agg(F.count(F.lit(1)).alias("n"))


def count_distribution(calls: DataFrame) -> DataFrame:
    """Summary of the counts of samples in each tissue, with totals and the median that orders them."""
    return sample_counts(calls).groupBy("tissue").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("n").alias("total"), F.avg("n").alias("mean_n"), F.stddev_samp("n").alias("sd_n"),
        F.min("n").alias("min_n"), F.percentile("n", F.lit(0.5)).alias("median_n"), F.max("n").alias("max_n"),
    )


def counts_per_read(calls: DataFrame, meta: DataFrame, min_samples: int = 2) -> DataFrame:
    """Mean calls per million mapped reads of tissues with more than ``min_samples`` samples."""
    rate = F.col("n") / F.col("n_unique_mapped") * 1e6
    both = sample_counts(calls).join(meta.select("sample_id", "n_unique_mapped"), "sample_id")
    return both.groupBy("tissue").agg(F.avg(rate).alias("mean_rate"), F.count(F.lit(1)).alias("n_samples")).filter(F.col("n_samples") > min_samples)


def weighted_frequency_summary(frequencies: DataFrame) -> DataFrame:
    """Percent frequencies over calls (each mutation as often as it is seen) and over distinct mutations."""
    v = F.col("freq") * 100
    q = lambda p: F.percentile(v, F.lit(p), F.col("n_with"))
    return frequencies.agg(
        q(0.25).alias("first_quartile"), q(0.75).alias("third_quartile"), q(0.5).alias("median_freq"), (F.sum(v * F.col("n_with")) / F.sum("n_with")).alias("mean_freq"),
        F.count(F.lit(1)).alias("unique_mutations"), F.sum("n_with").alias("total_mutations"), F.max("n_samples").alias("total_samples"), F.max(v).alias("max_freq"), F.min(v).alias("min_freq"),
    )


def cumulative_frequency(frequencies: DataFrame) -> DataFrame:
    """Share of calls and of distinct mutations below each frequency that occurs; one row per distinct frequency is ordered."""
    at = frequencies.groupBy("freq").agg(F.count(F.lit(1)).alias("u"), F.sum("n_with").alias("t"))
    below, every = Window.orderBy("freq").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    share = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0)) / F.sum(c).over(every)
    return at.select("freq", share("t").alias("calls_below"), share("u").alias("mutations_below"))


def cohort_size(meta: DataFrame) -> DataFrame:
    return meta.agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("tissue").alias("n_tissues"), F.countDistinct("subject_id").alias("n_subjects"))


def samples_per_tissue(meta: DataFrame) -> DataFrame:
    return meta.groupBy("tissue").agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("subject_id").alias("n_subjects"))


def sibling_average(values: DataFrame, pattern: str, label: str) -> DataFrame:
    """Values per subject and tissue, with the tissues that match taken together and averaged."""
    tissue = F.when(F.col("tissue").rlike(pattern), label).otherwise(F.col("tissue"))
    return values.groupBy("subject_id", tissue.alias("tissue")).agg(F.avg("value").alias("value"))


def subjects_with_tissues(meta: DataFrame, tissues: list[str], n: int) -> DataFrame:
    """Subjects with at least n of the listed tissues."""
    return meta.filter(F.col("tissue").isin(*tissues)).groupBy("subject_id").agg(F.countDistinct("tissue").alias("n_tissues")).filter(F.col("n_tissues") >= n)


def catalogue_overlap(calls: DataFrame, catalogue: DataFrame, depth: DataFrame) -> DataFrame:
    """For each sample: calls at catalogued positions with the same and another alternate, its calls, the
    catalogued mutations at its covered positions, and those positions."""
    alts = catalogue.groupBy("chrom", "pos").agg(F.collect_set("alt").alias("alts"), F.countDistinct("ref", "alt").alias("known"))
    mine = calls.join(alts, ["chrom", "pos"], "left").groupBy("sample_id").agg(
        F.count_if(F.array_contains("alts", F.col("alt"))).alias("overlap_correct"), F.count_if(~F.array_contains("alts", F.col("alt"))).alias("overlap_incorrect"), F.count(F.lit(1)).alias("total_mut")
    )
    covered = depth.join(alts.select("chrom", "pos", "known"), ["chrom", "pos"], "left").groupBy("sample_id").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("catalogue_mut"), F.count(F.lit(1)).alias("bases_covered"))
    return mine.join(covered, "sample_id", "left")


def inside_catalogue_share(calls: DataFrame, intervals: DataFrame) -> DataFrame:
    """Share of each sample's calls that lie in catalogued intervals."""
    inside = overlap_join(calls.select("sample_id", *ALLELE), intervals, "left_semi").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_inside"))
    every = calls.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    return every.join(inside, "sample_id", "left").fillna(0, ["n_inside"]).withColumn("share", F.col("n_inside") / F.col("n"))


def seeded(seed: int, *keys: str) -> Column:
    """An order that depends on the seed and the keys alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


#: Positions of a stretch, and hex digits of a hash that make one, where rows of a sample are numbered.
STRETCH, DIGITS = 1 << 20, 3


def _by_place(df: DataFrame, order: list[str]) -> DataFrame:
    return number_rows(df, ["sample_id", "ref"], [F.col("chrom"), F.floor(F.col("pos") / STRETCH)], order)


def _dealt(df: DataFrame, seed: int, order: list[str]) -> DataFrame:
    mixed = df.withColumn("_h", seeded(seed, "sample_id", *order))
    return number_rows(mixed, ["sample_id", "ref"], [F.substring("_h", 1, DIGITS)], ["_h", *order]).drop("_h")


def random_positions(calls: DataFrame, covered: DataFrame, seed: int = 1) -> DataFrame:
    """Control: each call moved to a covered position of its sample with the same reference base.

    Calls and positions of a (sample, ref) are numbered, the positions in a seeded order, and matched by number; where
    there are more calls than positions, those are used again from the first on.  Every call comes back, one
    without any such position with null for chrom and pos.  Rows are numbered by ranges of places and of hashes.
    """
    by = ["sample_id", "ref"]
    sizes = covered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    a = _by_place(calls, ["chrom", "pos", "alt"]).select(*by, "alt", "k").join(sizes, by, "left")
    a = a.withColumn("k", (F.col("k") - 1) % F.col("_n") + 1)
    b = _dealt(covered.select(*by, "chrom", "pos"), seed, ["chrom", "pos"])
    return a.join(b, [*by, "k"], "left").select("sample_id", *ALLELE)


def shuffle_alts(calls: DataFrame, seed: int = 1) -> DataFrame:
    """Control: alternates dealt anew among the calls of a sample with the same reference base."""
    n = _by_place(calls, ["chrom", "pos", "alt"]).drop("alt")
    alts = _dealt(calls.select("sample_id", *ALLELE), seed, ["chrom", "pos", "alt"]).select("sample_id", "ref", "k", "alt")
    return n.join(alts, ["sample_id", "ref", "k"]).drop("k")
