"""Reads to pileups, pileups to calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITE = ["sample_id", "chrom", "pos"]
COUNTS = {"A": "a_n", "T": "t_n", "G": "g_n", "C": "c_n"}


def base_counts() -> Column:
    """The four counts of a pileup row as an array of (base, n)."""
    return F.array(*[F.struct(F.lit(b).alias("base"), F.col(c).cast("int").alias("n")) for b, c in COUNTS.items()])


def call_variants(
    pileup: DataFrame, min_support: int = 6, min_coverage: int = 40, vaf_lo: float = 0.0, vaf_hi: float = 0.7, biallelic_only: bool = True, require_unique_top: bool = False
) -> DataFrame:
    """Calls of a pileup: one row per alternate base with enough reads.

    Coverage is the sum of the four counts; the reference is the middle of the context and must be
    seen.  An alternate base needs ``min_support`` reads and vaf_lo < n / coverage <= vaf_hi.  With
    ``biallelic_only`` exactly two bases may be seen; with ``require_unique_top`` sites are dropped
    where two bases share the largest count.  A projection: no shuffle, and streams work too.
    """
    counts = [F.col(c).cast("int") for c in COUNTS.values()]
    coverage = sum(counts[1:], counts[0])
    top = F.greatest(*counts)
    how_many = lambda test: sum((F.when(test(c), 1).otherwise(0) for c in counts[1:]), F.when(test(counts[0]), 1).otherwise(0))
    ref = F.substring("context", ((F.length("context") + 1) / 2).cast("int"), F.lit(1))
    keys = [c for c in ("tissue", *SITE) if c in pileup.columns]
    sites = pileup.filter(coverage >= min_coverage)
    if biallelic_only:
        sites = sites.filter(how_many(lambda c: c > 0) == 2)
    if require_unique_top:
        sites = sites.filter(how_many(lambda c: c == top) == 1)
    ref_n = reduce(lambda acc, kv: F.when(ref == kv[0], F.col(kv[1]).cast("int")).otherwise(acc), COUNTS.items(), F.lit(0))
    each = sites.select(*keys, ref.alias("ref"), "context", coverage.alias("coverage"), ref_n.alias("ref_n"), F.explode(base_counts()).alias("x"))
    vaf = F.col("x.n") / F.col("coverage")
    alts = each.filter((F.col("x.base") != F.col("ref")) & (F.col("ref_n") > 0) & (F.col("x.n") >= min_support) & (vaf > vaf_lo) & (vaf <= vaf_hi))
    return alts.select(*keys, "ref", F.col("x.base").alias("alt"), "context", "coverage", F.col("x.n").alias("n_support"))


def call_top_two(pileup: DataFrame, min_support: int = 6, min_coverage: int = 40, maf_lo: float = 0.0, maf_hi: float = 0.7) -> DataFrame:
    """One call per site by its two most frequent bases: the first is the reference, the second the
    alternate (X if there is none), ties in the order A, T, G, C; maf_lo < alt / (alt + ref) < maf_hi."""
    ordered = F.array_sort(base_counts(), lambda a, b: (b["n"] - a["n"]).cast("int"))
    two = pileup.withColumn("o", ordered).select(
        *[c for c in ("tissue", *SITE) if c in pileup.columns], F.col("o")[0]["base"].alias("ref"), F.col("o")[0]["n"].alias("ref_n"),
        F.when(F.col("o")[1]["n"] > 0, F.col("o")[1]["base"]).otherwise("X").alias("alt"), F.col("o")[1]["n"].alias("alt_n"),
        sum((F.col(c) for c in COUNTS.values()), F.lit(0)).cast("int").alias("coverage"),
    )
    maf = F.col("alt_n") / (F.col("alt_n") + F.col("ref_n"))
    called = (F.col("alt_n") >= min_support) & (maf > maf_lo) & (maf < maf_hi)
    return two.filter(F.col("coverage") >= min_coverage).withColumn("maf", maf).withColumn("called", F.coalesce(called, F.lit(False)))


def compare_pair(pileup_a: DataFrame, pileup_b: DataFrame, **limits: float) -> DataFrame:
    """Sites covered in both of two samples, with each side's two bases; kept if either side calls."""
    side = lambda df, s: call_top_two(df, **limits).select("chrom", "pos", *[F.col(c).alias(f"{c}_{s}") for c in ("ref", "alt", "ref_n", "alt_n", "coverage", "called")])
    return side(pileup_a, "a").join(side(pileup_b, "b"), ["chrom", "pos"]).filter("called_a or called_b")


def compare_samples(pileup: DataFrame, subjects: DataFrame, **limits: float) -> DataFrame:
    """``compare_pair`` of every two samples of a subject; ``subjects`` has (sample_id, subject_id)."""
    two = call_top_two(pileup, **limits).join(subjects.select("sample_id", "subject_id"), "sample_id")
    side = lambda s: two.select("subject_id", "chrom", "pos", *[F.col(c).alias(f"{c}_{s}") for c in ("sample_id", "ref", "alt", "ref_n", "alt_n", "coverage", "called")])
    return side("a").join(side("b"), ["subject_id", "chrom", "pos"]).filter("sample_id_a < sample_id_b and (called_a or called_b)")


def drop_duplicate_reads(reads: DataFrame, key: tuple[str, ...] = ("sample_id", "chrom", "start", "is_reverse"), seed: int = 1) -> DataFrame:
    """One read of those that start at the same place, chosen by a hash of its id rather than by quality."""
    order = Window.partitionBy(*key).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("read_id").cast("string"))), "read_id")
    return reads.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def read_bases(reads: DataFrame) -> DataFrame:
    """One row per base of each read: position, base, quality, and its place in the read (from its 5' end)."""
    out = reads.select("*", F.posexplode(F.split("seq", "")).alias("offset", "base")).filter("base <> ''")
    place = F.when(F.col("is_reverse"), F.length("seq") - 1 - F.col("offset")).otherwise(F.col("offset"))
    return out.select("sample_id", "read_id", "chrom", (F.col("start") + F.col("offset")).alias("pos"), "base", F.element_at("quals", F.col("offset") + 1).alias("qual"), place.cast("int").alias("read_pos"))


def depth(reads: DataFrame, min_qual: int = 29, min_depth: int = 40) -> DataFrame:
    """Positions whose depth at base quality ``min_qual`` or more reaches ``min_depth``."""
    bases = read_bases(reads).filter(F.col("qual") >= min_qual)
    return bases.groupBy(*SITE).agg(F.count(F.lit(1)).alias("depth")).filter(F.col("depth") >= min_depth)


def pileup(reads: DataFrame, reference: DataFrame, min_qual: int = 30, context_len: int = 5) -> DataFrame:
    """Base counts at positions where two different called bases are seen and the reference is known.

    ``reference`` holds (chrom, chunk_id, chunk_start, seq) with context_len - 1 bases of overlap, so
    that each context lies in one chunk; the join is on the chunk and the counts are combined before
    they are shuffled.
    """
    bases = read_bases(reads).filter(F.col("qual") >= min_qual)
    counts = [F.count_if(F.col("base") == b).alias(n) for b, n in (*COUNTS.items(), ("N", "n_n"))]
    sites = bases.groupBy(*SITE).agg(*counts).filter(sum((F.col(c) > 0).cast("int") for c in COUNTS.values()) >= 2)
    found = reference_context(sites, reference, context_len).filter(F.col("ref") != "N")
    ref_count = reduce(lambda acc, kv: F.when(F.col("ref") == kv[0], F.col(kv[1])).otherwise(acc), COUNTS.items(), F.lit(0))
    return found.withColumn("ref_n", ref_count)


def reference_context(sites: DataFrame, reference: DataFrame, k: int = 5, chunk: int = 1000) -> DataFrame:
    """Adds the k-mer of the reference centred at pos, in upper case, and its middle base."""
    half = k // 2
    keyed = sites.withColumn("chunk_id", F.floor((F.col("pos") - 1) / chunk))
    at = (F.col("pos") - half - F.col("chunk_start") + 1).cast("int")
    out = keyed.join(reference, ["chrom", "chunk_id"]).withColumn("context", F.upper(F.substring(F.col("seq"), at, F.lit(k))))
    return out.filter((at >= 1) & (F.length("context") == k)).withColumn("ref", F.substring("context", half + 1, 1)).drop("chunk_id", "chunk_start", "seq")


def reference_chunks(genome: DataFrame, chunk: int = 1000, k: int = 5) -> DataFrame:
    """(chrom, seq) cut into chunks of positions chunk_id * chunk + 1 ..., with k // 2 more bases on both sides."""
    half = k // 2
    cut = genome.withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("seq") - 1) / chunk))))
    start = F.greatest(F.lit(1).cast("long"), F.col("chunk_id") * chunk + 1 - half)
    return cut.select("chrom", "chunk_id", start.alias("chunk_start"), F.substring(F.col("seq"), start.cast("int"), ((F.col("chunk_id") + 1) * chunk + half - start + 1).cast("int")).alias("seq"))


def base_histogram(reads: DataFrame, of: str = "read_pos") -> DataFrame:
    """For each site and base a map from place in the read (or quality) to count."""
    counted = read_bases(reads).groupBy(*SITE, "base", of).agg(F.count(F.lit(1)).cast("int").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(of).cast("int").alias("k"), F.col("n").alias("v"))))
    return counted.groupBy(*SITE, "base").agg(F.map_from_entries(entries).alias("histogram"))


def sum_histograms(calls: DataFrame, histogram: str, key: list[str]) -> DataFrame:
    """Sums the maps of calls by key and map key."""
    return calls.select(*key, F.explode(histogram).alias("k", "v")).groupBy(*key, "k").agg(F.sum("v").alias("n"))


def base_totals(reads: DataFrame, key: list[str], of: str = "read_pos") -> DataFrame:
    """What ``sum_histograms`` makes of ``base_histogram`` by ``key`` and base: (key, base, k, n), without a map for each site.

    Bases are counted by these few values before they are shuffled."""
    return read_bases(reads).groupBy(*key, "base", F.col(of).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def genome_partitions(sizes: DataFrame, size: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive pieces of at most ``size`` positions of each chromosome (chrom, length)."""
    kept = sizes.filter(~F.col("chrom").isin(*exclude)) if exclude else sizes
    starts = kept.withColumn("start_pos", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"), F.lit(size).cast("long"))))
    return starts.select("chrom", "start_pos", F.least(F.col("start_pos") + size - 1, F.col("length")).alias("end_pos"))


def merge_pileups(regions: list[DataFrame], depth: str) -> DataFrame:
    """One pileup of those of several regions: a row for each site of a sample, with the columns of the first.

    Where regions overlap, or a region was worked out twice, a site comes several times: the row of the largest ``depth``
    (an expression) stays, of equal ones the largest by its other columns in their order.  Null keys are values like others.
    """
    columns = regions[0].columns
    every = reduce(lambda a, b: a.unionByName(b), regions)
    rest = [c for c in columns if c not in SITE]
    best = every.groupBy(*SITE).agg(F.max(F.struct(F.expr(depth).alias("_depth"), *rest)).alias("_best"))
    return best.select(*(F.col(c) if c in SITE else F.col(f"_best.{c}").alias(c) for c in columns))


def attach_stats(pileup: DataFrame, stats: DataFrame) -> DataFrame:
    return pileup.join(stats, SITE, "left")


def _by_subject(pileup: DataFrame, genotypes: DataFrame) -> list[str]:
    """Genotypes of several subjects have ``subject_id``, which the pileup must then have too."""
    if "subject_id" not in genotypes.columns:
        return []
    if "subject_id" not in pileup.columns:
        raise ValueError("genotypes have a subject_id, the pileup has none")
    return ["subject_id"]


def drop_germline(pileup: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Drops sites where the subject's own genotype is heterozygous or half-missing; a longer reference
    covers each of its positions.  Genotypes without ``subject_id`` are those of one subject."""
    by = _by_subject(pileup, genotypes)
    bad = genotypes.filter(F.col("gt").isin("0/1", "1/0", "1/.", "0/.", "./1", "./0"))
    sites = bad.select(*by, "chrom", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.length("ref") - 1)).alias("pos")).distinct()
    return pileup.join(sites, [*by, "chrom", "pos"], "left_anti")


def repair_context(pileup: DataFrame, genotypes: DataFrame, k: int = 5) -> DataFrame:
    """Writes homozygous single-base alleles of the subject into the contexts (of k bases), and resets ref to the middle base.

    Each homozygous site is dealt to the k positions whose contexts hold it, and the pileup is joined once.  Of
    several alleles of a subject at a site the first in order of text counts.
    """
    by, half = _by_subject(pileup, genotypes), k // 2
    single = genotypes.filter((F.length("ref") == 1) & (F.length("alt") == 1) & F.col("gt").isin("0/0", "1/1"))
    own = single.groupBy(*by, "chrom", F.col("pos").alias("at")).agg(F.min(F.when(F.col("gt") == "1/1", F.col("alt")).otherwise(F.col("ref"))).alias("allele"))
    dealt = own.withColumn("d", F.explode(F.sequence(F.lit(-half), F.lit(half)))).select(*by, "chrom", (F.col("at") - F.col("d")).alias("pos"), F.struct((F.col("d") + half).alias("i"), "allele").alias("_f"))
    fixes = dealt.groupBy(*by, "chrom", "pos").agg(F.map_from_entries(F.collect_list("_f")).alias("_f"))  # k entries at the most
    written = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.col("_f")[i], F.substring(F.col("context"), i + 1, F.lit(1)))), "")
    out = pileup.join(fixes, [*by, "chrom", "pos"], "left").withColumn("context", F.when(F.col("_f").isNull(), F.col("context")).otherwise(written)).drop("_f")
    return out.withColumn("ref", F.substring("context", half + 1, 1))
