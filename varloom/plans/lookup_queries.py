"""Queries of lookups, assembled tables and combined scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators import lookups, stats
from varloom.operators.intervals import overlap_join
from varloom.plans.calls_queries import TYPE, rounded
from varloom.plans.projections import Tables
from varloom.plans.stats_queries import RANK, features, pvalues

TYPES = f"select tissue, sample_id, {TYPE} as feature, count(*) as n from calls group by 1, 2, 3"
HISTOGRAM = "select coverage, count(*) as n from calls where tissue = '{0}' group by 1"
TPM = "select sample_id, avg(tpm) as mean_tpm from expression group by 1"
DEPTHS = "select sample_id, count(*) as n_deep, cast(null as int) as unknown from depth group by 1"
GENE_COUNTS = "select tissue, gene_id, count(*) as n from gene_calls group by 1, 2"
SYMBOLS = "select gene_id, concat(chrom, strand) as symbol from exons"
WEIGHTS = """select sample_id, 'age' as weight, cast(age as double) as y from sample_meta
  union all select sample_id, 'bmi', bmi from sample_meta union all select sample_id, 'reads', cast(n_unique_mapped as double) from sample_meta"""
RANKED = "rank() over (partition by feature, weight order by {0}) + (count(*) over (partition by feature, weight, {0}) - 1) / 2.0"


def side_pairs(t: Tables) -> DataFrame:
    inside = overlap_join(t.pairs, t.exons.select("chrom", "start_pos", "end_pos", "strand"))
    return inside.withColumn("mut_type", F.concat("ref1", F.lit(">"), "alt1"))


def pathways(t: Tables) -> DataFrame:
    """Pathways (genes by their last digit) whose genes' expression goes with age, against ages dealt anew."""
    ages, expression = t.sample_meta.withColumn("every", F.lit(1)).select("every", "sample_id", "age"), t.expression
    real = stats.correlate(expression.join(ages, "sample_id"), "tpm", "age", ["gene_id"]).filter("p is not null").select("gene_id", "p")
    drawn = expression.join(stats.permute(ages, ["every"], "age", "sample_id", 20), "sample_id")
    permuted = stats.correlate(drawn, "tpm", "age", ["perm_id", "gene_id"]).filter("p is not null").select("perm_id", "gene_id", "p")
    return lookups.pathway_enrichment(real, permuted, t.sql("select distinct concat('P', substr(gene_id, length(gene_id), 1)) as term, gene_id from expression"))


def driven(t: Tables) -> DataFrame:
    return t.sql("select distinct gene_id from exons where cast(substr(gene_id, 2) as int) % 5 = 0")


def region(t: Tables) -> DataFrame:
    variants = t.sql("select distinct variant_id as feature, concat('chr', cast(variant_id % 5 + 1 as varchar(9))) as chrom, variant_id * 40 as pos from genotypes")
    genes = t.sql("select gene_id, chrom, min(start_pos) as start_pos, max(end_pos) as end_pos, min(strand) as strand from exons group by 1, 2")
    return lookups.region_scan(features(t), variants, genes, t.sql("select tissue as phenotype, sample_id, n as y from sample_counts"), 2000, 20, 30)


QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {
    "i9_merge_histograms": (
        lambda t: lookups.merge_histograms(t.sql(HISTOGRAM.format("T0")), t.sql(HISTOGRAM.format("T1")), ["coverage"]),
        f"""with a as ({HISTOGRAM.format("T0")}), b as ({HISTOGRAM.format("T1")})
        select coalesce(a.coverage, b.coverage) as coverage, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b from a full join b on a.coverage = b.coverage""",
    ),
    "j2_j3_metadata": (
        lambda t: rounded(lookups.assemble_metadata(t.sample_meta, [t.sql(TPM), t.sql(DEPTHS)], "sample_id"), "mean_tpm", digits=4),
        f"with x as ({TPM}), d as ({DEPTHS}) select m.*, round(x.mean_tpm, 4) as mean_tpm, d.n_deep from sample_meta m left join x on m.sample_id = x.sample_id left join d on m.sample_id = d.sample_id",
    ),
    "j4_first_symbol": (
        lambda t: lookups.first_symbol(t.sql("select gene_id, count(*) as n from expression group by 1"), t.sql(SYMBOLS)),
        f"with s as ({SYMBOLS}), f as (select gene_id, min(symbol) as symbol from s group by 1), g as (select gene_id, count(*) as n from expression group by 1) select g.gene_id, n, symbol from g left join f on g.gene_id = f.gene_id",
    ),
    "j9_listed_hits": (
        lambda t: lookups.listed_hits(pvalues(t).withColumn("p", F.col("p").cast("double")), t.sql("select concat(chrom, '_', pos) as id from catalogue"), ["id"]),
        """select tissue, concat(chrom, '_', pos) as id, cast(round((n_support % 50 + 0.5) / 50.0, 6) as double) as p from calls
        where concat(chrom, '_', pos) in (select concat(chrom, '_', pos) from catalogue)""",
    ),
    "a25_covered_contexts": (
        lambda t: lookups.covered_contexts(t.calls.filter("coverage >= 40"), t.exons),
        "select strand, context, count(distinct concat(chrom, '_', pos)) as n from gene_calls where coverage >= 40 group by 1, 2",
    ),
    "a35_context_fdr": (
        lambda t: rounded(lookups.context_fdr(side_pairs(t), ["strand", "mut_type"]), "mean_fdr"),
        """with p as (select p.subject_id, e.strand, concat(ref1, '>', alt1) as mut_type, ref1 = ref2 and alt1 = alt2 and alt_n2 > 0 as ok
          from pairs p join exons e on p.chrom = e.chrom and p.pos >= e.start_pos and p.pos < e.end_pos where alt_n1 * 1.0 / cov1 * cov2 >= 8),
        s as (select subject_id, strand, mut_type, count(*) filter (not ok) * 100.0 / count(*) as fdr from p group by 1, 2, 3)
        select strand, mut_type, round(avg(fdr), 6) as mean_fdr, count(*) as n_subjects from s group by 1, 2""",
    ),
    "r8_log_ratio": (
        lambda t: rounded(lookups.log_ratio(t.sql(f"select tissue, {TYPE} as mut_type, count(*) as n from calls group by 1, 2"), "mut_type", "tissue"), "expected", "log_ratio"),
        f"""with c as (select tissue, {TYPE} as mut_type, count(*) as n from calls group by 1, 2),
        e as (select *, sum(n) over (partition by tissue) * sum(n) over (partition by mut_type) * 1.0 / sum(n) over () as expected from c)
        select tissue, mut_type, n, round(expected, 6) as expected, round(log2(n / expected), 6) as log_ratio from e""",
    ),
    "r10_r9_correlation_grid": (
        lambda t: rounded(lookups.correlation_grid(t.sql(TYPES).select("feature", "sample_id", F.col("n").cast("double").alias("x")), t.sql(WEIGHTS), "sample_id", with_p=False).select("feature", "weight", "n", "r"), "r", digits=5),
        f"""with f as ({TYPES}), w as ({WEIGHTS}), j as (select feature, weight, f.n as x, y from f join w on f.sample_id = w.sample_id),
        k as (select feature, weight, {RANKED.format("x")} as rx, {RANKED.format("y")} as ry from j)
        select feature, weight, count(*) as n, round(corr(rx, ry), 5) as r from k group by 1, 2""",
    ),
    "t18_driver_summary": (
        lambda t: rounded(lookups.driver_summary(t.sql(GENE_COUNTS), driven(t)).drop("p", "p_adjusted"), "target_mean", "other_mean", "log2_ratio", "z"),
        f"""with g as ({GENE_COUNTS}), b as (select g.*, cast(substr(gene_id, 2) as int) % 5 = 0 as target from g), k as (select *, {RANK.format(k="tissue", v="n")} as r, count(*) over (partition by tissue, n) as c from b),
        s as (select tissue, avg(n) filter (target) as target_mean, avg(n) filter (not target) as other_mean, count(*) filter (target) as n1, count(*) filter (not target) as n2, sum(r) filter (target) as rs, sum(c * c - 1) as ties from k group by 1)
        select tissue, round(target_mean, 6) as target_mean, round(other_mean, 6) as other_mean, round(log2(target_mean / other_mean), 6) as log2_ratio, n1, n2, rs - n1 * (n1 + 1) / 2.0 as w,
          round((rs - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties * 1.0 / ((n1 + n2) * (n1 + n2 - 1)))), 6) as z from s""",
    ),
    "r6_region_scan": (region, None),
    "t13_pathway_enrichment": (pathways, None),
}
