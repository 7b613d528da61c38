"""Queries of summaries, selection ratios, labels of their own, sources' projections and scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import scalars
from varloom.operators import filters, genes, intervals, profiles, regression, selection, stats, summaries
from varloom.plans.calls_queries import TYPE, rounded
from varloom.plans.projections import Tables
from varloom.plans.reads_queries import REF, genome
from varloom.plans.stats_queries import GENE_P, IMPACT, annotated, drivers, opportunity, real_and_permuted
from varloom.sources import tables

SHARES = f"c as (select sample_id, {TYPE} as mut_type, count(*) as n from calls group by 1, 2), sh as (select sample_id, mut_type, n * 1.0 / sum(n) over (partition by sample_id) as share from c)"
SIGNATURE = "select gene_id, avg(tpm) as level from expression where sample_id >= 30 group by 1"
POSTERIORS = "select variant_id, sample_id, dosage, variant_id % 3 = 0 and sample_id = variant_id % 40 as unsure from genotypes"
LAST = "concat(gene_id, chrom, case when strand = '-' then 'm' else 'p' end)"


LOG = {"n_input": "Number of input reads", "unique_pct": "Uniquely mapped reads %", "n_unique": "Uniquely mapped reads number", "mismatch_pct": "Mismatch rate per base, %", "n_splices": "Number of splices: Total"}
PLACED = "select variant_id, sample_id, dosage, concat('chr', variant_id % 5 + 1) as chrom, variant_id * 7 % 80000 as pos from genotypes"


def map_text(t: Tables) -> DataFrame:
    """Calls as lines of files, some of them with missing values."""
    return t.sql("""select concat('/data/', tissue, '/q30/', sample_id, '.map.gz') as path,
      concat_ws(chr(9), chrom, pos, ref, alt, case when pos % 7 = 0 then '.' else context end, coverage, case when pos % 4 = 0 then 'NA' else cast(n_support as string) end) as value from calls""")


def matrix_text(t: Tables) -> tuple[DataFrame, list[str]]:
    ids = list(range(40))
    wide = t.expression.groupBy("gene_id").pivot("sample_id", ids).agg(F.first("tpm"))
    return wide.select(F.concat_ws("\t", "gene_id", F.lit("-"), *(F.coalesce(F.col(str(i)).cast("string"), F.lit("NA")) for i in ids)).alias("value")), ["Name", "Description", *(f"S{i}" for i in ids)]


def log_text(t: Tables) -> DataFrame:
    numbers = {"n_input": F.col("n") * 3, "unique_pct": F.concat(F.col("age").cast("string"), F.lit("%")), "n_unique": F.col("n_unique_mapped"), "mismatch_pct": F.concat(F.col("bmi").cast("string"), F.lit("%")), "n_splices": F.when(F.col("sample_id") != 3, F.col("n"))}
    lines = [F.concat(F.lit(f"  {name} |\t"), numbers[k].cast("string")) for k, name in LOG.items()]
    return t.sample_counts.select(F.col("sample_id").cast("string").alias("sample_id"), F.explode(F.array(*lines, F.lit("UNIQUE READS:"))).alias("value"))


def placed_genotypes(t: Tables) -> DataFrame:
    """Genotypes with a place, a third each as GT, DS and GL."""
    d, third = F.col("dosage"), F.col("variant_id") % 3
    gt = F.element_at(F.array(*map(F.lit, ("0/0", "0|1", "1/1"))), d.cast("int") + 1)
    gl = F.array(*(-1.5 * F.abs(d - i) for i in range(3)))
    return t.sql(PLACED).select("variant_id", "sample_id", "chrom", "pos", F.when(third == 0, gt).alias("gt"), F.when(third == 1, d.cast("double")).alias("ds"), F.when(third == 2, gl).alias("gl"))


def shares(t: Tables) -> DataFrame:
    return profiles.share_within(profiles.type_counts(t.calls_once, ["sample_id"]), "n", ["sample_id"]).select("sample_id", "mut_type", "share")


def per_gene(t: Tables) -> DataFrame:
    return selection.good_ratios(genes.dnds_per_gene(annotated(t), opportunity(t), with_p=False))


def labelled_edits(t: Tables) -> DataFrame:
    known = lambda df: tables.edit_sites(df, "chrom", "pos")
    return filters.label_near(filters.label_near(t.calls, known(t.catalogue), 1, "rna_edit"), known(t.calls.filter("pos % 7 = 0")), 1, "rna_edit_second")


def boundaries(t: Tables) -> DataFrame:
    ends = t.exons.select("chrom", F.explode(F.array("start_pos", F.col("end_pos") - 1)).alias("start_pos"))
    return ends.withColumn("end_pos", F.col("start_pos") + 1)


def fits(t: Tables) -> DataFrame:
    """Calls of each sample and type with what a model of age and bmi in its tissue fits to them, and the model's sigma."""
    n = profiles.type_counts(t.calls, ["tissue", "sample_id"]).join(t.sample_meta.select("sample_id", "age", "bmi"), "sample_id")
    return regression.fitted_models(n, "n", ["age", "bmi"], ["tissue", "mut_type"])


def random_gene_sets(t: Tables) -> DataFrame:
    return stats.matched_random_sets(genes.expression_stats(t.expression), drivers(t), "mean_tpm", 50, 4)


def ranked(by: str, value: str) -> str:
    return f"rank() over (partition by {by} order by {value}) + (count(*) over (partition by {by}, {value}) - 1) / 2.0"


def last_of(t: Tables) -> DataFrame:
    named = t.exons.withColumn("gene_id", F.concat("gene_id", "chrom", F.when(F.col("strand") == "-", "m").otherwise("p")))
    return intervals.last_interval(named).select("gene_id", F.col("start_pos").alias("last_start"), F.col("end_pos").alias("last_end"))


def shuffled_silhouette(t: Tables) -> DataFrame:
    points = t.base("embeddings")
    dealt = stats.permute(points.select("vec_id", "label").withColumn("every", F.lit(1)), ["every"], "label", "vec_id", 1).select("vec_id", "label")
    return stats.silhouette(points.drop("label").join(dealt, "vec_id"), "embedding", "label", "vec_id")


QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {
    "f2_edit_labels": (
        lambda t: labelled_edits(t).groupBy("sample_id", filters.filter_string().alias("filter")).agg(F.count(F.lit(1)).alias("n")),
        """with l as (select sample_id, exists (select 1 from catalogue k where k.chrom = c.chrom and k.pos = c.pos) as a, pos % 7 = 0 as b from calls c)
        select sample_id, case when a and b then 'rna_edit;rna_edit_second' when a then 'rna_edit' when b then 'rna_edit_second' else 'PASS' end as filter, count(*) as n from l group by 1, 2""",
    ),
    "f3_splice_labels": (
        lambda t: filters.label_near(t.calls, boundaries(t), 7, "splice_junction_error").groupBy("sample_id").agg(F.count_if(F.size("filters") > 0).alias("n_labelled"), F.count(F.lit(1)).alias("n")),
        """with l as (select sample_id, exists (select 1 from exons x where x.chrom = c.chrom and (abs(c.pos - x.start_pos) < 7 or abs(c.pos - x.end_pos + 1) < 7)) as f from calls c)
        select sample_id, count(*) filter (f) as n_labelled, count(*) as n from l group by 1""",
    ),
    "p16_stranded_flanks": (
        lambda t: summaries.stranded_flanks(t.calls.select("sample_id", "chrom", "pos"), t.exons, genome(t, t.calls.groupBy("chrom").agg(F.max("pos").alias("last")))).select("sample_id", "chrom", "pos", "strand", "seq"),
        f"select distinct sample_id, chrom, pos, strand, concat({', '.join(REF.format(p=f'(pos + {o})') for o in (-1, 0, 1))}) as seq from gene_calls",
    ),
    "s15_by_gene": (
        lambda t: summaries.by_gene_table(t.gene_calls),
        """select gene_id, sample_id as "Sample_ID", tissue as "Cancer_Type", chrom as "Chromosome", pos as "Start_Position", pos as "End_Position", ref as "Reference_Allele", alt as "Variant_Allele" from gene_calls""",
    ),
    "u1_sorted_union": (
        lambda t: summaries.sorted_union(*(t.calls.filter(F.col("tissue") == x).select("chrom", "pos", "ref", "alt") for x in ("T0", "T1", "T2", "T3"))),
        "select distinct chrom, pos, ref, alt from calls",
    ),
    "x1_x14_scalars": (
        lambda t: t.calls.select(
            "sample_id", "chrom", "pos", scalars.code_tissue(F.concat("tissue", F.lit(" - (left  side)"))).alias("code"), scalars.display_tissue(F.when(F.col("pos") % 2 == 0, "Whole_Blood").otherwise(F.concat(F.lit("Left_"), "tissue"))).alias("shown"),
            scalars.subject_of(F.concat(F.lit("AB-"), F.col("sample_id"), F.lit("-0001-X"))).alias("subject"), scalars.variant_parts(F.concat_ws("_", "chrom", "pos", "ref", "alt")).alias("v"),
            scalars.dosage(F.element_at(F.array(*map(F.lit, ("0/0", "0|1", "1/1", "./1"))), (F.col("pos") % 4 + 1).cast("int"))).alias("dosage"), scalars.p_label(F.col("vdb") / F.col("n_support")).alias("stars"),
            scalars.position_bin(F.col("pos") % 100 + 1, F.lit(100)).alias("bin"), F.round(scalars.line_through(F.lit(0.0), F.col("coverage"), F.col("n_support").cast("double"), F.col("pos"))["slope"], 6).alias("slope"),
        ).withColumns({"v_pos": F.col("v.pos"), "v_alt": F.col("v.alt")}).drop("v"),
        """select sample_id, chrom, pos, concat(tissue, '_left_side') as code, case when pos % 2 = 0 then 'Blood' else concat('Left ', tissue) end as shown, concat('AB-', sample_id) as subject, pos as v_pos, alt as v_alt,
        case pos % 4 when 0 then 0 when 1 then 1 when 2 then 2 end as dosage, case when vdb / n_support < 0.001 then '***' when vdb / n_support < 0.01 then '**' when vdb / n_support < 0.05 then '*' else 'n.s.' end as stars,
        least(10, (pos % 100) // 10 + 1) as bin, round((pos - coverage) / n_support::double, 6) as slope from calls""",
    ),
    "x9_certain_variants": (
        lambda t: summaries.certain_variants(t.sql(POSTERIORS).select("variant_id", "sample_id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(F.col("unsure"), 0.4).when(F.col("dosage") == i, 0.94).otherwise(0.03)).alias("posteriors")))
        .groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("genotype").alias("alternates")),
        f"with p as ({POSTERIORS}) select variant_id, count(*) as n, sum(dosage) as alternates from p group by 1 having not bool_or(unsure)",
    ),
    "x15_share_within": (lambda t: rounded(shares(t), "share"), f"with {SHARES} select sample_id, mut_type, round(share, 6) as share from sh"),
    "i13_calls_in_last": (
        lambda t: genes.flag_last_interval(t.gene_calls.withColumn("gene_id", F.concat("gene_id", "chrom", F.when(F.col("strand") == "-", "m").otherwise("p"))), last_of(t)).groupBy("gene_id").agg(F.count_if("in_last").alias("n_last"), F.count(F.lit(1)).alias("n")),
        f"""with g as (select {LAST} as gene_id, start_pos, end_pos, strand from exons), l as (select gene_id, case when min(strand) = '-' then min(start_pos) else max(start_pos) end as a, case when min(strand) = '-' then arg_min(end_pos, start_pos) else arg_max(end_pos, start_pos) end as b from g group by 1),
        c as (select {LAST} as gene_id, pos from gene_calls) select c.gene_id, count(*) filter (pos >= a and pos < b) as n_last, count(*) as n from c left join l on c.gene_id = l.gene_id group by 1""",
    ),
    "x12_cds_profile": (
        lambda t: genes.cds_position_profile(annotated(t).join(t.cds.groupBy("gene_id").agg(F.max("cds_pos").alias("cds_length")), "gene_id"), 5),
        f"with {IMPACT}, m as (select gene_id, max(cds_pos) as len from cds group by 1) select least(5, cast(floor((cds_pos - 1) * 5 / len) as bigint) + 1) as bin, impact, count(*) as n from ann join m on ann.gene_id = m.gene_id group by 1, 2",
    ),
    "r9_signature_correlation": (
        lambda t: rounded(summaries.signature_correlation(t.expression, t.sql(SIGNATURE), t.sample_meta.select("sample_id", F.col("bmi").alias("value")), with_p=False).select("n", "r"), "r", digits=5),
        f"""with s as ({SIGNATURE}), j as (select sample_id, tpm, level from expression join s using (gene_id)), k as (select sample_id, {ranked("sample_id", "tpm")} as x, {ranked("sample_id", "level")} as y from j),
        a as (select sample_id, corr(x, y) as similarity from k group by 1), b as (select 1 as g, similarity, bmi from a join sample_meta using (sample_id)), c as (select {ranked("g", "similarity")} as x, {ranked("g", "bmi")} as y from b)
        select count(*) as n, round(corr(x, y), 5) as r from c""",
    ),
    "r12_gene_fdr": (
        lambda t: rounded(summaries.association_fdr(*real_and_permuted(t), ["gene_id"]), "statistic", "fdr"),
        f"""with {GENE_P}, r as (select gene_id, round(-2 * sum(ln(p)), 9) as s, count(*) as k from gp where b = 0 group by 1), d as (select round(-2 * sum(ln(p)), 9) as s from gp where b > 0 group by gene_id, b)
        select gene_id, round(s, 6) as statistic, k as n_tests, round(least(1.0, (select count(*) from d where d.s >= r.s) * 1.0 / (select count(*) from d) * (select count(*) from r) / (select count(*) from r x where x.s >= r.s)), 6) as fdr from r""",
    ),
    "r12_pathway_fdr": (
        lambda t: rounded(summaries.association_fdr(*(x.withColumn("pathway", F.substring("gene_id", -1, 1)) for x in real_and_permuted(t)), ["pathway", "tissue"], ["tissue"]), "statistic", "fdr"),
        f"""with {GENE_P}, r as (select right(gene_id, 1) as pathway, tissue, round(-2 * sum(ln(p)), 9) as s, count(*) as k from gp where b = 0 group by 1, 2), d as (select tissue, round(-2 * sum(ln(p)), 9) as s from gp where b > 0 group by tissue, right(gene_id, 1), b)
        select pathway, tissue, round(s, 6) as statistic, k as n_tests, round(least(1.0, (select count(*) from d where d.tissue = r.tissue and d.s >= r.s) * 1.0 / (select count(*) from d where d.tissue = r.tissue)
        * (select count(*) from r y where y.tissue = r.tissue) / (select count(*) from r x where x.tissue = r.tissue and x.s >= r.s)), 6) as fdr from r""",
    ),
    "r13_simulated_medians": (lambda t: summaries.simulated_medians(fits(t), ["tissue", "mut_type"], "sample_id", 200, 200), None),
    "r13_fitted_models": (
        lambda t: rounded(regression.fitted_models(t.sample_counts, "n", ["age"], ["tissue"]).select("sample_id", "tissue", "n", "fitted", "sigma"), "fitted", "sigma", digits=4),
        """with f as (select tissue, regr_intercept(n, age) as a, regr_slope(n, age) as b from sample_counts group by 1), r as (select s.sample_id, s.tissue, n, a + b * age as fitted from sample_counts s join f on s.tissue = f.tissue)
        select sample_id, tissue, n, round(fitted, 4) as fitted, round(sqrt(sum(pow(n - fitted, 2)) over (partition by tissue) / (count(*) over (partition by tissue) - 2)), 4) as sigma from r""",
    ),
    "t14_profile_ratio": (
        lambda t: rounded(summaries.profile_ratio(t.expression, shares(t), n=20), "log2_ratio", "perm_mean", "p_permuted", digits=5),
        f"""with {SHARES}, q as (select gene_id, quantile_cont(tpm, 0.2) as a, quantile_cont(tpm, 0.8) as b from expression group by 1),
        sd as (select e.gene_id, e.sample_id, case when tpm <= a then 'low' else 'high' end as side from expression e join q on e.gene_id = q.gene_id where tpm <= a or tpm >= b),
        m as (select gene_id, mut_type, log2(avg(share) filter (side = 'high') / avg(share) filter (side = 'low')) as lr from sd join sh on sd.sample_id = sh.sample_id group by 1, 2),
        sz as (select gene_id, count(*) filter (side = 'low') as nl, count(*) filter (side = 'high') as nh from sd group by 1),
        o as (select b, mut_type, share, row_number() over (partition by b, mut_type order by md5(concat('1|', b, '|', sample_id)), sample_id) as k from sh, range(1, 21) x(b)),
        u as (select nl, nh, b, mut_type, log2((sum(share) filter (k > nl and k <= nl + nh) / nh) / (sum(share) filter (k <= nl) / nl)) as r from o, (select distinct nl, nh from sz) z group by 1, 2, 3, 4)
        select m.gene_id, m.mut_type, sz.nl as n_low, sz.nh as n_high, round(lr, 5) as log2_ratio, round(avg(r), 5) as perm_mean, round(avg((abs(r) >= abs(lr) - 1e-12)::int), 5) as p_permuted
        from m join sz on m.gene_id = sz.gene_id join u on u.nl = sz.nl and u.nh = sz.nh and u.mut_type = m.mut_type group by 1, 2, 3, 4, lr""",
    ),
    "t19_silhouette_shuffled": (
        lambda t: rounded(shuffled_silhouette(t), "silhouette", digits=4),
        """with n as (select vec_id, embedding::double[] as v, row_number() over (order by vec_id) as k from embeddings), m as (select label, row_number() over (order by md5(concat('1|1|', vec_id)), vec_id) as k from embeddings),
        e as (select n.vec_id, n.v, m.label from n join m on n.k = m.k), d as (select a.vec_id, a.label, b.label as o, sum(pow(list_distance(a.v, b.v), 2)) / greatest(1, count(*) - (case when a.label = b.label then 1 else 0 end)) as m, count(*) as n from e a, e b group by 1, 2, 3),
        w as (select vec_id, label, max(m) filter (label = o and n > 1) as a, min(m) filter (label <> o) as b from d group by 1, 2) select label, round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 4) as silhouette, count(*) as n from w group by 1""",
    ),
    "t23_ratio_means": (lambda t: selection.ratio_means(per_gene(t), rounds=100), None),
    "t24_recurrence_bands": (
        lambda t: rounded(genes.ratio_by_class(selection.recurrence_bands(annotated(t)), opportunity(t), "band"), "mis_ratio"),
        f"""with {IMPACT}, f as (select chrom, pos, ref, alt, count(distinct sample_id) as often from ann group by 1, 2, 3, 4), c as (select impact, case when often >= 5 then 5 when often >= 3 then 3 when often >= 2 then 2 else 1 end as g from ann join f using (chrom, pos, ref, alt)),
        l as (select impact, sum(sites) as s from opp group by 1), n as (select g, c.impact, count(*) as n, max(s) as s from c join l on c.impact = l.impact group by 1, 2)
        select g as band, round(sum(n * 1.0 / s) filter (impact = 'Missense') / sum(n * 1.0 / s) filter (impact = 'Synonymous'), 6) as mis_ratio, sum(n) as n from n group by 1""",
    ),
    "t25_set_ratio": (
        lambda t: selection.set_ratio(per_gene(t).withColumn("gene_id", F.split("gene_id", "_")[0]).groupBy("gene_id").agg(F.avg("ratio").alias("ratio")), drivers(t), random_gene_sets(t)),
        None,
    ),
    "s1_s2_parse_maps": (
        lambda t: tables.path_columns(tables.parse_tsv(map_text(t), tables.MAP), path=F.col("path")).drop("path"),
        """select tissue, 'q30' as param_set, cast(sample_id as varchar) as sample_id, chrom, pos, ref, alt, case when pos % 7 <> 0 then context end as context, coverage, case when pos % 4 <> 0 then n_support end as n_support from calls""",
    ),
    "s3_parse_intervals": (
        lambda t: tables.parse_tsv(t.sql("select concat_ws(chr(9), chrom, start_pos, end_pos, exon_id, '.', strand) as value from exons"), tables.BED),
        "select chrom, start_pos, end_pos, cast(exon_id as varchar) as name, '.' as score, strand from exons",
    ),
    "s4_parse_expression": (
        lambda t: tables.parse_expression(*matrix_text(t), [f"S{i}" for i in range(0, 40, 2)]).filter("tpm is not null"),
        "select gene_id, concat('S', sample_id) as sample_id, tpm from expression where sample_id % 2 = 0",
    ),
    "s6_transpose": (
        lambda t: tables.transpose(t.sample_meta.select("sample_id", F.col("age").cast("double").alias("age"), "bmi").unpivot(["sample_id"], ["age", "bmi"], "measure", "v").groupBy("measure").pivot("sample_id", list(range(40))).agg(F.first("v")), "measure"),
        "select cast(sample_id as varchar) as sample_id, cast(age as double) as age, bmi from sample_meta",
    ),
    "s7_genotypes_in_regions": (
        lambda t: rounded(tables.genotypes_in(placed_genotypes(t), t.sql("select chrom, start_pos - 5 as start_pos, end_pos + 5 as end_pos from exons"), t.sql("select sample_id from sample_meta where gender = 1")).select("variant_id", "sample_id", "chrom", "pos", tables.any_dosage().alias("dosage")), "dosage"),
        f"""with g as ({PLACED}) select variant_id, sample_id, g.chrom, pos, round(case when variant_id % 3 < 2 then dosage
          else (pow(10, -1.5 * abs(dosage - 1)) + 2 * pow(10, -1.5 * abs(dosage - 2))) / (pow(10, -1.5 * abs(dosage)) + pow(10, -1.5 * abs(dosage - 1)) + pow(10, -1.5 * abs(dosage - 2))) end, 6) as dosage
        from g join exons e on g.chrom = e.chrom and pos >= start_pos - 5 and pos < end_pos + 5 where sample_id % 2 = 0""",
    ),
    "s8_parse_mapping_logs": (
        lambda t: tables.parse_mapping_logs(log_text(t), LOG),
        "select cast(sample_id as varchar) as sample_id, cast(n * 3 as double) as n_input, cast(age as double) as unique_pct, cast(n_unique_mapped as double) as n_unique, bmi as mismatch_pct, case when sample_id <> 3 then cast(n as double) end as n_splices from sample_counts",
    ),
    "s11_map_lines": (
        lambda t: tables.map_lines(filters.label(filters.label(t.calls, "low_support", F.col("n_support") < 3), "deep", F.col("coverage") > 150)),
        """select tissue, sample_id, concat(chrom, chr(9), pos, chr(9), ref, chr(9), alt, chr(9), context, chr(9), coverage, chr(9), n_support, chr(9),
          case when n_support < 3 and coverage > 150 then 'low_support;deep' when n_support < 3 then 'low_support' when coverage > 150 then 'deep' else 'PASS' end) as value from calls""",
    ),
}
