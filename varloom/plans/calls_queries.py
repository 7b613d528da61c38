"""Queries of calling, labels, cohorts, profiles and intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import scalars
from varloom.operators import calling, cohort, filters, intervals, profiles
from varloom.plans import pipelines
from varloom.plans.projections import Tables

FOLD = "case when ref in ('A', 'G') then translate({0}, 'ACGT', 'TGCA') else {0} end"
TYPE = f"concat({FOLD.format('ref')}, '>', {FOLD.format('alt')})"
CODE = f"concat(cast(instr('TC', {FOLD.format('ref')}) - 1 as varchar), cast(instr('ATGC', {FOLD.format('alt')}) - 1 as varchar))"
MIDDLE_FOLD = "case when ref in ('A', 'G') then concat(substr(context, 1, 2), translate(substr(context, 3, 1), 'ACGT', 'TGCA'), substr(context, 4, 2)) else context end"
CLEAN = "clean as (select * from calls where coverage >= 40 and n_support >= 6 and n_support * 1.0 / coverage > 0 and n_support * 1.0 / coverage <= 0.7)"
FREQ = f"""{CLEAN}, freq as (select c.tissue, c.chrom, c.pos, c.ref, c.alt, count(distinct c.sample_id) as n_with, s.n_samples, count(distinct c.sample_id) * 1.0 / s.n_samples as freq
  from clean c join (select tissue, count(distinct sample_id) as n_samples from clean group by tissue) s on c.tissue = s.tissue group by c.tissue, c.chrom, c.pos, c.ref, c.alt, s.n_samples)"""
FREQ_ALL = f"""{CLEAN}, freq as (select c.chrom, c.pos, c.ref, c.alt, count(distinct c.sample_id) as n_with, s.n_samples, count(distinct c.sample_id) * 1.0 / s.n_samples as freq
  from clean c cross join (select count(distinct sample_id) as n_samples from clean) s group by c.chrom, c.pos, c.ref, c.alt, s.n_samples)"""
NEAR = """line as (select sample_id, chrom, pos, 1 as k, null as s, null as e from calls union all select null, chrom, start_pos, 0, start_pos, end_pos from exons),
 w as (select *, max(e) over (partition by chrom order by pos, k rows unbounded preceding) as pe, min(s) over (partition by chrom order by pos desc, k rows unbounded preceding) as nx from line),
 near as (select sample_id, chrom, pos, case when pe > pos then 0 else coalesce(least(coalesce(pos - pe + 1, nx - pos), coalesce(nx - pos, pos - pe + 1)), -1) end as distance from w where k = 1)"""


def clean(t: Tables) -> DataFrame:
    return pipelines.threshold(t.calls)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def labelled(t: Tables) -> DataFrame:
    out = filters.label_clustered(filters.label_near(t.calls_once, t.exons, 7, "near_exon"))
    return filters.label_bias(out)


LABELS = f"""with {NEAR}, l as (select c.sample_id, c.chrom, c.pos, n.distance >= 0 and n.distance < 7 as f1,
  count(*) over (partition by c.sample_id, c.chrom order by c.pos range between 100 preceding and 100 following) >= 3 as f2,
  coalesce(vdb, 1.0) < 0.05 as f3, coalesce(rpb, 1.0) < 0.05 as f4, coalesce(mqb, 1.0) < 0.05 as f5, coalesce(bqb, 1.0) < 0.05 as f6, coalesce(mqsb, 1.0) < 0.05 as f7
  from calls c join near n on c.sample_id = n.sample_id and c.chrom = n.chrom and c.pos = n.pos)"""

def uncorrelated(t: Tables) -> DataFrame:
    """Which of four columns of all line items stay when those that correlate with one kept before go."""
    price = F.col("l_extendedprice").cast("double")
    table = t.base("lineitem").select(F.col("l_quantity").alias("quantity"), price.alias("price"), (price * (1 - F.col("l_discount").cast("double"))).alias("discounted"), F.col("l_tax").alias("tax"))
    kept = filters.prune_collinear(table, table.columns)
    return t.spark.createDataFrame([(c, c in kept) for c in table.columns], "covariate string, kept boolean")


QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {
    "flagship_cohort": (
        lambda t: pipelines.flagship(t.calls),
        f"""with {FREQ}, panel as (select distinct chrom, pos from freq where freq >= 0.4)
        select tissue, {TYPE} as mut_type, count(*) as n from clean c where not exists (select 1 from panel p where p.chrom = c.chrom and p.pos = c.pos) group by 1, 2""",
    ),
    "c1_call_variants": (
        lambda t: calling.call_variants(t.pileup).select("sample_id", "chrom", "pos", "ref", "alt", "coverage", "n_support"),
        """select sample_id, chrom, pos, ref, alt, coverage, n as n_support from (select p.*, a_n + t_n + g_n + c_n as coverage, b.alt, case b.alt when 'A' then a_n when 'T' then t_n when 'G' then g_n else c_n end as n,
        case ref when 'A' then a_n when 'T' then t_n when 'G' then g_n else c_n end as ref_n from pileup p cross join (values ('A'), ('T'), ('G'), ('C')) b(alt)) x
        where coverage >= 40 and alt <> ref and n >= 6 and ref_n > 0 and n * 1.0 / coverage > 0 and n * 1.0 / coverage <= 0.7
        and (a_n > 0)::int + (t_n > 0)::int + (g_n > 0)::int + (c_n > 0)::int = 2""",
    ),
    "c2_call_top_two": (
        lambda t: rounded(calling.call_top_two(t.pileup).select("sample_id", "chrom", "pos", "ref_n", "alt_n", "maf", "called"), "maf"),
        """select sample_id, chrom, pos, ref_n, alt_n, round(alt_n * 1.0 / (alt_n + ref_n), 6) as maf, alt_n >= 6 and alt_n * 1.0 / (alt_n + ref_n) > 0 and alt_n * 1.0 / (alt_n + ref_n) < 0.7 as called
        from (select *, greatest(a_n, t_n, g_n, c_n) as ref_n, a_n + t_n + g_n + c_n - greatest(a_n, t_n, g_n, c_n) as alt_n, a_n + t_n + g_n + c_n as coverage from pileup) where coverage >= 40""",
    ),
    "c3_compare_pair": (
        lambda t: calling.compare_samples(t.pileup.drop("tissue"), t.sample_meta)
        .select("sample_id_a", "sample_id_b", "chrom", "pos", "ref_n_a", "alt_n_a", "called_a", "ref_n_b", "alt_n_b", "called_b"),
        """with s as (select *, greatest(a_n, t_n, g_n, c_n) as rn, a_n + t_n + g_n + c_n - greatest(a_n, t_n, g_n, c_n) as an, a_n + t_n + g_n + c_n as cov from pileup),
        q as (select sample_id, chrom, pos, rn, an, an >= 6 and an * 1.0 / (an + rn) > 0 and an * 1.0 / (an + rn) < 0.7 as called from s where cov >= 40)
        select a.sample_id as sample_id_a, b.sample_id as sample_id_b, a.chrom, a.pos, a.rn as ref_n_a, a.an as alt_n_a, a.called as called_a, b.rn as ref_n_b, b.an as alt_n_b, b.called as called_b
        from q a join q b on a.chrom = b.chrom and a.pos = b.pos and a.sample_id % 10 = b.sample_id % 10 where a.sample_id < b.sample_id and (a.called or b.called)""",
    ),
    "c4_unique_top": (
        lambda t: calling.call_variants(t.pileup, require_unique_top=True, vaf_hi=0.9).groupBy("tissue").agg(F.count(F.lit(1)).alias("n"), F.sum("n_support").alias("support")),
        """select tissue, count(*) as n, sum(n) as support from (select p.*, a_n + t_n + g_n + c_n as coverage, a_n + t_n + g_n + c_n - case ref when 'A' then a_n when 'T' then t_n when 'G' then g_n else c_n end as n,
        case ref when 'A' then a_n when 'T' then t_n when 'G' then g_n else c_n end as ref_n from pileup p) x
        where coverage >= 40 and n >= 6 and ref_n > 0 and ref_n <> n and n * 1.0 / coverage <= 0.9 group by tissue""",
    ),
    "f1_f6_f7_labels": (
        lambda t: labelled(t).select("sample_id", "chrom", "pos", filters.filter_string().alias("filter")),
        LABELS + """ select sample_id, chrom, pos, case when s = '' then 'PASS' else s end as filter from (select *, array_to_string(list_filter([case when f1 then 'near_exon' end, case when f2 then 'clustered_mutation' end,
        case when f3 then 'vdb_bias' end, case when f4 then 'rpb_bias' end, case when f5 then 'mqb_bias' end, case when f6 then 'bqb_bias' end, case when f7 then 'mqsb_bias' end], lambda x: x is not null), ';') as s from l)""",
    ),
    "f8_keep_clean": (
        lambda t: filters.keep_clean(labelled(t)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")),
        LABELS + " select sample_id, count(*) as n from l where not (f1 or f3 or f4 or f5 or f6 or f7) group by sample_id",
    ),
    "f5_sequencing_error": (
        lambda t: filters.label_seq_error(t.calls).groupBy("sample_id").agg(F.count_if(F.size("filters") > 0).alias("n_labelled"), F.count(F.lit(1)).alias("n")),
        """with support as (select distinct coverage, n_support from calls), tails as (select coverage, n_support,
        1 - list_sum(list_transform(range(0, n_support + 1), lambda k: exp(lgamma(coverage + 1) - lgamma(k + 1) - lgamma(coverage - k + 1) + k * ln(0.001) + (coverage - k) * ln(0.999)))) as p from support where coverage > n_support
        union all select coverage, n_support, 0.0 from support where coverage <= n_support)
        select sample_id, count(*) filter (p >= 1e-4) as n_labelled, count(*) as n from calls join tails using (coverage, n_support) group by sample_id""",
    ),
    "f9_keep_far": (
        lambda t: filters.keep_far(t.calls, t.exons, 7).select("sample_id", "chrom", "pos"),
        f"with {NEAR} select sample_id, chrom, pos from near where distance > 7",
    ),
    "f10_fix_reference": (
        lambda t: filters.fix_reference(t.calls.withColumns({"ref": F.when(F.col("pos") % 3 == 0, F.col("alt")).otherwise(F.col("ref")), "alt": F.when(F.col("pos") % 3 == 0, F.col("ref")).otherwise(F.when(F.col("pos") % 7 == 0, "NN").otherwise(F.col("alt")))}))
        .select("sample_id", "chrom", "pos", "ref", "alt"),
        "select sample_id, chrom, pos, ref, alt from calls where pos % 3 = 0 or pos % 7 <> 0",
    ),
    "f11_low_coverage_pairs": (
        lambda t: filters.drop_low_coverage_pairs(t.sql("select a.chrom, a.pos, a.n_support as alt_n1, a.coverage as cov1, b.coverage as cov2 from calls a join calls b on a.chrom = b.chrom and a.pos = b.pos and a.sample_id + 10 = b.sample_id")),
        """select a.chrom, a.pos, a.n_support as alt_n1, a.coverage as cov1, b.coverage as cov2 from calls a join calls b on a.chrom = b.chrom and a.pos = b.pos and a.sample_id + 10 = b.sample_id
        where a.n_support * 1.0 / a.coverage * b.coverage >= 8""",
    ),
    "f12_count_outliers": (
        lambda t: filters.count_outliers(t.calls, 15, 1400),
        "select * from (select tissue, sample_id, count(*) as n, case when count(*) < 15 then 'few' when count(*) > 1400 then 'many' end as reason from calls group by tissue, sample_id) where reason is not null",
    ),
    "f18_expressed_genes": (
        lambda t: rounded(filters.expressed_genes(t.expression, 30.0, 0.5), "share"),
        "select gene_id, round(avg(case when tpm > 30 then 1.0 else 0.0 end), 6) as share from expression group by gene_id having avg(case when tpm > 30 then 1.0 else 0.0 end) >= 0.5",
    ),
    "f19_usable_covariates": (
        lambda t: rounded(filters.usable_covariates(t.sample_meta, ["age", "bmi", "gender", "n_unique_mapped", "tissue"]), "top_share"),
        """with l as (select 'age' as covariate, cast(age as varchar) as v from sample_meta union all select 'bmi', cast(bmi as varchar) from sample_meta union all select 'gender', cast(gender as varchar) from sample_meta
        union all select 'n_unique_mapped', cast(n_unique_mapped as varchar) from sample_meta union all select 'tissue', tissue from sample_meta), c as (select covariate, v, count(*) as n from l group by 1, 2)
        select covariate, round(max(n) * 1.0 / sum(n), 6) as top_share from c group by 1 having max(n) * 1.0 / sum(n) < 0.95 and sum(case when v is null then n else 0 end) = 0""",
    ),
    "f21_collinear": (
        lambda t: uncorrelated(t),
        """with d as (select l_quantity::double as quantity, l_extendedprice::double as price, l_extendedprice * (1 - l_discount)::double as discounted, l_tax::double as tax from lineitem),
        r as (select abs(corr(quantity, price)) > 0.8 as qp, abs(corr(quantity, discounted)) > 0.8 as qd, abs(corr(quantity, tax)) > 0.8 as qt, abs(corr(price, discounted)) > 0.8 as pd, abs(corr(price, tax)) > 0.8 as pt, abs(corr(discounted, tax)) > 0.8 as dt from d),
        k as (select *, not qp as p, not qd and not (not qp and pd) as d from r) select 'quantity' as covariate, true as kept from k union all select 'price', p from k union all select 'discounted', d from k
        union all select 'tax', not qt and not (p and pt) and not (d and dt) from k""",
    ),
    "f20_common_variants": (
        lambda t: filters.common_variants(t.genotypes).select("variant_id", "rarest", "n", "classes"),
        """with c as (select variant_id, dosage, count(*) as n from genotypes group by 1, 2) select variant_id, min(n) as rarest, sum(n) as n, count(*) as classes from c group by 1 having count(*) > 1 and min(n) >= 0.1 * sum(n)""",
    ),
    "a1_type_matrix": (
        lambda t: profiles.type_matrix(t.calls, ["sample_id"]),
        f"with x as (select sample_id, {TYPE} as ty from calls) select sample_id, " + ", ".join(f"count(*) filter (ty = '{x}') as \"{x}\"" for x in profiles.TYPES) + " from x group by 1",
    ),
    "a2_context_counts": (
        lambda t: profiles.context_counts(t.calls, ["tissue"]),
        f"""with c as (select tissue, {CODE} as mut_code, {MIDDLE_FOLD} as context, count(*) as n from calls group by 1, 2, 3),
        l as (select unnest(['A', 'C', 'G', 'T', 'N']) as b), codes as (select concat(r.i, o.j) as mut_code, r.b as m from (values ('0', 'T'), ('1', 'C')) r(i, b), (values ('0', 'A'), ('1', 'T'), ('2', 'G'), ('3', 'C')) o(j, b) where r.b <> o.b),
        grid as (select t.tissue, mut_code, concat(b1.b, b2.b, m, b3.b, b4.b) as context from (select distinct tissue from calls) t, codes, l b1, l b2, l b3, l b4)
        select g.tissue, g.mut_code, g.context, coalesce(c.n, 0) as n from grid g left join c on g.tissue = c.tissue and g.mut_code = c.mut_code and g.context = c.context""",
    ),
    "a3_shrink_contexts": (
        lambda t: profiles.shrink_contexts(profiles.context_counts(t.calls, ["tissue"], dense=False), ["tissue"], 3),
        f"with c as (select tissue, {CODE} as mut_code, {MIDDLE_FOLD} as context from calls) select tissue, mut_code, substr(context, 2, 3) as context, count(*) as n from c group by 1, 2, 3",
    ),
    "a4_population_frequency": (
        lambda t: rounded(cohort.population_frequency(clean(t)), "freq"),
        f"with {FREQ} select tissue, chrom, pos, ref, alt, n_with, n_samples, round(freq, 6) as freq from freq",
    ),
    "a5_frequency_all": (
        lambda t: rounded(cohort.population_frequency(clean(t), by=None), "freq"),
        f"with {FREQ_ALL} select chrom, pos, ref, alt, n_with, n_samples, round(freq, 6) as freq from freq",
    ),
    "a6_panel_of_normals": (lambda t: cohort.panel_of_normals(clean(t), 0.3, "allele"), f"with {FREQ} select distinct chrom, pos, ref, alt from freq where freq >= 0.3"),
    "a7_drop_recurrent": (
        lambda t: cohort.drop_recurrent(clean(t), 0.1).select("sample_id", "chrom", "pos", "ref", "alt"),
        f"with {FREQ_ALL} select sample_id, chrom, pos, ref, alt from clean c where not exists (select 1 from freq f where f.chrom = c.chrom and f.pos = c.pos and f.ref = c.ref and f.alt = c.alt and freq >= 0.1)",
    ),
    "a8_distinct_mutations": (lambda t: cohort.distinct_mutations(t.calls), "select distinct chrom, pos, ref, alt from calls"),
    "a9_in_several_tissues": (
        lambda t: cohort.in_several_tissues(t.calls, 2),
        "select chrom, pos, ref, alt, count(distinct tissue) as n_tissues from calls group by 1, 2, 3, 4 having count(distinct tissue) > 2",
    ),
    "a10_frequency_summary": (
        lambda t: rounded(cohort.frequency_summary(cohort.population_frequency(clean(t))), "mean_freq", "min_freq", "max_freq"),
        f"with {FREQ} select tissue, round(avg(freq), 6) as mean_freq, round(min(freq), 6) as min_freq, round(max(freq), 6) as max_freq, max(n_samples) as n_samples, count(*) as n_mutations from freq group by 1",
    ),
    "a11_vaf_quantiles": (
        lambda t: rounded(cohort.vaf_quantiles(t.calls), "vaf"),
        " union all ".join(f"select {p}::double as p, round(quantile_cont(n_support * 1.0 / coverage, {p}), 6) as vaf from calls" for p in (0.0, 0.25, 0.5, 0.75, 1.0)),
    ),
    "a12_filter_waterfall": (
        lambda t: rounded(cohort.filter_waterfall(labelled(t), ["near_exon", "clustered_mutation", "vdb_bias"]), "share_left"),
        LABELS + """, s as (select sample_id, case when f1 then 1 when f2 then 2 when f3 then 3 else 0 end as st from l), m as (select sample_id, count(*) filter (st not in (1)) * 1.0 / count(*) as a, count(*) filter (st not in (1, 2)) * 1.0 / count(*) as b,
        count(*) filter (st = 0) * 1.0 / count(*) as c from s group by 1)
        select 1 as stage, 'near_exon' as filter, round(avg(a), 6) as share_left from m union all select 2, 'clustered_mutation', round(avg(b), 6) from m union all select 3, 'vdb_bias', round(avg(c), 6) from m""",
    ),
    "a13_type_share_by_frequency": (
        lambda t: rounded(cohort.type_share_by_frequency(cohort.population_frequency(clean(t))), "share"),
        f"""with {FREQ}, c as (select case when freq > 0 and freq <= 0.05 then 1 when freq <= 0.1 then 2 when freq <= 0.2 then 3 when freq <= 0.5 then 4 when freq <= 1 then 5 end as band, {TYPE} as mut_type, count(*) as n from freq group by 1, 2)
        select band, mut_type, n, round(n * 1.0 / sum(n) over (partition by band), 6) as share from c""",
    ),
    "a14_type_summary": (
        lambda t: rounded(profiles.type_summary(t.calls), "mean_n", "sd_n", "share"),
        f"""with c as (select sample_id, {TYPE} as mut_type, count(*) as n from calls group by 1, 2), s as (select mut_type, avg(n) as m, stddev_samp(n) as sd, sum(n) as total from c group by 1)
        select mut_type, round(m, 6) as mean_n, round(sd, 6) as sd_n, total, round(total * 1.0 / sum(total) over (), 6) as share from s""",
    ),
    "a15_type_rates": (
        lambda t: rounded(profiles.type_rates(t.calls, t.calls.filter("coverage >= 40").groupBy(scalars.fold("ref").alias("base")).agg(F.count(F.lit(1)).alias("n_bases"))), "rate"),
        f"""with b as (select case when r in ('A', 'G') then translate(r, 'ACGT', 'TGCA') else r end as base, count(*) as n_bases from (select substr(context, 3, 1) as r from calls where coverage >= 40) d group by 1),
        c as (select {TYPE} as mut_type, count(*) as n from calls group by 1) select c.mut_type, c.n, b.base, b.n_bases, round(c.n * 1.0 / b.n_bases, 6) as rate from c join b on substr(c.mut_type, 1, 1) = b.base""",
    ),
    "a16_a17_count_distribution": (
        lambda t: rounded(cohort.count_distribution(t.calls), "mean_n", "sd_n", "median_n"),
        """with c as (select tissue, sample_id, count(*) as n from calls group by 1, 2) select tissue, count(*) as n_samples, sum(n) as total, round(avg(n), 6) as mean_n, round(stddev_samp(n), 6) as sd_n, min(n) as min_n,
        round(quantile_cont(n, 0.5), 6) as median_n, max(n) as max_n from c group by 1""",
    ),
    "a18_counts_per_read": (
        lambda t: rounded(cohort.counts_per_read(t.calls, t.sample_meta), "mean_rate"),
        """with c as (select tissue, sample_id, count(*) as n from calls group by 1, 2) select c.tissue, round(avg(n * 1.0 / n_unique_mapped * 1e6), 6) as mean_rate, count(*) as n_samples from c join sample_meta m on c.sample_id = m.sample_id group by 1 having count(*) > 2""",
    ),
    "a19_cpg_ratio": (
        lambda t: rounded(profiles.cpg_ratio(t.calls, ["tissue"]), "log2_ratio"),
        f"""with c as (select tissue, case when ref in ('A', 'G') then reverse(translate(context, 'ACGT', 'TGCA')) else context end as x from calls where {TYPE} = 'C>T')
        select tissue, count(*) filter (substr(x, 4, 1) = 'G') as n_cpg, count(*) filter (substr(x, 4, 1) <> 'G') as n_other, round(log2(count(*) filter (substr(x, 4, 1) = 'G') * 1.0 / count(*) filter (substr(x, 4, 1) <> 'G')), 6) as log2_ratio from c group by 1""",
    ),
    "a21_diversity": (
        lambda t: rounded(profiles.diversity(t.expression), "entropy", "diversity"),
        """with e as (select sample_id, tpm / sum(tpm) over (partition by sample_id) as p from expression where tpm > 0), s as (select sample_id, -sum(p * log2(p)) as h, count(*) as n from e group by 1)
        select sample_id, round(h, 6) as entropy, n as n_genes, round(h / log2(n), 6) as diversity from s""",
    ),
    "a22_diversity_pseudo": (
        lambda t: rounded(profiles.diversity(t.expression, 1.0), "entropy", "diversity"),
        """with e as (select sample_id, (tpm + 1.0) / sum(tpm + 1.0) over (partition by sample_id) as p from expression), s as (select sample_id, -sum(p * log2(p)) as h, count(*) as n from e group by 1)
        select sample_id, round(h, 6) as entropy, n as n_genes, round(h / log2(n), 6) as diversity from s""",
    ),
    "a23_kmer_counts": (
        lambda t: profiles.kmer_counts(t.sql("select distinct concat(chrom, '_', pos) as site, context as seq from calls"), "site", 3),
        """with s as (select distinct concat(chrom, '_', pos) as site, context as seq from calls), k as (select site, unnest([substr(seq, 1, 3), substr(seq, 2, 3), substr(seq, 3, 3)]) as kmer from s) select site, kmer, count(*) as n from k group by 1, 2""",
    ),
    "a24_kmer_opportunity": (
        lambda t: rounded(profiles.kmer_opportunity(profiles.kmer_counts(gene_seqs(t), "gene_id", 3).groupBy("gene_id", "kmer").agg(F.sum("n").alias("n")), t.expression), "weight", digits=3),
        """with i as (select c.context, x.gene_id from calls c join exons x on c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos),
        k as (select gene_id, unnest([substr(context, 1, 3), substr(context, 2, 3), substr(context, 3, 3)]) as kmer from i), n as (select gene_id, kmer, count(*) as n from k group by 1, 2)
        select sample_id, case when substr(kmer, 2, 1) in ('A', 'G') then reverse(translate(kmer, 'ACGT', 'TGCA')) else kmer end as kmer, round(sum(n * tpm), 3) as weight from n join expression e on n.gene_id = e.gene_id group by 1, 2""",
    ),
    "a26_merge_strands": (
        lambda t: profiles.merge_strands(t.calls.groupBy("tissue", "context").agg(F.count(F.lit(1)).alias("n")), ["tissue"]),
        "select tissue, least(context, reverse(translate(context, 'ACGT', 'TGCA'))) as context, count(*) as n from calls group by 1, 2",
    ),
    "a27_coding_share": (
        lambda t: rounded(profiles.coding_share(in_exon(t).groupBy("context", "coding").agg(F.count(F.lit(1)).alias("n")), t.calls.groupBy("context").agg(F.countDistinct("chrom", "pos").alias("n_background"))), "coding_share", "rate"),
        """with i as (select c.context, c.chrom, c.pos, exists (select 1 from exons x where c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos) as coding from calls c)
        select context, count(*) filter (coding) as n_coding, count(*) as n, round(count(*) filter (coding) * 1.0 / count(*), 6) as coding_share, round(count(*) * 1.0 / count(distinct concat(chrom, '_', pos)), 6) as rate from i group by 1""",
    ),
    "a32_profile_similarity": (
        lambda t: rounded(profiles.profile_similarity(profiles.type_counts(t.calls, ["tissue"])), "cosine"),
        f"""with p as (select tissue, {TYPE} as ty, count(*)::double as n from calls group by 1, 2) select a.tissue as a, b.tissue as b, round(sum(a.n * b.n) / (select sqrt(sum(n * n)) from p where tissue = a.tissue) / (select sqrt(sum(n * n)) from p where tissue = b.tissue), 6) as cosine
        from p a join p b on a.ty = b.ty and a.tissue < b.tissue group by 1, 2""",
    ),
    "a36_catalogue_overlap": (
        lambda t: cohort.catalogue_overlap(t.calls, t.catalogue, t.depth),
        """with k as (select chrom, pos, count(*) as known, list(alt) as alts from catalogue group by 1, 2),
        m as (select c.sample_id, count(*) filter (list_contains(alts, c.alt)) as overlap_correct, count(*) filter (not list_contains(alts, c.alt)) as overlap_incorrect, count(*) as total_mut from calls c left join k on c.chrom = k.chrom and c.pos = k.pos group by 1),
        d as (select d.sample_id, coalesce(sum(known), 0) as catalogue_mut, count(*) as bases_covered from depth d left join k on d.chrom = k.chrom and d.pos = k.pos group by 1)
        select m.sample_id, overlap_correct, overlap_incorrect, total_mut, catalogue_mut, bases_covered from m left join d on m.sample_id = d.sample_id""",
    ),
    "a37_random_positions": (
        lambda t: cohort.random_positions(t.calls.select("sample_id", "chrom", "pos", "ref", "alt"), t.calls.filter("coverage >= 100").select("sample_id", "chrom", "pos", "ref")).groupBy("sample_id", "ref", "alt").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum")),
        """with a as (select sample_id, ref, alt, row_number() over (partition by sample_id, ref order by chrom, pos, alt) as k from calls),
        b as (select sample_id, ref, chrom, pos, row_number() over (partition by sample_id, ref order by md5(concat('1|', sample_id, '|', chrom, '|', pos)), chrom, pos) as k from calls where coverage >= 100),
        m as (select sample_id, ref, count(*) as m from b group by 1, 2)
        select a.sample_id, a.ref, a.alt, count(*) as n, sum(b.pos) as pos_sum from a left join m on a.sample_id = m.sample_id and a.ref = m.ref
        left join b on a.sample_id = b.sample_id and a.ref = b.ref and (a.k - 1) % m.m + 1 = b.k group by 1, 2, 3""",
    ),
    "a38_shuffle_alts": (
        lambda t: cohort.shuffle_alts(t.calls.select("sample_id", "chrom", "pos", "ref", "alt")),
        """with a as (select sample_id, chrom, pos, ref, row_number() over (partition by sample_id, ref order by chrom, pos, alt) as k from calls),
        b as (select sample_id, ref, alt, row_number() over (partition by sample_id, ref order by md5(concat('1|', sample_id, '|', chrom, '|', pos, '|', alt)), chrom, pos, alt) as k from calls)
        select a.sample_id, a.ref, a.chrom, a.pos, b.alt from a join b on a.sample_id = b.sample_id and a.ref = b.ref and a.k = b.k""",
    ),
    "a42_weighted_frequency": (
        lambda t: rounded(cohort.weighted_frequency_summary(cohort.population_frequency(clean(t), by=None)), "first_quartile", "third_quartile", "median_freq", "mean_freq", "max_freq", "min_freq"),
        f"""with {FREQ_ALL}, r as (select freq * 100 as v, unnest(range(0, n_with)) as i from freq), q as (select quantile_cont(v, 0.25) as a, quantile_cont(v, 0.75) as b, quantile_cont(v, 0.5) as c, avg(v) as d from r)
        select round(a, 6) as first_quartile, round(b, 6) as third_quartile, round(c, 6) as median_freq, round(d, 6) as mean_freq, count(*) as unique_mutations, sum(n_with) as total_mutations, max(n_samples) as total_samples, round(max(freq * 100), 6) as max_freq, round(min(freq * 100), 6) as min_freq from freq, q group by a, b, c, d""",
    ),
    "a42_cumulative_frequency": (
        lambda t: rounded(cohort.cumulative_frequency(cohort.population_frequency(clean(t), by=None)), "freq", "calls_below", "mutations_below"),
        f"""with {FREQ_ALL}, x as (select freq, count(*) as u, sum(n_with) as t from freq group by 1) select round(freq, 6) as freq, round(coalesce(sum(t) over (order by freq rows between unbounded preceding and 1 preceding), 0) * 1.0 / sum(t) over (), 6) as calls_below,
        round(coalesce(sum(u) over (order by freq rows between unbounded preceding and 1 preceding), 0) * 1.0 / sum(u) over (), 6) as mutations_below from x""",
    ),
    "a43_samples_per_tissue": (lambda t: cohort.samples_per_tissue(t.sample_meta), "select tissue, count(*) as n_samples, count(distinct subject_id) as n_subjects from sample_meta group by 1"),
    "a43_cohort_size": (lambda t: cohort.cohort_size(t.sample_meta), "select count(distinct sample_id) as n_samples, count(distinct tissue) as n_tissues, count(distinct subject_id) as n_subjects from sample_meta"),
    "a45_sibling_average": (
        lambda t: rounded(cohort.sibling_average(t.sample_meta.select("subject_id", "tissue", F.col("bmi").alias("value")), "^T[12]$", "T1+T2"), "value"),
        "select subject_id, case when tissue in ('T1', 'T2') then 'T1+T2' else tissue end as tissue, round(avg(bmi), 6) as value from sample_meta group by 1, 2",
    ),
    "a46_subjects_with_tissues": (
        lambda t: cohort.subjects_with_tissues(t.sample_meta, ["T0", "T1", "T2"], 2),
        "select subject_id, count(distinct tissue) as n_tissues from sample_meta where tissue in ('T0', 'T1', 'T2') group by 1 having count(distinct tissue) >= 2",
    ),
    "i1_overlap_join": (
        lambda t: intervals.overlap_join(t.calls.select("sample_id", "chrom", "pos"), t.exons).select("sample_id", "chrom", "pos", "exon_id"),
        "select c.sample_id, c.chrom, c.pos, x.exon_id from calls c join exons x on c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos",
    ),
    "i2_outside_exons": (
        lambda t: intervals.overlap_join(t.calls_once.select("sample_id", "chrom", "pos"), t.exons, "left_anti"),
        "select sample_id, chrom, pos from calls c where not exists (select 1 from exons x where c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos)",
    ),
    "i3_nearest": (lambda t: intervals.nearest(t.calls.select("sample_id", "chrom", "pos"), t.exons), f"with {NEAR} select sample_id, chrom, pos, distance from near"),
    "i4_left_overlap": (
        lambda t: intervals.overlap_join(t.calls.select("sample_id", "chrom", "pos"), t.exons, "left").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count("exon_id").alias("n_inside")),
        "select c.sample_id, count(*) as n, count(exon_id) as n_inside from calls c left join exons x on c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos group by 1",
    ),
    "i5_depth_per_exon": (
        lambda t: intervals.map_intervals(t.exons, t.depth, F.sum("depth").alias("depth_sum"), ["exon_id"]),
        "select x.exon_id, sum(d.depth) as depth_sum from exons x left join depth d on d.chrom = x.chrom and d.pos >= x.start_pos and d.pos < x.end_pos group by 1",
    ),
    "i6_interval_coverage": (
        lambda t: rounded(intervals.interval_coverage(t.exons, t.calls, ["exon_id"]), "share"),
        "select x.exon_id, x.end_pos - x.start_pos as length, count(c.pos) as hits, count(distinct c.pos) as covered, round(count(distinct c.pos) * 1.0 / (x.end_pos - x.start_pos), 6) as share from exons x left join calls c on c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos group by 1, 2",
    ),
    "i7_drop_positions": (
        lambda t: intervals.drop_positions(t.calls.select("sample_id", "chrom", "pos"), t.catalogue),
        "select sample_id, chrom, pos from calls c where not exists (select 1 from catalogue k where k.chrom = c.chrom and k.pos = c.pos)",
    ),
    "i8_inside_share": (
        lambda t: rounded(cohort.inside_catalogue_share(t.calls, t.exons), "share"),
        "with i as (select sample_id, exists (select 1 from exons x where c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos) as h from calls c) select sample_id, count(*) as n, count(*) filter (h) as n_inside, round(count(*) filter (h) * 1.0 / count(*), 6) as share from i group by 1",
    ),
    "i11_genes_near": (
        lambda t: intervals.genes_near(t.catalogue.select("chrom", "pos", "alt"), t.exons, 100).select("chrom", "pos", "alt", "exon_id", "tss_distance"),
        """select k.chrom, k.pos, k.alt, x.exon_id, case when x.strand = '-' then x.end_pos - 1 - k.pos else k.pos - x.start_pos end as tss_distance from catalogue k join exons x on k.chrom = x.chrom and k.pos >= x.start_pos - 100 and k.pos < x.end_pos + 100""",
    ),
    "i12_expand": (
        lambda t: intervals.expand(t.exons, 50, 20).select("exon_id", "start_pos", "end_pos"),
        "select exon_id, greatest(1, start_pos - case when strand = '-' then 20 else 50 end) as start_pos, end_pos + case when strand = '-' then 50 else 20 end as end_pos from exons",
    ),
    "i13_last_interval": (
        lambda t: intervals.last_interval(t.exons.withColumn("gene_id", F.concat("gene_id", "chrom", F.when(F.col("strand") == "-", "m").otherwise("p")))).select("gene_id", "start_pos", "end_pos"),
        """with g as (select concat(gene_id, chrom, case when strand = '-' then 'm' else 'p' end) as gene_id, start_pos, end_pos, strand from exons) select gene_id, case when min(strand) = '-' then min(start_pos) else max(start_pos) end as start_pos, case when min(strand) = '-' then arg_min(end_pos, start_pos) else arg_max(end_pos, start_pos) end as end_pos from g group by 1""",
    ),
    "x_scalars": (
        lambda t: t.calls.select("sample_id", "chrom", "pos", scalars.mutation_id().alias("id"), scalars.mutation_code().alias("code"), scalars.type_of_code(scalars.mutation_code()).alias("mut_type"), scalars.folded_context(strand_mode="revcomp").alias("rc"), scalars.amino_acid(F.substring("context", 2, 3)).alias("aa"), F.round(scalars.error_probability(F.col("coverage") / 10.0), 9).alias("err")),
        f"""select sample_id, chrom, pos, concat(chrom, '.', pos, '.', ref, '.', alt) as id, {CODE} as code, {TYPE} as mut_type, case when ref in ('A', 'G') then reverse(translate(context, 'ACGT', 'TGCA')) else context end as rc,
        substr('{scalars.AMINO_ACIDS}', cast((instr('TCAG', substr(context, 2, 1)) - 1) * 16 + (instr('TCAG', substr(context, 3, 1)) - 1) * 4 + instr('TCAG', substr(context, 4, 1)) as int), 1) as aa, round(pow(10.0, -coverage / 100.0), 9) as err from calls""",
    ),
}


def gene_seqs(t: Tables) -> DataFrame:
    return intervals.overlap_join(t.calls, t.exons.drop("strand")).select("gene_id", F.col("context").alias("seq"))


def in_exon(t: Tables) -> DataFrame:
    inside = intervals.overlap_join(t.calls, t.exons.drop("strand"), "left_semi").select("sample_id", "chrom", "pos").withColumn("coding", F.lit(True))
    return t.calls.join(inside, ["sample_id", "chrom", "pos"], "left").fillna({"coding": False})
