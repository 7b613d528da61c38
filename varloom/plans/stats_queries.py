"""Queries of windows, tests, regressions, resampling and genes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.nulls import PRIME, STEPS
from varloom.functions.tails import least_r
from varloom.operators import filters, genes, profiles, regression, selection, stats, windows
from varloom.plans.calls_queries import TYPE, rounded
from varloom.plans.projections import Tables

RANK = "rank() over (partition by {k} order by {v}) + (count(*) over (partition by {k}, {v}) - 1) / 2.0"
RANKS = "rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2.0"
GENES = "g as (select gene_id, sample_id, count(*) as n from gene_calls group by 1, 2)"
PVALUES = "pv as (select tissue, concat(chrom, '_', pos) as id, round((n_support % 50 + 0.5) / 50.0, 6) as p from calls)"
AA = "substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', cast((instr('TCAG', substr({0}, 1, 1)) - 1) * 16 + (instr('TCAG', substr({0}, 2, 1)) - 1) * 4 + instr('TCAG', substr({0}, 3, 1)) as int), 1)"
CODONS = """cod as (select gene_id, (cds_pos - 1) // 3 as ci, string_agg(base, '' order by cds_pos) as codon from cds group by 1, 2),
 sites as (select c.*, (c.cds_pos - 1) // 3 as ci, (c.cds_pos - 1) % 3 + 1 as k, cod.codon from cds c join cod on c.gene_id = cod.gene_id and (c.cds_pos - 1) // 3 = cod.ci)"""
IMPACT = f"""{CODONS}, raw as (select c.sample_id, c.tissue, c.chrom, c.pos, c.ref, c.alt, c.coverage, c.n_support, s.gene_id, s.cds_pos, s.ci, s.strand,
   case when s.strand = '-' then translate(c.ref, 'ACGT', 'TGCA') else c.ref end as ref_cod, case when s.strand = '-' then translate(c.alt, 'ACGT', 'TGCA') else c.alt end as alt_cod, s.codon, s.k
   from calls c join sites s on c.chrom = s.chrom and c.pos = s.pos),
 aas as (select *, case when length(codon) = 3 then {AA.format("concat(substr(codon, 1, k - 1), ref_cod, substr(codon, k + 1))")} end as old_aa, case when length(codon) = 3 then {AA.format("concat(substr(codon, 1, k - 1), alt_cod, substr(codon, k + 1))")} end as new_aa from raw),
 ann as (select *, case when new_aa = old_aa then 'Synonymous' when new_aa = '*' then 'Nonsense' when old_aa <> '*' then 'Missense' when old_aa = '*' then 'Stop_loss' end as impact from aas),
 opp as (select gene_id, concat(base, '>', a) as change, case when n = o then 'Synonymous' when n = '*' then 'Nonsense' when o <> '*' then 'Missense' end as impact, count(*) as sites
   from (select gene_id, base, a, {AA.format("codon")} as o, {AA.format("concat(substr(codon, 1, k - 1), a, substr(codon, k + 1))")} as n from sites, (values ('A'), ('C'), ('G'), ('T')) x(a) where a <> base and length(codon) = 3) y
   where n = o or n = '*' or o <> '*' group by 1, 2, 3)"""


def annotated(t: Tables) -> DataFrame:
    return genes.annotate_impact(t.calls, genes.codon_sites(t.cds))


def opportunity(t: Tables) -> DataFrame:
    return genes.opportunities(genes.codon_sites(t.cds))


def in_context(t: Tables) -> tuple[DataFrame, DataFrame]:
    sites = genes.codon_sites(t.cds_flanks)
    return selection.annotate_contexts(t.calls, sites, t.splice_sites), selection.context_opportunities(sites, t.splice_sites)


def context_cells(t: Tables) -> DataFrame:
    calls, possible = in_context(t)
    return possible.join(calls.groupBy("change", "impact").agg(F.count(F.lit(1)).alias("n")), ["change", "impact"], "left").fillna(0, ["n"])


CHANGE = "concat(up, {0}, down, '>', up, {1}, down) as change"
CODED = "case when strand = '-' then translate({0}, 'ACGT', 'TGCA') else {0} end"
IN_CONTEXT = f"""{IMPACT.replace("from cds c join cod", "from cds_flanks c join cod").replace("s.codon, s.k", "s.codon, s.k, s.up, s.down")},
 ends as (select up, down, {CODED.format("ref")} as r, {CODED.format("alt")} as a from calls c join splice_sites s on c.chrom = s.chrom and c.pos = s.pos),
 seen as (select change, impact, count(*) as n from (select {CHANGE.format("ref_cod", "alt_cod")}, impact from ann where impact <> 'Stop_loss' union all select {CHANGE.format("r", "a")}, 'Essential_Splice' from ends) x group by 1, 2),
 whole as (select up, down, base, a, {AA.format("codon")} as o, {AA.format("concat(substr(codon, 1, k - 1), a, substr(codon, k + 1))")} as n from sites, (values ('A'), ('C'), ('G'), ('T')) x(a) where a <> base and length(codon) = 3),
 could as (select change, impact, count(*) as sites from (select {CHANGE.format("base", "a")}, case when n = o then 'Synonymous' when n = '*' then 'Nonsense' when o <> '*' then 'Missense' end as impact from whole
   union all select {CHANGE.format("base", "a")}, 'Essential_Splice' from splice_sites, (values ('A'), ('C'), ('G'), ('T')) x(a) where a <> base) z where impact is not null group by 1, 2)"""


def pvalues(t: Tables) -> DataFrame:
    return t.sql("select tissue, concat(chrom, '_', pos) as id, round((n_support % 50 + 0.5) / 50.0, 6) as p from calls")


ROUNDS = 9
#: p of each gene's correlation of expression and calls over a tissue's samples (b = 0) and of its permutations, by rank among them.
GENE_P = f"""gn as (select gene_id, sample_id, count(*) as n from gene_calls group by 1, 2),
 ec as (select e.gene_id, m.tissue, e.sample_id, e.tpm, coalesce(g.n, 0) as n from expression e join sample_meta m on e.sample_id = m.sample_id left join gn g on g.gene_id = e.gene_id and g.sample_id = e.sample_id),
 eu as (select *, row_number() over (partition by tissue, gene_id order by sample_id) as k from ec),
 ev as (select b, gene_id, tissue, n, row_number() over (partition by b, gene_id, tissue order by md5(concat('1|', b, '|', sample_id)), sample_id) as k from ec, range(1, {ROUNDS + 1}) x(b)),
 rr as (select gene_id, tissue, 0 as b, tpm as x, n as y from ec union all select u.gene_id, u.tissue, v.b, u.tpm, v.n from eu u join ev v on u.gene_id = v.gene_id and u.tissue = v.tissue and u.k = v.k),
 ra as (select gene_id, tissue, b, round(case when stddev_pop(x) > 0 and stddev_pop(y) > 0 then abs(covar_pop(x, y) / stddev_pop(x) / stddev_pop(y)) else 0 end, 9) as a, covar_pop(x, y) as c from rr group by 1, 2, 3),
 gp as (select gene_id, tissue, b, c, count(*) over (partition by gene_id, tissue order by a desc) / {ROUNDS + 1}.0::double as p from ra)"""


#: Upper tail of chi-squared at a value, with twice a whole number of degrees of freedom.
EVEN_TAIL = "case when {0} <= 0 then 1 else list_sum(list_transform(range(0, {1}), lambda i: exp(i * ln({0} / 2.0) - {0} / 2.0 - lgamma(i + 1)))) end"


def gene_p(t: Tables) -> DataFrame:
    """Both tables, with a row for each gene and sample or permutation, are read several times and kept: they are small beside the calls."""
    both = genes.expression_with_counts(t.expression, genes.gene_counts(t.gene_calls)).join(t.sample_meta.select("sample_id", "tissue"), "sample_id").persist()
    return stats.permuted_p(both, "tpm", "n", "sample_id", ["gene_id", "tissue"], ROUNDS).persist()


def real_and_permuted(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = gene_p(t)
    return p.filter("perm_id = 0").drop("perm_id"), p.filter("perm_id > 0")


def stranded(t: Tables) -> DataFrame:
    return genes.transcribed_strand(t.gene_calls)


STRANDED = f"s as (select *, {TYPE} as mut_type, case when strand = '+' then ref in ('A', 'G') else not ref in ('A', 'G') end as transcribed from gene_calls)"


def features(t: Tables) -> DataFrame:
    return t.genotypes.select(F.col("variant_id").alias("feature"), "sample_id", F.col("dosage").cast("double").alias("x"))


def phenotypes(t: Tables) -> DataFrame:
    return t.sql("select gene_id as phenotype, sample_id, tpm as y from expression")


BY_GENDER = "select s.tissue, s.n, m.gender from sample_counts s join sample_meta m on s.sample_id = m.sample_id"
AGAINST = "select b.tissue, a.n as x, b.n as y from sample_counts a join sample_counts b on a.subject_id = b.subject_id where a.tissue = 'T0' and b.tissue <> 'T0'"
#: Rows of the ten samples of a tissue in order, with doubled ranks; and every way to choose some of them.
DEALT = f"""b as ({BY_GENDER}), g as (select tissue, min(gender) as g from b group by 1),
 k as (select b.tissue, gender = g as mine, row_number() over (partition by b.tissue order by n, gender) - 1 as i, 2 * ({RANK.format(k='b.tissue', v='n')}) as r from b join g on b.tissue = g.tissue),
 s as (select tissue, count(*) filter (mine) as n1, count(*) filter (not mine) as n2, sum(r) filter (mine) as rs from k group by 1)"""
MASKS = "m as (select tissue, mask, sum(case when (mask >> i) & 1 = 1 then r else 0 end) as t, sum((mask >> i) & 1) as c from k, range(0, 1024) x(mask) group by 1, 2)"


def resampled(rounds: int, places: str, group: str = "tissue", name: str = "tissue") -> str:
    """SQL of a bootstrap of the counts of samples: how often each row is drawn, and the mean of the places that ``places`` gives for n values."""
    hashed = "('0x' || substr(md5(concat({0})), 1, 8))::bigint"
    times = " + ".join(f"(u >= {k})::int" for k in STEPS)
    return f"""with d as (select {group} as grp, n::double as v, row_number() over (partition by {group}, n) as j from sample_counts), x as (select *, {hashed.format("'1|', grp, '|', v, '|', j")} % {PRIME} as x from d),
        f as (select b, {hashed.format("'1|', b, '|a'")} % {PRIME - 1} + 1 as fa, {hashed.format("'1|', b, '|b'")} % {PRIME} as fb from range(1, {rounds + 1}) q(b)),
        w as (select grp, v, j, b, {times} as w from (select *, (fa * x + fb) % {PRIME} as u from x, f) y union all select grp, v, j, 0, 1 from x),
        c as (select *, sum(w) over (partition by grp, b order by v, j) as upto, sum(w) over (partition by grp, b) as n from w),
        s as (select grp, b, sum(v * greatest(0, least(upto, last) - greatest(upto - w, first - 1))) / any_value(last - first + 1) as s from c, lateral {places} p where n > 0 group by 1, 2),
        o as (select grp, s as o from s where b = 0)
        select s.grp as {name}, round(o, 6) as estimate, round(o + quantile_cont(o - s, 0.025), 6) as low, round(o + quantile_cont(o - s, 0.975), 6) as high from s join o on s.grp = o.grp where b > 0 group by s.grp, o"""


CORR = "corr({0}, {1})"
#: The p of pairs that the scan with covariates returns, and the smallest |r| that has it, for all degrees of freedom of pairs of 40 samples.
MOST_P = 0.05
LEAST_R = f"cuts as (select * from (values {', '.join(f'({df}, {least_r(df, MOST_P)!r})' for df in range(1, 39))}) x(df, least))"
#: Residuals of a value on age and bmi within each key: the two-predictor least squares solution from centred sums.
FREED = """{out}_m as (select {k} as k, t.sample_id, t.{v} - avg(t.{v}) over w as y, m.age - avg(m.age) over w as a, m.bmi - avg(m.bmi) over w as b from {t} t join sample_meta m on t.sample_id = m.sample_id
  where t.{v} is not null and m.age is not null and m.bmi is not null window w as (partition by {k})),
 {out}_s as (select k, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as yb from {out}_m group by 1),
 {out} as (select m.k, sample_id, y - a * (ay * bb - yb * ab) / (aa * bb - ab * ab) - b * (yb * aa - ay * ab) / (aa * bb - ab * ab) as e from {out}_m m join {out}_s s on m.k = s.k)"""
SCAN = "select variant_id as feature, gene_id as phenotype, count(*) as n, regr_slope(tpm, dosage) as b, corr(dosage, tpm) as r from genotypes g join expression e on g.sample_id = e.sample_id group by 1, 2"

QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {
    "w1_distance_to_next": (
        lambda t: windows.distance_to_next(t.calls, ["sample_id"]).select("sample_id", "chrom", "pos", "distance"),
        "select sample_id, chrom, pos, lead(pos) over (partition by sample_id, chrom order by pos) - pos as distance from calls",
    ),
    "w2_distance_summary": (
        lambda t: rounded(windows.distance_summary(t.calls, ["tissue", "sample_id"]), "median_d", "mean_d", "sd_d", "var_d"),
        """with d as (select tissue, sample_id, coalesce(lead(pos) over (partition by sample_id, chrom order by pos) - pos, 0) as d from calls)
        select tissue, sample_id, round(quantile_cont(d, 0.5), 6) as median_d, round(avg(d), 6) as mean_d, round(stddev_samp(d), 6) as sd_d, round(var_samp(d), 6) as var_d, count(*) as n from d group by 1, 2""",
    ),
    "w3_below_percentile": (
        lambda t: windows.below_percentile(t.calls, "coverage", 0.85, ["tissue"]).groupBy("tissue").agg(F.count(F.lit(1)).alias("n"), F.max("coverage").alias("most")),
        "select c.tissue, count(*) as n, max(coverage) as most from calls c join (select tissue, quantile_cont(coverage, 0.85) as q from calls group by 1) x on c.tissue = x.tissue where coverage < q group by 1",
    ),
    "w4_step_score": (
        lambda t: rounded(windows.step_score(t.calls.groupBy("tissue", "coverage").agg(F.avg("n_support").alias("v")), "v", "coverage", 4, ["tissue"]), "v", "step", "step_change"),
        """with g as (select tissue, coverage, avg(n_support) as v from calls group by 1, 2), s as (select *, avg(v) over (partition by tissue order by coverage rows between 3 preceding and current row)
        - coalesce(avg(v) over (partition by tissue order by coverage rows between 1 following and 4 following), v) as step from g)
        select tissue, coverage, round(v, 6) as v, round(step, 6) as step, round(coalesce(lead(step) over (partition by tissue order by coverage) - step, 0), 6) as step_change from s""",
    ),
    "w5_change_point": (
        lambda t: windows.change_point(windows.step_score(t.calls.groupBy("tissue", "coverage").agg(F.sum("n_support").alias("v")), "v", "coverage", 4, ["tissue"]).withColumn("step_change", F.round("step_change", 6)), "coverage", 25, ["tissue"]),
        """with g as (select tissue, coverage, sum(n_support) as v from calls group by 1, 2), s as (select *, avg(v) over (partition by tissue order by coverage rows between 3 preceding and current row)
        - coalesce(avg(v) over (partition by tissue order by coverage rows between 1 following and 4 following), v) as step from g),
        c as (select *, round(coalesce(lead(step) over (partition by tissue order by coverage) - step, 0), 6) as ch, row_number() over (partition by tissue order by coverage) as r from s)
        select tissue, coverage as cutoff from (select *, row_number() over (partition by tissue order by ch, r) as k from c where r <= 25) where k = 1""",
    ),
    "w6_top_n": (
        lambda t: windows.top_n(genes.gene_counts(t.gene_calls), 3, [F.desc("n"), F.col("gene_id")], ["sample_id"]).select("sample_id", "gene_id", "n", "rank"),
        f"with {GENES} select * from (select sample_id, gene_id, n, row_number() over (partition by sample_id order by n desc, gene_id) as rank from g) where rank <= 3",
    ),
    "w7_rank_scores": (
        lambda t: windows.rank_scores(t.gene_calls.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_support").alias("s")), {"most_calls": [F.desc("n"), F.col("gene_id")], "fewest_calls": [F.col("n"), F.desc("s"), F.col("gene_id")]}, 15),
        """with g as (select gene_id, count(*) as n, sum(n_support) as s from gene_calls group by 1), r as (select *, row_number() over (order by n desc, gene_id) as a, row_number() over (order by n, s desc, gene_id) as b from g)
        select gene_id, n, s, case when a <= 15 then 16 - a else 0 end as most_calls, case when b <= 15 then 16 - b else 0 end as fewest_calls from r""",
    ),
    "w8_limits": (
        lambda t: windows.limit_per_gene_and_sample(t.gene_calls, 5, 199).groupBy("sample_id", "gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum")),
        """with f as (select * from (select *, row_number() over (partition by gene_id, sample_id order by chrom, pos, alt) as r from gene_calls) where r <= 5), k as (select sample_id from f group by 1 having count(*) <= 199)
        select sample_id, gene_id, count(*) as n, sum(pos) as pos_sum from f where sample_id in (select sample_id from k) group by 1, 2""",
    ),
    "w9_top_hits": (
        lambda t: rounded(windows.top_hits(regression.association_scan(features(t), phenotypes(t), top=50).withColumn("p", -F.round(F.abs("r"), 9)), 50).select("feature", "phenotype", "r"), "r"),
        f"with s as ({SCAN}) select feature, phenotype, round(r, 6) as r from s where not isnan(r) order by round(abs(r), 9) desc, feature, phenotype limit 50",
    ),
    "w10_quantile_groups": (
        lambda t: windows.quantile_groups(t.expression, "tpm", 11).groupBy("quantile_group").agg(F.count(F.lit(1)).alias("n")),
        """with q as (select quantile_cont(tpm, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as q from expression)
        select greatest(1, least(10, """ + " + ".join(f"(q[{i}] <= tpm)::int" for i in range(1, 12)) + """)) as quantile_group, count(*) as n from expression, q group by 1""",
    ),
    "w11_residual_in_group": (
        lambda t: rounded(windows.residual_in_group(t.expression, "tpm", "sample_id", 5).groupBy("quantile_group").agg(F.max("residual").alias("most"), F.min("residual").alias("least"), F.count(F.lit(1)).alias("n")), "most", "least"),
        """with q as (select quantile_cont(sample_id, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from expression), g as (select e.*, greatest(1, least(4, """ + " + ".join(f"(q[{i}] <= sample_id)::int" for i in range(1, 6)) + """)) as quantile_group from expression e, q),
        m as (select quantile_group, quantile_cont(tpm, 0.5) as m from g group by 1) select g.quantile_group, round(max(tpm - m), 6) as most, round(min(tpm - m), 6) as least, count(*) as n from g join m on g.quantile_group = m.quantile_group group by 1""",
    ),
    "w12_rankit": (
        lambda t: windows.rankit(t.expression, "tpm", ["gene_id"]).withColumn("rank", windows.average_rank("tpm", ["gene_id"])).select("gene_id", "sample_id", "rank", F.round("rankit", 3).alias("rankit")).drop("rankit"),
        f"select gene_id, sample_id, {RANK.format(k='gene_id', v='tpm')} as rank from expression",
    ),
    "w12_rankit_scores": (lambda t: windows.rankit(t.expression, "tpm", ["gene_id"]), None),
    "w13_quartile_contrast": (
        lambda t: windows.quartile_contrast(t.expression, "tpm", ["gene_id"]).groupBy("gene_id", "side").agg(F.count(F.lit(1)).alias("n")),
        """with q as (select gene_id, quantile_cont(tpm, 0.25) as a, quantile_cont(tpm, 0.75) as b from expression group by 1) select e.gene_id, case when tpm <= a then 'low' else 'high' end as side, count(*) as n from expression e join q on e.gene_id = q.gene_id where tpm <= a or tpm >= b group by 1, 2""",
    ),
    "w15_extreme_fraction": (
        lambda t: windows.extreme_fraction(t.expression, "tpm", 0.1, ["sample_id"]).select("sample_id", "gene_id", "side"),
        """select sample_id, gene_id, case when r <= 0.1 then 'bottom' else 'top' end as side from (select *, percent_rank() over (partition by sample_id order by tpm) as r from expression) where r <= 0.1 or r >= 1 - 0.1""",
    ),
    "w16_deidentify": (
        lambda t: windows.deidentify(t.calls.select(F.col("sample_id").cast("string").alias("id"), "chrom", "pos"), "id", "S"),
        "select concat('S', lpad(cast(dense_rank() over (order by cast(sample_id as varchar)) as varchar), 6, '0')) as id, chrom, pos from calls",
    ),
    "t1_pearson": (
        lambda t: rounded(stats.correlate(t.sql("select e.gene_id, e.tpm, m.age from expression e join sample_meta m on e.sample_id = m.sample_id"), "tpm", "age", ["gene_id"], with_p=False), "r", "t"),
        """with c as (select gene_id, count(*) as n, corr(tpm, age) as r from expression e join sample_meta m on e.sample_id = m.sample_id group by 1) select gene_id, n, round(r, 6) as r, round(r * sqrt((n - 2) / (1 - r * r)), 6) as t from c""",
    ),
    "t1_spearman": (
        lambda t: rounded(stats.correlate(t.sql("select e.gene_id, e.tpm, m.age from expression e join sample_meta m on e.sample_id = m.sample_id"), "tpm", "age", ["gene_id"], "spearman", with_p=False), "r", "t"),
        f"""with b as (select e.gene_id, e.tpm, m.age from expression e join sample_meta m on e.sample_id = m.sample_id), k as (select gene_id, {RANK.format(k='gene_id', v='tpm')} as x, {RANK.format(k='gene_id', v='age')} as y from b),
        c as (select gene_id, count(*) as n, corr(x, y) as r from k group by 1) select gene_id, n, round(r, 6) as r, round(r * sqrt((n - 2) / (1 - r * r)), 6) as t from c""",
    ),
    "t1_correlation_p": (lambda t: stats.correlate(t.sql("select e.gene_id, e.tpm, m.age from expression e join sample_meta m on e.sample_id = m.sample_id"), "tpm", "age", ["gene_id"]), None),
    "t2_rank_sum": (
        lambda t: rounded(stats.rank_sum(t.sql("select e.gene_id, e.tpm, m.gender from expression e join sample_meta m on e.sample_id = m.sample_id"), "tpm", "gender", ["gene_id"]).drop("p"), "z"),
        f"""with b as (select e.gene_id, e.tpm, m.gender from expression e join sample_meta m on e.sample_id = m.sample_id), k as (select gene_id, gender, {RANK.format(k='gene_id', v='tpm')} as r, count(*) over (partition by gene_id, tpm) as c from b),
        s as (select gene_id, count(*) filter (gender = 1) as n1, count(*) filter (gender <> 1) as n2, sum(r) filter (gender = 1) as rs, sum(c * c - 1) as ties from k group by 1)
        select gene_id, n1, n2, rs - n1 * (n1 + 1) / 2.0 as w, round((rs - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties * 1.0 / ((n1 + n2) * (n1 + n2 - 1)))), 6) as z from s""",
    ),
    "t3_signed_rank": (
        lambda t: rounded(stats.signed_rank(t.pairs, "alt_n1", "alt_n2", ["subject_id"]), "z"),
        f"""with d as (select subject_id, alt_n1 - alt_n2 as d, abs(alt_n1 - alt_n2) as a from pairs where alt_n1 <> alt_n2), k as (select subject_id, d, {RANK.format(k='subject_id', v='a')} as r, count(*) over (partition by subject_id, a) as c from d),
        s as (select subject_id, count(*) as n, sum(case when d > 0 then r else 0 end) as v, sum(c * c - 1) as ties from k group by 1)
        select subject_id, n, v, round((v - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) as z from s""",
    ),
    "t3_ks": (
        lambda t: rounded(stats.ks_two_sample(t.calls.filter("tissue in ('T0', 'T1')"), "coverage", "tissue", [], exact=10_000).drop("p_exact"), "d", "p"),
        """with c as (select coverage as v, count(*) filter (tissue = 'T0') as a, count(*) filter (tissue = 'T1') as b from calls where tissue in ('T0', 'T1') group by 1),
        g as (select a, b, abs(sum(a) over (order by v) * 1.0 / sum(a) over () - sum(b) over (order by v) * 1.0 / sum(b) over ()) as gap from c), s as (select max(gap)::double as d, sum(a) as n1, sum(b) as n2 from g),
        x as (select *, d * sqrt(n1 * n2 / (n1 + n2)::double) as x from s)
        select round(d, 6) as d, n1, n2, round(case when x < 0.1 then 1.0 else least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 61), lambda k: (case when k % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0 * k * k * x * x))))) end, 6) as p from x""",
    ),
    "t2_exact_p": (
        lambda t: rounded(stats.rank_sum(t.sql(BY_GENDER), "n", "gender", ["tissue"], exact=50).select("tissue", "n1", "n2", "w", "p_exact"), "p_exact", digits=9),
        f"""with {DEALT}, {MASKS} select s.tissue, n1, n2, any_value(rs) / 2.0 - n1 * (n1 + 1) / 2.0 as w, round(least(1.0, 2 * least(avg((t <= rs)::int), avg((t >= rs)::int))), 9) as p_exact
        from s join m on s.tissue = m.tissue where c = n1 group by s.tissue, n1, n2""",
    ),
    "t3_exact_p": (
        lambda t: rounded(stats.signed_rank(t.sql(AGAINST), "x", "y", ["tissue"], exact=50).select("tissue", "n", "v", "p_exact"), "p_exact", digits=9),
        f"""with d as (select tissue, x - y as d, abs(x - y) as a from ({AGAINST}) q where x <> y), k as (select tissue, d > 0 as up, row_number() over (partition by tissue order by a, d) - 1 as i, 2 * ({RANK.format(k='tissue', v='a')}) as r from d),
        s as (select tissue, count(*) as n, coalesce(sum(r) filter (up), 0) as rs from k group by 1), m as (select tissue, mask, sum(case when (mask >> i) & 1 = 1 then r else 0 end) as t from k, range(0, 1024) x(mask) group by 1, 2)
        select s.tissue, n, rs / 2.0 as v, round(least(1.0, 2 * least(avg((t <= rs)::int), avg((t >= rs)::int))), 9) as p_exact from s join m on s.tissue = m.tissue group by s.tissue, n, rs""",
    ),
    "t3_ks_exact_p": (
        lambda t: rounded(stats.ks_two_sample(t.sql(BY_GENDER), "n", "gender", ["tissue"], exact=10_000).select("tissue", "n1", "n2", "d", "p", "p_exact"), "d", "p", "p_exact", digits=6),
        f"""with {DEALT}, {MASKS}, ends as (select tissue, max(i) as i from k group by tissue, r),
        own as (select tissue, i, sum(mine::int) over (partition by tissue order by i) as a from k), o as (select own.tissue, max(abs(a * n2 - (own.i + 1 - a) * n1)) as far from own join ends on own.tissue = ends.tissue and own.i = ends.i join s on own.tissue = s.tissue group by 1),
        every as (select k.tissue, mask, k.i, sum((mask >> k.i) & 1) over (partition by k.tissue, mask order by k.i) as a from k join m on k.tissue = m.tissue join s on k.tissue = s.tissue where c = n1),
        f as (select e.tissue, mask, max(abs(a * n2 - (e.i + 1 - a) * n1)) as far from every e join ends on e.tissue = ends.tissue and e.i = ends.i join s on e.tissue = s.tissue group by 1, 2),
        p as (select f.tissue, any_value(o.far) as far, avg((f.far >= o.far)::int) as p_exact from f join o on f.tissue = o.tissue group by 1), x as (select p.*, n1, n2, far / (n1 * n2)::double as d, far / (n1 * n2)::double * sqrt(n1 * n2 / (n1 + n2)::double) as x from p join s on p.tissue = s.tissue)
        select tissue, n1, n2, round(d, 6) as d, round(p_exact, 6) as p_exact, round(case when x < 0.1 then 1.0 else least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 61), lambda k: (case when k % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0 * k * k * x * x))))) end, 6) as p from x""",
    ),
    "t4_bootstrap_mean": (
        lambda t: rounded(stats.bootstrap_ci(t.sample_counts, "n", ["tissue"], "mean", 200), "estimate", "low", "high"),
        resampled(200, "(select 1 as first, n as last)"),
    ),
    "t4_bootstrap_trimmed": (
        lambda t: rounded(stats.bootstrap_ci(t.sample_counts, "n", ["tissue"], "trimmed_mean", 100), "estimate", "low", "high"),
        resampled(100, "(select floor(n * 0.1::double) + 1 as first, n - floor(n * 0.1::double) as last)"),
    ),
    "t4_bootstrap_median": (
        lambda t: rounded(stats.bootstrap_ci(t.sample_counts.withColumn("even", F.col("sample_id") % 2), "n", ["even"], "median", 100), "estimate", "low", "high"),
        resampled(100, "(select (n + 1) // 2 as first, n // 2 + 1 as last)", "sample_id % 2", "even"),
    ),
    "t5_bh": (
        lambda t: rounded(stats.adjust(pvalues(t), "p", ["tissue"]).groupBy("tissue", "p").agg(F.max("p_adjusted").alias("p_adjusted"), F.count(F.lit(1)).alias("n")), "p_adjusted"),
        f"""with {PVALUES}, r as (select tissue, p, p * count(*) over (partition by tissue) / count(*) over (partition by tissue order by p) as raw from pv),
        a as (select tissue, p, least(1.0, min(raw) over (partition by tissue order by p desc)) as q from r) select tissue, p, round(max(q), 6) as p_adjusted, count(*) as n from a group by 1, 2""",
    ),
    "t5_bonferroni": (
        lambda t: rounded(stats.adjust(pvalues(t).withColumn("p", F.col("p") / 1000), "p", [], "bonferroni").groupBy("tissue").agg(F.min("p_adjusted").alias("least"), F.avg("p_adjusted").alias("mean")), "least", "mean"),
        f"with {PVALUES}, n as (select count(*) as m from pv) select tissue, round(min(least(1.0, p / 1000 * m)), 6) as least, round(avg(least(1.0, p / 1000 * m)), 6) as mean from pv, n group by 1",
    ),
    "t6_permutation_fdr": (
        lambda t: rounded(stats.permutation_fdr(*real_and_permuted(t)), "fdr"),
        f"""with {GENE_P}, pt as (select p, count(*) filter (b = 0) as a, count(*) filter (b > 0) as b from gp group by 1),
        f as (select p, a, sum(b) over (order by p) * 1.0 / sum(b) over () * sum(a) over () / sum(a) over (order by p) as fdr from pt) select p, a as n, round(fdr, 6) as fdr from f where a > 0""",
    ),
    "t7_uniform_fdr": (
        lambda t: rounded(stats.uniform_fdr(pvalues(t), "p", ["tissue"]), "fdr"),
        f"with {PVALUES}, pt as (select tissue, p, count(*) as n from pv group by 1, 2) select tissue, p, n, round(least(1.0, sum(n) over (partition by tissue) * p / sum(n) over (partition by tissue order by p)), 6) as fdr from pt",
    ),
    "t8_t16_permuted_correlation": (
        lambda t: rounded(stats.permuted_correlation(t.sample_counts, "n", "age", "sample_id", ["tissue"], 50), "observed", "perm_mean", "perm_sd", "p"),
        """with c as (select s.*, b from sample_counts s, range(1, 51) x(b)), u as (select b, tissue, sample_id, n, row_number() over (partition by b, tissue order by sample_id) as k from c),
        v as (select b, tissue, age, row_number() over (partition by b, tissue order by md5(concat('1|', b, '|', sample_id)), sample_id) as k from c),
        r as (select u.b, u.tissue, corr(u.n, v.age) as r from u join v on u.b = v.b and u.tissue = v.tissue and u.k = v.k group by 1, 2), o as (select tissue, corr(n, age) as o from sample_counts group by 1)
        select r.tissue, round(o, 6) as observed, round(avg(r), 6) as perm_mean, round(stddev_samp(r), 6) as perm_sd, round(avg((r >= o)::int), 6) as p from r join o on r.tissue = o.tissue group by r.tissue, o""",
    ),
    "t9_fisher": (
        lambda t: rounded(stats.fisher_combine(pvalues(t), "p", ["tissue"], with_p=False), "statistic"),
        f"with {PVALUES} select tissue, round(-2 * sum(ln(p)), 6) as statistic, count(*) as n from pv group by 1",
    ),
    "t9_fisher_p": (
        lambda t: rounded(stats.fisher_combine(pvalues(t), "p", ["tissue", "id"]), "statistic", "p_combined"),
        f"with {PVALUES}, s as (select tissue, id, -2 * sum(ln(p)) as st, count(*) as n from pv group by 1, 2) select tissue, id, n, round(st, 6) as statistic, round({EVEN_TAIL.format('st', 'n')}, 6) as p_combined from s",
    ),
    "t10_binomial_enrichment": (
        lambda t: rounded(stats.binomial_enrichment(t.sql("select g.tissue, g.gene_id, g.n, k.total, 1.0D / 40 as share from (select tissue, gene_id, count(*) as n from gene_calls group by 1, 2) g join (select tissue, count(*) as total from gene_calls group by 1) k on g.tissue = k.tissue"), ["tissue"], "share").select("tissue", "gene_id", "n", "p_low", "p_high", "fdr"), "p_low", "p_high", "fdr"),
        """with g as (select tissue, gene_id, count(*) as n from gene_calls group by 1, 2), k as (select tissue, count(*) as total from gene_calls group by 1),
        p as (select g.tissue, gene_id, n, list_sum(list_transform(range(0, n + 1), lambda i: exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln(0.025) + (total - i) * ln(0.975)))) as lo from g join k on g.tissue = k.tissue),
        r as (select *, 1 - lo as hi, lo * count(*) over (partition by tissue) / count(*) over (partition by tissue order by lo) as rl, (1 - lo) * count(*) over (partition by tissue) / count(*) over (partition by tissue order by 1 - lo) as rh from p),
        f as (select *, least(1.0, min(rl) over (partition by tissue order by lo desc)) as fl, least(1.0, min(rh) over (partition by tissue order by hi desc)) as fh from r)
        select tissue, gene_id, n, round(least(1.0, lo), 6) as p_low, round(greatest(0.0, hi), 6) as p_high, round(least(fl, fh), 6) as fdr from f""",
    ),
    "t11_overlap_significance": (
        lambda t: rounded(stats.overlap_significance(hyper(t), "hits", "drawn", "marked", "total", []).select("sample_id", "hits", "drawn", "marked", "total", "p"), "p"),
        """with k as (select distinct chrom, pos from catalogue), u as (select distinct chrom, pos from calls), n as (select count(*) as total from u), m as (select count(*) as marked from k),
        h as (select c.sample_id, count(k.pos) as hits, count(*) as drawn from calls c left join k on c.chrom = k.chrom and c.pos = k.pos group by 1)
        select sample_id, hits, drawn, marked, total, round(least(1.0, list_sum(list_transform(range(hits, least(drawn, marked) + 1), lambda i: exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(total - marked + 1) - lgamma(drawn - i + 1) - lgamma(total - marked - drawn + i + 1)
        - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1))))), 6) as p from h, n, m""",
    ),
    "t12_set_enrichment": (
        lambda t: rounded(stats.set_enrichment(t.gene_calls.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 0"), t.exons.select("gene_id").distinct(), t.sql("select distinct concat('term', p_size % 7) as term, concat('G', cast(cast(floor(p_partkey / 50.0) as int) as varchar(9))) as gene_id from part where p_partkey % 25 < 5")).drop("genes", "p_adjusted"), "p"),
        """with s as (select gene_id from gene_calls group by 1 having count(*) % 2 = 0), u as (select distinct gene_id from exons), t as (select distinct concat('term', p_size % 7) as term, concat('G', cast(cast(floor(p_partkey / 50.0) as int) as varchar(9))) as gene_id from part where p_partkey % 25 < 5),
        z as (select (select count(*) from u) as nu, (select count(*) from s) as ns), h as (select term, count(*) as n_term, count(s.gene_id) as n_overlap from t left join s on t.gene_id = s.gene_id where t.gene_id in (select gene_id from u) group by 1)
        select term, n_term, n_overlap, nu as n_universe, ns as n_selected, round(least(1.0, list_sum(list_transform(range(n_overlap, least(ns, n_term) + 1), lambda i: case when nu - n_term - ns + i < 0 then 0 else exp(lgamma(n_term + 1) - lgamma(i + 1) - lgamma(n_term - i + 1) + lgamma(nu - n_term + 1) - lgamma(ns - i + 1)
        - lgamma(nu - n_term - ns + i + 1) - lgamma(nu + 1) + lgamma(ns + 1) + lgamma(nu - ns + 1)) end))), 6) as p from h, z""",
    ),
    "t14_quartile_profiles": (
        lambda t: rounded(windows.quartile_contrast(t.sample_counts, "bmi", ["tissue"]).join(profiles.type_counts(t.calls, ["sample_id"]).withColumnRenamed("n", "k"), "sample_id").groupBy("mut_type", "side").agg(F.avg("k").alias("mean_n")), "mean_n"),
        f"""with q as (select tissue, quantile_cont(bmi, 0.25) as a, quantile_cont(bmi, 0.75) as b from sample_counts group by 1), s as (select c.sample_id, case when bmi <= a then 'low' else 'high' end as side from sample_counts c join q on c.tissue = q.tissue where bmi <= a or bmi >= b),
        k as (select sample_id, {TYPE} as mut_type, count(*) as k from calls group by 1, 2) select mut_type, side, round(avg(k), 6) as mean_n from k join s on k.sample_id = s.sample_id group by 1, 2""",
    ),
    "t15_permuted_cosine": (
        lambda t: rounded(stats.permuted_cosine(t.sample_counts.select("tissue", "sample_id", F.col("n").cast("double").alias("n"), F.col("age").cast("double").alias("age")), "n", "age", "sample_id", ["tissue"], 40), "cosine", "p"),
        """with c as (select s.*, b from sample_counts s, range(1, 41) x(b)), u as (select b, tissue, n::double as n, row_number() over (partition by b, tissue order by sample_id) as k from c),
        v as (select b, tissue, age::double as age, row_number() over (partition by b, tissue order by md5(concat('1|', b, '|', sample_id)), sample_id) as k from c),
        r as (select u.b, u.tissue, sum(n * age) / sqrt(sum(n * n) * sum(age * age)) as r from u join v on u.b = v.b and u.tissue = v.tissue and u.k = v.k group by 1, 2), o as (select tissue, sum(n * age) / sqrt(sum(n::double * n) * sum(age::double * age)) as o from sample_counts group by 1)
        select r.tissue, round(o, 6) as cosine, round(avg((r >= o)::int), 6) as p from r join o on r.tissue = o.tissue group by r.tissue, o""",
    ),
    "t17_t25_driver_enrichment": (
        lambda t: stats.driver_enrichment(t.gene_calls.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")), drivers(t), stats.matched_random_sets(genes.expression_stats(t.expression), drivers(t), "mean_tpm", 50, 4)),
        None,
    ),
    "t19_silhouette": (
        lambda t: rounded(stats.silhouette(t.base("embeddings"), "embedding", "label", "vec_id"), "silhouette", digits=4),
        """with e as (select vec_id, label, embedding::double[] as v from embeddings), d as (select a.vec_id, a.label, b.label as o, sum(pow(list_distance(a.v, b.v), 2)) / greatest(1, count(*) - (case when a.label = b.label then 1 else 0 end)) as m, count(*) as n from e a, e b group by 1, 2, 3),
        w as (select vec_id, label, max(m) filter (label = o and n > 1) as a, min(m) filter (label <> o) as b from d group by 1, 2) select label, round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 4) as silhouette, count(*) as n from w group by 1""",
    ),
    "t20_principal_components": (lambda t: stats.principal_components(t.base("embeddings"), "embedding", 0.5, 20).select("vec_id", "label", "scores"), None),
    "t21_dnds_global": (lambda t: genes.dnds_global(annotated(t), opportunity(t)), None),
    "t21_context_cells": (context_cells, f"with {IN_CONTEXT} select c.change, c.impact, c.sites, coalesce(s.n, 0) as n from could c left join seen s on c.change = s.change and c.impact = s.impact"),
    "t21_context_ratios": (lambda t: selection.context_ratios(*in_context(t)), None),
    "t21_ratios_by_tissue": (lambda t: selection.context_ratios(*in_context(t), ["tissue"]), None),
    "t22_dnds_per_gene": (
        lambda t: rounded(genes.dnds_per_gene(annotated(t), opportunity(t), with_p=False).select("gene_id", "n_syn", "n_mis", "n_non", "e_syn", "e_mis", "e_non", "wmis", "wnon", "lr_mis", "lr_all"), "e_syn", "e_mis", "e_non", "wmis", "wnon", "lr_mis", "lr_all", digits=4),
        f"""with {IMPACT}, n as (select gene_id, concat(ref_cod, '>', alt_cod) as change, impact, count(*) as n from ann group by 1, 2, 3), cells as (select o.*, coalesce(n.n, 0) as n from opp o left join n on o.gene_id = n.gene_id and o.change = n.change and o.impact = n.impact),
        rates as (select change, sum(n) * 1.0 / sum(sites) as rate from cells where impact = 'Synonymous' group by 1),
        s as (select gene_id, sum(n) filter (impact = 'Synonymous') as n1, sum(n) filter (impact = 'Missense') as n2, coalesce(sum(n) filter (impact = 'Nonsense'), 0) as n3, sum(sites * rate) filter (impact = 'Synonymous') as e1, sum(sites * rate) filter (impact = 'Missense') as e2, coalesce(sum(sites * rate) filter (impact = 'Nonsense'), 0) as e3
          from cells c join rates r on c.change = r.change group by 1),
        f as (select *, (n1 + n2 + n3) / (e1 + e2 + e3) as r0, greatest(1e-10, (n1 + n2) / (e1 + e2)) as r1, greatest(1e-10, n1 / e1) as r2 from s where e1 > 0 and e2 > 0),
        w as (select *, case when n2 = 0 or e2 = 0 then 0 else n2 / e2 / r2 end as wm, case when n3 = 0 or e3 = 0 then 0 else n3 / e3 / r2 end as wn, case when n3 = 0 or e3 = 0 then 0 else n3 / e3 / r1 end as w1 from f),
        m as (select *, [e1 * r0, e2 * r0, e3 * r0, e1 * r1, e2 * r1, e3 * r1 * w1, e1 * r2, e2 * r2 * wm, e3 * r2 * wn] as l from w),
        t as (select *, list_transform(range(1, 10), lambda i: (case when l[i] > 0 then [n1, n2, n3][(i - 1) % 3 + 1] * ln(l[i]) else 0 end) - l[i]) as q from m)
        select gene_id, n1 as n_syn, n2 as n_mis, n3 as n_non, round(e1, 4) as e_syn, round(e2, 4) as e_mis, round(e3, 4) as e_non, round(least(1e4, wm), 4) as wmis, round(least(1e4, wn), 4) as wnon, round(2 * (q[7] + q[8] + q[9] - q[4] - q[5] - q[6]), 4) as lr_mis, round(2 * (q[7] + q[8] + q[9] - q[1] - q[2] - q[3]), 4) as lr_all from t""",
    ),
    "t22_dnds_adjusted": (lambda t: genes.dnds_per_gene(annotated(t), opportunity(t)), None),
    "t24_ratio_by_class": (
        lambda t: rounded(genes.ratio_by_class(genes.vaf_classes(annotated(t), 4), opportunity(t), "quantile_group"), "mis_ratio"),
        f"""with {IMPACT}, q as (select quantile_cont(n_support * 1.0 / coverage, [0.0, 0.3333333333333333, 0.6666666666666666, 1.0]) as q from ann), c as (select impact, greatest(1, least(3, (q[1] <= n_support * 1.0 / coverage)::int + (q[2] <= n_support * 1.0 / coverage)::int + (q[3] <= n_support * 1.0 / coverage)::int + (q[4] <= n_support * 1.0 / coverage)::int)) as g from ann, q),
        l as (select impact, sum(sites) as s from opp group by 1), n as (select g, c.impact, count(*) as n, max(s) as s from c join l on c.impact = l.impact group by 1, 2) select g as quantile_group, round(sum(n * 1.0 / s) filter (impact = 'Missense') / sum(n * 1.0 / s) filter (impact = 'Synonymous'), 6) as mis_ratio, sum(n) as n from n group by 1""",
    ),
    "t26_error_grid": (
        lambda t: rounded(stats.error_grid(t.calls_once.select("coverage").distinct(), 5, (10.0, 20.0, 30.0)), "p", digits=9),
        """with c as (select distinct coverage from calls) select coverage, n::int as n, q as qual, round(greatest(0.0, 1 - list_sum(list_transform(range(0, n), lambda i: exp(lgamma(coverage + 1) - lgamma(i + 1) - lgamma(coverage - i + 1) + i * ln(pow(10, -q / 10)) + (coverage - i) * ln(1 - pow(10, -q / 10)))))), 9) as p
        from c, range(1, 6) x(n), (values (10.0::double), (20.0::double), (30.0::double)) y(q)""",
    ),
    "t27_annotate_impact": (
        lambda t: annotated(t).select("sample_id", "chrom", "pos", "gene_id", "cds_pos", "ref_cod", "alt_cod", "aachange", "ntchange", "impact"),
        f"with {IMPACT} select sample_id, chrom, pos, gene_id, cds_pos, ref_cod, alt_cod, case when old_aa is not null and new_aa is not null then concat(old_aa, ci + 1, new_aa) end as aachange, concat(ref_cod, cds_pos, alt_cod) as ntchange, impact from ann",
    ),
    "a20_gene_counts": (lambda t: genes.gene_counts(t.gene_calls), "select gene_id, sample_id, count(*) as n from gene_calls group by 1, 2"),
    "i10_assign_genes": (
        lambda t: genes.assign_genes(t.calls, t.exons).select("sample_id", "chrom", "pos", "gene_id", "ref_cod", "alt_cod"),
        "select sample_id, chrom, pos, gene_id, case when strand = '-' then translate(ref, 'ACGT', 'TGCA') else ref end as ref_cod, case when strand = '-' then translate(alt, 'ACGT', 'TGCA') else alt end as alt_cod from gene_calls",
    ),
    "j6_dense_gene_counts": (
        lambda t: genes.dense_gene_counts(genes.gene_counts(t.gene_calls), t.exons, t.sample_meta),
        f"with {GENES} select e.gene_id, m.sample_id, coalesce(g.n, 0) as n from (select distinct gene_id from exons) e cross join sample_meta m left join g on g.gene_id = e.gene_id and g.sample_id = m.sample_id",
    ),
    "j7_expression_with_counts": (
        lambda t: genes.expression_with_counts(t.expression, genes.gene_counts(t.gene_calls)),
        f"with {GENES} select e.gene_id, e.sample_id, e.tpm, coalesce(g.n, 0) as n from expression e left join g on g.gene_id = e.gene_id and g.sample_id = e.sample_id",
    ),
    "j8_known_changes": (
        lambda t: genes.flag_known_changes(annotated(t), annotated(t).filter("sample_id < 3")).groupBy("sample_id").agg(F.count_if("known").alias("n_known"), F.count(F.lit(1)).alias("n")),
        f"""with {IMPACT}, a as (select *, concat(old_aa, ci + 1, new_aa) as ch from ann), k as (select distinct gene_id, ch from a where sample_id < 3 and old_aa is not null)
        select a.sample_id, count(*) filter (k.ch is not null) as n_known, count(*) as n from a left join k on a.gene_id = k.gene_id and a.ch = k.ch and a.old_aa is not null group by 1""",
    ),
    "f14_recurrence_in_gene": (
        lambda t: rounded(filters.recurrent_in_gene(t.gene_calls, 0.02).select("sample_id", "chrom", "pos", "gene_id", "recurrence"), "recurrence"),
        """with d as (select gene_id, count(distinct concat(chrom, '.', pos, '.', ref, '.', alt)) as d from gene_calls group by 1), n as (select gene_id, chrom, pos, ref, alt, count(*) as n from gene_calls group by 1, 2, 3, 4, 5)
        select c.sample_id, c.chrom, c.pos, c.gene_id, round(n.n * 1.0 / d.d, 6) as recurrence from gene_calls c join n on c.gene_id = n.gene_id and c.chrom = n.chrom and c.pos = n.pos and c.ref = n.ref and c.alt = n.alt join d on c.gene_id = d.gene_id where n.n * 1.0 / d.d >= 0.02""",
    ),
    "f15_dominant_in_gene": (
        lambda t: rounded(filters.dominant_in_gene(t.gene_calls.withColumn("gene_id", F.concat("gene_id", F.lit("_"), F.floor(F.col("pos") / 200).cast("string"), "chrom"))), "share"),
        """with c as (select concat(gene_id, '_', cast(pos // 200 as varchar), chrom) as gene_id, concat(chrom, '.', pos, '.', ref, '.', alt) as mutation from gene_calls), n as (select gene_id, mutation, count(*) as n from c group by 1, 2), g as (select *, sum(n) over (partition by gene_id) as gene_n from n)
        select gene_id, mutation, n, gene_n, round(n * 1.0 / gene_n, 6) as share from g where (log10(gene_n) > 1 and n * 1.0 / gene_n > 0.3) or (log10(gene_n) > 3 and n * 1.0 / gene_n > 0.1)""",
    ),
    "f16_exclude_listed": (
        lambda t: filters.exclude_listed(t.calls, t.catalogue).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")),
        "select sample_id, count(*) as n from calls c where not exists (select 1 from catalogue k where k.chrom = c.chrom and k.pos = c.pos and k.ref = c.ref and k.alt = c.alt) group by 1",
    ),
    "f17_restrict_genes": (
        lambda t: filters.restrict_genes(t.gene_calls, t.gene_calls.filter("sample_id = 3")).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")),
        "select gene_id, count(*) as n from gene_calls where gene_id in (select gene_id from gene_calls where sample_id = 3) group by 1",
    ),
    "a28_strand_pairs": (
        lambda t: rounded(genes.strand_asymmetry(stranded(t), ["sample_id"])[0], "fc"),
        f"with {STRANDED}, c as (select sample_id, mut_type, count(*) filter (transcribed) as a, count(*) filter (not transcribed) as b from s group by 1, 2) select sample_id, mut_type, nullif(a, 0) as n_transcribed, nullif(b, 0) as n_other, round(nullif(a, 0) * 1.0 / nullif(b, 0), 6) as fc from c",
    ),
    "a28_strand_stats": (
        lambda t: rounded(genes.strand_asymmetry(stranded(t), ["sample_id"])[1], "mean_n", "sd_n", "stderr_n"),
        f"with {STRANDED}, c as (select sample_id, mut_type, transcribed, count(*) as n from s group by 1, 2, 3) select mut_type, transcribed, round(avg(n), 6) as mean_n, round(stddev_samp(n), 6) as sd_n, round(stddev_samp(n) / count(*), 6) as stderr_n from c group by 1, 2",
    ),
    "a30_strand_by_gene": (
        lambda t: rounded(genes.strand_asymmetry_by_gene(stranded(t), with_p=False), "n_transcribed", "n_other", "fc"),
        f"""with {STRANDED}, c as (select gene_id, mut_type, sample_id, count(*) filter (transcribed) as a, count(*) filter (not transcribed) as b from s group by 1, 2, 3)
        select gene_id, mut_type, round(sum(a) + 0.9, 6) as n_transcribed, round(sum(b) + 0.9, 6) as n_other, count(*) as n_samples, round((sum(a) + 0.9) / (sum(b) + 0.9), 6) as fc from c group by 1, 2""",
    ),
    "a30_strand_tests": (lambda t: genes.strand_asymmetry_by_gene(stranded(t)), None),
    "a31_two_tissue_ratio": (
        lambda t: rounded(genes.two_tissue_ratio(t.gene_calls.groupBy("tissue", "gene_id").agg(F.count(F.lit(1)).alias("n")), "T0", "T1"), "ratio"),
        "with g as (select gene_id, count(*) filter (tissue = 'T0') as a, count(*) filter (tissue = 'T1') as b from gene_calls group by 1) select gene_id, a as n_a, b as n_b, round(a * 1.0 / b, 6) as ratio from g where a >= 6 and b >= 6",
    ),
    "a33_agreement": (
        lambda t: genes.agreement(t.pairs, ["subject_id"]),
        """with p as (select subject_id, concat(ref1, alt1) as a, concat(ref2, alt2) as b, concat(alt2, ref2) as i, alt2 = 'X' as x, alt_n2 >= 6 as s from pairs where alt_n1 * 1.0 / cov1 * cov2 >= 8)
        select subject_id, count(*) as total, count(*) filter (a = b or a = i) as agreed_bases, count(*) filter (a = b) as agreed_direction, count(*) filter (a <> b and a <> i and not x) as disagreed, count(*) filter (x) as no_call,
        count(*) filter (s) as sure, count(*) filter (s and (a = b or a = i)) as sure_agreed_bases, count(*) filter (s and a = b) as sure_agreed_direction, count(*) filter (s and a <> b and a <> i and not x) as sure_disagreed from p group by 1""",
    ),
    "a34_agreement_fdr": (
        lambda t: rounded(genes.agreement_fdr(t.pairs.withColumn("mut_type", F.concat("ref1", F.lit(">"), "alt1")), ["mut_type"]), "fdr_percent"),
        """with p as (select concat(ref1, '>', alt1) as mut_type, ref1 = ref2 and alt1 = alt2 and alt_n2 > 0 as ok from pairs where alt_n1 * 1.0 / cov1 * cov2 >= 8)
        select mut_type, count(*) filter (not ok) as false_positives, count(*) filter (ok) as true_positives, round(count(*) filter (not ok) * 100.0 / count(*), 6) as fdr_percent from p group by 1""",
    ),
    "a39_expression_stats": (
        lambda t: rounded(genes.expression_stats(t.expression), "sum_tpm", "median_tpm", "mean_tpm", "var_tpm", digits=4),
        "select gene_id, round(sum(tpm), 4) as sum_tpm, round(quantile_cont(tpm, 0.5), 4) as median_tpm, round(avg(tpm), 4) as mean_tpm, round(var_samp(tpm), 4) as var_tpm from expression group by 1",
    ),
    "a40_impact_share": (
        lambda t: rounded(genes.impact_share(annotated(t)), "share"),
        f"with {IMPACT}, c as (select gene_id, impact, count(*) as n from ann where impact is not null group by 1, 2) select gene_id, impact, n, round(n * 1.0 / sum(n) over (partition by gene_id), 6) as share from c",
    ),
    "a40_gene_by_tissue": (
        lambda t: genes.gene_by_tissue(t.gene_calls, ["T0", "T1", "T2", "T3"]),
        "select gene_id, " + ", ".join(f"count(*) filter (tissue = 'T{i}') as \"T{i}\"" for i in range(4)) + " from gene_calls group by 1",
    ),
    "a41_collapsed_vaf": (
        lambda t: rounded(genes.collapsed_vaf(annotated(t)).withColumn("vaf", F.col("vaf") + 1e-9), "vaf", digits=5),
        f"with {IMPACT} select concat(chrom, '.', pos, '.', ref, '.', alt) as mutation, gene_id, impact, round(quantile_cont(n_support * 1.0 / coverage, 0.5) + 1e-9, 5) as vaf from ann where impact is not null group by 1, 2, 3",
    ),
    "a47_distance_histogram": (
        lambda t: rounded(genes.distance_histogram(t.calls.filter("n_support >= 6").select("chrom", "pos"), t.depth.select("chrom", "pos"), t.exons), "rate"),
        """with u as (select distinct chrom, pos from calls), line as (select chrom, pos, 1 as k, null as s, null as e from u union all select chrom, start_pos, 0, start_pos, end_pos from exons),
        w as (select *, max(e) over (partition by chrom order by pos, k rows unbounded preceding) as pe, min(s) over (partition by chrom order by pos desc, k rows unbounded preceding) as nx from line),
        d as (select chrom, pos, case when pe > pos then 0 else coalesce(least(coalesce(pos - pe + 1, nx - pos), coalesce(nx - pos, pos - pe + 1)), -1) end as distance from w where k = 1),
        h as (select distance, count(*) filter (n_support >= 6) as n_calls, count(*) filter (coverage >= 40) as n_covered from calls c join d on c.chrom = d.chrom and c.pos = d.pos where distance between 0 and 100 group by 1)
        select distance, n_calls, n_covered, round(n_calls * 1.0 / n_covered, 6) as rate from h where n_calls > 0 or n_covered > 0""",
    ),
    "a48_a49_a50_exon_signal": (
        lambda t: rounded(genes.exon_signal(t.exons, t.calls, t.depth, t.sql("select concat('m', sample_id % 3) as mark, chrom, pos, n_support as signal from calls")), "log_rate", "m0", "m1", "m2"),
        """with n as (select exon_id, count(*) as n_calls from calls c join exons x on c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos group by 1), d as (select exon_id, count(*) as n_covered from depth c join exons x on c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos group by 1),
        m as (select exon_id, avg(n_support) filter (sample_id % 3 = 0) as m0, avg(n_support) filter (sample_id % 3 = 1) as m1, avg(n_support) filter (sample_id % 3 = 2) as m2 from calls c join exons x on c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos group by 1)
        select n.exon_id, n_calls, n_covered, round(log2(n_calls * 1.0 / n_covered), 6) as log_rate, round(log2(m0), 6) as m0, round(log2(m1), 6) as m1, round(log2(m2), 6) as m2 from n join d on n.exon_id = d.exon_id join m on n.exon_id = m.exon_id where m0 > 0 and m1 > 0 and m2 > 0""",
    ),
    "a48_exon_signal_long": (
        lambda t: rounded(genes.exon_signal_long(t.exons, t.calls, t.depth, t.sql("select concat('m', sample_id % 3) as mark, chrom, pos, n_support as signal from calls")), "log_rate", "log_signal"),
        """with n as (select exon_id, count(*) as n_calls from calls c join exons x on c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos group by 1), d as (select exon_id, count(*) as n_covered from depth c join exons x on c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos group by 1),
        m as (select exon_id, concat('m', sample_id % 3) as mark, avg(n_support) as s from calls c join exons x on c.chrom = x.chrom and c.pos >= x.start_pos and c.pos < x.end_pos group by 1, 2),
        e as (select exon_id from m where s > 0 group by 1 having count(*) = 3)
        select n.exon_id, n_calls, n_covered, round(log2(n_calls * 1.0 / n_covered), 6) as log_rate, mark, round(log2(s), 6) as log_signal from n join d on n.exon_id = d.exon_id join e on n.exon_id = e.exon_id join m on n.exon_id = m.exon_id""",
    ),
    "j1_translate_ids": (
        lambda t: genes.translate_ids(t.calls.select("sample_id", "chrom", "pos"), t.sql("select sample_id, concat('run', sample_id * 3) as run_id from sample_meta where sample_id <> 7"), "sample_id", "run_id"),
        "select c.sample_id, c.chrom, c.pos, case when c.sample_id <> 7 then concat('run', c.sample_id * 3) end as run_id from calls c",
    ),
    "j5_match_assays": (
        lambda t: genes.match_assays(t.sql("select subject_id, concat('a', sample_id, ', b', sample_id) as runs from sample_meta where sample_id < 20"), t.sql("select subject_id, concat('e', sample_id) as runs from sample_meta where sample_id >= 20")),
        "select a.subject_id, concat(p.p, a.sample_id) as run_a, concat('e', b.sample_id) as run_b from sample_meta a join sample_meta b on a.subject_id = b.subject_id cross join (values ('a'), ('b')) p(p) where a.sample_id < 20 and b.sample_id >= 20",
    ),
    "r1_linear_fit": (
        lambda t: rounded(regression.linear_fit(t.sql("select e.gene_id, e.tpm, m.age from expression e join sample_meta m on e.sample_id = m.sample_id"), "tpm", ["age"], ["gene_id"]).select("gene_id", "term", "coefficient", "n"), "coefficient", digits=5),
        """with f as (select gene_id, regr_intercept(tpm, age) as a, regr_slope(tpm, age) as b, count(*) as n from expression e join sample_meta m on e.sample_id = m.sample_id group by 1)
        select gene_id, '(intercept)' as term, round(a, 5) as coefficient, n from f union all select gene_id, 'age', round(b, 5), n from f""",
    ),
    "r2_coefficient_tests": (lambda t: regression.linear_fit(t.sample_counts, "n", ["age", "bmi"], ["tissue"]), None),
    "r1_residuals": (
        lambda t: rounded(regression.linear_residuals(t.sample_counts, "n", ["age"], ["tissue"]).select("sample_id", "tissue", "n", "fitted", "residual"), "fitted", "residual", digits=5),
        """with f as (select tissue, regr_intercept(n, age) as a, regr_slope(n, age) as b from sample_counts group by 1) select s.sample_id, s.tissue, s.n, round(a + b * age, 5) as fitted, round(n - (a + b * age), 5) as residual from sample_counts s join f on s.tissue = f.tissue""",
    ),
    "f13_hypermutated": (
        lambda t: rounded(regression.hypermutated(t.sample_counts.select("tissue", "sample_id", "n"), t.sample_meta, ("age",), 5.0), "residual", digits=5),
        """with f as (select tissue, regr_intercept(n, age) as a, regr_slope(n, age) as b from sample_counts group by 1) select s.tissue, s.sample_id, s.n, round(n - (a + b * age), 5) as residual from sample_counts s join f on s.tissue = f.tissue where n - (a + b * age) >= 5""",
    ),
    "a44_observed_predicted": (
        lambda t: rounded(regression.observed_predicted(t.sample_counts.select("tissue", "sample_id", "n"), t.sample_meta, ["age"]), "predicted", digits=4),
        "with f as (select regr_intercept(n, age) as a, regr_slope(n, age) as b from sample_counts) select tissue, sum(n) as observed, round(sum(a + b * age), 4) as predicted from sample_counts, f group by 1",
    ),
    "r3_normal_score_residuals": (lambda t: regression.normal_score_residuals(t.sample_counts, "n", ["age", "bmi"], ["tissue"]), None),
    "r4_association_scan": (
        lambda t: regression.association_scan(features(t), phenotypes(t), digits=5).filter("r is not null").select("feature", "phenotype", "n", "beta", "r"),
        f"with s as ({SCAN}) select feature, phenotype, n, round(b, 5) as beta, round(r, 5) as r from s where not isnan(r)",
    ),
    "r4_scan_with_covariates": (
        lambda t: regression.association_scan(features(t), phenotypes(t), t.sample_meta, ["age", "bmi"], MOST_P, digits=4).select("feature", "phenotype", "n", "beta", "r"),
        f"""with {FREED.format(out='fx', k='variant_id', v='dosage', t='genotypes')}, {FREED.format(out='fy', k='gene_id', v='tpm', t='expression')},
        s as (select fx.k as feature, fy.k as phenotype, count(*) as n, regr_slope(fy.e, fx.e) as b, corr(fx.e, fy.e) as r, max(abs(fx.e)) as xe, max(abs(fy.e)) as ye from fx join fy on fx.sample_id = fy.sample_id group by 1, 2), {LEAST_R}
        select feature, phenotype, n, round(b, 4) as beta, round(r, 4) as r from s join cuts on n - 4 = df where xe > 1e-9 and ye > 1e-9 and abs(r) >= least""",
    ),
    "r5_permutation_scan": (lambda t: regression.permutation_scan(features(t), t.sql("select cast(tissue as string) as phenotype, sample_id, n as y from sample_counts"), 20, 30), None),
    "r7_tissue_pairs": (
        lambda t: rounded(regression.tissue_pair_correlations(t.sql("select subject_id, tissue, concat(ref, '>', alt) as mut_type, sum(n) as value from (select c.ref, c.alt, m.subject_id, m.tissue, 1 as n from calls c join sample_meta m on c.sample_id = m.sample_id) x group by 1, 2, 3"), 5, with_p=False), "r", "t", digits=4),
        """with v as (select m.subject_id, m.tissue, concat(c.ref, '>', c.alt) as mut_type, count(*) as value from calls c join sample_meta m on c.sample_id = m.sample_id group by 1, 2, 3),
        p as (select a.tissue as tissue_a, b.tissue as tissue_b, a.mut_type, count(*) as n, corr(a.value, b.value) as r from v a join v b on a.subject_id = b.subject_id and a.mut_type = b.mut_type and a.tissue < b.tissue group by 1, 2, 3)
        select tissue_a, tissue_b, mut_type, n, round(r, 4) as r, round(r * sqrt((n - 2) / (1 - r * r)), 4) as t from p where n >= 5""",
    ),
    "r11_meta_summary": (
        lambda t: rounded(genes.meta_summary(real_and_permuted(t)[0].withColumnRenamed("r", "beta")), "statistic", "sign_ratio", "p_combined", "p_adjusted", digits=5),
        f"""with {GENE_P}, s as (select gene_id, count(*) filter (c > 0) as n_up, count(*) filter (c < 0) as n_down, count(*) as n_tests, -2 * sum(ln(p)) as st from gp where b = 0 group by 1),
        f as (select *, {EVEN_TAIL.format("st", "n_tests")} as p from s), o as (select *, count(*) over () * p / count(*) over (order by p) as q from f)
        select gene_id, n_up, n_down, n_tests, round(st, 5) as statistic, round(log2((n_up + 1.0) / (n_down + 1)), 5) as sign_ratio, round(p, 5) as p_combined, round(least(1.0, min(q) over (order by p desc)), 5) as p_adjusted from o""",
    ),
    "r14_paired_ratio": (
        lambda t: rounded(regression.paired_ratio_contrast(t.sample_counts.select("subject_id", "tissue", F.col("n").alias("value")), t.sample_meta, "T0", "T1", "gender").select("n1", "n2", "w", "z"), "z"),
        f"""with r as (select a.subject_id, log2(a.n * 1.0 / b.n) as ratio from sample_counts a join sample_counts b on a.subject_id = b.subject_id where a.tissue = 'T0' and b.tissue = 'T1'), g as (select distinct subject_id, gender from sample_meta),
        k as (select gender, {RANKS.format(v='ratio')} as r, count(*) over (partition by ratio) as c from r join g on r.subject_id = g.subject_id), f as (select min(gender) as f from k),
        s as (select count(*) filter (gender = f) as n1, count(*) filter (gender <> f) as n2, sum(r) filter (gender = f) as rs, sum(c * c - 1) as ties from k, f)
        select n1, n2, rs - n1 * (n1 + 1) / 2.0 as w, round((rs - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties * 1.0 / ((n1 + n2) * (n1 + n2 - 1)))), 6) as z from s""",
    ),
}


def hyper(t: Tables) -> DataFrame:
    return t.sql(
        """with k as (select distinct chrom, pos from catalogue), u as (select distinct chrom, pos from calls), n as (select count(*) as total from u), m as (select count(*) as marked from k),
        h as (select c.sample_id, count(k.pos) as hits, count(*) as drawn from calls c left join k on c.chrom = k.chrom and c.pos = k.pos group by 1) select sample_id, hits, drawn, marked, total from h, n, m"""
    )


def drivers(t: Tables) -> DataFrame:
    return t.exons.select("gene_id").distinct().filter(F.pmod(F.crc32(F.col("gene_id").cast("binary")), F.lit(5)) == 0)
