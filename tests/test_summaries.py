"""Sources without a query, and operators whose results SQL does not give, against NumPy."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import genes, regression, selection, stats, summaries
from varloom.sources import tables


def test_bed_files_and_transposed_tables(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#head\nchr1\t9\t20\tx\t0\t+\nchr2\t0\t5\ty\t1\t-\n")
    got = [tuple(r) for r in tables.read_bed(spark, str(tmp_path / "a.bed")).orderBy("chrom").collect()]
    assert got == [("chr1", 9, 20, "x", "0", "+"), ("chr2", 0, 5, "y", "1", "-")]
    assert [r["start_pos"] for r in tables.read_bed(spark, str(tmp_path / "a.bed"), one_based=True).orderBy("chrom").collect()] == [10, 1]
    wide = spark.createDataFrame([("C1", 0.5, 1.5), ("C2", 2.5, 3.5)], "id string, s1 double, s2 double")
    assert sorted(map(tuple, tables.transpose(wide, "id").select("sample_id", "C1", "C2").collect())) == [("s1", 0.5, 2.5), ("s2", 1.5, 3.5)]


def test_genotypes_of_a_region(spark, tmp_path):
    spark.createDataFrame([("c1", p, s, "0/1") for p in range(10) for s in "ab"] + [("c2", 5, "a", "1/1")], "chrom string, pos bigint, sample_id string, gt string").write.parquet(str(tmp_path / "g"))
    got = tables.read_genotypes(spark, str(tmp_path / "g"), "c1", 3, 6, ["a"])
    assert sorted((r["pos"], r["sample_id"]) for r in got.collect()) == [(p, "a") for p in range(3, 7)]
    assert tables.read_genotypes(spark, str(tmp_path / "g"), "c1", 3, 6).count() == 8


def test_tables_by_gene(spark, tmp_path):
    calls = spark.createDataFrame([(s, "T0", "chr1", s * 10, "A", "T", f"G{s % 2}") for s in range(6)], "sample_id int, tissue string, chrom string, pos bigint, ref string, alt string, gene_id string")
    tables.write_by_gene(calls, str(tmp_path / "o"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "o"))
    assert collections.Counter(r["gene_id"] for r in back.collect()) == {"G0": 3, "G1": 3} and "Reference_Allele" in back.columns


def test_simulated_medians(spark):
    rows = [("t", f"s{i}", float(i), 3.0) for i in range(31)]
    got = summaries.simulated_medians(spark.createDataFrame(rows, "tissue string, sample_id string, fitted double, sigma double"), ["tissue"], "sample_id", 400, 100).first()
    assert got["median"] == pytest.approx(15, abs=0.6) and got["low"] < got["median"] < got["high"]  # mean of 400 draws: sd 0.15
    draws = spark.range(20_000).select(summaries.normal_draw(F.lit(2.0), F.lit(3.0), "id").alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert draws[0] == pytest.approx(2, abs=0.1) and draws[1] == pytest.approx(3, abs=0.1)


def test_good_ratios_and_sets(spark):
    per = spark.createDataFrame([("a", 2, 4, 0.0), ("b", 3, 3, 2.0), ("c", 0, 9, 5.0), ("d", 1, 2, 1.0), ("e", 5, 5, 4.0)], "gene_id string, n_syn long, n_mis long, wmis double")
    got = {r["gene_id"]: r["ratio"] for r in selection.good_ratios(per).collect()}
    assert got == {"a": pytest.approx(1 / 5), "b": 2.0, "e": 4.0}
    means = {r["statistic"]: r for r in selection.ratio_means(selection.good_ratios(per), rounds=50).collect()}
    logs = np.log2([0.2, 2, 4])
    assert means["mean"]["estimate"] == pytest.approx(logs.mean()) and means["median"]["estimate"] == pytest.approx(1.0) and means["mean"]["low"] <= means["mean"]["high"]
    sets = spark.createDataFrame([(1, "a"), (1, "e"), (2, "b"), (3, "a")], "perm_id int, gene_id string")
    out = selection.set_ratio(selection.good_ratios(per), spark.createDataFrame([("b",), ("x",)], "gene_id string"), sets).first()
    m = [(logs[0] + 2) / 2, 1.0, logs[0]]
    assert (out["target_mean"], out["random_mean"], out["random_sd"], out["p"]) == pytest.approx((1.0, np.mean(m), np.std(m, ddof=1), 1 / 3))


def test_matched_sets_have_the_targets_levels(spark):
    levels = spark.createDataFrame([(f"g{i}", float(i)) for i in range(40)], "gene_id string, level double")
    targets = spark.createDataFrame([("g1",), ("g2",), ("g30",)], "gene_id string")
    sets = collections.defaultdict(list)
    for r in stats.matched_random_sets(levels, targets, "level", 5, 5).collect():
        sets[r["perm_id"]].append(int(r["gene_id"][1:]))
    assert len(sets) == 5 and all(sum(x < 10 for x in s) == 2 and sum(29 <= x for x in s) == 1 and not {1, 2, 30} & set(s) for s in sets.values())
    counts = spark.createDataFrame([(f"g{i}", i) for i in range(40)], "gene_id string, n long")
    got = stats.driver_enrichment(counts, targets, spark.createDataFrame([(k, f"g{x}") for k, s in sets.items() for x in s], "perm_id int, gene_id string")).first()
    means = [np.mean(s) for s in sets.values()]
    assert (got["target_mean"], got["random_mean"], got["p"]) == pytest.approx((11, np.mean(means), np.mean([m >= 11 for m in means])))


def test_components_explain_the_variance(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (60, 5)) * [5, 3, 1, 0.2, 0.1]
    got = stats.principal_components(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, v array<double>"), "v", 0.9, 5).orderBy("id").collect()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    k = int(np.searchsorted(np.cumsum(values[::-1]) / values.sum(), 0.9)) + 1
    scores = np.array([r["scores"] for r in got])
    assert scores.shape[1] == k
    assert np.abs(scores) == pytest.approx(np.abs(x @ vectors[:, ::-1][:, :k]), abs=1e-6)


def test_selection_models(spark):
    rng = np.random.default_rng(7)
    changes = [f"{a}>{b}" for a in "ACGT" for b in "ACGT" if a != b]
    sites = [(f"g{g}", c, k, int(rng.integers(20, 200))) for g in range(4) for c in changes for k in ("Synonymous", "Missense", "Nonsense")]
    calls = [(g, c[0], c[2], k) for g, c, k, s in sites for _ in range(rng.poisson(s * 0.05 * {"Synonymous": 1, "Missense": 2, "Nonsense": 0.5}[k]))]
    opportunity = spark.createDataFrame(sites, "gene_id string, change string, impact string, sites long")
    annotated = spark.createDataFrame(calls, "gene_id string, ref_cod string, alt_cod string, impact string")
    n = collections.Counter((f"{a}>{b}", k) for _, a, b, k in calls)
    total = collections.Counter()
    for _, c, k, s in sites:
        total[c, k] += s
    keys = sorted(total)
    for kinds, names in (((("Missense",), ("Nonsense",)), ("wmis", "wnon")), ((("Missense", "Nonsense"),), ("wall",))):
        X = np.array([[c == x for x in changes] + [k in kind for kind in kinds] for c, k in keys], float)
        y, offset, beta = np.array([n[q] for q in keys]), np.log([total[q] for q in keys]), np.zeros(X.shape[1])
        beta[:12] = math.log(0.05)
        for _ in range(50):  # Newton steps
            mu = np.exp(X @ beta + offset)
            beta = beta + np.linalg.solve(X.T * mu @ X, X.T @ (y - mu))
        se = np.sqrt(np.diag(np.linalg.inv(X.T * np.exp(X @ beta + offset) @ X)))
        got = {r["name"]: r for r in genes.dnds_global(annotated, opportunity).collect()}
        for i, name in enumerate(names):
            assert (got[name]["mle"], got[name]["cilow"], got[name]["cihigh"]) == pytest.approx(tuple(np.exp(beta[12 + i] + np.array([0, -1, 1]) * 1.959963984540054 * se[12 + i])), rel=1e-3)
    per = genes.dnds_per_gene(annotated, opportunity).collect()
    p = sorted((r["p_all"], r["q_all"]) for r in per)
    for r in per:
        assert r["p_mis"] == pytest.approx(math.erfc(math.sqrt(max(0.0, r["lr_mis"]) / 2)), rel=1e-6) and r["p_all"] == pytest.approx(math.exp(-max(0.0, r["lr_all"]) / 2), rel=1e-6)
    assert [q for _, q in p] == pytest.approx([min(min(1.0, x * len(p) / (j + 1)) for j, (x, _) in enumerate(p) if j >= i) for i in range(len(p))])


def test_scans_with_covariates_and_permutations(spark):
    rng = np.random.default_rng(9)
    n, samples = 24, [f"s{i:02d}" for i in range(24)]
    age, x, y = rng.normal(50, 9, n), rng.integers(0, 3, (5, n)).astype(float), rng.normal(0, 1, (2, n))
    y[1] += x[2]
    long = lambda m, name, v: spark.createDataFrame([(f"{name}{i}", s, float(a)) for i, row in enumerate(m) for s, a in zip(samples, row)], f"{name} string, sample_id string, {v} double")
    f, p = long(x, "feature", "x"), long(y, "phenotype", "y")
    cov = spark.createDataFrame(list(zip(samples, map(float, age))), "sample_id string, age double")
    free = lambda v: v - np.polyval(np.polyfit(age, v, 1), age)
    for r in regression.association_scan(f, p, cov, ["age"]).collect():
        a, b = free(x[int(r["feature"][-1])]), free(y[int(r["phenotype"][-1])])
        corr = np.corrcoef(a, b)[0, 1]
        assert (r["r"], r["beta"], r["t"]) == pytest.approx((corr, (a @ b) / (a @ a), corr * math.sqrt((n - 3) / (1 - corr**2))), rel=1e-6)
    drawn = collections.defaultdict(dict)
    for r in stats.permute(p, ["phenotype"], "y", "sample_id", 10).collect():
        drawn[r["perm_id"], r["phenotype"]][r["sample_id"]] = r["y"]
    assert all(sorted(v.values()) == pytest.approx(sorted(y[int(k[1][-1])])) for k, v in drawn.items())
    best = [max(abs(np.corrcoef(x[i], [drawn[k, f"phenotype{j}"][s] for s in samples])[0, 1]) for i in range(5) for j in range(2)) for k in range(1, 11)]
    got = regression.permutation_scan(f, p, 10, 4).collect()
    assert got[0]["feature"] == "feature2" and len(got) == 4
    for r in got:
        assert r["p_empirical"] == pytest.approx(np.mean([b >= abs(r["r"]) - 1e-12 for b in best])) and r["p_bonferroni"] == pytest.approx(min(1, r["p"] * 10))


def test_pathways_and_scores(spark):
    real = spark.createDataFrame([("a", 0.01), ("b", 0.2), ("c", 0.9)], "gene_id string, p double")
    drawn = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.5), (2, "a", 0.001), (2, "b", 0.01), (2, "c", 0.9)], "perm_id int, gene_id string, p double")
    from varloom.operators import lookups

    got = {r["term"]: r for r in lookups.pathway_enrichment(real, drawn, spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "term string, gene_id string")).collect()}
    assert got["x"]["statistic"] == pytest.approx(-2 * math.log(0.002)) and got["x"]["p_permuted"] == 0.5 and got["y"]["p_permuted"] == 1.0
    p = stats.fisher_combine(real.withColumn("k", F.lit(1)), "p", ["k"]).first()
    h = -math.log(0.01 * 0.2 * 0.9)
    assert p["p_combined"] == pytest.approx(math.exp(-h) * (1 + h + h * h / 2), rel=1e-9)
    rng = np.random.default_rng(2)
    z, age = rng.normal(0, 1, 15), rng.normal(0, 1, 15)
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(z, age))], "k string, i int, y double, age double")
    from statistics import NormalDist

    score = np.array([NormalDist().inv_cdf((r + 0.5) / 15) for r in np.argsort(np.argsort(z))])
    expected = score - np.polyval(np.polyfit(age, score, 1), age)
    assert [r["residual"] for r in regression.normal_score_residuals(df, "y", ["age"], ["k"]).orderBy("i").collect()] == pytest.approx(expected.tolist(), abs=1e-6)


def test_recurrent_calls_are_those_of_all_recurrences(spark):
    """The cutoff is applied to mutations, before the calls are joined."""
    from varloom.operators.filters import recurrence_in_gene, recurrent_in_gene

    rows = [("g1", "c", 1, "A", "T")] * 3 + [("g1", "c", 2, "A", "T"), ("g2", "c", 9, "C", "T"), ("g2", "c", 8, "C", "T")]
    calls = spark.createDataFrame(rows, "gene_id string, chrom string, pos long, ref string, alt string")
    every = sorted((r.gene_id, r.pos, r.recurrence) for r in recurrence_in_gene(calls).collect())
    assert every == [("g1", 1, 1.5)] * 3 + [("g1", 2, 0.5), ("g2", 8, 0.5), ("g2", 9, 0.5)]
    kept = recurrent_in_gene(calls, 1.0)
    assert sorted((r.gene_id, r.pos, r.recurrence) for r in kept.collect()) == [("g1", 1, 1.5)] * 3
    assert "count(distinct" not in kept._jdf.queryExecution().optimizedPlan().toString()  # mutations are counted once, not again as distinct ones


def test_certain_variants_move_genotypes_alone(spark):
    from varloom.operators import summaries

    rows = [(1, 0, [0.95, 0.03, 0.02]), (1, 1, [0.01, 0.04, 0.95]), (2, 0, [0.4, 0.4, 0.2]), (2, 1, [0.95, 0.03, 0.02])]
    got = summaries.certain_variants(spark.createDataFrame(rows, "variant_id int, sample_id int, posteriors array<double>")).select("variant_id", "genotype")
    assert sorted(map(tuple, got.collect())) == [(1, 0), (1, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(plan) if "Join LeftSemi" in line)
    assert "genotype" in plan[first + 1] and "posteriors" not in plan[first + 1].split("[", 1)[1].split(", cast", 1)[0]  # the join's left side is projected
