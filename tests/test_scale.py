"""Rules that small tables do not show: tails of large numbers, large means, subjects, positions that run out."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import calling, cohort, filters, intervals, regression, stats

PILE = "sample_id int, subject_id int, chrom string, pos bigint, ref string, context string, a_n int, t_n int, g_n int, c_n int"


def log_binomial(n, k, p):
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def test_binomial_tail(spark):
    cases = [(10**6, 25_000, 0.025), (10**6, 25_400, 0.025), (10**6, 24_000, 0.025), (40_000, 1_000, 0.025), (40_000, 1_500, 0.025), (100, 3, 0.001), (8_000, 20, 0.1), (7, 7, 0.5), (7, -1, 0.5), (50, 49, 0.9)]
    df = spark.createDataFrame(cases, "n long, k long, p double").withColumn("tail", filters.binomial_tail(F.col("n"), F.col("k"), F.col("p")))
    for n, k, p, tail in df.collect():
        expected = math.fsum(math.exp(log_binomial(n, i, p)) for i in range(k + 1, n + 1)) if k >= 0 else 1.0
        assert tail == pytest.approx(expected, rel=1e-6, abs=1e-300)


def test_hypergeometric_tail(spark):
    cases = [(0, 20_000, 20_000, 200_000), (2_000, 20_000, 20_000, 200_000), (2_100, 20_000, 20_000, 200_000), (1_800, 20_000, 20_000, 200_000), (3, 5, 4, 10), (5, 5, 8, 10), (3, 5, 8, 10), (1, 1, 1, 1), (4, 5, 3, 10)]
    df = spark.createDataFrame(cases, "h long, d long, m long, t long").withColumn("tail", stats.hypergeometric_tail(*map(F.col, "hdmt")))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    for h, d, m, t, tail in df.collect():
        expected = math.fsum(math.exp(choose(m, i) + choose(t - m, d - i) - choose(t, d)) for i in range(max(h, d + m - t, 0), min(d, m) + 1))
        assert tail == pytest.approx(min(1.0, expected), rel=1e-6), (h, d, m, t)


def test_enrichment_takes_both_tails(spark):
    df = spark.createDataFrame([("t", "few", 2, 1000, 0.02), ("t", "as expected", 20, 1000, 0.02), ("t", "many", 45, 1000, 0.02), ("t", "many too", 45, 1000, 0.02)], "tissue string, gene_id string, n long, total long, share double")
    got = {r["gene_id"]: r for r in stats.binomial_enrichment(df, ["tissue"], "share").collect()}
    assert got["few"]["p_low"] == pytest.approx(sum(math.exp(log_binomial(1000, i, 0.02)) for i in range(3)))
    assert got["many"]["p_high"] == pytest.approx(sum(math.exp(log_binomial(1000, i, 0.02)) for i in range(46, 1001)))
    assert got["few"]["fdr"] < 0.01 and got["many"]["fdr"] == got["many too"]["fdr"] < 0.01 and got["as expected"]["fdr"] > 0.5


def test_a_predictor_with_a_large_mean(spark):
    rng = np.random.default_rng(3)
    x, z = 3e7 + rng.normal(0, 100, 60), rng.normal(0, 1, 60)
    y = 5 + 0.02 * (x - 3e7) + 2 * z + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([("a", float(a), float(b), float(c), 7.0, float(2 * b)) for a, b, c in zip(y, x, z)] + [("b", 1.0, None, 2.0, 7.0, 1.0)], "g string, y double, x double, z double, same double, twice double")
    got = {r["term"]: r for r in regression.linear_fit(df, "y", ["x", "z", "same", "twice"], ["g"]).collect()}
    X = np.stack([np.ones(60), x - x.mean(), z], 1)
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    s2 = ((y - X @ beta) ** 2).sum() / 57
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2)
    assert (got["x"]["coefficient"], got["z"]["coefficient"]) == pytest.approx(tuple(beta[1:]), rel=1e-6)
    assert (got["x"]["std_error"], got["z"]["std_error"]) == pytest.approx(tuple(se[1:]), rel=1e-5)
    assert got["(intercept)"]["coefficient"] == pytest.approx(beta[0] - beta[1] * x.mean(), rel=1e-6)
    assert got["same"]["coefficient"] is None and got["twice"]["coefficient"] is None and got["x"]["df"] == 57


def test_genotypes_are_those_of_the_subject(spark):
    p = spark.createDataFrame([(s, s % 2, "chr1", q, "A", "CCACC", 50, 50, 0, 0) for s in (1, 2) for q in (10, 11, 12)], PILE)
    g = spark.createDataFrame([(1, "chr1", 10, "A", "T", "0/1"), (0, "chr1", 11, "A", "G", "1/1"), (0, "chr1", 11, "A", "C", "1/1")], "subject_id int, chrom string, pos bigint, ref string, alt string, gt string")
    assert {(r["sample_id"], r["pos"]) for r in calling.drop_germline(p, g).collect()} == {(1, 11), (1, 12), (2, 10), (2, 11), (2, 12)}
    got = {(r["sample_id"], r["pos"]): (r["ref"], r["context"]) for r in calling.repair_context(p, g).collect()}
    assert len(got) == 6 and all(got[1, q] == ("A", "CCACC") for q in (10, 11, 12))
    assert (got[2, 10], got[2, 11], got[2, 12]) == (("A", "CCACC"), ("C", "CCCCC"), ("A", "CCACC"))
    with pytest.raises(ValueError, match="subject_id"):
        calling.drop_germline(p.drop("subject_id"), g)


def test_calls_beyond_the_positions_come_back(spark):
    calls = spark.createDataFrame([(1, "c", p, "A", "T") for p in range(7)] + [(2, "c", 1, "G", "T")], "sample_id int, chrom string, pos bigint, ref string, alt string")
    covered = spark.createDataFrame([(1, "c", 100 + p, "A") for p in range(3)], "sample_id int, chrom string, pos bigint, ref string")
    got = cohort.random_positions(calls, covered).collect()
    assert len(got) == 8 and sorted(collections.Counter(r["pos"] for r in got if r["sample_id"] == 1).values()) == [2, 2, 3]
    assert [r["pos"] for r in got if r["sample_id"] == 2] == [None]


def test_label_near_is_the_distance_rule(spark):
    rng = np.random.default_rng(2)
    spans = spark.createDataFrame([("c1", int(a), int(a + w)) for a, w in zip(rng.integers(20, 2000, 60), rng.integers(0, 30, 60))], "chrom string, start_pos bigint, end_pos bigint")
    calls = spark.createDataFrame([("c1", int(p)) for p in rng.integers(1, 2100, 500)] + [("c2", 5)], "chrom string, pos bigint")
    for cutoff in (1, 2, 7):
        slow = {(r["chrom"], r["pos"]): 0 <= r["distance"] < cutoff for r in intervals.nearest(calls, spans).collect()}
        got = filters.label_near(calls, spans, cutoff, "near")
        assert got.count() == 501 and all((len(r["filters"]) == 1) == slow[r["chrom"], r["pos"]] for r in got.collect())
    own = calls.withColumns({"start_pos": F.lit(7), "end_pos": F.lit("x")})  # columns that intervals have too
    assert {(r["start_pos"], r["end_pos"], len(r["filters"])) for r in filters.label_near(own, spans, 7, "near").collect()} == {(7, "x", 0), (7, "x", 1)}
    merged = intervals.merge_intervals(spans).orderBy("start_pos").collect()
    assert all(a["end_pos"] < b["start_pos"] for a, b in zip(merged, merged[1:]))


def test_scan_by_blocks_equals_the_join(spark, monkeypatch):
    rng = random.Random(4)
    cell = lambda i, s: None if rng.random() < 0.2 else 0.1 if i == 3 else 1e6 + rng.gauss(0, 1)
    f = [(i, s, cell(i, s)) for i in [None, *range(9)] for s in [*range(8), None]] + [(1, 2, 1e6), (77, 99, 1.0)]
    p = [(f"p{i}", s, cell(i, s)) for i in range(7) for s in range(8)] + [("p1", 2, 5e5)]
    features, phenotypes = spark.createDataFrame(f, "feature int, sample_id int, x double"), spark.createDataFrame(p, "phenotype string, sample_id int, y double")
    monkeypatch.setattr(regression, "BLOCK", 2)
    got = {(r["feature"], r["phenotype"]): r for r in regression.association_scan(features, phenotypes).collect()}
    pairs = collections.defaultdict(list)
    for (i, s, x), (j, u, y) in itertools.product(f, p):
        if s is not None and s == u and x is not None and y is not None:
            pairs[i, j].append((x, y))
    assert set(got) == set(pairs)
    for k, values in pairs.items():
        x, y = np.array(values).T
        if len(values) < 2 or np.ptp(x) == 0 or np.ptp(y) == 0:
            assert got[k]["n"] == len(values) and got[k]["r"] is None and got[k]["beta"] is None
        else:
            r, beta = np.corrcoef(x, y)[0, 1], np.polyfit(x - x.mean(), y, 1)[0]
            assert (got[k]["n"], got[k]["r"], got[k]["beta"]) == pytest.approx((len(values), r, beta), rel=1e-6, abs=1e-9)
    most = {r["feature"]: r["m"] for r in regression.strongest(features, phenotypes.withColumn("perm_id", F.lit(1))).collect()}
    for i, m in most.items():
        assert m == pytest.approx(max(abs(r["r"]) for (a, _), r in got.items() if a == i and r["r"] is not None))
    assert regression.association_scan(features.limit(0), phenotypes).count() == 0 and regression.association_scan(features, phenotypes.limit(0)).count() == 0
    assert regression.strongest(features.limit(0), phenotypes.withColumn("perm_id", F.lit(1))).count() == 0
