"""Tails of large numbers, and scans that keep pairs by p or rank, against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import tails
from varloom.operators import regression


def test_gamma_tail_of_large_shapes():
    # Q(a, a) is 1/2 - 1 / (3 sqrt(2 pi a)) - 1 / (540 sqrt(2 pi) a^1.5) and so on; checked against its own next term.
    for a in (1e3, 3e4, 1e5, 1e6, 1e7):
        expected = 0.5 - (1 / 3 + 1 / (540 * a) - 25 / (6048 * a * a)) / math.sqrt(2 * math.pi * a)
        assert float(tails.upper_gamma(a, a)) == pytest.approx(expected, abs=1e-11)
    # integer shapes: sums of Poisson terms
    for a, x in ((1, 0.5), (5, 3.0), (50, 70.0), (200, 150.0), (200, 260.0), (64, 64.0), (63, 63.0)):
        terms = [math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(a)]
        assert float(tails.upper_gamma(a, x)) == pytest.approx(math.fsum(terms), rel=1e-11)
    many = tails.upper_gamma(np.array([[1.0, 1e5], [1e6, 2.0]]), np.array([[1.0, 1e5], [1e6, 0.0]]))
    assert many[0, 0] == pytest.approx(math.exp(-1)) and many[1, 1] == 1.0 and many[1, 0] == pytest.approx(0.4998670, abs=1e-6)


def test_log_gamma():
    x = np.concatenate([np.geomspace(1e-6, 1e9, 400), [0.5, 1.0, 2.0]])
    expected = np.array([math.lgamma(v) for v in x])
    assert np.abs(tails._log_gamma(x) - expected).max() < 1e-4 and (np.abs(tails._log_gamma(x) - expected) <= 5e-14 * np.maximum(10, np.abs(expected))).all()


def test_hypergeometric_against_all_terms():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        t = int(rng.integers(1, 60))
        d, m = (int(rng.integers(0, t + 1)) for _ in "ab")
        rows.append((int(rng.integers(-1, min(d, m) + 3)), d, m, t))
    got = tails.hypergeometric(*(np.array(c) for c in zip(*rows)))
    for (h, d, m, t), p in zip(rows, got):
        exact = sum(math.comb(m, k) * math.comb(t - m, d - k) for k in range(max(0, h), min(d, m) + 1) if d - k <= t - m) / math.comb(t, d)
        assert p == pytest.approx(exact, abs=1e-12)


def test_least_r():
    for df, t, p in ((38, 2.024394, 0.05), (10, 3.169273, 0.01), (5, 6.868827, 0.001)):
        assert tails.least_r(df, p) == pytest.approx(t / math.sqrt(df + t * t), abs=1e-6)


@pytest.fixture(scope="module")
def scanned(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 3, (11, 16)), rng.integers(0, 4, (9, 16))
    y[3] = x[2]
    y[4] = 1
    long = lambda m, name, v: spark.createDataFrame([(f"{name[0]}{i}", s, float(a)) for i, row in enumerate(m) for s, a in enumerate(row) if (i * 7 + s * 5) % 9], f"{name} string, sample_id int, {v} double")
    return long(x, "feature", "x"), long(y, "phenotype", "y")


@pytest.mark.parametrize("block", [2, 512])
def test_pairs_by_p_and_rank(spark, scanned, monkeypatch, block):
    monkeypatch.setattr(regression, "BLOCK", block)
    features, phenotypes = scanned
    every = [r for r in regression.association_scan(features, phenotypes).collect()]
    known = sorted((r for r in every if r["r"] is not None), key=lambda r: (-abs(r["r"]), r["feature"], r["phenotype"]))
    for p in (0.5, 0.05, 1e-9):
        assert sorted(map(str, regression.association_scan(features, phenotypes, most_p=p).collect())) == sorted(str(r) for r in known if r["p"] is not None and r["p"] <= p)
    for k in (1, 7, 30, 1000):
        assert list(map(str, regression.association_scan(features, phenotypes, top=k).collect())) == list(map(str, known[:k]))
    each = {(r["feature"], r["phenotype"]) for r in regression.association_scan(features, phenotypes, top_each=2).collect()}
    for f, own in itertools.groupby(sorted(known, key=lambda r: r["feature"]), lambda r: r["feature"]):
        assert {(f, r["phenotype"]) for r in sorted(own, key=lambda r: (-abs(r["r"]), r["phenotype"]))[:2]} <= each
    tests = regression.tested_pairs(features, phenotypes)
    assert tests.agg(F.sum("tests")).first()[0] == len(every) and tests.count() == 11
    assert regression.tested_pairs(features.limit(0), phenotypes).count() == 0 == regression.association_scan(features.limit(0), phenotypes, top=3).count()


def test_alike_features_are_scanned_once(spark, scanned, monkeypatch):
    features, phenotypes = scanned
    copies = features.unionByName(features.withColumn("feature", F.concat(F.lit("a"), "feature"))).unionByName(features.withColumn("feature", F.concat(F.lit("z"), "feature")))
    rows, members = regression.alike(copies)
    assert rows.select("feature").distinct().count() == 11 and members.count() == 33 and {r[0][:2] for r in members.select("first").collect()} == {"af"}
    blocks, seen = regression._blocks, []
    monkeypatch.setattr(regression, "_blocks", lambda f, p, key: (seen.append(f.select("feature").distinct().count()), blocks(f, p, key))[1])
    every = regression.association_scan(copies, phenotypes).collect()
    alone = {(r["feature"], r["phenotype"]): r[2:] for r in regression.association_scan(features, phenotypes).collect()}
    assert len(every) == 3 * len(alone) and all(r[2:] == alone[r["feature"].lstrip("az"), r["phenotype"]] for r in every)
    known = sorted((r for r in every if r["r"] is not None), key=lambda r: (-abs(r["r"]), r["feature"], r["phenotype"]))
    for k in (1, 4, 50):
        assert list(map(str, regression.association_scan(copies, phenotypes, top=k).collect())) == list(map(str, known[:k]))
    m = {r["feature"]: r["m"] for r in regression.strongest(copies, phenotypes.withColumn("perm_id", F.lit(1))).collect()}
    assert all(m[f] == m[f"a{f}"] == m[f"z{f}"] == pytest.approx(max(abs(r["r"]) for r in known if r["feature"] == f), abs=1e-11) for f in (f"f{i}" for i in range(11)))
    tests = {r["feature"]: r["tests"] for r in regression.tested_pairs(copies, phenotypes).collect()}
    assert len(tests) == 33 and all(tests[f"a{f}"] == tests[f] for f in (f"f{i}" for i in range(11)))
    assert set(seen) == {11}
    unnamed = features.unionByName(features.filter("feature = 'f2'").withColumn("feature", F.lit(None).cast("string")))  # a null id is a feature too, the smallest
    assert regression.association_scan(unnamed, phenotypes, top=1).collect()[0]["feature"] is None


def test_features_of_a_large_class_are_dealt_to_tasks(spark, scanned, monkeypatch):
    monkeypatch.setattr(regression, "PART", 4)
    monkeypatch.setattr(regression, "PARTS", 6)
    features, phenotypes = scanned
    names = [None, *(f"c{i:02d}" for i in range(40))]
    copies = spark.createDataFrame([(n,) for n in names], "feature string").crossJoin(features.filter("feature = 'f2'").select("sample_id", "x"))
    whole = regression.association_scan(features, phenotypes, digits=3)
    known = {(r["feature"], r["phenotype"]): r[2:] for r in whole.collect()}
    plain = {(r["feature"], r["phenotype"]): r for r in regression.association_scan(features, phenotypes).withColumns({c: F.round(c, 3) for c in ("beta", "r")}).collect()}
    assert known == {k: r[2:] for k, r in plain.items()}
    for few in (0, 1024):  # the first ones by a join, and by their names
        monkeypatch.setattr(regression, "FEW", few)
        got = regression.association_scan(features.unionByName(copies), phenotypes, digits=3).withColumn("task", F.spark_partition_id()).collect()
        assert len(got) == len(known) + 41 * 9 and len({r["task"] for r in got if r["feature"] is None or r["feature"][0] == "c"}) > 1
        assert all(r[2:-1] == known["f2" if r["feature"] is None or r["feature"][0] == "c" else r["feature"], r["phenotype"]] for r in got)


def test_covariate_scan_moves_no_cells_of_like_features(spark, capsys):
    """All cells were moved by their feature to find those of the first ones, and results were rounded for each feature."""
    from varloom.plans.projections import Tables
    from varloom.plans.stats_queries import QUERIES, features

    t = Tables(spark, "/root/testdata/sf0.001")
    regression.alike(features(t))[0].explain()
    assert "hashpartitioning(coalesce(feature" not in capsys.readouterr().out
    for name in ("r4_scan_with_covariates", "r4_association_scan"):
        QUERIES[name][0](t).explain()
        before, after = (out := capsys.readouterr().out).split("Join [_first", 1)
        assert "round(" not in before and "round(" in after, out


def test_genotypes_are_those_of_the_projection(spark):
    from varloom.plans.projections import PROJECTIONS, Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    sql = t.sql(PROJECTIONS["genotypes"])
    assert t.genotypes.columns == sql.columns and t.genotypes.exceptAll(sql).count() == 0 == sql.exceptAll(t.genotypes).count()
