"""Exact and limiting p-values of rank tests against enumeration, and bootstrap intervals against NumPy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import nulls
from varloom.operators import stats


def ranks(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


def tail(values, at):
    return min(1.0, 2 * min(np.mean([v <= at + 1e-9 for v in values]), np.mean([v >= at - 1e-9 for v in values])))


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(3)
    out = {g: [(float(rng.randrange(4 if g % 2 else 50)), rng.random() < 0.5) for _ in range(rng.randrange(2, 10))] for g in range(24)}
    out[None] = [(1.0, True), (2.0, False), (3.0, False)]
    out[99] = [(1.0, True), (2.0, True)]
    out[100] = [(float(k % 7), k % 2 == 0) for k in range(200)]
    return out


@pytest.fixture(scope="module")
def table(spark, groups):
    return spark.createDataFrame([(g, v, "a" if first else "b") for g, rows in groups.items() for v, first in rows], "g int, v double, l string").repartition(3)


def test_rank_sum(table, groups):
    for r in stats.rank_sum(table, "v", "l", ["g"], exact=50).collect():
        rows = groups[r["g"]]
        label = min("a" if f else "b" for _, f in rows)
        mine = [f == (label == "a") for _, f in rows]
        n1, n2 = sum(mine), len(rows) - sum(mine)
        assert (r["n1"], r["n2"]) == (n1, n2)
        assert r["p"] is None or r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), abs=2e-7)
        if n2 == 0 or r["g"] == 100:
            assert r["p_exact"] is None
            continue
        k = ranks([v for v, _ in rows])
        assert r["p_exact"] == pytest.approx(tail([sum(c) for c in itertools.combinations(k, n1)], sum(x for x, m in zip(k, mine) if m)))
        if r["z"] is not None:
            sd = (r["w"] - n1 * n2 / 2) / r["z"] if r["z"] else None
            assert sd is None or r["p_corrected"] == pytest.approx(min(1, math.erfc(max(0, abs(r["w"] - n1 * n2 / 2) - 0.5) / abs(sd) / math.sqrt(2))), abs=2e-7)
    one = stats.rank_sum(table.filter("g = 3"), "v", "l", [], exact=50).collect()
    assert len(one) == 1 and one[0]["p_exact"] == pytest.approx(next(r["p_exact"] for r in stats.rank_sum(table, "v", "l", ["g"], exact=50).collect() if r["g"] == 3))


def test_signed_rank(spark, groups):
    rows = [(g, v, float(i % 3)) for g, own in groups.items() if g != 100 for i, (v, _) in enumerate(own)]
    got = stats.signed_rank(spark.createDataFrame(rows, "g int, x double, y double"), "x", "y", ["g"], exact=50).collect()
    assert len(got) > 20
    for r in got:
        d = [x - y for g, x, y in rows if g == r["g"] and x != y]
        k = ranks([abs(x) for x in d])
        sums = [sum(x for x, s in zip(k, signs) if s) for signs in itertools.product((0, 1), repeat=len(k))]
        assert r["n"] == len(d) and r["v"] == pytest.approx(sum(x for x, y in zip(k, d) if y > 0)) and r["p_exact"] == pytest.approx(tail(sums, r["v"]))
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), abs=2e-7)
    assert all(r["p_exact"] is None for r in stats.signed_rank(spark.createDataFrame(rows, "g int, x double, y double"), "x", "y", ["g"], exact=1).collect())


def test_ks(table, groups):
    def largest(values, chosen):
        n, m = len(chosen), len(values) - len(chosen)
        return max(abs(sum(values[i] <= v for i in chosen) / n - sum(values[i] <= v for i in range(len(values)) if i not in chosen) / m) for v in values)

    for r in stats.ks_two_sample(table, "v", "l", ["g"], exact=10_000).collect() + stats.ks_two_sample(table.filter("g is null"), "v", "l", [], exact=10_000).withColumn("g", F.lit(None)).collect():
        rows = groups.get(r["g"])
        if r["n2"] == 0 or r["g"] == 100:
            assert r["p_exact"] is None  # one label, or 100 * 100 rows
            continue
        values, chosen = [v for v, _ in rows], {i for i, (_, f) in enumerate(rows) if f == (min("a" if f else "b" for _, f in rows) == "a")}
        every = [largest(values, set(c)) for c in itertools.combinations(range(len(values)), len(chosen))]
        assert r["d"] == pytest.approx(largest(values, chosen)) and r["p_exact"] == pytest.approx(np.mean([x >= r["d"] - 1e-9 for x in every]))
        x = r["d"] * math.sqrt(r["n1"] * r["n2"] / (r["n1"] + r["n2"]))
        assert r["p"] == pytest.approx(min(1, max(0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 200)))) if x >= 0.1 else 1, abs=1e-9)


def test_known_values():
    assert nulls.rank_sum_p(2 * np.arange(1, 11), np.arange(10) < 5) == pytest.approx(2 / 252)
    assert nulls.ks_p(np.array([1] * 8 + [0] * 8), np.array([0] * 8 + [1] * 8)) == pytest.approx(2 / math.comb(16, 8))
    assert nulls.signed_rank_p(2 * np.arange(1, 50), np.ones(49, bool)) == pytest.approx(2 / 2**49)


def test_weights_are_poisson():
    x = np.random.default_rng(0).integers(0, nulls.PRIME, 4000)
    w = nulls.resample_weights(x, nulls.round_factors(1, 300))[1:]
    share = np.bincount(w.ravel(), minlength=6)[:6] / w.size
    assert share == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(6)], abs=2e-3)
    assert np.var(w.sum(axis=1)) == pytest.approx(4000, rel=0.35) and abs(np.corrcoef(w[:30])[np.triu_indices(30, 1)]).max() < 0.1


@pytest.mark.parametrize("stat", ["mean", "median", "trimmed_mean"])
def test_bootstrap(spark, stat, monkeypatch):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(5, 2, 400), "b": np.round(rng.exponential(3, 300)), None: np.array([1.0, 2.0, 4.0]), "one": np.array([7.0]), "same": np.full(50, 3.0)}
    rows = [(g, float(v)) for g, own in values.items() for v in own] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    plain = {"mean": np.mean, "median": np.median, "trimmed_mean": lambda v: np.sort(v)[int(len(v) * 0.1) : len(v) - int(len(v) * 0.1)].mean()}[stat]
    whole = {r["g"]: r for r in stats.bootstrap_ci(df, "v", ["g"], stat, 300).collect()}
    monkeypatch.setattr(stats, "CELLS", 500)  # weights of a round or two at a time
    monkeypatch.setattr(stats, "RANGES", 8)
    cut = {r["g"]: r for r in stats.bootstrap_ci(df, "v", ["g"], stat, 300, held=20).collect()}
    assert whole.keys() == cut.keys() == values.keys()
    for g, own in values.items():
        for k in ("estimate", "low", "high"):
            assert cut[g][k] == pytest.approx(whole[g][k], rel=1e-9)  # ranges give what whole groups give
        assert whole[g]["estimate"] == pytest.approx(plain(own)) and whole[g]["low"] <= whole[g]["estimate"] <= whole[g]["high"]
    for g in ("a", "b"):  # as wide as NumPy's intervals of resamples
        drawn = [plain(rng.choice(values[g], len(values[g]))) for _ in range(2000)]
        low, high = whole[g]["estimate"] + np.quantile(whole[g]["estimate"] - np.array(drawn), [0.025, 0.975])
        width = high - low
        assert whole[g]["high"] - whole[g]["low"] == pytest.approx(width, rel=0.25, abs=1e-9 if stat != "median" else 1.01) and abs(whole[g]["low"] - low) < 0.25 * width + (stat == "median")
    assert (whole["same"]["low"], whole["same"]["high"]) == (3.0, 3.0)
    assert stats.bootstrap_ci(df.limit(0), "v", ["g"], stat, 20).count() == 0
    every = stats.bootstrap_ci(df.filter("g = 'a'"), "v", [], stat, 50).collect()
    assert len(every) == 1 and every[0]["estimate"] == pytest.approx(plain(values["a"]))
