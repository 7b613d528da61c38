"""Distances of shared places, permutations as orders of one array, ranks of identifiers between borders, labels in blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from varloom.operators import calling, filters, genes, intervals, stats, windows


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_nearest_of_shared_places(spark):
    draw = random.Random(1)
    points = [(s, draw.choice(["a", "b", "c", None]), draw.choice([None, *range(1, 60)])) for s in range(400)] + [(7, "a", 5)] * 3
    spans = [("a", 5, 9, "x"), ("a", 20, 20, "empty"), ("a", 30, 41, "y"), ("b", 50, 52, "z")]
    p = spark.createDataFrame(points, "distance int, chrom string, pos long").withColumnRenamed("distance", "start_pos").repartition(5)
    i = spark.createDataFrame(spans, "chrom string, start_pos long, end_pos long, name string")

    def plain(chrom, pos):
        there = [(a, b) for c, a, b, _ in spans if c == chrom and b > a]
        if not there or pos is None:
            return -1
        return min(0 if a <= pos < b else (a - pos if pos < a else pos - b + 1) for a, b in there)

    for stretch in (8, 1 << 20):
        want = sorted(((s, c, q, plain(c, q)) for s, c, q in points), key=lambda r: tuple((x is not None, str(x)) for x in r))
        assert rows(intervals.nearest(p, i, stretch), "start_pos", "chrom", "pos", "distance") == want
    for cutoff in (0, 3, 30):
        want = sorted(((s, c, q) for s, c, q in points if plain(c, q) > cutoff), key=lambda r: tuple((x is not None, str(x)) for x in r))
        far = filters.keep_far(p, i, cutoff)
        assert far.columns == p.columns and rows(far, "start_pos", "chrom", "pos") == want
    none = i.limit(0)
    assert {r["distance"] for r in intervals.nearest(p, none).collect()} == {-1} and filters.keep_far(p, none, 1).count() == 0
    assert intervals.nearest(p.limit(0), i).count() == 0
    with pytest.raises(ValueError):
        filters.keep_far(p, i, -1)


def test_distance_histogram_counts_rows(spark):
    i = spark.createDataFrame([("a", 10, 12)], "chrom string, start_pos long, end_pos long")
    calls = spark.createDataFrame([("a", 9), ("a", 9), ("a", 11), ("a", 500), ("b", 1)], "chrom string, pos long")
    covered = spark.createDataFrame([("a", 9), ("a", 9), ("a", 9), ("a", 9), ("a", 13)], "chrom string, pos long")
    assert rows(genes.distance_histogram(calls, covered, i), "distance", "n_calls", "n_covered") == [(0, 1, 0), (1, 2, 4), (2, 0, 1)]


@pytest.mark.parametrize("statistic", ["pearson", "cosine"])
def test_permuted_statistics_are_those_of_permute(spark, statistic):
    draw = random.Random(3)
    value = lambda: draw.choice([None, float("nan"), *(round(draw.random(), 2) for _ in range(8))])
    data = [(g, f"u{k}", value(), value()) for g, n in (("a", 40), ("b", 3), (None, 12), ("one", 1)) for k in range(n)]
    data += [("flat", f"u{k}", 0.1, float(k)) for k in range(6)] + [("void", f"u{k}", None, 1.0) for k in range(3)]
    df = spark.createDataFrame(data, "g string, unit string, x double, y double").withColumn("s", F.lit("clash")).repartition(4)
    n = stats.DRAWS + 5  # more than one task a group
    got = {(r["g"], r["perm_id"]): r["s"] for r in stats.permuted_statistics(df, "x", "y", "unit", ["g"], n, statistic=statistic).collect()}
    spark_only = {(r["g"], r["perm_id"]): r["s"] for r in stats.permuted_statistics(df, "x", "y", "unit", ["g"], n, statistic=statistic, held=0).collect()}
    mixed = {(r["g"], r["perm_id"]): r["s"] for r in stats.permuted_statistics(df, "x", "y", "unit", ["g"], n, statistic=statistic, held=6).collect()}
    assert len(got) == 6 * (n + 1) and got.keys() == spark_only.keys() == mixed.keys()
    for other in (spark_only, mixed):
        for k, s in got.items():
            assert (s is None) == (other[k] is None) and (s is None or math.isclose(s, other[k], abs_tol=1e-9)), (k, s, other[k])
    assert all(got["void", i] is None for i in (0, 1)) and (statistic == "cosine" or got["flat", 1] is None)
    assert stats.permuted_statistics(df.limit(0), "x", "y", "unit", ["g"], 3).count() == 0
    every = stats.permuted_statistics(df.filter("g = 'a'"), "x", "y", "unit", [], 3, statistic=statistic).collect()
    assert {r["perm_id"]: r["s"] for r in every} == {i: got["a", i] for i in range(4)}
    with pytest.raises(ValueError):
        stats.permuted_statistics(df, "x", "y", "unit", ["g"], 3, statistic="other")


def test_permute_keeps_groups_of_null_keys(spark):
    df = spark.createDataFrame([(None, k, k * 10, "e") for k in range(4)] + [("a", 1, 5, "e")], "g string, unit int, v int, other string")
    out = stats.permute(df, ["g"], "v", "unit", 2)
    assert out.count() == 10 and rows(out.filter("g is null and perm_id = 1"), "v") == [(0,), (10,), (20,), (30,)]


def test_ranks_of_identifiers(spark, monkeypatch):
    draw = random.Random(5)
    ids = [None, "", *(f"S-{draw.randrange(300)}" for _ in range(900))]
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, _id int").repartition(6)
    rank = {i: k + 1 for k, i in enumerate(sorted({i for i in ids if i is not None}))}
    for borders, width in ((4, 6), (512, 1)):
        monkeypatch.setattr(windows, "BORDERS", borders)
        want = sorted((f"P{rank[i]:0{width}d}", k) for k, i in enumerate(ids) if i is not None)
        assert sorted((r["id"], r["_id"]) for r in windows.deidentify(df, "id", "P", width).collect()) == want
    assert windows.deidentify(df.limit(0), "id", "P").count() == 0


def test_silhouette_does_not_depend_on_blocks(spark, monkeypatch):
    draw = random.Random(6)
    points = [(k, f"l{k % 9}", [draw.gauss(k % 9, 1), draw.gauss(0, 1)]) for k in range(120)] + [(999, "alone", [0.0, 0.0])]
    df = spark.createDataFrame(points, "id int, label string, v array<double>").repartition(3)
    whole = rows(stats.silhouette(df, "v", "label", "id"), "label", "silhouette", "n")
    monkeypatch.setattr(stats, "LABELS", 2)
    blocks = rows(stats.silhouette(df, "v", "label", "id"), "label", "silhouette", "n")
    assert [r[::2] for r in whole] == [r[::2] for r in blocks] and all(math.isclose(a[1], b[1], abs_tol=1e-12) for a, b in zip(whole, blocks, strict=True))


def test_merged_region_pileups(spark):
    schema = "sample_id int, chrom string, pos long, a_n int, t_n int, extra string"
    one = spark.createDataFrame([(1, "a", 5, 3, 0, "x"), (1, "a", 9, 1, 1, "x"), (1, "a", 9, 1, 1, "x")], schema)
    two = spark.createDataFrame([(1, "a", 9, 2, 0, "y"), (2, "a", 9, 1, 1, None), (None, "a", 9, 4, 4, None)], schema)
    got = rows(calling.merge_pileups([one, two.select(*reversed(two.columns))], "a_n + t_n"), "sample_id", "pos", "a_n", "t_n", "extra")
    assert got == [(None, 9, 4, 4, None), (1, 5, 3, 0, "x"), (1, 9, 2, 0, "y"), (2, 9, 1, 1, None)]
    assert calling.merge_pileups([one.limit(0), two.limit(0)], "a_n + t_n").count() == 0
