"""Tests, adjustments, resampling and enrichment over groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import nulls
from varloom.functions.scalars import normal_cdf
from varloom.functions.tails import chi2_p, hypergeometric_upper, student_p
from varloom.operators.windows import _same, average_rank, quantile_groups


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson correlation, null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlate(df: DataFrame, x: str, y: str, key: list[str], method: str = "pearson", with_p: bool = True) -> DataFrame:
    """Correlation of two columns in each group, over rows that have both: n, r, t, p."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if method == "spearman":
        d = d.withColumn("x2", average_rank("x", key)).withColumn("y2", average_rank("y", key)).select(*key, F.col("x2").alias("x"), F.col("y2").alias("y"))
    elif method != "pearson":
        raise ValueError(f"unknown method {method}")
    out = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("r"))
    out = out.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.greatest(F.lit(0.0), 1 - F.col("r") * F.col("r")))))
    return out.withColumn("p", student_p("t", F.col("n") - 2)) if with_p else out


def _exact(small: DataFrame, key: list[str], columns: list[str], p: Callable[..., float]) -> DataFrame:
    """``p_exact`` of each group, from its values of ``columns``, of groups that are small."""
    types = dict(small.dtypes)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["p_exact"] = [float(p(*(np.asarray(x) for x in row))) for row in zip(*(frame[c] for c in columns), strict=True)]
            yield frame[[*key, "p_exact"]]

    rows = small.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"))
    lists = rows.filter(F.size("_rows") > 0).select(*key, *(F.col("_rows")[c].alias(c) for c in columns))
    return lists.mapInPandas(work, ", ".join([*(f"{c} {types[c]}" for c in key), "p_exact double"]))


def _beside(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """df with the one row of each group in ``other``, where there is one; null keys match."""
    if not key:
        return df.join(F.broadcast(other), F.lit(True), "left")  # one row
    renamed = other.select(*(F.col(k).alias(f"_{k}") for k in key), *(c for c in other.columns if c not in key))
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(renamed, on, "left").drop(*(f"_{k}" for k in key))


def rank_sum(df: DataFrame, value: str, label: str, key: list[str], exact: int = 0) -> DataFrame:
    """Two-group rank test: W of the label that sorts first, z with the correction for ties, normal p.

    With ``exact`` also p_corrected, normal with the correction for continuity, and p_exact, which is worked out from all
    ways to deal the ranks (those of ties included) where both groups have fewer rows than that, and null elsewhere.
    """
    d = df.filter(F.col(value).isNotNull()).select(*key, F.col(value).alias("v"), F.col(label).alias("l"))
    first = d.groupBy(*key).agg(F.min("l").alias("first"))
    ranked = d.withColumn("r", average_rank("v", key)).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy(*key, "v")))
    ranked = ranked.join(first, key) if key else ranked.join(F.broadcast(first), how="cross")  # one row
    mine = F.col("l") == F.col("first")
    s = ranked.groupBy(*key).agg(
        F.count_if(mine).alias("n1"), F.count_if(~mine).alias("n2"), F.sum(F.when(mine, F.col("r"))).alias("rs"), F.sum((F.col("c") * F.col("c") - 1).cast("double")).alias("ties")
    )
    n = F.col("n1") + F.col("n2")
    w = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    off = F.col("w") - F.col("n1") * F.col("n2") / 2
    out = s.withColumn("w", w).withColumn("z", F.try_divide(off, sd)).withColumn("p_corrected", F.least(F.lit(1.0), 2 * normal_cdf(-F.try_divide(F.greatest(F.lit(0.0), F.abs(off) - 0.5), sd))))
    out = out.withColumn("p", 2 * normal_cdf(-F.abs("z"))).select(*key, "n1", "n2", "w", "z", "p", *(["p_corrected"] if exact else []))
    if not exact:
        return out
    few = out.filter((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n1") < exact) & (F.col("n2") < exact)).select(*key, F.lit(True).alias("_few"))
    small = _beside(ranked.select(*key, (2 * F.col("r")).cast("long").alias("twice"), mine.alias("mine")), few, key).filter("_few")
    return _beside(out, _exact(small, key, ["twice", "mine"], nulls.rank_sum_p), key)


def signed_rank(df: DataFrame, x: str, y: str, key: list[str], exact: int = 0) -> DataFrame:
    """Paired signed-rank test: V, the sum of the ranks of positive differences; z; pairs without difference are left out.

    With ``exact`` also p (normal), p_corrected (for continuity) and p_exact, which is worked out from all signs that the
    ranks (those of ties included) may have, for groups of fewer pairs than that, and null elsewhere.
    """
    d = df.select(*key, (F.col(x) - F.col(y)).cast("double").alias("d")).filter("d <> 0").withColumn("a", F.abs("d"))
    r = d.withColumn("r", average_rank("a", key)).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy(*key, "a")))
    s = r.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("v"), F.sum((F.col("c") * F.col("c") - 1).cast("double")).alias("ties"))
    n = F.col("n")
    off, sd = F.col("v") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    out = s.withColumn("z", F.try_divide(off, sd))
    if not exact:
        return out.drop("ties")
    corrected = F.least(F.lit(1.0), 2 * normal_cdf(-F.try_divide(F.greatest(F.lit(0.0), F.abs(off) - 0.5), sd)))
    out = out.withColumn("p", 2 * normal_cdf(-F.abs("z"))).withColumn("p_corrected", corrected).drop("ties")
    few = out.filter(n < exact).select(*key, F.lit(True).alias("_few"))
    small = _beside(r.select(*key, (2 * F.col("r")).cast("long").alias("twice"), (F.col("d") > 0).alias("up")), few, key).filter("_few")
    return _beside(out, _exact(small, key, ["twice", "up"], nulls.signed_rank_p), key)


def ks_two_sample(df: DataFrame, value: str, label: str, key: list[str], exact: int = 0) -> DataFrame:
    """Largest difference of two empirical distributions; counts per distinct value are ordered, not rows.

    With ``exact`` also p, by Kolmogorov's series, and p_exact, from all orders of the rows with those of equal values kept together,
    where the product of both groups' rows is less than that, and null elsewhere.  Groups of one label have null statistics.
    """
    first = df.groupBy(*key).agg(F.min(label).alias("first"))
    d = df.join(first, key) if key else df.join(F.broadcast(first), how="cross")  # one row
    mine = F.col(label) == F.col("first")
    at = d.groupBy(*key, F.col(value).alias("v")).agg(F.count_if(mine).alias("a"), F.count_if(~mine).alias("b"))
    run, every = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    gap = F.abs(F.try_divide(F.sum("a").over(run), F.sum("a").over(every)) - F.try_divide(F.sum("b").over(run), F.sum("b").over(every)))
    out = at.withColumn("gap", gap).groupBy(*key).agg(F.max("gap").alias("d"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    if not exact:
        return out
    out = out.withColumn("p", kolmogorov_p(F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))))
    few = out.filter((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n1") * F.col("n2") < exact)).select(*key, F.lit(True).alias("_few"))
    return _beside(out, _exact(_beside(at.select(*key, "v", "a", "b"), few, key).filter("_few"), key, ["v", "a", "b"], lambda v, a, b: nulls.ks_p(a, b)), key)


def kolmogorov_p(x: Column) -> Column:
    """P that the supremum of a Brownian bridge is above x: 2 * sum of (-1)^(k - 1) * exp(-2 * k^2 * x^2); 1 below 0.1."""
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0.0), lambda total, k: total + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x.isNotNull(), F.when(x < 0.1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * terms))))


def hash_index(n: Column, *parts: Column) -> Column:
    """A number in 1..n that depends on the parts alone, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long") % n + 1


#: Rows of a group that one task holds, ranges that larger groups are cut into, and cells of weights worked out together.
HELD, RANGES, CELLS = 1 << 20, 256, 1 << 22


def bootstrap_ci(df: DataFrame, value: str, key: list[str], stat: str = "mean", *args, **more) -> DataFrame:
    """One statistic of each group with an interval; see ``bootstrap``, which takes the same arguments."""
    return bootstrap(df, value, key, (stat,), *args, **more).drop("statistic")


def bootstrap(
    df: DataFrame, value: str, key: list[str], stats: tuple[str, ...] = ("mean",), rounds: int = 1000, interval: float = 0.95, seed: int = 1, trim: float = 0.1, held: int = HELD
) -> DataFrame:
    """Statistics of each group ('mean', 'median', 'trimmed_mean'; a row for each) with an interval: the quantiles of (original - resample), added to the original.

    Every statistic is the mean of some places of the ordered values: of a trimmed mean those without floor(trim * n) at
    either end, of each resample's own values.  In each round a row is drawn a Poisson number of times, told by a hash
    of seed, group, value and number among equal values, so a resample needs no copy of the table and does not depend on partitions; the numbers of
    rows of resamples differ from the group's by about its square root.  Rounds that draw nothing are left out.

    A group of up to ``held`` rows is worked out whole in a task.  A larger one is cut into ranges of values by approximate
    quantiles; sums of each range and round tell in which ranges a statistic's first and last places lie, and only those
    ranges are ordered; whether there are such groups is found out at once.  Nulls are left out; null keys are a group.
    """
    if unknown := set(stats) - {"mean", "median", "trimmed_mean"}:
        raise ValueError(f"unknown statistics {unknown}")
    d = df.filter(F.col(value).isNotNull()).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col(value).cast("double").alias("v"))
    by = [f"_k{i}" for i in range(len(key))]
    types, factors, off = dict(d.dtypes), nulls.round_factors(seed, rounds), (1 - interval) / 2
    names = ", ".join(f"{k} {types[k]}" for k in by)
    named = (names + ", ") * bool(by)
    each = d.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    told = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in by), F.col("v").cast("string"), F.col("j").cast("string")))
    rows = each.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), "c"))).select(*by, "v", (F.conv(F.substring(told, 1, 8), 16, 10).cast("long") % nulls.PRIME).alias("x"))
    sizes = each.groupBy(*by).agg(F.sum("c").alias("n"))
    any_large = not sizes.filter(F.col("n") > held).isEmpty()
    sized = _beside(rows, sizes, by) if any_large else rows

    def slices(n: int) -> Iterator[slice]:
        step = max(1, CELLS // max(1, n))
        return (slice(a, min(a + step, rounds)) for a in range(0, rounds, step))

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        v, x = (c.to_numpy() for _, c in frame.sort_values("v")[["v", "x"]].items())
        if not len(v):
            return pd.DataFrame(columns=[*by, "statistic", "estimate", "low", "high"])
        found: dict[str, list[np.ndarray]] = {stat: [] for stat in stats}
        for part in slices(len(v)):
            w = nulls.resample_weights(x, factors[part])
            n = w.sum(axis=1)
            for stat in stats:
                low, high = nulls.between(stat, n, trim)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where(n > 0, nulls.placed_sums(v, w, low, high) / (high - low + 1), np.nan)
                found[stat].append(s[int(part.start > 0) :])
        out = []
        for stat, parts in found.items():
            s = np.concatenate(parts)
            gaps = s[0] - s[1:][~np.isnan(s[1:])]
            out.append((*frame[by].iloc[0], stat, s[0], *(s[0] + np.quantile(gaps, [off, 1 - off]) if len(gaps) else (np.nan, np.nan))))
        return pd.DataFrame(out, columns=[*by, "statistic", "estimate", "low", "high"])

    named_back = lambda out: out.select(*(F.col(a).alias(k) for a, k in zip(by, key, strict=True)), "statistic", "estimate", "low", "high")
    schema = f"{named}statistic string, estimate double, low double, high double"
    if not any_large:
        return named_back(sized.groupBy(*by).applyInPandas(whole, schema))
    found = sized.filter(F.col("n") <= held).groupBy(*by).applyInPandas(whole, schema)

    # Larger groups: sums of ranges, then the places within the ranges that hold a first or last place.
    large = sized.filter(F.col("n") > held)
    cuts = large.groupBy(*by).agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 20 * RANGES).alias("cuts"))
    ranged = _beside(large, cuts, by).withColumn("at", F.size(F.filter("cuts", lambda c: c < F.col("v")))).select(*by, "at", "v", "x")

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        v, x, out = frame["v"].to_numpy(), frame["x"].to_numpy(), []
        for part in slices(len(v)):
            w = nulls.resample_weights(x, factors[part])
            out.append(pd.DataFrame({"round": np.append(0, np.arange(part.start, part.stop) + 1), "w": w.sum(axis=1), "s": w @ v})[int(part.start > 0) :])
        return pd.concat(out).assign(**{c: frame[c].iloc[0] for c in [*by, "at"]})[[*by, "at", "round", "w", "s"]]

    totals = ranged.groupBy(*by, "at").applyInPandas(sums, f"{named}at int, round int, w bigint, s double")
    per = Window.partitionBy(*by, "round")
    n, before = F.sum("w").over(per), F.coalesce(F.sum("w").over(per.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = totals.withColumn("n", n).withColumn("before", before)

    def some(values: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "round", "first", "last", "s"]
        if values.empty or wanted.empty:
            return pd.DataFrame(columns=columns)
        v, x = (c.to_numpy() for _, c in values.sort_values("v")[["v", "x"]].items())
        s, step = [], max(1, CELLS // len(v))
        for a in range(0, len(wanted), step):
            q = wanted.iloc[a : a + step]
            w = np.stack([nulls.resample_weights(x, factors[b - 1 : b])[1 if b else 0] for b in q["round"]])
            s.append(nulls.placed_sums(v, w, q["low"].to_numpy(), q["high"].to_numpy()))
        return wanted.assign(s=np.concatenate(s))[columns]

    for stat in stats:
        first = {"mean": F.lit(1), "median": F.floor((F.col("n") + 1) / 2), "trimmed_mean": F.floor(F.col("n") * trim) + 1}[stat].cast("long")
        last = F.floor(F.col("n") / 2) + 1 if stat == "median" else F.col("n") + 1 - F.col("first")
        at = placed.withColumn("first", first).withColumn("last", last)
        at = at.withColumn("low", F.greatest(F.col("first") - F.col("before"), F.lit(1))).withColumn("high", F.least(F.col("last") - F.col("before"), F.col("w"))).filter("low <= high")
        all_of = at.filter("low = 1 and high = w").select(*by, "round", "first", "last", "s")
        asked = at.filter("low > 1 or high < w").select(*by, "at", "round", "first", "last", "low", "high")
        parts = ranged.groupBy(*by, "at").cogroup(asked.groupBy(*by, "at")).applyInPandas(some, f"{named}round int, first bigint, last bigint, s double")
        means = all_of.unionByName(parts).groupBy(*by, "round", "first", "last").agg(F.sum("s").alias("s")).select(*by, "round", (F.col("s") / (F.col("last") - F.col("first") + 1)).alias("s"))
        original = means.filter("round = 0").select(*by, F.col("s").alias("estimate"))
        q = _beside(means.filter("round > 0"), original, by).groupBy(*by).agg(F.first("estimate").alias("estimate"), F.percentile(F.col("estimate") - F.col("s"), F.array(F.lit(off), F.lit(1 - off))).alias("_q"))
        found = found.unionByName(q.filter("estimate is not null").select(*by, F.lit(stat).alias("statistic"), "estimate", (F.col("estimate") + F.col("_q")[0]).alias("low"), (F.col("estimate") + F.col("_q")[1]).alias("high")))
    return named_back(found)


def permute(df: DataFrame, key: list[str], value: str, unit: str, n: int, seed: int = 1) -> DataFrame:
    """n copies of the table, numbered by perm_id, in each of which the values of a group are dealt anew to its units."""
    copies = lambda d: d.withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm_id").cast("string"), F.col(unit).cast("string")))
    to = copies(df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(unit))).drop(value))  # ordered before it is copied
    dealt = copies(df.select(*key, unit, value)).withColumn("_k", F.row_number().over(Window.partitionBy("perm_id", *key).orderBy(order, unit)))
    on = ["perm_id", *key, "_k"]
    named = dealt.select(*(F.col(c).alias(f"_of_{c}") for c in on), value)
    return to.join(named, _same(on)).select(*(c for c in to.columns if c != "_k"), value)


#: Rows of a group that one task permutes whole, and how many permutations of a group it works out.
PERMUTED, DRAWS = 1 << 17, 128


def permuted_statistics(df: DataFrame, x: str, y: str, unit: str, key: list[str], n: int, seed: int = 1, statistic: str = "pearson", held: int = PERMUTED) -> DataFrame:
    """A statistic ('pearson' or 'cosine') of two columns of each group and of n permutations of it: (key, perm_id, s), perm_id 0 for the real one.

    The permutations are those of ``permute``.  A group of up to ``held`` rows is sent to a task as it is, once for each
    128 permutations, which are orders of one array there; the table is not copied for each.  Larger groups are permuted
    by Spark; whether there are such groups is found out at once.  Nulls and NaN of either column are dealt like values, and pairs
    with one do not count; a statistic that is not defined is null.  Null keys are a group; rows that repeat a unit are
    ordered by their values, in groups of up to ``held`` rows.
    """
    if statistic not in ("pearson", "cosine"):
        raise ValueError(f"unknown statistic {statistic}")
    by = [f"_k{i}" for i in range(len(key))]
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*(F.col(k).alias(a) for a, k in zip(by, key, strict=True)), F.col(unit).alias("_u"), F.col(unit).cast("string").alias("_name"), number(x).alias("_x"), number(y).alias("_y"))
    schema = ", ".join([*(f"{k} {t}" for k, t in rows.dtypes if k in by), "perm_id int, s double"])
    of = nulls.correlation if statistic == "pearson" else nulls.cosine

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=[*by, "perm_id", "s"])
        frame = frame.sort_values(["_u", "_y", "_x"], na_position="first")
        block, names = int(frame["_b"].iloc[0]), [b"" if u is None else b"|" + u.encode() for u in frame["_name"]]
        a, b = frame["_x"].to_numpy(float), frame["_y"].to_numpy(float)
        drawn = range(block * DRAWS, min((block + 1) * DRAWS, n + 1))
        s = [of(a, b[nulls.hashed_order(names, seed, i)] if i else b) for i in drawn]
        return pd.DataFrame({**{k: [frame[k].iloc[0]] * len(s) for k in by}, "perm_id": list(drawn), "s": s})

    def whole(some: DataFrame) -> DataFrame:
        return some.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n // DRAWS)))).groupBy(*by, "_b").applyInPandas(work, schema).withColumn("s", F.nanvl("s", F.lit(None).cast("double")))

    named = lambda out: out.select(*(F.col(a).alias(k) for a, k in zip(by, key, strict=True)), "perm_id", "s")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if sizes.filter(F.col("_n") > held).isEmpty():
        return named(whole(rows))
    sized = _beside(rows, sizes, by)
    large = sized.filter(F.col("_n") > held).drop("_n", "_name")
    dealt = permute(large, by, "_y", "_u", n, seed).unionByName(large.withColumn("perm_id", F.lit(0)))
    pair = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    a, b = F.when(pair, F.col("_x")), F.when(pair, F.col("_y"))
    s = safe_corr(a, b) if statistic == "pearson" else F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b)))
    return named(whole(sized.filter(F.col("_n") <= held).drop("_n")).unionByName(dealt.groupBy(*by, "perm_id").agg(s.alias("s"))))


def _against_permuted(statistics: DataFrame, key: list[str]) -> DataFrame:
    """The real statistic of each row's group beside the permuted ones (n rows a group)."""
    real = F.max(F.when(F.col("perm_id") == 0, F.col("s"))).over(Window.partitionBy(*key))
    return statistics.withColumn("_real", real).filter("perm_id > 0")


def permuted_p(df: DataFrame, x: str, y: str, unit: str, key: list[str], n: int = 99, seed: int = 1) -> DataFrame:
    """Two-sided p of each group's correlation and of each of n permutations of it: (key, perm_id, r, p), perm_id 0 for the real one.

    The p of each is the share of all n + 1 that are as far from 0 (to nine digits), itself included, so real and
    permuted ones are worked out alike.  A correlation that is not defined counts as 0.
    """
    r = permuted_statistics(df, x, y, unit, key, n, seed).withColumnRenamed("s", "r")
    far = r.withColumn("_a", F.round(F.abs(F.coalesce("r", F.lit(0.0))), 9))
    as_far = F.count(F.lit(1)).over(Window.partitionBy(*key).orderBy(F.col("_a").desc()).rangeBetween(Window.unboundedPreceding, 0))  # n + 1 rows
    return far.withColumn("p", as_far / (n + 1.0)).drop("_a")


def adjust(df: DataFrame, p: str, key: list[str], method: str = "bh", out: str = "p_adjusted") -> DataFrame:
    """Adjusted p-values of each group.

    Benjamini-Hochberg works on the distinct p-values and their counts, so one long list of tests
    orders only as many rows as it has different values.
    """
    if method == "bonferroni":
        m = df.groupBy(*key).agg(F.count(p).alias("_m"))
        joined = df.join(m, key) if key else df.join(F.broadcast(m), how="cross")  # one row
        return joined.withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("_m"))).drop("_m")
    if method != "bh":
        raise ValueError(f"unknown method {method}")
    counts = df.filter(F.col(p).isNotNull()).groupBy(*key, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    up, down = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col("_p") * F.sum("_n").over(Window.partitionBy(*key)) / F.sum("_n").over(up)
    found = counts.withColumn("_raw", raw).withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(down))).select(*[F.col(k).alias(f"_{k}") for k in key], "_p", out)
    match = F.col(p) == F.col("_p")
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(found, match, "left").drop("_p", *[f"_{k}" for k in key])


def permutation_fdr(real: DataFrame, permuted: DataFrame, p: str = "p", key: list[str] | None = None) -> DataFrame:
    """Expected false positives over the rank: share of permuted p-values up to a real one times the
    number of real ones, over how many real ones are up to it."""
    key = key or []
    both = real.groupBy(*key, p).agg(F.count(F.lit(1)).alias("a")).withColumn("b", F.lit(0).cast("long")).unionByName(
        permuted.groupBy(*key, p).agg(F.count(F.lit(1)).alias("b")).withColumn("a", F.lit(0).cast("long"))
    )
    at = both.groupBy(*key, p).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run, every = Window.partitionBy(*key).orderBy(p).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    fdr = F.try_divide(F.try_divide(F.sum("b").over(run), F.sum("b").over(every)) * F.sum("a").over(every), F.sum("a").over(run))
    return at.withColumn("fdr", fdr).filter("a > 0").select(*key, p, F.col("a").alias("n"), "fdr")


def uniform_fdr(df: DataFrame, p: str, key: list[str] | None = None) -> DataFrame:
    """FDR of each distinct p-value if p-values were uniform."""
    key = key or []
    at = df.groupBy(*key, p).agg(F.count(F.lit(1)).alias("n"))
    run, every = Window.partitionBy(*key).orderBy(p).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    return at.withColumn("fdr", F.least(F.lit(1.0), F.sum("n").over(every) * F.col(p) / F.sum("n").over(run)))


def fisher_combine(df: DataFrame, p: str, key: list[str], with_p: bool = True) -> DataFrame:
    """Fisher's combination of the p-values of each group."""
    out = df.filter(F.col(p).isNotNull()).groupBy(*key).agg((-2 * F.sum(F.log(F.greatest(F.col(p), F.lit(1e-300))))).alias("statistic"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("p_combined", chi2_p("statistic", 2 * F.col("n"))) if with_p else out


def binomial_enrichment(counts: DataFrame, key: list[str], share: str, n: str = "n", total: str = "total") -> DataFrame:
    """Whether counts are few or many for a binomial with the total and the expected share.

    p_low is P(X <= n), p_high P(X > n), each adjusted by Benjamini-Hochberg over the rows of a key; fdr is the
    smaller of both.  Tails are worked out once for each distinct count, total and share.
    """
    from varloom.operators.filters import binomial_tail

    kinds = counts.select(n, total, share).distinct()
    tails = kinds.withColumn("p_high", binomial_tail(F.col(total), F.col(n), F.col(share).cast("double")))
    # P(X <= n) is the upper tail of the failures, so that small values keep their digits.
    tails = tails.withColumn("p_low", binomial_tail(F.col(total), F.col(total) - F.col(n) - 1, 1 - F.col(share).cast("double")))
    both = counts.join(tails, [n, total, share])
    out = adjust(adjust(both, "p_low", key, out="fdr_low"), "p_high", key, out="fdr_high")
    return out.withColumn("fdr", F.least("fdr_low", "fdr_high"))


def hypergeometric_tail(hits: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """P(X >= hits) when ``drawn`` of ``total`` are drawn and ``marked`` are marked, for numbers of any size."""
    return hypergeometric_upper(*(c.cast("double") for c in (hits, drawn, marked, total)))


def overlap_significance(counts: DataFrame, hits: str, drawn: str, marked: str, total: str, key: list[str]) -> DataFrame:
    """Hypergeometric p of each row, Bonferroni-adjusted over the rows of a key."""
    p = hypergeometric_tail(*(F.col(c).cast("long") for c in (hits, drawn, marked, total)))
    return adjust(counts.withColumn("p", p), "p", key, "bonferroni")


def set_enrichment(selected: DataFrame, universe: DataFrame, terms: DataFrame) -> DataFrame:
    """Over-representation of selected genes in each term: overlap, sizes, p, BH, genes.

    ``terms`` has (term, gene_id); genes outside the universe do not count.
    """
    known = terms.join(universe.select("gene_id").distinct(), "gene_id", "left_semi").distinct()
    chosen = selected.select("gene_id").distinct().join(universe.select("gene_id").distinct(), "gene_id", "left_semi").withColumn("_in", F.lit(True))
    per = known.join(chosen, "gene_id", "left").groupBy("term").agg(
        F.count(F.lit(1)).alias("n_term"), F.count("_in").alias("n_overlap"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("_in"), F.col("gene_id")))), ",").alias("genes")
    )
    sizes = universe.select("gene_id").distinct().agg(F.count(F.lit(1)).alias("n_universe")).crossJoin(chosen.agg(F.count(F.lit(1)).alias("n_selected")))  # one row each
    both = per.join(F.broadcast(sizes), how="cross")
    p = hypergeometric_tail(*(F.col(c).cast("long") for c in ("n_overlap", "n_selected", "n_term", "n_universe")))
    return adjust(both.withColumn("p", p), "p", [])


def permuted_correlation(df: DataFrame, x: str, y: str, unit: str, key: list[str], n: int = 100, seed: int = 1) -> DataFrame:
    """Observed correlation of each group against n permutations: mean and sd of those, one-sided p."""
    both = _against_permuted(permuted_statistics(df, x, y, unit, key, n, seed), key)
    reached = F.avg((F.col("s") >= F.col("_real") - 1e-12).cast("double"))
    return both.groupBy(*key).agg(F.first("_real").alias("observed"), F.avg("s").alias("perm_mean"), F.stddev_samp("s").alias("perm_sd"), reached.alias("p"))


def permuted_cosine(df: DataFrame, a: str, b: str, unit: str, key: list[str], n: int = 100, seed: int = 1) -> DataFrame:
    """Cosine of two columns of each group with the share of permutations that reach it."""
    both = _against_permuted(permuted_statistics(df, a, b, unit, key, n, seed, "cosine"), key)
    return both.groupBy(*key).agg(F.first("_real").alias("cosine"), F.avg((F.col("s") >= F.col("_real") - 1e-12).cast("double")).alias("p"))


def matched_random_sets(genes: DataFrame, targets: DataFrame, level: str, n: int, bins: int = 10, seed: int = 1) -> DataFrame:
    """n random gene sets that match the targets' number in each bin of expression and avoid the targets."""
    binned = quantile_groups(genes, level, bins)
    flagged = binned.join(targets.select("gene_id").distinct().withColumn("_t", F.lit(True)), "gene_id", "left")
    need = flagged.filter("_t").groupBy("quantile_group").agg(F.count(F.lit(1)).alias("need"))
    pool = flagged.filter("_t is null").withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm_id").cast("string"), "gene_id"))
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy("perm_id", "quantile_group").orderBy(order, "gene_id")))
    return ranked.join(need, "quantile_group").filter("_r <= need").select("perm_id", "gene_id")


def driver_enrichment(counts: DataFrame, targets: DataFrame, random_sets: DataFrame) -> DataFrame:
    """Mean count of the target genes against those of the random sets: log2 ratio and empirical p."""
    real = counts.join(targets.select("gene_id").distinct(), "gene_id").agg(F.avg("n").alias("target_mean"))
    sets = random_sets.join(counts, "gene_id").groupBy("perm_id").agg(F.avg("n").alias("m"))
    both = sets.join(F.broadcast(real), how="cross")  # one row
    return both.agg(F.first("target_mean").alias("target_mean"), F.avg("m").alias("random_mean"), F.log2(F.try_divide(F.first("target_mean"), F.avg("m"))).alias("log2_ratio"), F.avg((F.col("m") >= F.col("target_mean")).cast("double")).alias("p"))


#: Labels that points meet at a time.
LABELS = 256


def silhouette(points: DataFrame, features: str, label: str, id_col: str) -> DataFrame:
    """Mean silhouette width of each label under squared Euclidean distance.

    Distances to a label's points follow from its count, sum vector and sum of squares, so points meet one row
    per label and no pair of points is formed.  Labels are dealt by hash to blocks of some 256, and points meet them by
    block: Spark broadcasts the labels where they are few and splits the points of a block where they are not.
    """
    dims = points.select(id_col, label, F.posexplode(features).alias("d", "x"))
    per_dim = dims.groupBy(label, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    one = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    stats = per_dim.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("sums"), F.sum("q").alias("sq"), F.max("n").alias("n"))
    blocks = stats.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / LABELS)).cast("int").alias("_blocks"))  # one row
    beside = lambda d: d.join(F.broadcast(blocks), how="cross")
    stats = beside(stats).select(F.col(label).alias("_other"), "sums", "sq", "n", F.pmod(F.hash(label), "_blocks").alias("_at"))
    x = F.transform(features, lambda v: v.cast("double"))
    own_sq = one(F.transform(x, lambda v: v * v))
    dot = one(F.zip_with(x, F.col("sums"), lambda a, b: a * b))
    dealt = beside(points.select(id_col, label, features)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    each = dealt.join(stats, F.col("_block") == F.col("_at"))
    total = F.col("n") * own_sq - 2 * dot + F.col("sq")
    mean = F.when(F.col(label) == F.col("_other"), F.when(F.col("n") > 1, total / (F.col("n") - 1))).otherwise(total / F.col("n"))
    dist = each.withColumn("m", mean).groupBy(id_col, label).agg(
        F.max(F.when(F.col(label) == F.col("_other"), F.col("m"))).alias("a"), F.min(F.when(F.col(label) != F.col("_other"), F.col("m"))).alias("b")
    )
    width = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return dist.groupBy(label).agg(F.avg(width).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def principal_components(points: DataFrame, features: str, explained: float = 0.9, most: int | None = None) -> DataFrame:
    """Scores of the leading components that explain a share of the variance; ``most`` of them where it is given.

    Fifty are worked out first, all only where those do not explain the share."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = points.withColumn("_v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    width = len(v.select(features).first()[0])
    limit = min(most or width, width)
    for tried in (min(50, limit), limit):
        model = PCA(k=tried, inputCol="_v", outputCol="_s").fit(v)
        total, k = 0.0, 0
        while k < tried and total < explained:
            total, k = total + float(model.explainedVariance[k]), k + 1
        if total >= explained or tried == limit:
            break
    return model.transform(v).withColumn("scores", F.slice(vector_to_array("_s"), 1, max(1, k))).drop("_v", "_s")


def error_grid(coverages: DataFrame, most: int, qualities: tuple[float, ...]) -> DataFrame:
    """Expected probability that errors alone give at least n alternate reads, for each coverage, n and quality."""
    from varloom.functions.scalars import error_probability
    from varloom.operators.filters import binomial_tail

    grid = coverages.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("qual", F.explode(F.array(*[F.lit(float(q)) for q in qualities])))
    return grid.withColumn("p", binomial_tail(F.col("coverage").cast("int"), F.col("n") - 1, error_probability(F.col("qual"))))
