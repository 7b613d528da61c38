"""Order within groups: distances, ranks, quantile groups, top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.scalars import normal_quantile


def distance_to_next(calls: DataFrame, key: list[str]) -> DataFrame:
    """Positions to the next call of the key on the chromosome; null for the last."""
    return calls.withColumn("distance", F.lead("pos").over(Window.partitionBy(*key, "chrom").orderBy("pos")) - F.col("pos"))


def distance_summary(calls: DataFrame, key: list[str]) -> DataFrame:
    """Median, mean, sd, variance and number of distances to the next call; the last of a chromosome counts as 0."""
    d = distance_to_next(calls, key).withColumn("d", F.coalesce("distance", F.lit(0)))
    return d.groupBy(*key).agg(
        F.percentile("d", F.lit(0.5)).alias("median_d"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd_d"), F.var_samp("d").alias("var_d"), F.count(F.lit(1)).alias("n")
    )


def _same(names: list[str], other: str = "_of_") -> Column:
    """Names that agree with those of the other side, which begin with ``other``; nulls agree."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in names], F.lit(True))


def exact_quantiles(df: DataFrame, value: Column | str, key: list[str], probabilities: list[float], out: str = "_q") -> DataFrame:
    """Quantiles of each group as ``percentile`` has them (linear, nulls left out), an array in the order of ``probabilities``.

    No task holds the distinct values of a group.  Those are counted, and their counts added up by stretches of values (64
    for each power of two), so that the stretch of a place in the order is known; only the stretches that a quantile needs are
    ordered.  NaN is above all numbers.  A group without values has null.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = 64 * (F.greatest(F.lit(-1099.0), F.least(F.lit(1099.0), F.log2(F.abs("_v")))) + 1100)
    stretch = F.when(F.isnan("_v"), 1 << 20).when(F.col("_v") == 0, 0).when(F.col("_v").isNotNull(), (F.signum("_v") * F.floor(size)).cast("int"))
    cut = df.groupBy(*key, v.alias("_v")).agg(F.count(v).alias("_c")).withColumn("_s", stretch)
    along = lambda by, order: F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cut.groupBy(*key, "_s").agg(F.sum("_c").alias("_c")).withColumn("_before", along(key, "_s")).withColumn("_all", F.sum("_c").over(Window.partitionBy(*key)))
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("_at")) for i, p in enumerate(probabilities)]))
    named = [F.col(c).alias(f"_of_{c}") for c in (*key, "_s")]
    asked = sums.filter("_c > 0").select(*named, "_before", "_c", places.alias("_p")).select("*", "_p.*", F.explode(F.array_distinct(F.array(F.floor("_p._at"), F.ceil("_p._at")))).alias("_place"))
    asked = asked.filter((F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_c"))).drop("_c", "_p")
    inside = cut.filter("_c > 0").join(asked.select(*(f"_of_{c}" for c in (*key, "_s"))).distinct(), _same([*key, "_s"]), "left_semi").withColumn("_from", along([*key, "_s"], "_v"))
    reached = F.col("_place") - F.col("_before")
    found = asked.join(inside, _same([*key, "_s"]) & (reached >= F.col("_from")) & (reached < F.col("_from") + F.col("_c")))
    share = F.first("_at") - F.floor(F.first("_at"))
    between = F.when(F.min("_v") == F.max("_v"), F.min("_v")).otherwise((1 - share) * F.min("_v") + share * F.max("_v"))
    each = found.groupBy(*(f"_of_{c}" for c in key), "_i").agg(between.alias("_x"))
    arrays = each.groupBy(*(f"_of_{c}" for c in key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias(out))
    whole = sums.groupBy(*key).agg(F.max("_all").alias("_all"))
    if not key:
        return whole.join(F.broadcast(arrays), F.col("_all") > 0, "left").select(out)  # one row each
    return whole.join(arrays, _same(key), "left").select(*key, out)


def below_percentile(df: DataFrame, value: str, p: float, key: list[str]) -> DataFrame:
    """Rows whose value is below the key's percentile."""
    cut = exact_quantiles(df, value, key, [p], "_cut")
    return df.join(cut, key).filter(F.col(value) < F.col("_cut")[0]).drop("_cut")


def step_score(df: DataFrame, value: str, order: str, k: int, key: list[str] | None = None) -> DataFrame:
    """Mean of the k rows up to a row less the mean of the k rows after it, and the change of that to the next row."""
    w = Window.partitionBy(*(key or [])).orderBy(order)
    after = F.coalesce(F.avg(value).over(w.rowsBetween(1, k)), F.col(value))
    out = df.withColumn("step", F.avg(value).over(w.rowsBetween(1 - k, 0)) - after)
    return out.withColumn("step_change", F.coalesce(F.lead("step").over(w) - F.col("step"), F.lit(0.0)))


def change_point(steps: DataFrame, order: str, first: int = 25, key: list[str] | None = None) -> DataFrame:
    """Where the step falls most, among the first rows."""
    w = Window.partitionBy(*(key or [])).orderBy(order)
    ranked = steps.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first)
    return ranked.groupBy(*(key or [])).agg(F.min_by(order, F.struct("step_change", "_r")).alias("cutoff"))


def top_n(df: DataFrame, n: int, order: list[Column], key: list[str]) -> DataFrame:
    """The first n rows of each key; the order should end with a unique column."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= n)


def rank_scores(df: DataFrame, orders: dict[str, list[Column]], n: int = 50) -> DataFrame:
    """For each order a score from n down to 1 for its first n rows and 0 for others.

    Each order's first rows are found by themselves and joined, so that no task ranks the whole table.
    """
    out = df
    for name, order in orders.items():
        best = df.orderBy(*order).limit(n).withColumn(name, (n + 1 - F.row_number().over(Window.orderBy(*order))).cast("long")).select("gene_id", name)
        out = out.join(best, "gene_id", "left").fillna(0, [name])
    return out


def limit_per_gene_and_sample(calls: DataFrame, per_gene: int, per_sample: int) -> DataFrame:
    """The first calls of each gene in each sample, of samples that then have few enough."""
    w = Window.partitionBy("gene_id", "sample_id").orderBy("chrom", "pos", "alt")
    few = calls.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_gene).drop("_r")
    kept = few.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= per_sample).select("sample_id")
    return few.join(kept, "sample_id", "left_semi")


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k smallest p-values; each task keeps k, and those are merged."""
    return hits.orderBy("p", "feature", "phenotype").limit(k)


def quantile_groups(df: DataFrame, value: str, groups: int, key: list[str] | None = None) -> DataFrame:
    """Adds the interval (1 .. groups - 1) of ``groups`` evenly spaced quantiles that holds the value, the
    last one closed; equal values share a group."""
    cuts = exact_quantiles(df, value, key or [], [i / (groups - 1) for i in range(groups)])
    joined = df.join(cuts, key) if key else df.join(F.broadcast(cuts), how="cross")  # one row
    at = F.size(F.filter("_q", lambda q: q <= F.col(value)))
    return joined.withColumn("quantile_group", F.greatest(F.lit(1), F.least(F.lit(groups - 1), at))).drop("_q")


def residual_in_group(df: DataFrame, value: str, by: str, groups: int = 100, key: list[str] | None = None) -> DataFrame:
    """Value less the median of the rows in its quantile group of ``by``."""
    grouped = quantile_groups(df, by, groups, key)
    keys = [*(key or []), "quantile_group"]
    medians = exact_quantiles(grouped, value, keys, [0.5], "_m")
    return grouped.join(medians, keys).withColumn("residual", F.col(value) - F.col("_m")[0]).drop("_m")


def average_rank(value: str, key: list[str]) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*key)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*key, value)) - 1) / 2


def rankit(df: DataFrame, value: str, key: list[str], out: str = "rankit") -> DataFrame:
    """Normal scores of the ranks, qnorm((rank - 0.5) / n); nulls stay null and are not ranked."""
    present = [*key, "_has"]
    d = df.withColumn("_has", F.col(value).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(*present))
    return d.withColumn(out, F.when(F.col("_has"), normal_quantile((average_rank(value, present) - 0.5) / n))).drop("_has")


def quartile_contrast(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Rows in the lowest and highest quarter of the key's values, labelled low and high."""
    cuts = exact_quantiles(df, value, key, [0.25, 0.75])
    side = F.when(F.col(value) <= F.col("_q")[0], "low").when(F.col(value) >= F.col("_q")[1], "high")
    return df.join(cuts, key).withColumn("side", side).filter("side is not null").drop("_q")


def extreme_fraction(df: DataFrame, value: str, fraction: float, key: list[str]) -> DataFrame:
    """Rows in the top and bottom fraction of the key by percent rank."""
    r = F.percent_rank().over(Window.partitionBy(*key).orderBy(value))
    return df.withColumn("_r", r).filter((F.col("_r") <= fraction) | (F.col("_r") >= 1 - fraction)).withColumn("side", F.when(F.col("_r") <= fraction, "bottom").otherwise("top")).drop("_r")


#: Stretches that identifiers are cut into to be ranked.
BORDERS = 512


def deidentify(df: DataFrame, id_col: str, prefix: str, width: int = 6) -> DataFrame:
    """Replaces ids by a prefix and the zero-padded rank of the id among the distinct ids; rows with a null id are left out.

    Every some-hundredth id by its hash is a border; ids are ranked between two borders and the counts before are added,
    so no task ranks all.  Where the borders lie changes nothing in the ranks.  A rank longer than ``width`` stays whole.
    """
    ids = df.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    every = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / BORDERS)).alias("_every")
    sample = ids.join(F.broadcast(ids.agg(every)), how="cross").filter(F.pmod(F.xxhash64(id_col), "_every") == 0)  # one row
    borders = sample.agg(F.collect_list(id_col).alias("_borders"))  # about as many as BORDERS
    placed = ids.join(F.broadcast(borders), how="cross").withColumn("_s", F.size(F.filter("_borders", lambda b: b < F.col(id_col)))).drop("_borders")
    ranked = number_rows(placed, [], [F.col("_s")], [id_col], "_k").withColumn("_k", F.col("_k").cast("string"))
    named = ranked.select(F.col(id_col).alias("_of_id"), F.concat(F.lit(prefix), F.lpad("_k", F.greatest(F.length("_k"), F.lit(width)), F.lit("0"))).alias("_of_rank"))
    return df.join(named, F.col(id_col) == F.col("_of_id")).withColumn(id_col, F.col("_of_rank")).select(*df.columns)


def number_rows(df: DataFrame, by: list[str], stretches: list[Column], order: list[Column | str], out: str = "k") -> DataFrame:
    """Adds the row number of each group in the order of ``stretches``, then of ``order``, without a task that orders a whole group.

    Rows are counted by stretch, the counts before a stretch are added up over the stretches of a group (a row each), and
    only a stretch's own rows are ordered together.  Stretches must ascend with the order that is meant: ranges of
    positions, or the first digits of a hash.  Null keys are a group of their own.
    """
    names = [f"_s{i}" for i in range(len(stretches))]
    cut = df.withColumns(dict(zip(names, stretches)))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_c")).select(before.alias("_before"), *(F.col(c).alias(f"_of_{c}") for c in (*by, *names)))
    numbered = cut.withColumn(out, F.row_number().over(Window.partitionBy(*by, *names).orderBy(*order)))
    return numbered.join(counts, _same([*by, *names])).withColumn(out, F.col(out) + F.col("_before")).select(*df.columns, out)
