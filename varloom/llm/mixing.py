"""Mixing sources to target weights by pivotal rounding of copies; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.common import WORD, checkpointed, documents, whole_text

#: Rows that one group of the reduction tree rounds.
FAN = 128
#: Sources of which the table may be broadcast; more are joined by a shuffle.
FEW_SOURCES = 10_000

ITEM = "struct<id:{id},size:bigint,p:double,u:double>"
#: Folds one more row into (r: the row still fractional, out: the rounded ones).  up and down are the
#: words that can move from x to r and from r to x; the direction is drawn so that neither row's
#: expected copies change, and then one of them is rounded and the other takes r's place.
FOLD = """
case when acc.r is null then named_struct('r', x, 'out', acc.out)
when x.u * (least((1 - acc.r.p) * acc.r.size, x.p * x.size) + least(acc.r.p * acc.r.size, (1 - x.p) * x.size))
     < least(acc.r.p * acc.r.size, (1 - x.p) * x.size)
then case when (1 - acc.r.p) * acc.r.size <= x.p * x.size
  then named_struct('r', named_struct('id', x.id, 'size', x.size, 'p', x.p - (1 - acc.r.p) * acc.r.size / x.size, 'u', x.u),
    'out', array_append(acc.out, named_struct('id', acc.r.id, 'size', acc.r.size, 'up', 1)))
  else named_struct('r', named_struct('id', acc.r.id, 'size', acc.r.size, 'p', acc.r.p + x.p * x.size / acc.r.size, 'u', acc.r.u),
    'out', array_append(acc.out, named_struct('id', x.id, 'size', x.size, 'up', 0))) end
else case when acc.r.p * acc.r.size <= (1 - x.p) * x.size
  then named_struct('r', named_struct('id', x.id, 'size', x.size, 'p', x.p + acc.r.p * acc.r.size / x.size, 'u', x.u),
    'out', array_append(acc.out, named_struct('id', acc.r.id, 'size', acc.r.size, 'up', 0)))
  else named_struct('r', named_struct('id', acc.r.id, 'size', acc.r.size, 'p', acc.r.p - (1 - x.p) * x.size / acc.r.size, 'u', acc.r.u),
    'out', array_append(acc.out, named_struct('id', x.id, 'size', x.size, 'up', 1))) end end
"""
#: The last row of a source is rounded to the nearer side; then the one row of the last group whose
#: turn makes up for it best is turned, if that helps.
LAST = """
named_struct('over', (if(r.p >= 0.5, 1, 0) - r.p) * r.size,
  'out', array_append(out, named_struct('id', r.id, 'size', r.size, 'up', if(r.p >= 0.5, 1, 0))))
"""
TURN = "array_min(transform(out, (x, i) -> named_struct('miss', abs(over + if(x.up = 1, -x.size, x.size)), 'at', i)))"
TURNED = "if(turn.miss < abs(over), transform(out, (x, i) -> if(i = turn.at, named_struct('id', x.id, 'size', x.size, 'up', 1 - x.up), x)), out)"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """One row per source: rank (by code point, null last), n, source_size, target.

    Sources weigh ``weights``, repeating, and share the sum of all sizes; no target is above
    ``most_copies`` times its source's size, and the excess goes to the others by weight.  With the
    sources in order of cap per weight, the level at which the shares use up the sum is the largest of
    (sum - caps so far) / (weights after).  One row per source meets in one task, no more.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_copies)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    after = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = F.max("share").over(every)
    return (
        capped.withColumn("share", left / after)
        .withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))
        .select("source", "rank", "n", "source_size", "target")
    )


def random_share(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3, seed: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (words), source_size, target, copies, taken.

    Each row of a source wants the same copies, target / source_size: the whole part is given, and
    the fractions are rounded by the pivotal method.  Rows are paired, words move from one to the
    other, in a direction drawn so that no expectation changes, until one fraction is 0 or 1; the
    other row goes on.  Groups of about 128 rows of a source do this by themselves and pass one
    fractional row up a tree, whose last group rounds the source's last row.  So a source takes its
    target but for a part of one row, at any size, and its groups share no task.

    Null texts have size 0; rows of size 0 get the whole part of the copies, and take 0.  A null
    source is a source of its own.  Draws depend on ids, sizes and the seed alone, so reruns agree.
    Rows of a source that repeat id and size are rounded as one: together they want a number of copies, of which the
    whole part is given to the first of them, so that any number of them is one row of the tree.  An empty table
    gives an empty result.  Only the named columns are read, and texts, however long, row by row.
    """
    size = F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")
    sizes = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size.alias("size"))
    sources = checkpointed(source_targets(sizes, weights, most_copies))
    few = F.broadcast if sources.count() <= FEW_SOURCES else lambda df: df
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = sources.withColumn("whole", F.floor(wanted + 1e-12)).withColumn("part", F.greatest(F.lit(0.0), wanted - F.col("whole")))
    rates = rates.withColumn("groups", F.ceil(F.col("n") / FAN))
    placed = sizes.join(few(rates.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    fractional = (F.col("part") > 1e-12) & (F.col("size") > 0)
    id_type = f"struct<doc_id:{dict(sizes.dtypes)['doc_id']},times:bigint,sure:bigint>"
    item = ITEM.format(id=id_type)

    # Equal rows as one, with the copies that they are sure to get together beside the fraction.
    alike = placed.filter(fractional).groupBy("rank", "groups", "part", "doc_id", "size").agg(F.count(F.lit(1)).alias("times"))
    alike = alike.withColumn("sure", F.floor(F.col("times") * F.col("part") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("times") * F.col("part") - F.col("sure")))
    rows = alike.select(
        "rank", "groups", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("groups")).alias("group"),
        F.struct(F.struct("doc_id", "times", "sure").alias("id"), "size", "p", random_share(F.col("doc_id"), F.col("size"), F.lit(seed), F.lit(0)).alias("u")).alias("x"),
    )
    done, level = [], 0
    most = sources.agg(F.max(F.ceil(F.col("n") / FAN))).first()[0] or 0
    while level == 0 or most > 1:
        most = -(-most // FAN) if level else most
        folded = rows.groupBy("rank", "groups", "group").agg(
            F.sort_array(F.collect_list(F.struct(F.col("x.size").alias("s"), F.col("x.u").alias("u"), "x")), asc=False).alias("xs")
        )
        start = f"named_struct('r', cast(null as {item}), 'out', cast(array() as array<struct<id:{id_type},size:bigint,up:int>>))"
        folded = folded.select("rank", "groups", "group", F.expr(f"aggregate(transform(xs, e -> e.x), {start}, (acc, x) -> {FOLD})").alias("f"))
        folded = folded.select("rank", "groups", "group", "f.r", "f.out").withColumn("last", F.expr(f"if(groups = 1, {LAST}, null)"))
        folded = folded.select("rank", "groups", "group", F.when(F.col("groups") > 1, F.col("r")).alias("r"), F.coalesce("last.out", "out").alias("out"), F.col("last.over").alias("over"))
        folded = folded.withColumn("turn", F.expr(f"if(groups = 1, {TURN}, null)")).withColumn("out", F.expr(f"if(groups = 1, {TURNED}, out)"))
        folded = checkpointed(folded.select("rank", "groups", "group", "r", "out"))
        done.append(folded.select("rank", F.explode("out").alias("o")).select("rank", "o.id", "o.size", "o.up"))
        level += 1
        draw = random_share(F.col("r.id.doc_id"), F.col("r.size"), F.lit(seed), F.lit(level))
        rows = folded.filter("r is not null").select(
            "rank", F.ceil(F.col("groups") / FAN).alias("groups"), F.floor(F.col("group") / FAN).alias("group"),
            F.struct("r.id", "r.size", "r.p", draw.alias("u")).alias("x"),
        )
    each = reduce(DataFrame.unionByName, done).select("rank", "size", "id.*", F.col("up").alias("last")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    turned = each.select("rank", F.col("doc_id").alias("id"), "size", (F.col("k") <= F.col("sure") + F.col("last")).cast("int").alias("up"))
    rounded = turned.unionByName(placed.filter(~fractional).select("rank", F.col("doc_id").alias("id"), "size", F.lit(0).alias("up")))
    per_source = rates.select("rank", "source_size", "target", "whole")
    return rounded.join(few(per_source), "rank").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("whole") + F.col("up")).cast("long").alias("copies"), (F.col("size") * (F.col("whole") + F.col("up"))).cast("long").alias("taken"),
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
