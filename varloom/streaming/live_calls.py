"""Calls, and counts of calls by time, over a stream of pileup rows.

Calling, bias labels and the error label's projection need no state, so the operators of the batch
library take streams as they are; labels that look around a call are for batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.scalars import mutation_type
from varloom.operators.calling import call_variants


def live_type_counts(pileup: DataFrame, time: str = "seen_at", window: str = "10 minutes", late: str = "30 minutes", **limits: float) -> DataFrame:
    """Calls of each type in windows of event time; rows later than ``late`` are left out by the watermark."""
    stamped = pileup.withWatermark(time, late)
    calls = call_variants(stamped.withColumn("tissue", F.struct("tissue", F.col(time).alias("at"))), **limits)
    return calls.groupBy(F.window("tissue.at", window).alias("w"), F.col("tissue.tissue").alias("tissue"), mutation_type().alias("mut_type")).agg(F.count(F.lit(1)).alias("n"))
