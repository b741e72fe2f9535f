"""Incremental allele counts over a stream of genotype calls.

Counts add up over variants and calls, so a stream of new panels can keep them current; frequencies, F_ST and f2 are then
computed from the running table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_counts(calls: DataFrame, *, late: str | None = None, time: str = "ts") -> DataFrame:
    """snp_idx, pop, n, ac, het of a streaming (or batch) table of calls; with `late`, calls of one variant and sample count once within that watermark."""
    own = calls.filter("dosage IS NOT NULL")
    if late:
        own = own.withWatermark(time, late).dropDuplicatesWithinWatermark(["snp_idx", "sample_idx"])
    return own.groupBy("snp_idx", "pop").agg(F.count("*").alias("n"), F.sum("dosage").cast("long").alias("ac"), F.sum((F.col("dosage") == 1).cast("long")).alias("het"))
