"""Jackknife blocks along the genome."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_blocks(snps: DataFrame, size: float, position: str = "genpos_m") -> DataFrame:
    """snp_idx, block_id (int, from 0 in genome order).

    A new block starts where the chromosome changes or a variant lies `size` or more beyond the block's first variant.
    The walk is sequential along a chromosome, and chromosomes run side by side; it carries positions only.
    """

    def walk(pdf):
        pdf = pdf.sort_values(["x", "snp_idx"], ignore_index=True)
        x = pdf["x"].to_numpy()
        own = np.zeros(len(x), np.int64)
        at, k = 0, 0
        while at < len(x):
            to = max(int(np.searchsorted(x, x[at] + size, "left")), at + 1)
            while to < len(x) and x[to] - x[at] < size:  # rounding of the sum
                to += 1
            own[at:to] = k
            at, k = to, k + 1
        return pdf.assign(own=own)[["snp_idx", "chrom", "own"]]

    own = snps.select("snp_idx", "chrom", F.col(position).cast("double").alias("x")).groupBy("chrom").applyInPandas(walk, "snp_idx long, chrom int, own long")
    counts = own.groupBy("chrom").agg((F.max("own") + 1).alias("n"))
    # a row for each chromosome
    before = counts.select("chrom", (F.sum("n").over(Window.orderBy("chrom")) - F.col("n")).alias("before"))
    return own.join(F.broadcast(before), "chrom").select("snp_idx", (F.col("own") + F.col("before")).cast("int").alias("block_id"))


def block_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_id").agg(F.count("*").alias("block_size"))
