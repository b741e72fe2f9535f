"""F_ST after Weir and Cockerham, its windows and branch statistics, and joint site-frequency spectra."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def pairs_within_snp(counts: DataFrame) -> DataFrame:
    """snp_idx, p1 < p2 and both sides' n, ac, het: pairs of a variant's populations, without a self-join."""
    one = counts.groupBy("snp_idx").agg(F.collect_list(F.struct("pop", "n", "ac", "het")).alias("pops"))
    a = one.select("snp_idx", "pops", F.explode("pops").alias("a"))
    b = a.select("snp_idx", "a", F.explode(F.filter("pops", lambda x: x["pop"] > F.col("a.pop"))).alias("b"))
    return b.select("snp_idx", F.col("a.pop").alias("p1"), F.col("b.pop").alias("p2"), *(F.col(f"{s}.{c}").alias(f"{c}{k}") for k, s in ((1, "a"), (2, "b")) for c in ("n", "ac", "het")))


def wc_components(pairs: DataFrame) -> DataFrame:
    """Adds num and den of the two-population estimator (a, and a + b + c), null where it is undefined.

    Steps use each other's results several times; as SQL expressions they would be written out, and computed, at each use.
    """

    def run(batches):
        for t in batches:
            n1, n2, ac1, ac2, het1, het2 = (t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n1", "n2", "ac1", "ac2", "het1", "het2"))
            with np.errstate(all="ignore"):
                total = n1 + n2
                mean = total / 2
                nc = total - (n1 * n1 + n2 * n2) / total
                q1, q2 = ac1 / (2 * n1), ac2 / (2 * n2)
                q = (ac1 + ac2) / (2 * total)
                s2 = (n1 * (q1 - q) * (q1 - q) + n2 * (q2 - q) * (q2 - q)) / mean
                h = (het1 + het2) / total
                inner = q * (1 - q) - s2 / 2
                a = mean / nc * (s2 - (inner - h / 4) / (mean - 1))
                b = mean / (mean - 1) * (inner - (2 * mean - 1) / (4 * mean) * h)
                den = a + b + h / 2
                none = ~((n1 > 0) & (n2 > 0) & (mean > 1) & (np.abs(den) > 1e-14))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(a, mask=none), pa.array(den, mask=none)], names=[*t.schema.names, "num", "den"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("num", DoubleType()), StructField("den", DoubleType())]))


def fst_sites(counts: DataFrame) -> DataFrame:
    """snp_idx, p1, p2, num, den, fst: each pair at each variant where both are seen."""
    return wc_components(pairs_within_snp(counts)).select("snp_idx", "p1", "p2", "num", "den", (F.col("num") / F.col("den")).alias("fst"))


def fst_pairs(sites: DataFrame) -> DataFrame:
    """p1, p2, fst (ratio of sums), mean_fst, n_snp over defined sites."""
    s = sites.filter("den IS NOT NULL").groupBy("p1", "p2").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.avg("fst").alias("mean_fst"), F.count("*").alias("n_snp"))
    return s.select("p1", "p2", F.expr("CASE WHEN den <> 0 THEN num / den END").alias("fst"), "mean_fst", "n_snp")


def fst_matrix(pairs: DataFrame) -> DataFrame:
    """p1, p2, fst for both orders, 0 on the diagonal."""
    labels = pairs.select(F.explode(F.array("p1", "p2")).alias("p1")).distinct()
    return pairs.select("p1", "p2", "fst").unionByName(pairs.select(F.col("p2").alias("p1"), F.col("p1").alias("p2"), "fst")).unionByName(labels.select("p1", F.col("p1").alias("p2"), F.lit(0.0).alias("fst")))


def windows(snps: DataFrame, size: int, step: int) -> DataFrame:
    """chrom, start, end (inclusive): from a chromosome's first variant on, the first window to reach the last variant is clipped there and is the last; chromosomes of one variant have none."""
    ends = snps.groupBy("chrom").agg(F.min("pos_bp").alias("a"), F.max("pos_bp").alias("z")).filter("z > a")
    last = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("z") - F.col("a") + 1 - size) / F.lit(step)))
    starts = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return starts.select("chrom", (F.col("a") + F.col("k") * step).alias("start"), F.least(F.col("a") + F.col("k") * step + size - 1, F.col("z")).alias("end")).filter("start <= end")


def in_windows(rows: DataFrame, wins: DataFrame, size: int) -> DataFrame:
    """Rows (chrom, pos_bp, ...) with each window that holds them: an equi-join on bins of `size` base pairs, two for each window."""
    b = wins.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))))
    return rows.withColumn("bin", F.floor(F.col("pos_bp") / size)).join(b, ["chrom", "bin"]).filter("pos_bp BETWEEN start AND end").drop("bin")


def fst_windows(sites: DataFrame, snps: DataFrame, size: int, step: int) -> DataFrame:
    """chrom, start, end, p1, p2, n_snp (all variants in the window), fst (null where nothing is defined)."""
    wins = windows(snps, size, step)
    counts = in_windows(snps.select("chrom", "pos_bp"), wins, size).groupBy("chrom", "start", "end").agg(F.count("*").alias("n_snp"))
    labels = sites.select("p1", "p2").distinct()
    placed = in_windows(sites.join(snps.select("snp_idx", "chrom", "pos_bp"), "snp_idx"), wins, size)
    sums = placed.groupBy("chrom", "start", "end", "p1", "p2").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    grid = counts.join(F.broadcast(labels), F.lit(True))  # pairs of populations, a small table
    return grid.join(sums, ["chrom", "start", "end", "p1", "p2"], "left").select("chrom", "start", "end", "p1", "p2", "n_snp", F.expr("CASE WHEN den <> 0 THEN num / den END").alias("fst"))


def branch_length(fst: str, eps: float = 1e-9):
    return -F.log(1 - F.least(F.greatest(F.col(fst), F.lit(0.0)), F.lit(1 - eps)))


def pbs(windowed: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """chrom, start, end, n_snp, fst_ab, fst_ac, fst_bc, pbs: the branch statistic of population `a`."""
    name = F.concat_ws("|", "p1", "p2")
    of = lambda x, y: F.max(F.when(name == "|".join(sorted((x, y))), F.col("fst")))
    t = windowed.groupBy("chrom", "start", "end").agg(F.first("n_snp").alias("n_snp"), of(a, b).alias("fst_ab"), of(a, c).alias("fst_ac"), of(b, c).alias("fst_bc"))
    return t.withColumn("pbs", (branch_length("fst_ab") + branch_length("fst_ac") - branch_length("fst_bc")) / 2)


def joint_sfs(counts: DataFrame, p1: str, p2: str, n1: int, n2: int, fold: bool = False) -> DataFrame:
    """i, j, sites over the whole grid: variants by allele copies in two populations of n1 and n2 samples, where none misses a call.

    Unfolded: copies of the counted allele, (2 n1 + 1) x (2 n2 + 1).  Folded: each population's own rarer allele.
    """
    own = lambda p, n, k: counts.filter((F.col("pop") == p) & (F.col("n") == n)).select("snp_idx", (F.least("ac", 2 * n - F.col("ac")) if fold else F.col("ac")).alias(k))
    cells = own(p1, n1, "i").join(own(p2, n2, "j"), "snp_idx").groupBy("i", "j").agg(F.count("*").alias("sites"))
    top = (n1, n2) if fold else (2 * n1, 2 * n2)
    spark = counts.sparkSession
    grid = spark.range(top[0] + 1).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top[1]).cast("long"))))
    return grid.join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("sites", F.lit(0).cast("long")).alias("sites"))


def pop_sfs(counts: DataFrame) -> DataFrame:
    """pop, n, ac, sites: variants by called samples and allele copies in each population."""
    return counts.groupBy("pop", "n", "ac").agg(F.count("*").alias("sites"))
