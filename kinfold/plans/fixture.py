"""Genotype tables derived from the driver's star schema with integer arithmetic, alike in Spark and DuckDB.

Variants are `part` rows, samples are `supplier` rows (population: region; ancestry subgroup: nation), and a genotype is
called where `lineitem` pairs the two; every row of those tables is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, sample_id, nation, pop, rk."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(F.col("s_suppkey").alias("sample_idx"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("sample_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("pop"), F.col("r_regionkey").cast("long").alias("rk"))


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_idx, snp_id, chrom, pos_bp, genpos_m, ref, alt; 22 chromosomes, variants 22,000 bp apart on each."""
    p = F.col("p_partkey") + 1
    base = lambda k: F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "part").select(
        p.alias("snp_idx"), F.concat(F.lit("rs"), p).alias("snp_id"), (1 + p % 22).cast("int").alias("chrom"), (p * 1000).alias("pos_bp"), (p * 1000 / 1e8).alias("genpos_m"),
        base(p).alias("ref"), base(p + 1 + p % 3 + F.when(p % 29 == 0, 3 - p % 3).otherwise(0)).alias("alt"),
    )


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_idx, chrom, pos_bp, sample_idx, pop, dosage (0, 1, 2 copies of the counted allele), hap (0 or 1); absent rows are missing calls."""
    # dealt by variant, so that all of a variant's aggregates take no shuffle of their own
    calls = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1).alias("p"), F.col("l_suppkey").alias("c")).repartition("p").distinct()
    who = F.broadcast(samples(spark, sf_dir).select(F.col("sample_idx").alias("c"), "pop", "rk"))  # a row for each sample
    p, c, rk = F.col("p"), F.col("c"), F.col("rk")
    h1 = (p * 7919 + c * 104729 + (p % 101) * (c % 103) * 31) % 100
    h2 = (p * 6271 + c * 15485863 + (p % 89) * (c % 97) * 17) % 100
    t = 5 + (p * 37 + rk * 13 * (1 + p % 3)) % 90
    one = lambda h: F.when(h < t, 1).otherwise(0)
    return calls.join(who, "c").select(p.alias("snp_idx"), (1 + p % 22).cast("int").alias("chrom"), (p * 1000).alias("pos_bp"), c.alias("sample_idx"), "pop", (one(h1) + one(h2)).cast("int").alias("dosage"), one(h1).cast("int").alias("hap"))


#: The same as common table expressions for DuckDB: smp, snps, geno.
GENO_SQL = """
smp AS (SELECT s_suppkey AS c, n_name AS nation, r_name AS pop, CAST(r_regionkey AS BIGINT) AS rk FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
snps AS (SELECT p AS snp_idx, 'rs' || p AS snp_id, CAST(1 + p % 22 AS INTEGER) AS chrom, p * 1000 AS pos_bp, substr('ACGT', CAST(p % 4 + 1 AS INTEGER), 1) AS ref,
  substr('ACGT', CAST((p + 1 + p % 3 + CASE WHEN p % 29 = 0 THEN 3 - p % 3 ELSE 0 END) % 4 + 1 AS INTEGER), 1) AS alt FROM (SELECT p_partkey + 1 AS p FROM part)),
calls AS (SELECT DISTINCT l_partkey + 1 AS p, l_suppkey AS c FROM lineitem),
hashed AS (SELECT p, c, pop, (p * 7919 + c * 104729 + (p % 101) * (c % 103) * 31) % 100 AS h1, (p * 6271 + c * 15485863 + (p % 89) * (c % 97) * 17) % 100 AS h2, 5 + (p * 37 + rk * 13 * (1 + p % 3)) % 90 AS t FROM calls JOIN smp USING (c)),
geno AS (SELECT p AS snp_idx, CAST(1 + p % 22 AS INTEGER) AS chrom, p * 1000 AS pos_bp, c AS sample_idx, pop, CAST((CASE WHEN h1 < t THEN 1 ELSE 0 END) + (CASE WHEN h2 < t THEN 1 ELSE 0 END) AS INTEGER) AS dosage,
  CASE WHEN h1 < t THEN 1 ELSE 0 END AS hap FROM hashed)
"""
