"""Bringing two site tables into step: reference sites, marker sets, sites that all samples have, frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ["chrom", "pos_bp"]


def polarised(targets: DataFrame, panel: DataFrame) -> DataFrame:
    """chrom, pos_bp, target_idx, panel_idx, flip: sites of `targets` in `panel` (snp_idx, chrom, pos_bp, ref, alt) by place.

    Alleles must be the same two, in either order (flip says which) and on either strand; a palindromic pair is taken as
    written.  Places that occur twice in a table, and sites of other alleles, are left out.
    """

    def once(t: DataFrame, name: str) -> DataFrame:
        a, b = F.upper("ref"), F.upper("alt")
        single = t.groupBy(*PLACE).agg(F.count("*").alias("n"), F.first("snp_idx").alias(f"{name}_idx"), F.first(a).alias(f"{name}_ref"), F.first(b).alias(f"{name}_alt"))
        return single.filter("n = 1").drop("n")

    both = once(targets, "target").join(once(panel, "panel"), PLACE)
    other = lambda c: F.translate(F.col(c), "ACGT", "TGCA")
    r, a = F.col("panel_ref"), F.col("panel_alt")
    same = (F.col("target_ref") == r) & (F.col("target_alt") == a)
    swapped = (F.col("target_ref") == a) & (F.col("target_alt") == r)
    same_other, swapped_other = (other("target_ref") == r) & (other("target_alt") == a), (other("target_ref") == a) & (other("target_alt") == r)
    flip = F.when(same, False).when(swapped, True).when(same_other, False).when(swapped_other, True)
    return both.withColumn("flip", flip).filter("flip IS NOT NULL").select(*PLACE, "target_idx", "panel_idx", "flip")


def flipped(geno: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls of the targets at the shared sites, as copies of the panel's counted allele: snp_idx (the panel's), sample_idx, dosage."""
    met = geno.join(sites.select(F.col("target_idx").alias("snp_idx"), "panel_idx", "flip"), "snp_idx")
    return met.select(F.col("panel_idx").alias("snp_idx"), "sample_idx", F.when(F.col("flip"), 2 - F.col("dosage")).otherwise(F.col("dosage")).alias("dosage"))


def same_markers(recipients: DataFrame, donors: DataFrame) -> None:
    """ValueError unless both marker tables (chrom, pos_bp, ref, alt) hold exactly the same markers."""
    key = [*PLACE, "ref", "alt"]
    a, b = recipients.select(*key), donors.select(*key)
    only = a.exceptAll(b).select(F.lit("recipients").alias("side"), *key).unionByName(b.exceptAll(a).select(F.lit("donors").alias("side"), *key)).limit(5).collect()
    if only:
        raise ValueError("markers differ: " + "; ".join(f"{r.side} {r.chrom}:{r.pos_bp}" for r in only))


def complete_sites(geno: DataFrame, samples: DataFrame) -> DataFrame:
    """snp_idx of the variants that every one of `samples` has a call at."""
    n = samples.select("sample_idx").distinct().count()
    called = geno.filter("dosage IS NOT NULL").join(samples.select("sample_idx").distinct(), "sample_idx", "left_semi").select("snp_idx", "sample_idx").distinct()
    return called.groupBy("snp_idx").agg(F.count("*").alias("n")).filter(F.col("n") == n).select("snp_idx")


def matched_frequencies(freq: DataFrame, snps: DataFrame) -> DataFrame:
    """`freq` (snp_id and frequencies) joined to `snps`; ValueError unless both hold the same ids, each once."""
    f = freq.withColumn("_in_freq", F.lit(True)).join(snps.select("snp_id", "snp_idx").withColumn("_in_snps", F.lit(True)), "snp_id", "full")
    s = f.agg(F.count("*").alias("n"), F.count_distinct("snp_id").alias("ids"), F.count("_in_freq").alias("f"), F.count("_in_snps").alias("s")).first()
    if not s["n"] == s["ids"] == s["f"] == s["s"]:
        raise ValueError(f"{s['n'] - s['f']} variants without frequencies, {s['n'] - s['s']} frequencies without a variant, {s['n'] - s['ids']} repeated ids")
    return f.drop("_in_freq", "_in_snps")
