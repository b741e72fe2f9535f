"""Allele counts and frequencies, ploidy, and quality filters over long genotype tables.

A genotype table has a row for each called genotype: snp_idx, sample_idx, pop, dosage (0, 1, 2).  Missing calls are
absent or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pop_counts(geno: DataFrame, by: str = "pop") -> DataFrame:
    """snp_idx, pop, n (called samples), ac (copies of the counted allele), het: exact integers, combined map-side."""
    called = geno.filter("dosage IS NOT NULL")
    return called.groupBy("snp_idx", F.col(by).alias("pop")).agg(F.count("*").alias("n"), F.sum("dosage").cast("long").alias("ac"), F.sum((F.col("dosage") == 1).cast("long")).alias("het"))


def detect_ploidy(geno: DataFrame, first_snps: int = 1000) -> DataFrame:
    """sample_idx, ploidy: 2 if a heterozygous call occurs among the first variants, else 1 (pseudo-haploid)."""
    probe = F.max(F.when((F.col("dosage") == 1) & (F.col("snp_idx") <= first_snps), 1).otherwise(0))
    return geno.groupBy("sample_idx").agg((1 + probe).cast("int").alias("ploidy"))


def allele_frequency(geno: DataFrame, ploidy: DataFrame | None = None) -> DataFrame:
    """snp_idx, pop, q, n (alleles seen).  Without `ploidy` every sample is diploid; a pseudo-haploid counts one allele for two copies."""
    called = geno.filter("dosage IS NOT NULL")
    if ploidy is None:
        called = called.withColumn("ploidy", F.lit(2))
    else:
        called = called.join(F.broadcast(ploidy), "sample_idx")  # a row for each sample
    sums = called.groupBy("snp_idx", "pop").agg(F.sum(F.col("dosage") / (3 - F.col("ploidy"))).alias("ac"), F.sum("ploidy").cast("long").alias("n"))
    return sums.select("snp_idx", "pop", (F.col("ac") / F.col("n")).alias("q"), "n")


# ---- variant filters; boundaries are inclusive, applied in the order in which they stand here ----------------------------
def valid_alleles(ref: str = "ref", alt: str = "alt") -> Column:
    a, b = F.upper(F.col(ref)), F.upper(F.col(alt))
    return a.isin("A", "C", "G", "T") & b.isin("A", "C", "G", "T") & (a != b)


def strand_ambiguous(ref: str = "ref", alt: str = "alt") -> Column:
    """A/T and C/G."""
    return F.translate(F.upper(F.col(ref)), "ACGT", "TGCA") == F.upper(F.col(alt))


def transversion(ref: str = "ref", alt: str = "alt") -> Column:
    purine = lambda c: F.upper(F.col(c)).isin("A", "G")
    return purine(ref) != purine(alt)


def autosomal(chrom: str = "chrom") -> Column:
    return F.col(chrom).between(1, 22)


def pooled_summary(geno: DataFrame, samples: int) -> DataFrame:
    """snp_idx, maf (folded, over all samples), missing (share of `samples` without a call)."""
    s = geno.filter("dosage IS NOT NULL").groupBy("snp_idx").agg(F.count("*").alias("n"), F.sum("dosage").cast("long").alias("ac"))
    q = F.col("ac") / (2 * F.col("n"))
    return s.select("snp_idx", F.least(q, 1 - q).alias("maf"), (1 - F.col("n") / F.lit(samples)).alias("missing"))


def filter_snps(snps: DataFrame, geno: DataFrame | None = None, samples: int = 0, *, drop_ambiguous: bool = False, maf: float = 0.0, max_missing: float = 1.0, drop_monomorphic: bool = False, transversions_only: bool = False, autosomes_only: bool = False, include: DataFrame | None = None, exclude: DataFrame | None = None, max_missing_pops: float | None = None, pops: int = 0) -> DataFrame:
    """Variants that pass.  With nothing asked for, `snps` unchanged; else invalid alleles always go.

    geno and samples are needed for maf, max_missing, drop_monomorphic and max_missing_pops; include and exclude are
    tables of snp_id (exclude wins).  max_missing_pops: the greatest share of the `pops` populations without any call.
    """
    counted = maf > 0 or max_missing < 1 or drop_monomorphic
    if not (counted or drop_ambiguous or transversions_only or autosomes_only or include is not None or exclude is not None or max_missing_pops is not None):
        return snps
    out = snps.filter(valid_alleles())
    if drop_ambiguous:
        out = out.filter(~strand_ambiguous())
    if transversions_only:
        out = out.filter(transversion())
    if autosomes_only:
        out = out.filter(autosomal())
    if counted:
        s = pooled_summary(geno, samples).filter((F.col("maf") >= maf) & (F.col("missing") <= max_missing))
        out = out.join(s.filter("maf > 0") if drop_monomorphic else s, "snp_id" if "snp_id" in s.columns else "snp_idx", "left_semi")
    if max_missing_pops is not None:
        seen = geno.filter("dosage IS NOT NULL").groupBy("snp_idx").agg(F.count_distinct("pop").alias("seen")).filter(1 - F.col("seen") / F.lit(pops) <= max_missing_pops)
        out = out.join(seen, "snp_idx", "left_semi")
    if include is not None:
        out = out.join(include, "snp_id", "left_semi")
    if exclude is not None:
        out = out.join(exclude, "snp_id", "left_anti")
    return out


def keep_samples(geno: DataFrame, snps: int, max_missing: float) -> DataFrame:
    """sample_idx of samples with at most this share of missing calls; inactive at 1 or more."""
    s = geno.filter("dosage IS NOT NULL").groupBy("sample_idx").agg(F.count("*").alias("n"))
    return s.filter(1 - F.col("n") / F.lit(snps) <= max_missing).select("sample_idx") if max_missing < 1 else s.select("sample_idx")


def id_namespace(snp_id: str = "snp_id") -> Column:
    c = F.col(snp_id)
    return F.when(c.rlike("^rs[0-9]+$"), "rs").when(c.rlike("^(chr)?[0-9XYM]+[:_][0-9]+"), "chrpos").when(c.rlike("^(AFFX|Affx|AX)-"), "probe").otherwise("other")


def ascertainment_overlap(own: DataFrame, other: DataFrame) -> DataFrame:
    """One row: ids of `other`, how many exist in `own`, their share, whether the same ascertainment is plausible (half or more)."""
    ids = other.select("snp_id").distinct()
    hit = ids.join(own.select("snp_id").distinct(), "snp_id", "left_semi").agg(F.count("*").alias("shared"))
    return ids.agg(F.count("*").alias("ids")).join(hit, F.lit(True)).select("ids", "shared", (F.col("shared") / F.col("ids")).alias("share"), (F.col("shared") * 2 >= F.col("ids")).alias("same_ascertainment"))


def select_pops(samples: DataFrame, *, explicit: list[str] | None = None, top: int | None = None, least: int | None = None) -> DataFrame:
    """pop, n: named populations, the `top` largest (ties: first seen), or those with `least` samples; sorted by label."""
    s = samples.groupBy("pop").agg(F.count("*").alias("n"), F.min("sample_idx").alias("seen"))
    if explicit is not None:
        s = s.filter(F.col("pop").isin(explicit))
    if least is not None:
        s = s.filter(F.col("n") >= least)
    if top is not None:
        s = s.orderBy(F.desc("n"), "seen").limit(top)
    return s.select("pop", "n").orderBy("pop")


# ---- pruning by linkage -------------------------------------------------------------------------------------------------
def ld_pairs(geno: DataFrame, order: DataFrame, window: int, r2: float) -> DataFrame:
    """chrom, a, b (ordinals on the chromosome, a < b < a + window): pairs whose squared correlation exceeds r2 over samples called in both.

    order: snp_idx, chrom, ord.  The window join is an equi-join on sample and on bins of `window` ordinals, so that a
    variant meets two bins only.
    """
    g = geno.filter("dosage IS NOT NULL").select("snp_idx", "sample_idx", F.col("dosage").cast("long").alias("d")).join(order.select("snp_idx", "chrom", "ord"), "snp_idx")
    left = g.select("sample_idx", "chrom", F.col("ord").alias("a"), F.col("d").alias("x"), F.explode(F.array(F.floor(F.col("ord") / window), F.floor(F.col("ord") / window) + 1)).alias("bin"))
    right = g.select("sample_idx", "chrom", F.col("ord").alias("b"), F.col("d").alias("y"), F.floor(F.col("ord") / window).alias("bin"))
    pairs = left.join(right, ["sample_idx", "chrom", "bin"]).filter("a < b AND b - a < " + str(window))
    s = pairs.groupBy("chrom", "a", "b").agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for k, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.expr("x * x")), ("syy", F.expr("y * y")), ("sxy", F.expr("x * y")))))
    cov, vx, vy = F.expr("n * sxy - sx * sy"), F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    return s.filter(cov.cast("double") * cov > r2 * (1 + 2.0**-44) * vx.cast("double") * vy).select("chrom", "a", "b")


def ld_prune(geno: DataFrame, snps: DataFrame, window: int, step: int, r2: float) -> DataFrame:
    """snp_idx kept by windowed pairwise pruning: within each window, from the last pair back, the variant with the commoner major allele goes (ties: the later).

    Correlated pairs come from a relational join; the greedy pass is sequential along a chromosome and runs on one task
    for each, over ordinals and pairs only.
    """
    from pyspark.sql import Window

    freq = geno.filter("dosage IS NOT NULL").groupBy("snp_idx").agg((F.sum("dosage") / (2 * F.count("*"))).alias("q"))
    poly = snps.join(freq, "snp_idx").filter("q > 0 AND q < 1").withColumn("major", F.greatest("q", 1 - F.col("q")))
    order = poly.withColumn("ord", F.row_number().over(Window.partitionBy("chrom").orderBy("pos_bp", "snp_idx")) - 1)
    pairs = ld_pairs(geno, order, window, r2).groupBy("chrom", "a").agg(F.collect_list("b").alias("bs"))  # fewer than `window` each
    rows = order.select("chrom", "ord", "snp_idx", "major").join(pairs.withColumnRenamed("a", "ord"), ["chrom", "ord"], "left")

    def greedy(pdf):
        pdf = pdf.sort_values("ord", ignore_index=True)
        n, major = len(pdf), pdf["major"].to_numpy()
        after = [set(x) if x is not None else () for x in pdf["bs"]]
        gone, start = [False] * n, 0
        while start < n:
            end = min(start + window, n)
            again = True
            while again:
                again = False
                for a in range(end - 2, start - 1, -1):
                    if gone[a]:
                        continue
                    for b in sorted(after[a]):
                        if b >= end or gone[b]:
                            continue
                        if major[a] > major[b]:
                            gone[a] = again = True
                            break
                        gone[b] = again = True
            start += step
        return pdf.loc[[not x for x in gone], ["snp_idx"]]

    return rows.groupBy("chrom").applyInPandas(greedy, "snp_idx long")
