"""Calls from VCF, gVCF and consumer exports at target sites, genetic maps, and agreement between result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base pairs of a bin in interval joins.
BIN = 10_000


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alts (array), passed, end, min_dp, sample_no, gt, dp, gq, pl: a row for each record and sample."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    c = F.split("value", "\t")
    info = lambda k: F.regexp_extract(c[7], rf"(?:^|;){k}=([^;]*)", 1)
    rows = lines.select(
        F.regexp_replace(c[0], "^chr", "").alias("chrom"), c[1].cast("long").alias("pos"), c[2].alias("id"), F.upper(c[3]).alias("ref"), F.split(F.upper(c[4]), ",").alias("alts"), c[6].isin("PASS", ".").alias("passed"),
        F.coalesce(info("END").try_cast("long"), c[1].cast("long")).alias("end"), info("MinDP").try_cast("int").alias("min_dp"), F.split(c[8], ":").alias("keys"), F.posexplode(F.slice(c, 10, F.size(c))).alias("sample_no", "s"),
    )
    v = F.split("s", ":")
    of = lambda k: F.get(v, (F.array_position("keys", k) - 1).cast("int"))
    have = lambda k: F.when(F.array_contains("keys", k), of(k))
    return rows.select("chrom", "pos", "id", "ref", "alts", "passed", "end", "min_dp", "sample_no", have("GT").alias("gt"), have("DP").try_cast("int").alias("dp"), have("GQ").try_cast("int").alias("gq"), F.coalesce(have("PL"), have("GL"), have("GP")).alias("pl"))


def detect_build(spark: SparkSession, path: str) -> str | None:
    """GRCh37 or GRCh38 by the length of chromosome 1 in the header, else by the reference line."""
    head = spark.read.text(path).filter(F.col("value").startswith("##"))
    r = head.select(F.max(F.regexp_extract("value", r"##contig=<ID=(?:chr)?1,length=(\d+)", 1)).alias("n"), F.max(F.lower(F.when(F.col("value").startswith("##reference"), F.col("value")))).alias("ref")).first()
    by_length = {"249250621": "GRCh37", "248956422": "GRCh38"}.get(r["n"])
    if by_length or not r["ref"]:
        return by_length
    return "GRCh38" if "38" in r["ref"] else "GRCh37" if "37" in r["ref"] or "hg19" in r["ref"] else None


def complement(c: Column) -> Column:
    return F.translate(c, "ACGT", "TGCA")


def copies(gt: Column, ref: Column, alts: Column, a1: Column, a2: Column) -> Column:
    """Copies of a1 in a genotype of two called alleles, read on the same strand first and then on the other; null if an allele fits neither."""
    idx = F.transform(F.split(gt, "[/|]"), lambda x: x.try_cast("int"))
    base = F.transform(idx, lambda i: F.when(i == 0, ref).otherwise(F.get(alts, i - 1)))
    fit = lambda x, y: F.size(idx) == F.aggregate(base, F.lit(0), lambda acc, b: acc + F.when((b == x) | (b == y), 1).otherwise(0))
    n = lambda x: F.aggregate(base, F.lit(0), lambda acc, b: acc + F.when(b == x, 1).otherwise(0))
    ok = (F.size(idx) == 2) & ~F.exists(idx, lambda i: i.isNull())
    return F.when(ok & fit(a1, a2), n(a1)).when(ok & fit(complement(a1), complement(a2)), n(complement(a1)))


def hardcalls(vcf: DataFrame, targets: DataFrame, min_dp: int = 8, min_gq: int = 20) -> DataFrame:
    """snp_id, chrom, pos, state, dosage: what a single-sample gVCF says of each target site (snp_id, chrom, pos, a1, a2, ref_base).

    A record at the site wins over any reference block, a passing block over a failing one; blocks meet sites by bins.
    States: called, dropped (palindrome, rsid_mismap, ref_change), missing (not_pass, below_floor, half_or_missing_gt,
    non_panel_allele, no_refbase, no_coverage).
    """
    pal = complement(F.col("a1")) == F.col("a2")
    block = F.forall("alts", lambda a: a.isin("<NON_REF>", "<*>", "."))
    deep = (F.lit(min_dp) == 0) | (F.coalesce("min_dp", "dp", F.lit(0)) >= min_dp)
    sure = (F.lit(min_gq) == 0) | (F.coalesce("gq", F.lit(0)) >= min_gq)
    best = Window.partitionBy("chrom", "pos").orderBy(F.desc("passed"), F.desc_nulls_last("gq"))
    records = vcf.filter(~block).withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("chrom", "pos", F.col("id").alias("v_id"), F.col("ref").alias("v_ref"), F.col("alts").alias("v_alts"), F.col("passed").alias("v_passed"), F.col("gt").alias("v_gt"), F.coalesce(deep & sure, F.lit(False)).alias("v_ok"), F.lit(True).alias("v"))
    blocks = vcf.filter(block).select("chrom", F.col("pos").alias("b_start"), F.col("end").alias("b_end"), F.coalesce(F.col("passed") & deep & sure, F.lit(False)).alias("b_ok")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("b_start") / BIN), F.floor(F.col("b_end") / BIN))))
    hit = targets.withColumn("bin", F.floor(F.col("pos") / BIN)).select("snp_id", "chrom", "pos", "bin").join(blocks, ["chrom", "bin"]).filter("pos BETWEEN b_start AND b_end").groupBy("snp_id").agg(F.max("b_ok").alias("b_ok"))
    t = targets.join(records, ["chrom", "pos"], "left").join(hit, "snp_id", "left")
    single = F.forall("v_alts", lambda a: F.length(a) == 1) & (F.length("v_ref") == 1) & ~F.array_contains("v_alts", "*")
    n = copies(F.col("v_gt"), F.col("v_ref"), F.col("v_alts"), F.col("a1"), F.col("a2"))
    whole = F.coalesce(F.col("v_gt").rlike(r"^\d+[/|]\d+$"), F.lit(False))
    refs = F.when(F.col("ref_base") == F.col("a1"), 2).when(F.col("ref_base") == F.col("a2"), 0)
    state = (
        F.when(pal, "dropped:palindrome")
        .when(F.col("v") & F.col("v_id").startswith("rs") & (F.col("v_id") != F.col("snp_id")), "dropped:rsid_mismap")
        .when(F.col("v") & ~F.col("v_passed"), "missing:not_pass").when(F.col("v") & ~F.col("v_ok"), "missing:below_floor")
        .when(F.col("v") & ~whole, "missing:half_or_missing_gt").when(F.col("v") & (~single | n.isNull()), "missing:non_panel_allele").when(F.col("v"), "called")
        .when(F.col("b_ok") & (F.col("ref_base").isNull() | (F.col("ref_base") == ".")), "missing:no_refbase").when(F.col("b_ok") & refs.isNull(), "dropped:ref_change").when(F.col("b_ok"), "called")
        .when(F.col("b_ok").isNotNull(), "missing:below_floor").otherwise("missing:no_coverage")
    )
    return t.withColumn("state", state).select("snp_id", "chrom", "pos", "state", F.when(F.col("state") == "called", F.when(F.col("v"), n).otherwise(refs)).cast("int").alias("dosage"))


def likelihoods(vcf: DataFrame, kind: str = "PL") -> DataFrame:
    """chrom, pos, sample_no, l (of 0, 1, 2 copies of the second allele, summing to 1), present: normalised PL, GL or GP; unseen 1/3 each."""
    v = F.transform(F.split("pl", ","), lambda x: x.try_cast("double"))
    lin = {"PL": F.transform(v, lambda x: F.pow(F.lit(10.0), -(x - F.array_min(v)) / 10)), "GL": F.transform(v, lambda x: F.pow(F.lit(10.0), x - F.array_max(v))), "GP": v}[kind]
    total = F.aggregate(lin, F.lit(0.0), lambda a, x: a + x)
    ok = F.coalesce((F.size(v) == 3) & ~F.exists(v, lambda x: x.isNull()) & (total > 0), F.lit(False))
    third = F.array(*[F.lit(1 / 3)] * 3)
    return vcf.filter(F.size("alts") == 1).select("chrom", "pos", "sample_no", F.when(ok, F.transform(lin, lambda x: x / total)).otherwise(third).alias("l"), ok.alias("present"))


def phased_haplotypes(vcf: DataFrame) -> DataFrame:
    """chrom, pos, hap_no (two for each sample), hap: alleles of phased two-allele records; unphased or missing ones are left out."""
    p = vcf.filter((F.size("alts") == 1) & F.col("gt").rlike(r"^[01]\|[01]$"))
    h = F.posexplode(F.split("gt", r"\|"))
    return p.select("chrom", "pos", "sample_no", h.alias("side", "a")).select("chrom", "pos", (2 * F.col("sample_no") + F.col("side")).cast("long").alias("hap_no"), F.col("a").cast("int").alias("hap"))


def read_consumer(spark: SparkSession, path: str) -> DataFrame:
    """snp_id, chrom, pos, a, b: raw exports with a genotype column or two allele columns, tabs or commas, quoted or not."""
    v = F.regexp_replace("value", '"', "")
    c = F.split(v, "[\t,]")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & ~F.lower("value").rlike('^"?rsid'))
    two = F.size(c) >= 5
    return rows.select(c[0].alias("snp_id"), c[1].alias("chrom"), c[2].try_cast("long").alias("pos"), F.upper(F.when(two, c[3]).otherwise(F.substring(c[3], 1, 1))).alias("a"), F.upper(F.when(two, F.get(c, F.lit(4))).otherwise(F.substring(c[3], 2, 1))).alias("b"))


def consumer_calls(raw: DataFrame, targets: DataFrame) -> DataFrame:
    """snp_id, state, dosage by id, else by place (targets: snp_id, chrom, pos, a1, a2)."""
    by_id = targets.join(raw.select("snp_id", "a", "b"), "snp_id", "left")
    placed = by_id.join(raw.select("chrom", "pos", F.col("a").alias("pa"), F.col("b").alias("pb")).dropDuplicates(["chrom", "pos"]), ["chrom", "pos"], "left")
    t = placed.withColumns({"x": F.coalesce("a", "pa"), "y": F.coalesce("b", "pb")})
    base = lambda c: F.col(c).isin("A", "C", "G", "T")
    fits = lambda f: F.col("x").isin(f(F.col("a1")), f(F.col("a2"))) & F.col("y").isin(f(F.col("a1")), f(F.col("a2")))
    n = lambda f: (F.col("x") == f(F.col("a1"))).cast("int") + (F.col("y") == f(F.col("a1"))).cast("int")
    same = lambda c: c
    d = F.when(fits(same), n(same)).when(fits(complement), n(complement))
    state = F.when(complement(F.col("a1")) == F.col("a2"), "dropped:palindrome").when(F.col("x").isNull(), "missing:no_coverage").when(~base("x") | ~base("y"), "missing:no_call").when(d.isNull(), "missing:non_panel_allele").otherwise("called")
    return t.withColumn("state", state).select("snp_id", "state", F.when(F.col("state") == "called", d).alias("dosage"))


def build_targets(snps: DataFrame, lift: DataFrame) -> DataFrame:
    """Target sites from a panel: autosomal rs ids, ids and places seen once only, lifted by `lift` (snp_id, pos38); palindromes flagged."""
    own = snps.filter(F.col("chrom").between(1, 22) & F.col("snp_id").startswith("rs"))
    once = own.withColumns({"k1": F.count("*").over(Window.partitionBy("snp_id")), "k2": F.count("*").over(Window.partitionBy("chrom", "pos_bp"))}).filter("k1 = 1 AND k2 = 1").drop("k1", "k2")
    lifted = lift.groupBy("snp_id").agg(F.max("pos38").alias("pos38"), F.count_distinct("pos38").alias("k")).filter("k = 1").drop("k")
    return once.join(lifted, "snp_id").withColumn("palindrome", complement(F.col("ref")) == F.col("alt"))


def interpolate_map(sites: DataFrame, gmap: DataFrame) -> DataFrame:
    """sites (chrom, pos) with morgans: linear in base pairs between map points (chrom, pos, cm), clamped at both ends.

    An as-of join: both tables are ordered together on each chromosome, and each site takes the last point before it and
    the first after, which is the last before it in the reverse order: a frame that only grows takes one step for a row.
    """
    both = sites.select("chrom", "pos", F.lit(None).cast("double").alias("cm")).unionByName(gmap.select("chrom", "pos", "cm"))
    seen = lambda *order: Window.partitionBy("chrom").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("cm").isNotNull(), F.struct("pos", "cm"))
    t = both.withColumns({"lo": F.last(point, True).over(seen("pos", F.desc_nulls_last("cm"))), "hi": F.last(point, True).over(seen(F.desc("pos"), F.asc_nulls_first("cm")))}).filter("cm IS NULL")
    cm = F.when(F.col("lo").isNull(), F.col("hi.cm")).when(F.col("hi").isNull() | (F.col("hi.pos") == F.col("lo.pos")), F.col("lo.cm")).otherwise(F.col("lo.cm") + (F.col("hi.cm") - F.col("lo.cm")) * (F.col("pos") - F.col("lo.pos")) / (F.col("hi.pos") - F.col("lo.pos")))
    return t.select("chrom", "pos", (cm / 100).alias("morgans"))


def pair_concordance(a: DataFrame, b: DataFrame, value: str = "p0_norm", tolerance: float = 1e-6) -> DataFrame:
    """One row: pairs in either, in both, agreeing in degree, within the tolerance; pairs are unordered."""
    side = lambda t, k: t.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), F.col("degree").alias(f"d{k}"), F.col(value).alias(f"v{k}"))
    t = side(a, 1).join(side(b, 2), ["id1", "id2"], "full_outer")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    both = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    return t.agg(F.count("*").alias("pairs"), n(both).alias("shared"), n(F.col("d1") == F.col("d2")).alias("same_degree"), n(F.abs(F.col("v1") - F.col("v2")) <= tolerance).alias("close"))


def site_concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """state1, state2, same_dosage, sites: agreement of two ingest reports by site."""
    t = a.select("snp_id", F.col("state").alias("s1"), F.col("dosage").alias("x")).join(b.select("snp_id", F.col("state").alias("s2"), F.col("dosage").alias("y")), "snp_id", "full_outer")
    return t.groupBy(F.coalesce("s1", F.lit("absent")).alias("state1"), F.coalesce("s2", F.lit("absent")).alias("state2"), F.col("x").eqNullSafe(F.col("y")).alias("same_dosage")).agg(F.count("*").alias("sites"))
