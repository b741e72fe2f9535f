"""Registered queries over the derived genotype tables, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.special import rounded
from kinfold.operators import blocks as bl
from kinfold.operators import differentiation as di
from kinfold.operators import frequencies as fr
from kinfold.operators import fstats as fs
from kinfold.operators import relatedness as re_
from kinfold.plans import fixture as fx
from kinfold.plans.fixture import GENO_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Base pairs of a jackknife block, and of a window and its step.
BLOCK, WIN, STEP = 220_000, 2_000_000, 1_000_000


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _round(df: DataFrame, *doubles: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in doubles})


R = lambda e, d=8: f"round(({e}) + 1.7e-12, {d}) + 0.0"
COUNTS_SQL = GENO_SQL + ", counts AS (SELECT snp_idx, pop, count(*) AS n, CAST(sum(dosage) AS BIGINT) AS ac, CAST(sum(CASE WHEN dosage = 1 THEN 1 ELSE 0 END) AS BIGINT) AS het FROM geno GROUP BY snp_idx, pop)"


@query("pop_counts", f"WITH {COUNTS_SQL} SELECT * FROM counts")
def q_counts(spark, d):
    return fr.pop_counts(fx.genotypes(spark, d))


@query("allele_frequency", f"WITH {COUNTS_SQL} SELECT snp_idx, pop, {R('ac / (2.0 * n)')} AS q, 2 * n AS n FROM counts")
def q_af(spark, d):
    return _round(fr.allele_frequency(fx.genotypes(spark, d)), "q")


@query("ploidy", f"WITH {GENO_SQL} SELECT sample_idx, CAST(1 + max(CASE WHEN dosage = 1 AND snp_idx <= 1000 THEN 1 ELSE 0 END) AS INTEGER) AS ploidy FROM geno GROUP BY sample_idx")
def q_ploidy(spark, d):
    return fr.detect_ploidy(fx.genotypes(spark, d))


@query("pseudo_haploid_frequency", f"WITH {GENO_SQL} SELECT snp_idx, pop, {R('sum(hap) / CAST(count(*) AS DOUBLE)')} AS q, count(*) AS n FROM geno GROUP BY snp_idx, pop")
def q_haf(spark, d):
    g = fx.genotypes(spark, d).withColumn("dosage", 2 * F.col("hap"))
    return _round(fr.allele_frequency(g, fr.detect_ploidy(g)), "q")


SUMMARY_SQL = GENO_SQL + ", summary AS (SELECT snp_idx, least(sum(dosage) / (2.0 * count(*)), 1 - sum(dosage) / (2.0 * count(*))) AS maf, 1 - count(*) / CAST((SELECT count(*) FROM supplier) AS DOUBLE) AS missing, count(DISTINCT pop) AS seen FROM geno GROUP BY snp_idx)"


@query("snp_summary", f"WITH {SUMMARY_SQL} SELECT snp_idx, {R('maf')} AS maf, {R('missing')} AS missing FROM summary")
def q_summary(spark, d):
    return _round(fr.pooled_summary(fx.genotypes(spark, d), fx.samples(spark, d).count()), "maf", "missing")


@query("filter_qc", f"WITH {SUMMARY_SQL} SELECT snps.snp_idx, snp_id, chrom, pos_bp FROM snps JOIN summary USING (snp_idx) WHERE ref <> alt AND ref || alt NOT IN ('AT', 'TA', 'CG', 'GC') AND maf >= 0.05 AND missing <= 0.98 AND maf > 0 AND chrom BETWEEN 1 AND 22 AND seen >= 3")
def q_qc(spark, d):
    return fr.filter_snps(fx.snps(spark, d), fx.genotypes(spark, d), fx.samples(spark, d).count(), drop_ambiguous=True, maf=0.05, max_missing=0.98, drop_monomorphic=True, autosomes_only=True, max_missing_pops=0.4, pops=5).select("snp_idx", "snp_id", "chrom", "pos_bp")


@query("filter_transversions", f"WITH {GENO_SQL} SELECT snp_idx, snp_id FROM snps WHERE ref <> alt AND (ref IN ('A', 'G')) <> (alt IN ('A', 'G'))")
def q_tv(spark, d):
    return fr.filter_snps(fx.snps(spark, d), transversions_only=True).select("snp_idx", "snp_id")


@query("filter_include_exclude", f"WITH {GENO_SQL} SELECT snp_idx, snp_id FROM snps WHERE ref <> alt AND snp_id IN (SELECT 'rs' || (l_partkey + 1) FROM lineitem WHERE l_returnflag = 'A') AND snp_id NOT IN (SELECT 'rs' || (l_partkey + 1) FROM lineitem WHERE l_quantity > 49)")
def q_ids(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("snp_id", F.concat(F.lit("rs"), F.col("l_partkey") + 1))
    return fr.filter_snps(fx.snps(spark, d), include=li.filter("l_returnflag = 'A'").select("snp_id"), exclude=li.filter("l_quantity > 49").select("snp_id")).select("snp_idx", "snp_id")


@query("filter_samples", f"WITH {GENO_SQL} SELECT sample_idx FROM geno GROUP BY sample_idx HAVING 1 - count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE) <= 0.97")
def q_mind(spark, d):
    return fr.keep_samples(fx.genotypes(spark, d), fx.table(spark, d, "part").count(), 0.97)


@query("ascertainment", f"WITH {GENO_SQL}, o AS (SELECT DISTINCT 'rs' || (2 * p_partkey) AS snp_id FROM part) SELECT count(*) AS ids, count(*) FILTER (snp_id IN (SELECT snp_id FROM snps)) AS shared, {R('count(*) FILTER (snp_id IN (SELECT snp_id FROM snps)) / CAST(count(*) AS DOUBLE)')} AS share, 2 * count(*) FILTER (snp_id IN (SELECT snp_id FROM snps)) >= count(*) AS same_ascertainment FROM o")
def q_asc(spark, d):
    other = fx.table(spark, d, "part").select(F.concat(F.lit("rs"), 2 * F.col("p_partkey")).alias("snp_id"))
    return _round(fr.ascertainment_overlap(fx.snps(spark, d), other), "share")


@query("select_pops", f"WITH {GENO_SQL}, s AS (SELECT nation AS pop, count(*) AS n, min(c) AS seen FROM smp GROUP BY nation) SELECT pop, n FROM s ORDER BY n DESC, seen LIMIT 7")
def q_pops(spark, d):
    return fr.select_pops(fx.samples(spark, d).drop("pop").withColumnRenamed("nation", "pop"), top=7)


BLOCK_SQL = f", ord AS (SELECT snp_idx, chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos_bp) - 1 AS k FROM snps), blk AS (SELECT snp_idx, dense_rank() OVER (ORDER BY chrom, k // {BLOCK // 22_000}) - 1 AS block_id FROM ord)"


@query("blocks", f"WITH {GENO_SQL} {BLOCK_SQL} SELECT snp_idx, CAST(block_id AS INTEGER) AS block_id FROM blk")
def q_blocks(spark, d):
    return bl.assign_blocks(fx.snps(spark, d), BLOCK, "pos_bp")


WALK_SQL = f"""
WITH RECURSIVE {GENO_SQL}, kept AS (SELECT snp_idx, chrom, pos_bp, row_number() OVER (PARTITION BY chrom ORDER BY pos_bp) AS k FROM snps WHERE ref <> alt AND ref || alt NOT IN ('AT', 'TA', 'CG', 'GC')),
walk AS (SELECT snp_idx, chrom, pos_bp, k, pos_bp AS a FROM kept WHERE k = 1
  UNION ALL SELECT n.snp_idx, n.chrom, n.pos_bp, n.k, CASE WHEN n.pos_bp - w.a >= 100000 THEN n.pos_bp ELSE w.a END FROM walk w JOIN kept n ON n.chrom = w.chrom AND n.k = w.k + 1)
SELECT snp_idx, CAST(dense_rank() OVER (ORDER BY chrom, a) - 1 AS INTEGER) AS block_id FROM walk
"""


@query("blocks_filtered", WALK_SQL)
def q_blocks_filtered(spark, d):
    return bl.assign_blocks(fr.filter_snps(fx.snps(spark, d), drop_ambiguous=True), 100_000, "pos_bp")


def tensor(spark, d, by: str = "pop") -> DataFrame:
    g = fx.genotypes(spark, d)
    if by != "pop":
        g = g.drop("pop").join(F.broadcast(fx.samples(spark, d).select("sample_idx", F.col(by).alias("pop"))), "sample_idx")
    return fs.f2_blocks(fr.allele_frequency(g), bl.assign_blocks(fx.snps(spark, d), BLOCK, "pos_bp"))


F2_SQL = COUNTS_SQL + BLOCK_SQL + """,
af AS (SELECT snp_idx, pop, ac / (2.0 * n) AS q, 2 * n AS n FROM counts), hc AS (SELECT *, q * (1 - q) / greatest(n - 1, 1) AS h FROM af),
sizes AS (SELECT block_id, count(*) AS block_size FROM blk GROUP BY block_id),
terms AS (SELECT a.snp_idx, a.pop AS p1, b.pop AS p2, (a.q - b.q) * (a.q - b.q) - a.h - b.h AS f2 FROM hc a JOIN hc b ON a.snp_idx = b.snp_idx AND a.pop <= b.pop),
f2b AS (SELECT block_id, p1, p2, sum(f2) / count(*) AS f2, count(*) AS vpair, any_value(block_size) AS block_size FROM terms JOIN blk USING (snp_idx) JOIN sizes USING (block_id) GROUP BY block_id, p1, p2),
whole AS (SELECT block_id FROM f2b GROUP BY block_id HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT p1, p2 FROM f2b))),
sym AS (SELECT block_id, p1, p2, CASE WHEN p1 = p2 THEN 0 ELSE f2 END AS f2, block_size FROM f2b JOIN whole USING (block_id) UNION ALL SELECT block_id, p2, p1, f2, block_size FROM f2b JOIN whole USING (block_id) WHERE p1 < p2)
"""


@query("f2_blocks", f"WITH {F2_SQL} SELECT CAST(block_id AS INTEGER) AS block_id, p1, p2, {R('f2')} AS f2, vpair, block_size FROM f2b")
def q_f2b(spark, d):
    return _round(tensor(spark, d), "f2")


@query("f2", f"WITH {F2_SQL} SELECT p1, p2, {R('sum(f2) / count(*)')} AS f2, count(*) AS vpair FROM terms GROUP BY p1, p2")
def q_f2(spark, d):
    return _round(fs.f2(fr.allele_frequency(fx.genotypes(spark, d))), "f2")


def _jack(keys: str, source: str, digits: int = 7) -> str:
    """Jackknife of `source` (keys, block_size, x) in SQL, written from the definition."""
    return f"""
t0 AS (SELECT *, sum(block_size) OVER w AS n, sum(x * block_size) OVER w AS s FROM {source} WINDOW w AS (PARTITION BY {keys})),
t1 AS (SELECT *, (s / n - x * block_size / n) / (1 - block_size / n) AS loo FROM t0),
t2 AS (SELECT *, sum(loo * (1 - block_size / n)) OVER w / sum(1 - block_size / n) OVER w AS line FROM t1 WINDOW w AS (PARTITION BY {keys})),
t3 AS (SELECT *, sum(line - loo) OVER w + sum(loo * block_size) OVER w / n AS est FROM t2 WINDOW w AS (PARTITION BY {keys})),
t4 AS (SELECT {keys}, any_value(est) AS est, sqrt(avg(pow(est * n / block_size - loo * (n / block_size - 1) - line, 2) / (n / block_size - 1))) AS se FROM t3 GROUP BY {keys})
SELECT {keys}, {R('est', digits)} AS est, {R('se', digits)} AS se, {R('est / se', digits - 2)} AS z FROM t4"""


QUART = "pop1, pop2, pop3, pop4"
QUART_SQL = ", labels AS (SELECT DISTINCT pop FROM smp), quart AS (SELECT a.pop AS pop1, b.pop AS pop2, c.pop AS pop3, d.pop AS pop4 FROM labels a, labels b, labels c, labels d WHERE a.pop < b.pop AND c.pop < d.pop AND a.pop < c.pop AND b.pop <> c.pop AND b.pop <> d.pop)"
F4_SQL = F2_SQL + QUART_SQL + """, x4 AS (SELECT pop1, pop2, pop3, pop4, a.block_id, a.block_size, (a.f2 + b.f2 - c.f2 - e.f2) / 2 AS x FROM quart
JOIN sym a ON a.p1 = pop2 AND a.p2 = pop3 JOIN sym b ON b.p1 = pop1 AND b.p2 = pop4 AND b.block_id = a.block_id JOIN sym c ON c.p1 = pop1 AND c.p2 = pop3 AND c.block_id = a.block_id JOIN sym e ON e.p1 = pop2 AND e.p2 = pop4 AND e.block_id = a.block_id)"""


def quartets(spark, d) -> DataFrame:
    """Every unordered pair of disjoint unordered pairs of populations."""
    p = [fx.samples(spark, d).select(F.col("pop").alias(f"pop{i}")).distinct() for i in range(1, 5)]
    out = p[0].join(p[1], F.col("pop1") < F.col("pop2")).join(p[2], (F.col("pop1") < F.col("pop3")) & (F.col("pop2") != F.col("pop3")))
    return out.join(p[3], (F.col("pop3") < F.col("pop4")) & (F.col("pop2") != F.col("pop4")))


@query("f4", f"WITH {F4_SQL}, {_jack(QUART, 'x4')}")
def q_f4(spark, d):
    return _round(_round(fs.f4(tensor(spark, d), quartets(spark, d)), "est", "se", digits=7), "z", digits=5)


@query("qpdstat_f2", ORACLES["f4"])
def q_qpdstat(spark, d):
    """On the f2 path D is f4."""
    return q_f4(spark, d)


#: The two-sided normal tail of z by the series erf(x) = exp(-x^2) sum x^(2 n + 1) / gamma(n + 3/2).
P_SQL = "CASE WHEN abs(est / se) > 8 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln(abs(est / se) / sqrt(2.0)) - pow(est / se, 2) / 2 - lgamma(n + 1.5)))) END"


def _p_of(sql: str) -> str:
    """A jackknife's SQL with p beside z."""
    return sql.replace("AS z FROM t4", f"AS z, {R(P_SQL, 4)} AS p FROM t4")


def _rounded_stats(df: DataFrame) -> DataFrame:
    return _round(_round(_round(df, "est", "se", digits=7), "z", digits=5), "p", digits=4)


@query("f4_p", _p_of(ORACLES["f4"]))
def q_f4p(spark, d):
    return _rounded_stats(fs.with_p(fs.f4(tensor(spark, d), quartets(spark, d))))


TRIPLE_SQL = F2_SQL + """, labels AS (SELECT DISTINCT pop FROM smp), x3 AS (SELECT a.p1 AS pop1, a.p2 AS pop2, b.p2 AS pop3, a.block_id, a.block_size, (a.f2 + b.f2 - c.f2) / 2 AS x FROM sym a JOIN sym b ON b.p1 = a.p1 AND b.block_id = a.block_id AND b.p2 > a.p2 AND a.p1 <> a.p2 AND b.p1 <> b.p2 JOIN sym c ON c.p1 = a.p2 AND c.p2 = b.p2 AND c.block_id = a.block_id)"""


@query("f3", f"WITH {TRIPLE_SQL}, {_jack('pop1, pop2, pop3', 'x3')}")
def q_f3(spark, d):
    p = [fx.samples(spark, d).select(F.col("pop").alias(f"pop{i}")).distinct() for i in range(1, 4)]
    triples = p[1].join(p[2], F.col("pop2") < F.col("pop3")).join(p[0], (F.col("pop1") != F.col("pop2")) & (F.col("pop1") != F.col("pop3")))
    return _round(_round(fs.f3(tensor(spark, d), triples), "est", "se", digits=7), "z", digits=5)


RATIO_SQL = F4_SQL + """, x5 AS (SELECT x.*, l.pop AS pop5, (a.f2 + b.f2 - c.f2 - e.f2) / 2 AS den FROM x4 x JOIN labels l ON l.pop NOT IN (x.pop1, x.pop2, x.pop3, x.pop4)
JOIN sym a ON a.p1 = pop2 AND a.p2 = l.pop AND a.block_id = x.block_id JOIN sym b ON b.p1 = pop1 AND b.p2 = pop4 AND b.block_id = x.block_id JOIN sym c ON c.p1 = pop1 AND c.p2 = l.pop AND c.block_id = x.block_id JOIN sym e ON e.p1 = pop2 AND e.p2 = pop4 AND e.block_id = x.block_id),
y0 AS (SELECT *, sum(block_size) OVER w AS n, sum(x * block_size) OVER w AS sx, sum(den * block_size) OVER w AS sd FROM x5 WINDOW w AS (PARTITION BY pop1, pop2, pop3, pop4, pop5)),
y1 AS (SELECT *, (sx - x * block_size) / (sd - den * block_size) AS r FROM y0 WHERE abs(den) >= 1e-6),
y2 AS (SELECT *, sum(x * block_size) OVER w / sum(den * block_size) OVER w AS tot, sum(block_size) OVER w AS m FROM y1 WINDOW w AS (PARTITION BY pop1, pop2, pop3, pop4, pop5)),
y3 AS (SELECT *, sum(tot - r) OVER w + sum(r * block_size) OVER w / m AS est FROM y2 WINDOW w AS (PARTITION BY pop1, pop2, pop3, pop4, pop5)),
y4 AS (SELECT pop1, pop2, pop3, pop4, pop5, any_value(est) AS alpha, sqrt(avg(pow(m / block_size * tot - (m / block_size - 1) * r - est, 2) / (m / block_size - 1))) AS se FROM y3 GROUP BY ALL)"""
RATIO_SQL = RATIO_SQL.replace("any_value(est) AS alpha", "max(est) AS alpha").replace("GROUP BY ALL", "GROUP BY pop1, pop2, pop3, pop4, pop5")


@query("f4_ratio", f"WITH {RATIO_SQL} SELECT pop1, pop2, pop3, pop4, pop5, {R('alpha', 4)} AS alpha, {R('se', 3)} AS se, {R('alpha / se', 3)} AS z FROM y4")
def q_ratio(spark, d):
    q5 = quartets(spark, d).join(fx.samples(spark, d).select(F.col("pop").alias("pop5")).distinct(), ~F.col("pop5").isin(F.col("pop1"), F.col("pop2"), F.col("pop3"), F.col("pop4")))
    return _round(_round(fs.f4_ratio(tensor(spark, d), q5), "alpha", digits=4), "se", "z", digits=3)


DSTAT_SQL = COUNTS_SQL + BLOCK_SQL + QUART_SQL + """, af AS (SELECT snp_idx, pop, ac / (2.0 * n) AS q FROM counts),
v AS (SELECT pop1, pop2, pop3, pop4, block_id, a.q AS a, b.q AS b, c.q AS c, e.q AS d FROM quart JOIN af a ON a.pop = pop1 JOIN af b ON b.pop = pop2 AND b.snp_idx = a.snp_idx JOIN af c ON c.pop = pop3 AND c.snp_idx = a.snp_idx JOIN af e ON e.pop = pop4 AND e.snp_idx = a.snp_idx JOIN blk ON blk.snp_idx = a.snp_idx),
s AS (SELECT pop1, pop2, pop3, pop4, block_id, sum((a - b) * (c - d)) AS num, sum((a + b - 2 * a * b) * (c + d - 2 * c * d)) AS den, count(*) AS cnt FROM v GROUP BY pop1, pop2, pop3, pop4, block_id),
d0 AS (SELECT *, sum(cnt) OVER w AS n, (sum(num) OVER w - num) / (sum(den) OVER w - den) AS r FROM s WINDOW w AS (PARTITION BY pop1, pop2, pop3, pop4)),
d1 AS (SELECT *, sum(r * (1 - cnt / n)) OVER w / sum(1 - cnt / n) OVER w AS tot FROM d0 WINDOW w AS (PARTITION BY pop1, pop2, pop3, pop4)),
d2 AS (SELECT *, sum(tot - r) OVER w + sum(r * cnt) OVER w / n AS est FROM d1 WINDOW w AS (PARTITION BY pop1, pop2, pop3, pop4)),
d3 AS (SELECT pop1, pop2, pop3, pop4, max(est) AS est, sqrt(avg(pow(n / cnt * tot - (n / cnt - 1) * r - est, 2) / (n / cnt - 1))) AS se FROM d2 GROUP BY pop1, pop2, pop3, pop4)"""


@query("dstat", f"WITH {DSTAT_SQL} SELECT pop1, pop2, pop3, pop4, {R('est', 7)} AS est, {R('se', 7)} AS se, {R('est / se', 5)} AS z FROM d3")
def q_dstat(spark, d):
    out = fs.dstat(fr.allele_frequency(fx.genotypes(spark, d)), bl.assign_blocks(fx.snps(spark, d), BLOCK, "pos_bp"), quartets(spark, d))
    return _round(_round(out, "est", "se", digits=7), "z", digits=5)


SWEEP4 = ORACLES["f4"].replace("a.pop < b.pop AND c.pop < d.pop AND a.pop < c.pop AND b.pop <> c.pop AND b.pop <> d.pop", "a.pop < b.pop AND b.pop < c.pop AND c.pop < d.pop")


@query("f4_sweep", _p_of(SWEEP4 + " WHERE abs(est / se) >= 0.5"))
def q_sweep4(spark, d):
    return _rounded_stats(fs.sweep(tensor(spark, d), 4, min_z=0.5))


@query("f3_sweep", _p_of(ORACLES["f3"] + " WHERE pop1 < pop2 ORDER BY abs(est / se) DESC, pop1, pop2, pop3 LIMIT 6"))
def q_sweep3(spark, d):
    return _rounded_stats(fs.sweep(tensor(spark, d), 3, top=6))


FST_SQL = COUNTS_SQL + """,
pr AS (SELECT a.snp_idx, a.pop AS p1, b.pop AS p2, CAST(a.n AS DOUBLE) AS n1, CAST(b.n AS DOUBLE) AS n2, a.ac / (2.0 * a.n) AS q1, b.ac / (2.0 * b.n) AS q2, a.het + b.het AS ht FROM counts a JOIN counts b ON a.snp_idx = b.snp_idx AND a.pop < b.pop),
p0 AS (SELECT *, (n1 + n2) / 2 AS nb, (n1 + n2) - (n1 * n1 + n2 * n2) / (n1 + n2) AS nc, (n1 * q1 + n2 * q2) / (n1 + n2) AS q, ht / (n1 + n2) AS h FROM pr WHERE n1 + n2 > 2),
p1_ AS (SELECT *, (n1 * (q1 - q) * (q1 - q) + n2 * (q2 - q) * (q2 - q)) / nb AS s2 FROM p0),
p2_ AS (SELECT *, nb / nc * (s2 - (q * (1 - q) - s2 / 2 - h / 4) / (nb - 1)) AS num, nb / (nb - 1) * (q * (1 - q) - s2 / 2 - (2 * nb - 1) / (4 * nb) * h) AS b FROM p1_),
sites AS (SELECT snp_idx, p1, p2, CASE WHEN abs(num + b + h / 2) > 1e-14 THEN num END AS num, CASE WHEN abs(num + b + h / 2) > 1e-14 THEN num + b + h / 2 END AS den FROM p2_)"""


@query("fst_sites", f"WITH {FST_SQL} SELECT snp_idx, p1, p2, {R('num')} AS num, {R('den')} AS den, {R('num / den')} AS fst FROM sites WHERE den IS NOT NULL")
def q_fst_sites(spark, d):
    return _round(di.fst_sites(fr.pop_counts(fx.genotypes(spark, d))).filter("den IS NOT NULL"), "num", "den", "fst")


@query("fst_pairs", f"WITH {FST_SQL} SELECT p1, p2, {R('sum(num) / sum(den)')} AS fst, {R('avg(num / den)')} AS mean_fst, count(*) AS n_snp FROM sites WHERE den IS NOT NULL GROUP BY p1, p2")
def q_fst(spark, d):
    return _round(di.fst_pairs(di.fst_sites(fr.pop_counts(fx.genotypes(spark, d)))), "fst", "mean_fst")


@query("fst_matrix", f"WITH {FST_SQL}, f AS (SELECT p1, p2, sum(num) / sum(den) AS fst FROM sites WHERE den IS NOT NULL GROUP BY p1, p2) SELECT p1, p2, {R('fst')} AS fst FROM f UNION ALL SELECT p2, p1, {R('fst')} FROM f UNION ALL SELECT p, p, 0.0 FROM (SELECT p1 AS p FROM f UNION SELECT p2 FROM f)")
def q_fst_matrix(spark, d):
    return _round(di.fst_matrix(di.fst_pairs(di.fst_sites(fr.pop_counts(fx.genotypes(spark, d))))), "fst")


WINDOW_SQL = FST_SQL + f""",
ends AS (SELECT chrom, min(pos_bp) AS a, max(pos_bp) AS z FROM snps GROUP BY chrom HAVING max(pos_bp) > min(pos_bp)),
wins AS (SELECT chrom, a + k * {STEP} AS "start", least(a + k * {STEP} + {WIN} - 1, z) AS "end" FROM (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((z - a + 1 - {WIN}) / {STEP}.0) AS BIGINT)))) AS k FROM ends)),
wn AS (SELECT w.chrom, w."start", w."end", count(*) AS n_snp FROM wins w JOIN snps s ON s.chrom = w.chrom AND s.pos_bp BETWEEN w."start" AND w."end" GROUP BY w.chrom, w."start", w."end"),
wf AS (SELECT w.chrom, w."start", w."end", s.p1, s.p2, sum(num) / nullif(sum(den), 0) AS fst FROM wins w JOIN snps v ON v.chrom = w.chrom AND v.pos_bp BETWEEN w."start" AND w."end" JOIN sites s ON s.snp_idx = v.snp_idx GROUP BY w.chrom, w."start", w."end", s.p1, s.p2),
ww AS (SELECT wn.*, l.p1, l.p2, wf.fst FROM wn CROSS JOIN (SELECT DISTINCT p1, p2 FROM pr) l LEFT JOIN wf ON wf.chrom = wn.chrom AND wf."start" = wn."start" AND wf.p1 = l.p1 AND wf.p2 = l.p2)"""


@query("fst_windows", f"WITH {WINDOW_SQL} SELECT chrom, \"start\", \"end\", p1, p2, n_snp, {R('fst')} AS fst FROM ww")
def q_fst_windows(spark, d):
    return _round(di.fst_windows(di.fst_sites(fr.pop_counts(fx.genotypes(spark, d))), fx.snps(spark, d), WIN, STEP), "fst")


T = lambda x: f"-ln(1 - least(greatest({x}, 0.0), 1 - 1e-9))"


@query("pbs", f"WITH {WINDOW_SQL}, t AS (SELECT chrom, \"start\", \"end\", max(n_snp) AS n_snp, max(CASE WHEN p1 = 'AFRICA' AND p2 = 'ASIA' THEN fst END) AS fst_ab, max(CASE WHEN p1 = 'AFRICA' AND p2 = 'EUROPE' THEN fst END) AS fst_ac, max(CASE WHEN p1 = 'ASIA' AND p2 = 'EUROPE' THEN fst END) AS fst_bc FROM ww GROUP BY chrom, \"start\", \"end\") SELECT chrom, \"start\", \"end\", n_snp, {R('fst_ab')} AS fst_ab, {R('fst_ac')} AS fst_ac, {R('fst_bc')} AS fst_bc, {R('(' + T('fst_ab') + ' + ' + T('fst_ac') + ' - (' + T('fst_bc') + ')) / 2')} AS pbs FROM t")
def q_pbs(spark, d):
    w = di.fst_windows(di.fst_sites(fr.pop_counts(fx.genotypes(spark, d))), fx.snps(spark, d), WIN, STEP)
    return _round(di.pbs(w, "AFRICA", "ASIA", "EUROPE"), "fst_ab", "fst_ac", "fst_bc", "pbs")


def _sfs_sql(fold: bool) -> str:
    k = lambda c: f"least({c}, 12 - {c})" if fold else c
    top = 6 if fold else 12
    return f"WITH {COUNTS_SQL}, c AS (SELECT {k('a.ac')} AS i, {k('b.ac')} AS j, count(*) AS sites FROM counts a JOIN counts b USING (snp_idx) WHERE a.pop = 'AFRICA' AND b.pop = 'ASIA' AND a.n = 6 AND b.n = 6 GROUP BY 1, 2) SELECT i, j, coalesce(sites, 0) AS sites FROM (SELECT unnest(range(0, {top + 1})) AS i) CROSS JOIN (SELECT unnest(range(0, {top + 1})) AS j) LEFT JOIN c USING (i, j)"


@query("joint_sfs", _sfs_sql(False))
def q_sfs(spark, d):
    return di.joint_sfs(fr.pop_counts(fx.genotypes(spark, d)), "AFRICA", "ASIA", 6, 6)


@query("joint_sfs_folded", _sfs_sql(True))
def q_sfs_folded(spark, d):
    return di.joint_sfs(fr.pop_counts(fx.genotypes(spark, d)), "AFRICA", "ASIA", 6, 6, fold=True)


@query("pop_sfs", f"WITH {COUNTS_SQL} SELECT pop, n, ac, count(*) AS sites FROM counts GROUP BY pop, n, ac")
def q_pop_sfs(spark, d):
    return di.pop_sfs(fr.pop_counts(fx.genotypes(spark, d)))


KING_SQL = GENO_SQL + """, kc AS (SELECT a.sample_idx AS id1, b.sample_idx AS id2, count(*) AS nsnp, CAST(sum(CASE WHEN a.dosage = 1 AND b.dosage = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hethet, CAST(sum(CASE WHEN abs(a.dosage - b.dosage) = 2 THEN 1 ELSE 0 END) AS BIGINT) AS ibs0, CAST(sum(CASE WHEN a.dosage = 1 THEN 1 ELSE 0 END) AS BIGINT) AS het1, CAST(sum(CASE WHEN b.dosage = 1 THEN 1 ELSE 0 END) AS BIGINT) AS het2 FROM geno a JOIN geno b ON a.snp_idx = b.snp_idx AND a.sample_idx < b.sample_idx GROUP BY 1, 2),
kp AS (SELECT *, 0.5 + (hethet - 2 * ibs0 - (het1 + het2) / 2.0) / (2.0 * nullif(least(het1, het2), 0)) AS phi FROM kc)"""
KIN_COLS = "id1, id2, nsnp, hethet, ibs0, het1, het2, " + R("phi") + " AS phi, CASE WHEN phi IS NULL THEN NULL WHEN phi > 0.354 THEN 'duplicate' WHEN phi > 0.177 THEN 'first' WHEN phi > 0.0884 THEN 'second' WHEN phi > 0.0442 THEN 'third' ELSE 'unrelated' END AS degree"


@query("kinship", f"WITH {KING_SQL} SELECT {KIN_COLS} FROM kp")
def q_king(spark, d):
    return _round(re_.kinship(re_.king_counts(fx.genotypes(spark, d))), "phi")


@query("kinship_pairs", f"WITH {KING_SQL} SELECT {KIN_COLS} FROM kp WHERE id2 = id1 + 1")
def q_king_pairs(spark, d):
    s = fx.samples(spark, d)
    wanted = s.select((F.col("sample_idx") + 1).alias("id1"), F.col("sample_idx").alias("id2"))
    return _round(re_.kinship(re_.king_counts(fx.genotypes(spark, d), wanted)), "phi")


@query("kinship_min", f"WITH {KING_SQL} SELECT {KIN_COLS} FROM kp WHERE phi >= 0.0442")
def q_king_min(spark, d):
    return _round(re_.kinship(re_.king_counts(fx.genotypes(spark, d))).filter("phi >= 0.0442"), "phi")


#: One sample goes in each step: the partner of the least sample with one relative, else the least of those with the most.
CUTOFF_SQL = """WITH RECURSIVE """ + KING_SQL + """, e0 AS (SELECT coalesce(list({'u': id1, 'v': id2} ORDER BY id1, id2), []) AS e FROM kp WHERE phi > 0.1 * (1 + pow(2.0, -44))),
step AS (SELECT 0 AS k, e, CAST(NULL AS BIGINT) AS gone FROM e0 UNION ALL
  SELECT k + 1, list_filter(e, lambda x: x.u <> out AND x.v <> out), out FROM (
    SELECT k, e, CASE WHEN one IS NULL THEN list_min(list_filter(own, lambda n: len(list_filter(ends, lambda m: m = n)) = most)) ELSE list_filter(e, lambda x: x.u = one OR x.v = one)[1].u + list_filter(e, lambda x: x.u = one OR x.v = one)[1].v - one END AS out FROM (
      SELECT k, e, ends, own, list_min(list_filter(own, lambda n: len(list_filter(ends, lambda m: m = n)) = 1)) AS one, list_max(list_transform(own, lambda n: len(list_filter(ends, lambda m: m = n)))) AS most FROM (
        SELECT k, e, ends, list_distinct(ends) AS own FROM (SELECT k, e, list_concat(list_transform(e, lambda x: x.u), list_transform(e, lambda x: x.v)) AS ends FROM step WHERE len(e) > 0)))))
SELECT c AS sample_idx, c IN (SELECT gone FROM step WHERE gone IS NOT NULL) AS removed FROM smp"""


@query("king_cutoff", CUTOFF_SQL)
def q_cutoff(spark, d):
    return re_.king_cutoff(re_.kinship(re_.king_counts(fx.genotypes(spark, d))), fx.samples(spark, d), 0.1)


RV2_SQL = GENO_SQL + """, ordv AS (SELECT snp_idx, row_number() OVER (ORDER BY chrom, pos_bp) - 1 AS ord FROM snps),
h AS (SELECT snp_idx, sample_idx, hap, ord // 100 AS win FROM geno JOIN ordv USING (snp_idx)),
w AS (SELECT a.sample_idx AS id1, b.sample_idx AS id2, a.win, count(*) AS comparable, CAST(sum(CASE WHEN a.hap <> b.hap THEN 1 ELSE 0 END) AS BIGINT) AS mismatched FROM h a JOIN h b ON a.snp_idx = b.snp_idx AND a.sample_idx < b.sample_idx GROUP BY 1, 2, 3),
s AS (SELECT id1, id2, count(*) AS n_windows, CAST(sum(comparable) AS BIGINT) AS n_overlap, avg(mismatched / CAST(comparable AS DOUBLE)) AS p0_mean, sum(pow(mismatched / CAST(comparable AS DOUBLE), 2)) AS s2, sum(mismatched / CAST(comparable AS DOUBLE)) AS s1 FROM w GROUP BY 1, 2),
b AS (SELECT median(p0_mean) AS bg FROM s)"""


@query("mismatch_windows", f"WITH {RV2_SQL} SELECT id1, id2, win, comparable, mismatched FROM w")
def q_mismatch(spark, d):
    return re_.mismatch_windows(fx.genotypes(spark, d).select("snp_idx", "sample_idx", "hap"), re_.snp_order(fx.snps(spark, d)).select("snp_idx", "ord"), 100)


@query("readv2", f"WITH {RV2_SQL} SELECT id1, id2, n_windows, n_overlap, {R('p0_mean')} AS p0_mean, {R('p0_mean / bg')} AS p0_norm, CASE WHEN p0_mean / bg < 0.625 THEN 'identical' WHEN p0_mean / bg < 0.8125 THEN 'first' WHEN p0_mean / bg < 0.90625 THEN 'second' ELSE 'unrelated' END AS degree, {R("(CASE WHEN p0_mean / bg < 0.625 THEN 0.625 WHEN p0_mean / bg < 0.8125 THEN 0.8125 ELSE 0.90625 END - p0_mean / bg) / nullif(sqrt(greatest((s2 - s1 * s1 / n_windows) / nullif(n_windows - 1, 0), 0.0)) / sqrt(n_windows) / bg, 0)", 4)} AS z FROM s, b")
def q_readv2(spark, d):
    rates = re_.pair_rates(fx.genotypes(spark, d).select("snp_idx", "sample_idx", "hap"), re_.snp_order(fx.snps(spark, d)).select("snp_idx", "ord"), 100)
    return _round(_round(re_.readv2(rates), "p0_mean", "p0_norm"), "z", digits=4)


@query("ld_pairs", f"WITH {GENO_SQL}, f AS (SELECT snp_idx, sum(dosage) / (2.0 * count(*)) AS q FROM geno GROUP BY snp_idx), o AS (SELECT snp_idx, chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos_bp) - 1 AS ord FROM snps JOIN f USING (snp_idx) WHERE q > 0 AND q < 1), p AS (SELECT a.chrom, a.ord AS a, b.ord AS b, count(*) AS n, sum(x.dosage) AS sx, sum(y.dosage) AS sy, sum(x.dosage * x.dosage) AS sxx, sum(y.dosage * y.dosage) AS syy, sum(x.dosage * y.dosage) AS sxy FROM o a JOIN o b ON a.chrom = b.chrom AND b.ord - a.ord BETWEEN 1 AND 9 JOIN geno x ON x.snp_idx = a.snp_idx JOIN geno y ON y.snp_idx = b.snp_idx AND y.sample_idx = x.sample_idx GROUP BY 1, 2, 3) SELECT chrom, a, b FROM p WHERE CAST(n * sxy - sx * sy AS DOUBLE) * (n * sxy - sx * sy) > 0.5 * (1 + pow(2.0, -44)) * CAST(n * sxx - sx * sx AS DOUBLE) * (n * syy - sy * sy)")
def q_ld_pairs(spark, d):
    from pyspark.sql import Window

    g, s = fx.genotypes(spark, d), fx.snps(spark, d)
    f = g.groupBy("snp_idx").agg((F.sum("dosage") / (2 * F.count("*"))).alias("q")).filter("q > 0 AND q < 1")
    order = s.join(f, "snp_idx").withColumn("ord", F.row_number().over(Window.partitionBy("chrom").orderBy("pos_bp")) - 1)
    return fr.ld_pairs(g, order, 10, 0.5).select("chrom", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("ld_prune")
def q_ld(spark, d):
    return fr.ld_prune(fx.genotypes(spark, d), fx.snps(spark, d), 50, 5, 0.5)
