"""Registered queries of model fits, scans, maps and agreement.  Iterative fits have no SQL; tests hold them against independent computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import blocks as bl
from kinfold.operators import dating as da
from kinfold.operators import frequencies as fr
from kinfold.operators import fstats as fs
from kinfold.operators import graphs as gr
from kinfold.operators import haplotypes as ha
from kinfold.operators import models as mo
from kinfold.operators import relatedness as re_
from kinfold.operators import structure as st
from kinfold.plans import fixture as fx
from kinfold.plans.queries import COUNTS_SQL, F2_SQL, KING_SQL, R, _round, query
from kinfold.sources import ingest as ing
from kinfold.streaming.accumulate import stream_counts

WIDE = 1_100_000
TARGET, LEFT, RIGHT = "NATION_2", ["NATION_7", "NATION_3"], ["NATION_0", "NATION_1", "NATION_6", "NATION_4", "NATION_9"]
POOL = ["NATION_7", "NATION_3", "NATION_12", "NATION_17", "NATION_8"]


def nations(spark: SparkSession, d: str) -> DataFrame:
    own = fx.samples(spark, d).select("sample_idx", F.col("nation").alias("pop"))
    return fx.genotypes(spark, d).drop("pop").join(F.broadcast(own), "sample_idx")


def nation_tensor(spark: SparkSession, d: str) -> DataFrame:
    return fs.f2_blocks(fr.allele_frequency(nations(spark, d)), bl.assign_blocks(fx.snps(spark, d), WIDE, "pos_bp")).persist()


@query("qpwave")
def q_wave(spark, d):
    return mo.qpwave(nation_tensor(spark, d), [TARGET, *LEFT], RIGHT)


@query("qpadm")
def q_adm(spark, d):
    models = spark.createDataFrame([(0, TARGET, LEFT, RIGHT)], "model_id long, target string, left array<string>, right array<string>")
    return mo.qpadm(models, nation_tensor(spark, d))


@query("qpadm_rotate")
def q_rotate(spark, d):
    return mo.qpadm(mo.rotation(spark, TARGET, POOL, RIGHT, 1, 3), nation_tensor(spark, d), full=False)


@query("scan")
def q_scan(spark, d):
    return mo.scan(nation_tensor(spark, d), TARGET, POOL, RIGHT, most=3)


@query("scan_beam")
def q_beam(spark, d):
    return mo.scan(nation_tensor(spark, d), TARGET, POOL, RIGHT, strategy="beam", width=2, most=3)


PRERANK_SQL = F2_SQL + ", m AS (SELECT p1, p2, sum(f2 * block_size) / sum(block_size) AS f2 FROM f2b WHERE p1 <> p2 GROUP BY p1, p2), b AS (SELECT * FROM m UNION ALL SELECT p2, p1, f2 FROM m)"


@query("prerank", f"WITH {PRERANK_SQL} SELECT s.p2 AS source, {R('avg((t.f2 + s.f2 - x.f2) / 2)')} AS score FROM b t JOIN b s ON s.p1 = t.p1 JOIN b x ON x.p1 = t.p2 AND x.p2 = s.p2 WHERE t.p2 = 'ASIA' AND t.p1 IN ('AMERICA', 'MIDDLE EAST') AND s.p2 IN ('AFRICA', 'EUROPE') GROUP BY s.p2")
def q_prerank(spark, d):
    from kinfold.plans.queries import tensor

    return _round(mo.prerank(tensor(spark, d), "ASIA", ["AFRICA", "EUROPE"], ["AMERICA", "MIDDLE EAST"]), "score")


GRAPH = [("R", "NATION_0"), ("R", "a"), ("a", "y"), ("y", "NATION_3"), ("a", "b"), ("b", "NATION_7"), ("b", "x"), ("x", "NATION_12"), ("y", "m"), ("x", "m"), ("m", "NATION_2")]


@query("qpgraph")
def q_graph(spark, d):
    graphs = spark.createDataFrame([(0, [{"from": a, "to": b} for a, b in GRAPH])], "graph_id long, edges array<struct<from:string,to:string>>")
    return gr.qpgraph(graphs, nation_tensor(spark, d))


@query("qpgraph_search")
def q_search(spark, d):
    return gr.search(spark, nation_tensor(spark, d), ["NATION_0", "NATION_3", "NATION_7", "NATION_2", "NATION_12"], mixtures=1)


@query("qpfstats")
def q_fstats(spark, d):
    g = fx.genotypes(spark, d)
    return da.smoothed_f2(fr.allele_frequency(g), bl.assign_blocks(fx.snps(spark, d), WIDE, "pos_bp"), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


@query("dates")
def q_dates(spark, d):
    g, s = fx.genotypes(spark, d), fx.snps(spark, d)
    m = da.date_moments(g, s, "ASIA", "AFRICA", "EUROPE", step=0.001, most=1.0).persist()
    return da.date(m, s.groupBy("chrom").agg(F.count("*").alias("n")), high=1.0)


@query("pca")
def q_pca(spark, d):
    return st.pca(fx.genotypes(spark, d), fx.samples(spark, d), 4)


@query("pca_project")
def q_project(spark, d):
    basis = [r[0] for r in fx.samples(spark, d).filter("pop <> 'ASIA'").select("sample_idx").collect()]
    return st.pca(fx.genotypes(spark, d), fx.samples(spark, d), 4, basis=basis)


@query("admixture")
def q_admixture(spark, d):
    return st.admixture(fx.genotypes(spark, d), fx.samples(spark, d), 3, rounds=200)[0]


@query("pcangsd")
def q_pcangsd(spark, d):
    n = fx.samples(spark, d).count()
    g = fx.genotypes(spark, d)
    like = F.when(F.col("dosage") == 0, F.array(F.lit(0.9), F.lit(0.09), F.lit(0.01))).when(F.col("dosage") == 1, F.array(F.lit(0.05), F.lit(0.9), F.lit(0.05))).otherwise(F.array(F.lit(0.01), F.lit(0.09), F.lit(0.9)))
    rows = g.groupBy("snp_idx").agg(F.map_from_entries(F.collect_list(F.struct("sample_idx", like))).alias("m"))
    third = F.array(*[F.lit(1 / 3)] * 3)
    gl = rows.select(F.col("snp_idx").alias("site"), F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), third))).alias("l"))
    return st.pcangsd(gl, n, rounds=100)


def _panels(spark, d):
    s = fx.snps(spark, d)
    return ha.panels(fx.genotypes(spark, d), s, fx.samples(spark, d))


@query("paint")
def q_paint(spark, d):
    return ha.paint(spark, _panels(spark, d), fx.samples(spark, d))


@query("local_ancestry")
def q_localanc(spark, d):
    return ha.local_ancestry(spark, _panels(spark, d), fx.samples(spark, d))


@query("roh")
def q_roh(spark, d):
    p = _panels(spark, d)
    genotypes = {c: x.alleles * 2 * (x.alleles >= 0) - (x.alleles < 0) for c, x in p.items()}
    return ha.roh_summary(ha.roh(spark, p, genotypes, fx.samples(spark, d)), fx.samples(spark, d))


@query("ibd")
def q_ibd(spark, d):
    import numpy as np

    like = lambda a: np.repeat(np.where(a < 0, 0.5, np.clip(a, 0.02, 0.98))[:, :, None], 2, axis=2)
    id1, id2 = (fx.samples(spark, d).select(F.col("sample_idx").alias(k)) for k in ("id1", "id2"))
    return ha.ibd_summary(ha.ibd(spark, _panels(spark, d), like, id1.join(id2, F.col("id1") < F.col("id2")), cutoff=0.9, least_cm=0.1))


ISLAND_SQL = COUNTS_SQL + """, f AS (SELECT chrom, pos_bp, count(*) FILTER (n >= 6) >= 3 AS flag FROM counts JOIN snps USING (snp_idx) GROUP BY chrom, pos_bp),
g AS (SELECT *, CASE WHEN flag AND NOT coalesce(lag(flag) OVER (PARTITION BY chrom ORDER BY pos_bp), false) THEN 1 ELSE 0 END AS new FROM f), i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos_bp) AS k FROM g)
SELECT chrom, min(pos_bp) AS "start", max(pos_bp) AS "end", count(*) AS n FROM i WHERE flag GROUP BY chrom, k"""


@query("islands", f"WITH {ISLAND_SQL}")
def q_islands(spark, d):
    c = fr.pop_counts(fx.genotypes(spark, d)).join(fx.snps(spark, d), "snp_idx")
    flags = c.groupBy("chrom", "pos_bp").agg((F.sum((F.col("n") >= 6).cast("int")) >= 3).alias("flag"))
    return ha.islands(flags, ["chrom"], "pos_bp", "flag")


MAP_SQL = """WITH s AS (SELECT CAST(1 + (p_partkey + 1) % 22 AS INTEGER) AS chrom, (p_partkey + 1) * 1000 AS pos FROM part),
g AS (SELECT chrom, pos + 500 AS pos, sqrt(pos) / 100.0 AS cm FROM s WHERE pos % 7000 = 0),
t AS (SELECT s.chrom, s.pos, (SELECT max(pos) FROM g WHERE g.chrom = s.chrom AND g.pos <= s.pos) AS a, (SELECT min(pos) FROM g WHERE g.chrom = s.chrom AND g.pos >= s.pos) AS z FROM s)
SELECT t.chrom, t.pos, round((CASE WHEN t.a IS NULL THEN h.cm WHEN t.z IS NULL OR t.z = t.a THEN l.cm ELSE l.cm + (h.cm - l.cm) * (t.pos - t.a) / (t.z - t.a) END) / 100 + 1.7e-12, 8) + 0.0 AS morgans
FROM t LEFT JOIN g l ON l.chrom = t.chrom AND l.pos = t.a LEFT JOIN g h ON h.chrom = t.chrom AND h.pos = t.z"""


@query("genetic_map", MAP_SQL)
def q_map(spark, d):
    s = fx.snps(spark, d).select("chrom", F.col("pos_bp").alias("pos"))
    g = s.filter("pos % 7000 = 0").select("chrom", (F.col("pos") + 500).alias("pos"), (F.sqrt("pos") / 100).alias("cm"))
    return _round(ing.interpolate_map(s, g), "morgans")


@query("target_sites", "WITH p AS (SELECT p_partkey + 1 AS k FROM part), s AS (SELECT 'rs' || (k - k % 2 * (CASE WHEN k % 10 = 1 THEN 1 ELSE 0 END)) AS snp_id, CAST(1 + k % 22 AS INTEGER) AS chrom, k * 1000 AS pos_bp FROM p), o AS (SELECT *, count(*) OVER (PARTITION BY snp_id) AS n FROM s), l AS (SELECT 'rs' || k AS snp_id, k * 1000 + 77 AS pos38 FROM p WHERE k % 3 <> 0) SELECT o.snp_id, chrom, pos_bp, pos38 FROM o JOIN l USING (snp_id) WHERE n = 1")
def q_targets(spark, d):
    k = F.col("snp_idx")
    s = fx.snps(spark, d).withColumn("snp_id", F.concat(F.lit("rs"), k - F.when(k % 10 == 1, k % 2).otherwise(0)))
    lift = fx.snps(spark, d).filter(k % 3 != 0).select("snp_id", (k * 1000 + 77).alias("pos38"))
    return ing.build_targets(s, lift).select("snp_id", "chrom", "pos_bp", "pos38")


@query("kinship_concordance", f"WITH {KING_SQL}, a AS (SELECT id1, id2, phi, CASE WHEN phi > 0.0442 THEN 'related' ELSE 'unrelated' END AS degree FROM kp WHERE nsnp >= 150), b AS (SELECT id1, id2, phi, CASE WHEN phi > 0.0884 THEN 'related' ELSE 'unrelated' END AS degree FROM kp WHERE nsnp <= 220) SELECT count(*) AS pairs, count(*) FILTER (a.phi IS NOT NULL AND b.phi IS NOT NULL) AS shared, count(*) FILTER (a.degree = b.degree) AS same_degree, count(*) FILTER (abs(a.phi - b.phi) <= 1e-6) AS \"close\" FROM a FULL JOIN b ON a.id1 = b.id1 AND a.id2 = b.id2")
def q_concord(spark, d):
    k = re_.kinship(re_.king_counts(fx.genotypes(spark, d))).persist()
    band = lambda t, cut: t.withColumn("degree", F.when(F.col("phi") > cut, "related").otherwise("unrelated"))
    return ing.pair_concordance(band(k.filter("nsnp >= 150"), 0.0442), band(k.filter("nsnp <= 220"), 0.0884), "phi")


@query("running_counts", f"WITH {COUNTS_SQL} SELECT * FROM counts")
def q_stream(spark, d):
    """The streaming accumulator on a batch table."""
    return stream_counts(fx.genotypes(spark, d))


@query("king_counts", f"WITH {KING_SQL} SELECT id1, id2, nsnp, hethet, ibs0, het1, het2 FROM kc")
def q_king_counts(spark, d):
    return re_.king_counts(fx.genotypes(spark, d))
