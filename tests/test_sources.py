import struct
import zlib

import numpy as np
import pytest

from kinfold.sources import f2_cache, genotypes, ingest


def rows(df):
    return {(r.snp_idx, r.sample_idx): r.dosage for r in df.collect()}


@pytest.fixture()
def g():
    return np.random.default_rng(4).integers(0, 4, (13, 7))


def want(g):
    return {(i, j): int(v) for i, r in enumerate(g) for j, v in enumerate(r) if v != 3}


def packed(g, high):
    x = np.zeros((len(g), -(-g.shape[1] // 4) * 4), np.uint8)
    x[:, : g.shape[1]] = g
    x = x.reshape(len(g), -1, 4)
    return (x << (np.array([6, 4, 2, 0]) if high else np.array([0, 2, 4, 6]))).sum(axis=2).astype(np.uint8)


def test_bed(spark, tmp_path, g):
    back = np.array([3, 2, 0, 1])
    (tmp_path / "p.bed").write_bytes(b"\x6c\x1b\x01" + packed(back[g], False).tobytes())
    (tmp_path / "p.bim").write_text("".join(f"{'X' if i == 3 else 1}\trs{i}\t0.{i}\t{i * 10}\tA\tC\n" for i in range(13)))
    (tmp_path / "p.fam").write_text("".join(f"pop{j % 2} s{j} 0 0 {j % 3} -9\n" for j in range(7)))
    calls, snps, samples = genotypes.read_panel(spark, str(tmp_path / "p"))
    assert rows(calls) == want(g)
    assert [(r.snp_idx, r.snp_id) for r in snps.orderBy("snp_idx").collect()] == [(i, f"rs{i}") for i in range(13)]
    assert snps.filter("chrom = 23").count() == 1 and samples.filter("pop = 'pop0'").count() == 4


@pytest.mark.parametrize("kind", ["GENO", "TGENO"])
def test_packed(spark, tmp_path, g, kind):
    head = f"{kind} 7 13 0 0".encode().ljust(48, b"\0")
    body = packed(g if kind == "GENO" else g.T, True)
    if kind == "GENO":
        body = np.pad(body, ((0, 0), (0, 48 - body.shape[1])))
    (tmp_path / "x.geno").write_bytes(head + body.tobytes())
    assert rows(genotypes.read_packed(spark, str(tmp_path / "x.geno"))) == want(g)


def test_text_panel_and_triples(spark, tmp_path, g):
    (tmp_path / "t.geno").write_text("".join("".join("9" if v == 3 else str(v) for v in r) + "\n" for r in g))
    assert rows(genotypes.read_text_panel(spark, str(tmp_path / "t.geno"))) == want(g)
    (tmp_path / "t.snp").write_text("".join(f"rs{i} 1 0.0 {i} A C\n" for i in range(13)))
    (tmp_path / "t.ind").write_text("".join(f"s{j} M P\n" for j in range(7)))
    (tmp_path / "u.geno").write_text("".join(f"rs{i} s{j} {-1 if v == 3 else v}\n" for i, r in enumerate(g) for j, v in enumerate(r)))
    snps, samples = genotypes.read_snps(spark, str(tmp_path / "t.snp")), genotypes.read_samples(spark, str(tmp_path / "t.ind"))
    assert rows(genotypes.read_triples(spark, str(tmp_path / "u.geno"), snps, samples)) == want(g)


def test_lines_across_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(genotypes, "RANGE", 1 << 20)
    lines = [f"{i}:" + "x" * (i % 97) for i in range(60_000)]
    (tmp_path / "l").write_text("\n".join(lines))
    got = {r.line: r.value for r in genotypes._numbered(spark, str(tmp_path / "l")).collect()}
    assert got == dict(enumerate(lines))


def test_beagle(spark, tmp_path):
    (tmp_path / "b").write_text("marker allele1 allele2 I0 I0 I0 I1 I1 I1\nm1 0 1 0.7 0.2 0.1 0 0 0\n")
    assert genotypes.read_beagle(spark, str(tmp_path / "b")).first().l == pytest.approx([0.1, 0.2, 0.7, 1 / 3, 1 / 3, 1 / 3])


def test_bgen(spark, tmp_path):
    probs = bytes([255, 0, 0, 255, 0, 0])  # two copies of the first allele, one each, none
    body = struct.pack("<IHBB", 3, 2, 2, 2) + bytes([2, 2, 2]) + bytes([0, 8]) + probs
    data = struct.pack("<I", len(body)) + zlib.compress(body)
    s = lambda x, f="<H": struct.pack(f, len(x)) + x
    variant = s(b"id") + s(b"rs1") + s(b"2") + struct.pack("<IH", 77, 2) + s(b"A", "<I") + s(b"G", "<I") + struct.pack("<I", len(data)) + data
    (tmp_path / "x.bgen").write_bytes(struct.pack("<IIII", 20, 20, 1, 3) + b"bgen" + struct.pack("<I", 1 | 2 << 2) + variant)
    got = genotypes.read_bgen(spark, str(tmp_path / "x.bgen")).orderBy("sample_idx").collect()
    assert [r.ds for r in got] == pytest.approx([0, 1, 2]) and got[0].pos_bp == 77


VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=248956422>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS
chr1\t10\t.\tA\t<NON_REF>\t.\tPASS\tEND=19;MinDP=30\tGT:DP:GQ\t0/0:31:60
chr1\t20\trs5\tA\tG\t.\tPASS\t.\tGT:DP:GQ:PL\t0/1:30:50:60,0,60
chr1\t30\trs6\tC\tT\t.\tPASS\t.\tGT:DP:GQ:PL\t1/1:3:50:60,6,0
chr1\t40\trs9\tC\tT\t.\tPASS\t.\tGT:DP:GQ:PL\t1|1:30:50:.
"""


def test_hardcalls(spark, tmp_path):
    (tmp_path / "v.vcf").write_text(VCF)
    assert ingest.detect_build(spark, str(tmp_path / "v.vcf")) == "GRCh38"
    vcf = ingest.read_vcf(spark, str(tmp_path / "v.vcf"))
    targets = spark.createDataFrame([("rs1", "1", 12, "A", "C", "A"), ("rs5", "1", 20, "G", "A", "A"), ("rs6", "1", 30, "C", "T", "C"), ("rs7", "1", 40, "C", "T", "C"), ("rs8", "1", 99, "C", "T", "C"), ("rs2", "1", 13, "A", "T", "A")], "snp_id string, chrom string, pos long, a1 string, a2 string, ref_base string")
    got = {r.snp_id: (r.state, r.dosage) for r in ingest.hardcalls(vcf, targets).collect()}
    assert got == {"rs1": ("called", 2), "rs5": ("called", 1), "rs6": ("missing:below_floor", None), "rs7": ("dropped:rsid_mismap", None), "rs8": ("missing:no_coverage", None), "rs2": ("dropped:palindrome", None)}
    like = {r.pos: (r.l, r.present) for r in ingest.likelihoods(vcf.filter("pl IS NOT NULL OR pos = 40")).collect()}
    assert like[20][0][1] > 0.99 and not like[40][1] and sum(like[30][0]) == pytest.approx(1)
    assert [(r.hap_no, r.hap) for r in ingest.phased_haplotypes(vcf).orderBy("hap_no").collect()] == [(0, 1), (1, 1)]


def test_consumer(spark, tmp_path):
    (tmp_path / "r").write_text('# c\nrsid\tchromosome\tposition\tgenotype\nrs1\t1\t5\tAG\nrs2\t1\t6\t--\n')
    raw = ingest.read_consumer(spark, str(tmp_path / "r"))
    t = spark.createDataFrame([("rs1", "1", 5, "A", "G"), ("rs2", "1", 6, "A", "G"), ("zz", "1", 5, "T", "C"), ("rs4", "2", 6, "A", "G")], "snp_id string, chrom string, pos long, a1 string, a2 string")
    got = {r.snp_id: (r.state, r.dosage) for r in ingest.consumer_calls(raw, t).collect()}
    assert got == {"rs1": ("called", 1), "rs2": ("missing:no_call", None), "zz": ("called", 1), "rs4": ("missing:no_coverage", None)}


def test_cache_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(b, p, q, 0.1 * b + (p != q), 5, 7) for b in range(3) for p, q in (("a", "a"), ("a", "b"), ("b", "b"))], "block_id int, p1 string, p2 string, f2 double, vpair long, block_size long")
    path = str(tmp_path / "c")
    f2_cache.write_cache(t, path, source="test")
    assert f2_cache.verify_cache(spark, path) and f2_cache.list_caches(str(tmp_path)) == ["c"]
    f2_cache.write_binary(t, str(tmp_path / "bin"))
    back = f2_cache.read_binary(spark, str(tmp_path / "bin"))
    off = lambda d: sorted((r.block_id, r.p1, r.p2, r.f2, r.block_size) for r in d.filter("p1 <> p2").collect())
    assert off(back) == off(t)


def test_merge_and_sinks(spark, tmp_path, g):
    calls = spark.createDataFrame([(i, j, d) for (i, j), d in want(g).items()], "snp_idx long, sample_idx long, dosage int")
    samples = spark.createDataFrame([(j, f"s{j}", "U", "P") for j in range(7)], "sample_idx long, sample_id string, sex string, pop string")
    snps = spark.createDataFrame([(i, f"rs{i}", 1, 0.0, float(i), "A", "C") for i in range(13)], "snp_idx long, snp_id string, chrom int, genpos_m double, pos_bp double, ref string, alt string")
    more, who = genotypes.merge_individual(calls, samples, spark.createDataFrame([(0, 2)], "snp_idx long, dosage int"), "new", "Q")
    assert rows(more)[0, 7] == 2 and who.count() == 8
    genotypes.write_text_panel(calls, snps, samples, str(tmp_path / "o"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "o.geno")).collect()]
    assert sorted(lines) == sorted("".join("9" if v == 3 else str(v) for v in r) for r in g)
    genotypes.write_result(calls, str(tmp_path / "r"), "tsv")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "r")).count() == calls.count()


def test_stream_counts_match_batch(spark, tmp_path, g):
    from kinfold.operators.frequencies import pop_counts
    from kinfold.streaming.accumulate import stream_counts

    calls = spark.createDataFrame([(i, j, f"P{j % 2}", d) for (i, j), d in want(g).items()], "snp_idx long, sample_idx long, pop string, dosage int")
    calls.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_counts(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("running").collect()) == sorted(pop_counts(calls).collect())
