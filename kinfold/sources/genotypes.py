"""Genotype files as DataFrames: packed and text panels, likelihoods, dosages, and their variant and sample tables.

Every reader plans byte ranges on the driver (from a header and the file's size) and reads them in tasks with
`pyarrow.fs`, so paths may be local or on any file system that it knows, and no file passes through one task.
Calls come as rows snp_idx, sample_idx, dosage; missing calls are left out.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one task reads.
RANGE = 8 << 20
#: Fixed values of the formats.
BED_MAGIC = b"\x6c\x1b\x01"
GENO_HEADER = 48
#: Copies of the first allele by two-bit code; 3 is missing.
BED_CODES = np.array([2, 3, 1, 0], np.int8)
GENO_CODES = np.array([0, 1, 2, 3], np.int8)
CHROMOSOMES = {"X": 23, "Y": 24, "MT": 90, "M": 90}

CALLS = "snp_idx long, sample_idx long, dosage int"


def _open(path: str):
    fs, where = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(where)


def _size(path: str) -> int:
    with _open(path) as f:
        return f.size()


def _head(path: str, n: int) -> bytes:
    with _open(path) as f:
        return f.read(n)


def _read(path: str, at: int, n: int) -> bytes:
    with _open(path) as f:
        return f.read_at(n, at)


def read_snps(spark: SparkSession, path: str, plink: bool = False) -> DataFrame:
    """snp_idx (from 0, in file order), snp_id, chrom (X 23, Y 24, MT 90, other names negative), genpos_m, pos_bp, ref, alt."""
    c = F.split(F.trim("value"), r"\s+")
    i = (1, 0, 2, 3, 4, 5) if plink else (0, 1, 2, 3, 4, 5)
    name = F.upper(F.regexp_replace(c[i[1]], "^(?i)chr", ""))
    chrom = F.when(name.rlike("^[0-9]+$"), name.try_cast("int"))
    for k, v in CHROMOSOMES.items():
        chrom = chrom.when(name == k, v)
    rows = _numbered(spark, path)
    return rows.filter(F.size(c) >= 4).select(F.col("line").alias("snp_idx"), c[i[0]].alias("snp_id"), chrom.otherwise(-1).cast("int").alias("chrom"), c[i[2]].cast("double").alias("genpos_m"), c[i[3]].cast("double").alias("pos_bp"), F.get(c, F.lit(i[4])).alias("ref"), F.get(c, F.lit(i[5])).alias("alt"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), value: text lines in file order, read by byte ranges; a line belongs to the range in which it starts."""
    if path.endswith((".gz", ".bgz")):
        rdd = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))  # one task reads a gzip file anyway
        return spark.createDataFrame(rdd, "line long, value string")
    size = _size(path)
    n = max(1, -(-size // RANGE))
    ranges = spark.range(0, n, 1, n)

    def lines(k: int) -> list[bytes]:
        at, end = k * RANGE, min((k + 1) * RANGE, size)
        start = max(at - 1, 0)
        data = _read(path, start, end - start)
        if at:
            cut = data.find(b"\n")
            data = b"" if cut < 0 else data[cut + 1 :]
        if not data:
            return []
        while not data.endswith(b"\n") and end < size:  # the last line ends in a later range
            more = _read(path, end, 1 << 16)
            cut = more.find(b"\n")
            data += more if cut < 0 else more[: cut + 1]
            end += len(more) if cut < 0 else size
        return data.splitlines()

    def count(batches):
        for b in batches:
            ids = b.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(lines(k)) for k in ids], pa.int64())], names=["id", "n"])

    counts = {r["id"]: r["n"] for r in ranges.mapInArrow(count, "id long, n long").collect()}  # a row for each range
    first, total = {}, 0
    for k in range(n):
        first[k] = total
        total += counts[k]

    def read(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                own = [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines(k)]
                yield pa.RecordBatch.from_arrays([pa.array(range(first[k], first[k] + len(own)), pa.int64()), pa.array(own, pa.string())], names=["line", "value"])

    return ranges.mapInArrow(read, "line long, value string")


def read_samples(spark: SparkSession, path: str, plink: bool = False) -> DataFrame:
    """sample_idx (file order), sample_id, sex, pop."""
    c = F.split(F.trim("value"), r"\s+")
    rows = _numbered(spark, path).filter(F.length(F.trim("value")) > 0)
    if plink:
        return rows.select(F.col("line").alias("sample_idx"), c[1].alias("sample_id"), F.when(c[4] == "1", "M").when(c[4] == "2", "F").otherwise("U").alias("sex"), c[0].alias("pop"))
    return rows.select(F.col("line").alias("sample_idx"), c[0].alias("sample_id"), c[1].alias("sex"), c[2].alias("pop"))


def _codes(raw: bytes, rows: int, width: int, columns: int, high_first: bool, table: np.ndarray) -> np.ndarray:
    """rows x columns of two-bit codes, four to a byte."""
    x = np.frombuffer(raw, np.uint8).reshape(rows, width)
    shifts = (6, 4, 2, 0) if high_first else (0, 2, 4, 6)
    return table[np.stack([x >> s & 3 for s in shifts], axis=2).reshape(rows, -1)[:, :columns]]


def _records(spark: SparkSession, path: str, header: int, width: int, rows: int, decode, transposed: bool = False) -> DataFrame:
    """Fixed-width records as calls; a record is a variant, or a sample if `transposed`."""
    each = max(1, RANGE // width)
    jobs = -(-rows // each)

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                a, z = k * each, min((k + 1) * each, rows)
                codes = decode(_read(path, header + a * width, (z - a) * width), z - a)
                for at in range(0, len(codes), 1024):
                    own = codes[at : at + 1024]
                    i, j = np.nonzero(own != 3)
                    i_, d = i + a + at, own[i, j].astype(np.int32)
                    snp, sample = (j, i_) if transposed else (i_, j)
                    yield pa.RecordBatch.from_arrays([pa.array(snp.astype(np.int64)), pa.array(sample.astype(np.int64)), pa.array(d)], names=["snp_idx", "sample_idx", "dosage"])

    return spark.range(0, jobs, 1, max(1, min(jobs, 10_000))).mapInArrow(run, CALLS)


def read_bed(spark: SparkSession, path: str, samples: int) -> DataFrame:
    """Variant-major binary panels, low bits first."""
    if _head(path, 3) != BED_MAGIC:
        raise ValueError("not a variant-major bed file")
    width = -(-samples // 4)
    return _records(spark, path, 3, width, (_size(path) - 3) // width, lambda raw, n: _codes(raw, n, width, samples, False, BED_CODES))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Packed panels, high bits first: GENO (variant-major; the header fills a record) and TGENO (sample-major, 48-byte header)."""
    head = _head(path, GENO_HEADER).split(b"\0")[0].split()
    samples, snps = int(head[1]), int(head[2])
    if head[0] == b"GENO":
        width = max(GENO_HEADER, -(-samples // 4))
        return _records(spark, path, width, width, snps, lambda raw, n: _codes(raw, n, width, samples, True, GENO_CODES))
    if head[0] == b"TGENO":
        width = -(-snps // 4)
        return _records(spark, path, GENO_HEADER, width, samples, lambda raw, n: _codes(raw, n, width, snps, True, GENO_CODES), transposed=True)
    raise ValueError("neither GENO nor TGENO")


def read_text_panel(spark: SparkSession, path: str) -> DataFrame:
    """A line of digits for each variant, a digit for each sample; 9 is missing."""
    c = F.posexplode(F.split("value", ""))
    rows = _numbered(spark, path).select(F.col("line").alias("snp_idx"), c.alias("sample_idx", "d"))
    return rows.filter(F.col("d").isin("0", "1", "2")).select("snp_idx", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("d").cast("int").alias("dosage"))


def read_triples(spark: SparkSession, path: str, snps: DataFrame, samples: DataFrame) -> DataFrame:
    """Lines of variant id, sample id and count; -1 is missing."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(c[0].alias("snp_id"), c[1].alias("sample_id"), c[2].cast("int").alias("dosage")).filter("dosage BETWEEN 0 AND 2")
    return rows.join(snps.select("snp_idx", "snp_id"), "snp_id").join(samples.select("sample_idx", "sample_id"), "sample_id").select("snp_idx", "sample_idx", "dosage")


def read_panel(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, variants and samples of `prefix`, whichever format its files have."""

    def there(path: str) -> bool:
        fs, where = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        return fs.get_file_info(where).type == pafs.FileType.File

    if there(f"{prefix}.bed"):
        samples = read_samples(spark, f"{prefix}.fam", True)
        return read_bed(spark, f"{prefix}.bed", samples.count()), read_snps(spark, f"{prefix}.bim", True), samples
    snps, samples = read_snps(spark, f"{prefix}.snp"), read_samples(spark, f"{prefix}.ind")
    head = _head(f"{prefix}.geno", GENO_HEADER)
    if head[:4] == b"GENO" or head[:5] == b"TGENO":
        return read_packed(spark, f"{prefix}.geno"), snps, samples
    if head[:1].isdigit() and b" " not in head.split(b"\n")[0]:
        return read_text_panel(spark, f"{prefix}.geno"), snps, samples
    return read_triples(spark, f"{prefix}.geno", snps, samples), snps, samples


def read_beagle(spark: SparkSession, path: str) -> DataFrame:
    """site, marker, l (array: for each sample the likelihood of 0, 1, 2 copies of the first allele; unseen samples 1/3 each)."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("marker")).select(c[0].alias("marker"), F.transform(F.slice(c, 4, F.size(c) - 3), lambda x: x.cast("double")).alias("raw"))
    n = F.floor(F.size("raw") / 3).cast("int")

    def triplet(i):  # the file lists two, one, no copies
        a, b, c_ = (F.element_at("raw", 3 * i + k) for k in (3, 2, 1))
        s = a + b + c_
        third = F.lit(1 / 3)
        return F.when(s > 0, F.array(a / s, b / s, c_ / s)).otherwise(F.array(third, third, third))

    return rows.select(F.xxhash64("marker").alias("site"), "marker", F.flatten(F.transform(F.sequence(F.lit(0), n - 1), triplet)).alias("l"))


def read_bgen(spark: SparkSession, path: str) -> DataFrame:
    """snp_idx, snp_id, chrom, pos_bp, ref, alt, sample_idx, ds: expected copies of the second allele (version 1.2, two alleles, diploid, plain or zlib).

    The driver walks the variants' length fields only; tasks read and unpack the probabilities.
    """
    with _open(path) as f:
        offset, header, variants, samples = struct.unpack("<IIII", f.read(16))
        f.seek(4 + header - 4)
        flags = struct.unpack("<I", f.read(4))[0]
        if flags >> 2 & 15 != 2 or flags & 3 > 1:
            raise ValueError("version 1.2, plain or zlib, is needed")
        packed, at, index = flags & 3, 4 + offset, []
        for i in range(variants):
            f.seek(at)
            buf = f.read(1 << 12)
            k, own = 0, []
            for _ in range(3):
                n = struct.unpack_from("<H", buf, k)[0]
                own.append(buf[k + 2 : k + 2 + n].decode())
                k += 2 + n
            pos, alleles = struct.unpack_from("<IH", buf, k)
            k += 6
            for _ in range(alleles):
                n = struct.unpack_from("<I", buf, k)[0]
                own.append(buf[k + 4 : k + 4 + n].decode())
                k += 4 + n
            size = struct.unpack_from("<I", buf, k)[0]
            index.append((i, own[1] or own[0], own[2], pos, own[3], own[4] if alleles > 1 else "", at + k + 4, size, alleles))
            at += k + 4 + size
    jobs = spark.createDataFrame(index, "snp_idx long, snp_id string, chrom string, pos_bp long, ref string, alt string, at long, size long, alleles int").filter("alleles = 2").repartition(max(1, min(len(index) // 256, 4096)))

    def run(batches):
        for b in batches:
            cols = b.to_pydict()
            for i in range(b.num_rows):
                raw = _read(path, cols["at"][i], cols["size"][i])
                data = zlib.decompress(raw[4:]) if packed else raw
                n, k, low, high = struct.unpack_from("<IHBB", data)
                if low != 2 or high != 2:
                    raise ValueError("diploid samples are needed")
                ploidy = np.frombuffer(data, np.uint8, n, 8)
                phased, bits = data[8 + n], data[9 + n]
                v = np.unpackbits(np.frombuffer(data, np.uint8, offset=10 + n), bitorder="little")[: 2 * n * bits].reshape(2 * n, bits) @ (1 << np.arange(bits, dtype=np.uint64))
                v = v.reshape(n, 2) / ((1 << bits) - 1)
                ds = 2 - v.sum(axis=1) if phased else 2 - 2 * v[:, 0] - v[:, 1]
                ok = ploidy < 128
                yield pa.RecordBatch.from_arrays([pa.array([cols[c][i]] * int(ok.sum())) for c in ("snp_idx", "snp_id", "chrom", "pos_bp", "ref", "alt")] + [pa.array(np.flatnonzero(ok)), pa.array(ds[ok])], names=["snp_idx", "snp_id", "chrom", "pos_bp", "ref", "alt", "sample_idx", "ds"])

    return jobs.drop("alleles").mapInArrow(run, "snp_idx long, snp_id string, chrom string, pos_bp long, ref string, alt string, sample_idx long, ds double")


# ---- sinks --------------------------------------------------------------------------------------------------------------
def write_text_panel(calls: DataFrame, snps: DataFrame, samples: DataFrame, prefix: str) -> None:
    """prefix.geno, .snp and .ind as folders of text parts in variant order."""
    n = samples.count()
    rows = snps.select("snp_idx").join(calls.groupBy("snp_idx").agg(F.map_from_entries(F.collect_list(F.struct("sample_idx", "dosage"))).alias("m")), "snp_idx", "left")
    digits = F.concat_ws("", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i).cast("string"), F.lit("9"))))
    rows.repartitionByRange("snp_idx").sortWithinPartitions("snp_idx").select(digits).write.text(f"{prefix}.geno")
    snps.repartitionByRange("snp_idx").sortWithinPartitions("snp_idx").select(F.concat_ws("\t", "snp_id", "chrom", "genpos_m", "pos_bp", "ref", "alt")).write.text(f"{prefix}.snp")
    samples.repartitionByRange("sample_idx").sortWithinPartitions("sample_idx").select(F.concat_ws("\t", "sample_id", "sex", "pop")).write.text(f"{prefix}.ind")


def merge_individual(calls: DataFrame, samples: DataFrame, own: DataFrame, sample_id: str, pop: str, sex: str = "U") -> tuple[DataFrame, DataFrame]:
    """A panel with one more sample at the end; own: snp_idx, dosage."""
    n = samples.count()
    row = samples.sparkSession.createDataFrame([(n, sample_id, sex, pop)], "sample_idx long, sample_id string, sex string, pop string")
    return calls.unionByName(own.select("snp_idx", F.lit(n).cast("long").alias("sample_idx"), F.col("dosage").cast("int").alias("dosage"))), samples.select(*row.columns).unionByName(row)


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A result table as csv, tsv, json or Parquet."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes)) if kind in ("csv", "tsv") else df
    writer = flat.write.option("header", True)
    {"csv": writer.csv, "tsv": writer.option("sep", "\t").csv, "json": flat.write.json, "parquet": df.write.parquet}[kind](path)
