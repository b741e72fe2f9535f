"""Reference bases from an indexed FASTA file (.fai: name, length, offset, bases in a line, bytes in a line)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.genotypes import _read


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """name, length, offset, bases, width: a row for each sequence of the index beside `path`."""
    raw = spark.read.csv(f"{path}.fai", sep="\t", schema="name string, length long, offset long, bases long, width long")
    return raw.filter("name IS NOT NULL")


def reference_bases(sites: DataFrame, path: str, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """`sites` with `ref_base`, the upper-case base at a 1-based place; null for unknown sequences and places outside them.

    Names match with or without a leading "chr".  Each task reads only the stretches of the file that hold its own sites,
    which are sorted by place first.
    """
    index = read_index(sites.sparkSession, path).withColumn("_name", F.regexp_replace("name", "^chr", ""))
    met = sites.withColumn("_name", F.regexp_replace(F.col(chrom).cast("string"), "^chr", "")).join(F.broadcast(index.select("_name", "length", "offset", "bases", "width")), "_name", "left")  # a row for each sequence of one file
    at = F.col(pos) - 1
    place = F.when(at.between(0, F.col("length") - 1), F.col("offset") + F.floor(at / F.col("bases")) * F.col("width") + at % F.col("bases"))
    names = sites.columns
    rows = met.withColumn("_at", place.cast("long")).select(*names, "_at").repartitionByRange("_at").sortWithinPartitions("_at")

    def run(batches):
        begin, held = 0, b""
        for b in batches:
            out = []
            for p in b.column("_at").to_pylist():
                if p is None:
                    out.append(None)
                    continue
                if not begin <= p < begin + len(held):
                    begin, held = p, _read(path, p, 1 << 16)
                out.append(held[p - begin : p - begin + 1].decode("ascii").upper() or None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "ref_base"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sites.schema), "ref_base string"])
    return rows.mapInArrow(run, schema)
