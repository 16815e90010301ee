"""Variant files."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession

from lacuna.functions.text import vcf_header
from lacuna.session import run_folder


def write_vcf(
    lines: DataFrame, contigs: DataFrame, samples: DataFrame, path: str, mode: str = "overwrite", parts: bool = False
) -> None:
    """Writes one VCF file at ``path``, or with ``parts`` the folders ``path/header`` and ``path/records``.

    Records are range sorted and written in parallel. For one file the parts are then appended in name order
    through the file system, as streams, and removed. Contigs and sample columns are what the header itself
    has to list.
    """
    spark = lines.sparkSession
    names = [r["sample"] for r in samples.orderBy("column").toLocalIterator()]
    table = [(r["contig"], r["len"]) for r in contigs.orderBy("contig_id").toLocalIterator()]
    header = vcf_header(table, [str(n) for n in names], datetime.date.today().strftime("%Y%m%d"))
    folder = path if parts else f"{run_folder(spark)}/vcf-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(i, h) for i, h in enumerate(header)], "i int, value string").coalesce(
        1
    ).sortWithinPartitions("i").select("value").write.mode(mode).text(f"{folder}/header")
    (
        lines.join(contigs.select("contig", "contig_id"), "contig")
        .orderBy("contig_id", "pos", "len", "line")
        .select("line")
        .write.mode(mode)
        .text(f"{folder}/records")
    )
    if not parts:
        append_parts(spark, [f"{folder}/header", f"{folder}/records"], path, mode == "overwrite")


def append_parts(spark: SparkSession, folders: list[str], path: str, overwrite: bool) -> None:
    """One file from the part files of ``folders``, in order; the bytes are streamed, never held."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, overwrite)
    try:
        for folder in folders:
            source = hadoop.fs.Path(folder)
            system = source.getFileSystem(conf)
            found = [s.getPath() for s in system.listStatus(source)]
            for part in sorted((f for f in found if f.getName().startswith("part-")), key=lambda f: f.getName()):
                stream = system.open(part)
                hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                stream.close()
            system.delete(source, True)
    finally:
        out.close()
