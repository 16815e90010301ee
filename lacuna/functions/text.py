"""Text forms of windows, headers and variant records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lacuna import __version__
from lacuna.functions import genotype as G


@F.pandas_udf(StringType())
def six_digits(x: pd.Series) -> pd.Series:
    """A double with six significant digits, as a C++ stream prints it by default.

    Runs on final calls only; the JVM formatter rounds ties and writes exponents differently.
    """
    return x.map(lambda v: f"{v:.6g}")


def window_pairs(entries: Column) -> Column:
    """``off:dev,off:dev`` of a sorted array of ``(off, dev)``; a dot when there is none."""
    cells = F.transform(
        entries, lambda e: F.concat(e["off"].cast("string"), F.lit(":"), e["dev"].cast("string"))
    )
    return F.when(F.size(entries) > 0, F.array_join(cells, ",")).otherwise(F.lit("."))


def sample_format(
    pl: list[Column], lad: list[Column], dad: list[Column], first: Column, last: Column
) -> Column:
    """``GT:PL:GQ:LAD:DAD:FL:FLD`` of one sample."""
    numbers = lambda cols: F.concat_ws(",", *[c.cast("string") for c in cols])
    return F.concat_ws(
        ":",
        G.genotype_string(*pl),
        G.phred_string(*pl),
        G.genotype_quality(*pl).cast("string"),
        numbers(lad),
        numbers(dad),
        numbers([first, last]),
        (last - first).cast("string"),
    )


FORMAT_KEYS = "GT:PL:GQ:LAD:DAD:FL:FLD"


def info_field(
    pos: Column, length: Column, af: Column, lr: Column, yield_share: Column, sig_windows: Column
) -> Column:
    text = lambda c: c.cast("string")
    return F.concat(
        F.lit("IMPRECISE;SVLEN=-"), text(length),
        F.lit(";END="), text(pos + length),
        F.lit(";SVTYPE=DEL;AF="), six_digits(af),
        F.lit(";LR="), six_digits(lr),
        F.lit(f";SVMETHOD=lacuna-{__version__};YIELD="), six_digits(yield_share),
        F.lit(";SWIN="), text(sig_windows),
    )


def vcf_position(pos: Column) -> Column:
    """1-based position; the first two positions share the shift the format adds."""
    return F.when(pos > 1, pos).otherwise(pos + 1)


# Declarations of the variant format.
VCF_INFO = (
    ("AF", "A", "Float", "Allele frequency"),
    ("IMPRECISE", "0", "Flag", "Imprecise structural variation"),
    ("SVLEN", ".", "Integer", "Difference in length between REF and ALT alleles"),
    ("SVTYPE", "1", "String", "Type of structural variant"),
    ("END", "1", "Integer", "End position of the structural variant"),
    ("SVMETHOD", "1", "String", "Approach used to detect the structural variant"),
    ("LR", "1", "String", "Log-likelihood ratio of deletion against reference"),
    ("YIELD", "1", "Float", "Fraction of genotyped samples"),
    ("SWIN", "1", "Integer", "Number of significant windows merged into this variant"),
)
VCF_FILTER = (
    ("LowLR", "Likelihood ratio below threshold"),
    ("missingSamples", "Too many samples without data"),
    ("allRefGT", "All samples genotyped as homozygous reference"),
    ("CSWin", "Low fraction of significant windows"),
)
VCF_FORMAT = (
    ("GT", "1", "String", "Genotype"),
    ("PL", "G", "Integer", "Phred-scaled genotype likelihoods"),
    ("GQ", "1", "Integer", "Genotype quality: distance of the best and second-best PL"),
    ("LAD", "3", "Integer", "Pairs by likelihood: REF, ambiguous, ALT"),
    ("DAD", "5", "Integer", "Pairs by distribution: REF only, both, between, ALT only, beyond"),
    ("FL", "2", "Integer", "First and last position of the active pairs"),
    ("FLD", "1", "Integer", "Distance between first and last position"),
)


def vcf_header(contigs: list[tuple[str, int]], samples: list[str], date: str) -> list[str]:
    """Header lines of the variant file. ``contigs`` come in header order."""
    lines = ["##fileformat=VCFv4.3", f"##fileDate={date}", f"##source=lacuna-{__version__}"]
    lines += [f"##contig=<ID={name},length={length}>" for name, length in contigs]
    lines += [f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in VCF_INFO]
    lines += [f'##FILTER=<ID={i},Description="{d}">' for i, d in VCF_FILTER]
    lines += [f'##FORMAT=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in VCF_FORMAT]
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]
    return [*lines, "\t".join(columns)]
