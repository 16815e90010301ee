"""Predicates and lengths of single alignment records.

Records have ``flag``, ``mapq``, ``contig``, ``mate_contig``, ``l_seq``, ``as_score`` and
``cigar array<struct<op:string,n:int>>`` with at least one element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.params import ReadQuality

# Fixed value: flags a reverse read must not carry (mate reversed or unmapped, not primary,
# failed, duplicate, supplementary).
REVERSE_FORBIDDEN = 3884

# CIGAR operations that do not advance on the reference. Padding counts as advancing.
NOT_ON_REFERENCE = ("S", "H", "I")


def flags_pass(flag: Column, quality: ReadQuality) -> Column:
    return (flag.bitwiseAND(F.lit(quality.flags_unset)) == 0) & (
        flag.bitwiseAND(F.lit(quality.flags_set)) == quality.flags_set
    )


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(REVERSE_FORBIDDEN)) == 0


def _clip(cigar: Column, index: int, op: str) -> Column:
    end = F.element_at(cigar, index)
    return F.when(end["op"] == op, end["n"]).otherwise(F.lit(0))


def left_clip(cigar: Column) -> Column:
    return _clip(cigar, 1, "S")


def right_clip(cigar: Column) -> Column:
    return _clip(cigar, -1, "S")


def unclipped_length(l_seq: Column, left: Column, right: Column) -> Column:
    return l_seq - left - right


def score_passes(length: Column, as_score: Column, quality: ReadQuality) -> Column:
    return (length >= quality.min_unclipped) & (as_score >= length * quality.min_rel_score)


def passes(quality: ReadQuality) -> Column:
    """The whole quality gate as one predicate; cheap tests first."""
    length = unclipped_length(F.col("l_seq"), left_clip(F.col("cigar")), right_clip(F.col("cigar")))
    test = flags_pass(F.col("flag"), quality) & (F.col("mapq") >= quality.min_mapq)
    if quality.same_contig:
        test = test & (F.col("contig") == F.col("mate_contig"))
    return test & score_passes(length, F.col("as_score"), quality)


def reference_length(cigar: Column) -> Column:
    """Bases of the reference an alignment spans."""
    return F.aggregate(
        cigar,
        F.lit(0),
        lambda a, c: a + F.when(c["op"].isin(*NOT_ON_REFERENCE), F.lit(0)).otherwise(c["n"]),
    )


def insert_begin(pos: Column, cigar: Column) -> Column:
    """Leftmost position of the fragment, the soft-clipped start included."""
    return pos - left_clip(cigar)


def insert_end(pos: Column, cigar: Column) -> Column:
    """End of the fragment, the soft-clipped end included."""
    return pos + reference_length(cigar) + right_clip(cigar)


def read_length(l_seq: Column, cigar: Column) -> Column:
    """Length of the read as sequenced: hard clips are added when the record starts with one."""
    first, last = F.element_at(cigar, 1), F.element_at(cigar, -1)
    # The end counts when it is not a hard clip, whatever its operation.
    clip = first["n"] + F.when(last["op"] != "H", last["n"]).otherwise(F.lit(0))
    return F.when(first["op"] == "H", l_seq + clip).otherwise(l_seq)


def parse_cigar(text: Column) -> Column:
    """``10S90M`` to an array of operations."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)),
        lambda t: F.struct(
            F.regexp_extract(t, "([A-Z=])$", 1).alias("op"),
            F.regexp_extract(t, r"^(\d+)", 1).cast("int").alias("n"),
        ),
    )


def header_read_group(line: Column) -> Column:
    """Identifier of an ``@RG`` header line; empty for other lines."""
    return F.regexp_extract(line, r"^@RG\tID:([^\t]*)", 1)
