"""Genomic regions as text and as 0-based half-open intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of a region. Numbers may hold thousands separators.
POSITIONED = r"^([^:]*):([0-9,]+)(?:-([0-9,]+))?$"
POSITIONED_LAST = r"^(.*):([0-9,]+)(?:-([0-9,]+))?$"
VALID_END = r"[A-Za-z0-9]$"


def _number(text: Column) -> Column:
    digits = F.regexp_replace(text, ",", "")
    return F.when(digits != "", digits).cast("bigint")


def parse_region(text: Column) -> Column:
    """``NAME``, ``NAME:START`` or ``NAME:START-END`` (1-based, closed) to ``(contig, beg, end)``.

    NULL for invalid text. A colon belongs to the name when no position follows the last one; open
    ends are NULL.
    """
    pattern = F.when(text.rlike(POSITIONED), F.lit(1)).when(text.rlike(POSITIONED_LAST), F.lit(2))
    simple = [F.regexp_extract(text, POSITIONED, k) for k in (1, 2, 3)]
    last = [F.regexp_extract(text, POSITIONED_LAST, k) for k in (1, 2, 3)]
    pick = lambda k: F.when(pattern == 1, simple[k]).when(pattern == 2, last[k])
    name = F.coalesce(pick(0), text)
    start, stop = _number(pick(1)), _number(pick(2))
    tail = F.substring_index(text, ":", -1)
    bare = pattern.isNull()
    # Without a position, digits right after the last colon are a malformed position.
    malformed = bare & text.contains(":") & (tail.rlike("^[0-9]") | (tail == ""))
    valid = (
        (text != "")
        & name.rlike(VALID_END)
        & ~malformed
        & (bare | ((start >= 1) & (stop.isNull() | (stop >= 1))))
    )
    return F.when(
        valid, F.struct(name.alias("contig"), (start - 1).alias("beg"), stop.alias("end"))
    )


def format_region(contig: Column, beg: Column, end: Column) -> Column:
    """Text of a region; open ends are left out."""
    position = F.when(
        beg.isNotNull(),
        F.concat(
            F.lit(":"), (beg + 1).cast("string"),
            F.when(end.isNotNull(), F.concat(F.lit("-"), end.cast("string"))).otherwise(F.lit("")),
        ),
    ).otherwise(F.lit(""))
    return F.concat(contig, position)


def fill_open(beg: Column, end: Column, contig_length: Column) -> tuple[Column, Column]:
    return F.coalesce(beg, F.lit(0).cast("bigint")), F.coalesce(end, contig_length)


def sample_name(path: Column) -> Column:
    """Last path component without its last extension."""
    base = F.regexp_replace(path, r"^.+[/\\]", "")
    return F.regexp_replace(base, r"\.[^.]*$", "")


def chunk_file_name(out: Column, contig: Column, beg: Column, end: Column) -> Column:
    return F.concat(
        out, F.lit("."), contig, F.lit("."), beg.cast("string"), F.lit("-"), end.cast("string"),
        F.lit(".profile"),
    )
