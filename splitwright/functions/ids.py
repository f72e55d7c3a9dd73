"""Identifiers, composite ids and content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout of a composite profile id, ``plate_cell_timeH:compound:dose``.
PROFILE_ID_PATTERN = r"^([A-Z0-9]+)_([A-Z0-9]+)_([0-9]+)H:([A-Z0-9\-]+):(\S+)$"
# Stricter layout by which a profile id column is recognised.
PROFILE_ID_SNIFF_PATTERN = r"^[A-Z0-9]+_[A-Z0-9]+_\d+H:BRD-[A-Z][0-9]+:\S+$"


def format_id(number: Column, prefix: str = "ID") -> Column:
    """``7`` -> ``ID_0007``."""
    return F.format_string(f"{prefix}_%04d", number.cast("long"))


def parse_id(text: Column, prefix: str = "ID") -> Column:
    """Inverse of :func:`format_id`; any other layout is an error."""
    digits = F.regexp_extract(text, rf"^{prefix}_(-?[0-9]+)$", 1)
    wrong = F.concat(F.lit(f"expected {prefix}_NNNN, got "), text)
    return F.when(text.isNull(), F.lit(None).cast("long")).otherwise(
        F.when(digits != "", digits.cast("long")).otherwise(F.raise_error(wrong).cast("long"))
    )


def is_profile_id(text: Column) -> Column:
    return F.coalesce(text.rlike(PROFILE_ID_PATTERN), F.lit(False))


def parse_profile_id(text: Column) -> Column:
    """Struct ``plate, cell_id, time_h, brd_id, dose_str, id_ok``; parts are null for another layout.

    One pattern check and one split: the first four parts cannot hold a separator.
    """

    def parts(p: Column) -> Column:
        return F.struct(
            p[0].alias("plate"),
            p[1].alias("cell_id"),
            F.regexp_replace(p[2], "H$", "").cast("int").alias("time_h"),
            p[3].alias("brd_id"),
            p[4].alias("dose_str"),
            F.isnotnull(p).alias("id_ok"),
        )

    # the one-element array binds the split result once
    return F.transform(F.array(F.when(is_profile_id(text), F.split(text, "[_:]", 5))), parts)[0]


def content_key(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over ``a|b|c``; null when a part is null."""
    joined = parts[0].cast("string")
    for part in parts[1:]:
        joined = F.concat(joined, F.lit("|"), part.cast("string"))
    return F.substring(F.sha2(joined, 256), 1, 16)


def own_group_key(group_key: Column, row_id: Column) -> Column:
    """Group key of a row; a row without one is a group of its own."""
    return F.when(
        group_key.isNull() | (group_key == ""), F.concat(F.lit("_acyclic_"), row_id.cast("string"))
    ).otherwise(group_key)
