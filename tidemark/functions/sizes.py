"""Shoe and clothing sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of "fits all".
ONE_SIZE = ("FREE", "F", "ONE SIZE", "ONESIZE", "OS")


def normalize_size(c: Column) -> Column:
    """Millimetres as text: 270, 270mm, 27 and 27cm are 270; letters stay, in upper case."""
    s = F.trim(F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "MM|CM", ""))
    n = F.when(s.rlike(r"^[0-9]+([.][0-9]*)?$|^[.][0-9]+$"), s.try_cast("double"))
    return F.when(n <= 35, F.floor(n * 10).cast("string")).when(n.isNotNull(), F.floor(n).cast("string")).otherwise(s)


def to_mm(c: Column) -> Column:
    """Centimetres to millimetres where numeric."""
    n = F.trim(c).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.floor(n * 10).cast("string")).otherwise(F.trim(c))


def label_size(c: Column) -> Column:
    """Drop a three-digit prefix: '095(M)' to 'M'; otherwise unchanged."""
    inner = F.regexp_extract(c, r"^[0-9]{3}\s*\(([^)]+)\)$", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), F.trim(c))


def canonical_size(c: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(up.isin(*ONE_SIZE), F.lit("ONE SIZE")).otherwise(up)


def base_size(c: Column) -> Column:
    """What stands before a parenthesis: '270(US9)' is 270."""
    return F.trim(F.substring_index(canonical_size(c), "(", 1))


def sizes_match(a: Column, b: Column) -> Column:
    """Equal, both 'fits all', or equal before a parenthesis."""
    return (canonical_size(a) == canonical_size(b)) | (base_size(a) == base_size(b))


def size_order(c: Column) -> Column:
    """Whole numbers by value, all else first."""
    return F.coalesce(F.when(c.rlike("^[0-9]+$"), c.try_cast("int")), F.lit(0))
