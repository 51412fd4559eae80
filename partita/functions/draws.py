"""Uniform numbers that any engine with MD5 draws alike: the same key, name and seed give the same number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 48 bits of the MD5 of the parts as text, joined by colons. Null parts count as empty words."""
    words = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *words)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def uniform_sql(*parts: str) -> str:
    """The same in DuckDB's SQL."""
    words = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"((CAST(concat('0x', substr(md5(concat_ws(':', {words})), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0)"


def normal(*parts: Column) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.ln(uniform(*parts))) * F.cos(2 * math.pi * uniform(*parts, F.lit("'")))


def normal_sql(*parts: str) -> str:
    """The same in DuckDB's SQL."""
    return f"""(sqrt(-2 * ln({uniform_sql(*parts)})) * cos({2 * math.pi!r} * {uniform_sql(*parts, "chr(39)")}))"""
