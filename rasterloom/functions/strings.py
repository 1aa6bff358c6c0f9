"""Parsing and formatting of list literals, labels and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import grid as G


def parse_list(text: Column) -> Column:
    """A bracketed list of numbers as ARRAY<DOUBLE>; NULL if it can't be read. One trailing comma is allowed."""
    return F.from_json(F.regexp_replace(text, r",\s*\]\s*$", "]"), "array<double>")


def wavelength_of(label: Column, band: Column) -> Column:
    """The first number in a band's label, else the grid's wavelength for the 1-based band."""
    found = F.regexp_extract(label, r"(\d+(?:\.\d+)?)", 1)
    return F.coalesce(F.when(found != "", found.cast("double")), G.GRID_START + G.GRID_STEP * (band - 1))


def band_label(wavelength: Column) -> Column:
    return F.format_string("%.0f nm", wavelength)


def fingerprint(content: Column) -> Column:
    """First 12 hexadecimal digits of the MD5."""
    return F.substring(F.md5(content), 1, 12)


def human_size(size: Column) -> Column:
    """Bytes with a binary unit and two decimals."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    out = F.format_string("%.2f " + units[-1], size / float(1024 ** (len(units) - 1)))
    for k in range(len(units) - 2, -1, -1):
        out = F.when(size < 1024 ** (k + 1), F.format_string("%.2f " + units[k], size / float(1024**k))).otherwise(out)
    return out


def coefficient_columns(columns: list[str]) -> list[str]:
    """Names c0, c1, ... in numeric order."""
    return sorted((c for c in columns if c[:1] == "c" and c[1:].isdecimal()), key=lambda c: int(c[1:]))
