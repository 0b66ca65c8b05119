"""Which member names are safe to join to a folder: the same verdict for text, UTF-16 units and Spark columns.

Nothing is normalised. The first failing rule names the reason: missing, empty, nul, unc, absolute, drive, traversal.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEP = "/\\"


def unsafe_reason(name: str | None) -> str | None:
    if name is None:
        return "missing"
    if name == "":
        return "empty"
    if "\0" in name:
        return "nul"
    if name[0] in _SEP:
        return "unc" if name[1:2] and name[1] in _SEP else "absolute"
    if re.match(r"[A-Za-z]:", name):
        return "drive"
    if ".." in re.split(r"[/\\]", name):
        return "traversal"
    return None


def unsafe_reason_units(units: list[int] | None) -> str | None:
    """The verdict on raw UTF-16 units; lone surrogates are ordinary units."""
    return unsafe_reason(None if units is None else "".join(map(chr, units)))


def unsafe_reason_column(name: Column) -> Column:
    """The verdict as a built-in expression; null for a safe name."""
    sep = lambda i: F.substring(name, i, 1).isin("/", "\\")
    return (
        F.when(name.isNull(), "missing")
        .when(name == "", "empty")
        .when(F.locate("\0", name) > 0, "nul")
        .when(sep(1) & sep(2), "unc")
        .when(sep(1), "absolute")
        .when(name.rlike("^[A-Za-z]:"), "drive")
        .when(F.exists(F.split(name, r"[/\\]", -1), lambda c: c == ".."), "traversal")
    )
