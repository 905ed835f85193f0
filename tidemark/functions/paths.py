"""Path and suffix functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import EXCLUDED_COMPONENTS, HIGH_RISK_SUFFIXES, SHEET_SUFFIX, TEXT_NAMES, TEXT_SUFFIXES


def parts(rel: Column) -> Column:
    return F.split(rel, "/", -1)


def file_name(rel: Column) -> Column:
    return F.element_at(parts(rel), -1)


def suffix(rel: Column) -> Column:
    """From the last dot of the last component, lower-cased; empty if the name has no dot, or only a first or last one."""
    return F.lower(F.regexp_extract(rel, r"(?s)^.*[^/](\.[^./]+)$", 1))


def excluded(rel: Column, own_path: str | None = None, components: tuple[str, ...] = EXCLUDED_COMPONENTS) -> Column:
    """True below an excluded component, for a file of such a name, and for the scanner's own path."""
    out = F.arrays_overlap(parts(rel), F.array(*[F.lit(c) for c in components]))
    return out if own_path is None else out | (rel == own_path)


def is_text(rel: Column) -> Column:
    return suffix(rel).isin(*TEXT_SUFFIXES) | file_name(rel).isin(*TEXT_NAMES)


def suffix_class(rel: Column) -> Column:
    """high-risk, sheet, text or other."""
    s = suffix(rel)
    return F.when(s.isin(*HIGH_RISK_SUFFIXES), "high-risk").when(s == SHEET_SUFFIX, "sheet").when(is_text(rel), "text").otherwise("other")
