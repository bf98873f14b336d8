"""Column helpers for sizes and maintenance measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.times import col


def reclaimable(size: Column | str, used_percent: Column | str) -> Column:
    return (100 - col(used_percent)) * col(size) / 100


def used_percent(used: Column | str, size: Column | str) -> Column:
    """Percent of size that is used; 0 where size is 0."""
    return F.when(col(size) != 0, col(used) * 100.0 / col(size)).otherwise(F.lit(0.0))


def growth_percent(old: Column | str, new: Column | str) -> Column:
    """Growth in percent, two decimals; null where old is 0."""
    return F.round(F.try_divide((col(new) - col(old)) * 100.0, col(old)), 2)


def density_deviation(record_bytes: Column | str, fill_factor: Column | str, density: Column | str) -> Column:
    """How far a page's density is from what full pages of such records would have; a page holds 8060 bytes."""
    r = col(record_bytes)
    return F.abs(F.floor(8060.0 / r) * r / 8060.0 * col(fill_factor) - col(density))


def stale(age_days: Column, rows: Column, changes: Column, most_age: int, percent: float) -> Column:
    """Statistics that are aged and changed, changed by percent, or changed beyond sqrt(1000 * rows)."""
    changed = F.abs(changes)
    return ((age_days >= most_age) & (changed != 0)) | (F.try_divide(changed * 100.0, rows) >= percent) | (F.sqrt(1000.0 * rows) <= changed)
