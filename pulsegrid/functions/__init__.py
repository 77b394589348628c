"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Severity classes by rank, and the category each belongs to.
RANKS = ("XL", "L", "M", "S", "XS")
CATEGORIES = {"XL": "high-load", "L": "high-load", "M": "medium-load", "S": "low-load", "XS": "low-load"}
#: What the logarithm of a value that has none is set to (the value itself, not its logarithm).
NO_LOG = 1e-5


def log_guard(x: Column) -> Column:
    """log10, or NO_LOG where x is not positive."""
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(NO_LOG))


def clip(x: Column, lo: float, hi: float) -> Column:
    """x within lo..hi; a null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def rank_name(rank: Column) -> Column:
    """XL for 0 to S for 3; XS for null, as for groups too small to be classified."""
    return F.coalesce(F.element_at(F.array(*map(F.lit, RANKS)), (rank + 1).cast("int")), F.lit(RANKS[-1]))


def category(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in CATEGORIES.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def polarity(lo: Column, hi: Column) -> Column:
    """Sign of the larger deflection of a snippet from lo to hi."""
    return F.signum(F.abs(hi) - F.abs(lo))


def micros(ts: Column) -> Column:
    """A timestamp as microseconds; one without time zone counts as UTC in a session of that zone."""
    return F.unix_micros(ts.cast("timestamp"))


def sq_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
