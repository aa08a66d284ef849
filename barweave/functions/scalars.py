"""Column helpers: guarded arithmetic, parsing, epoch units and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_MINUTE = 60_000
MS_PER_DAY = 86_400_000


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def safe_ratio(n, d) -> Column:
    """n / d, and 0 where d is 0."""
    n, d = as_col(n), as_col(d)
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def clip(x, lo: float, hi: float) -> Column:
    """x held inside [lo, hi]; null stays null (`greatest` and `least` alone would skip it)."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def log1p_pos(x) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), as_col(x)))


def num(c, default: float = 0.0) -> Column:
    """Parse text to a finite double; anything else becomes the default."""
    v = as_col(c).cast("string").try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(default))).otherwise(v)


def truthy(c) -> Column:
    """A flag is set when its number is not zero; 'true' text counts as 1."""
    c = as_col(c)
    text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(text == "true", F.lit(False)) | (F.abs(num(c)) > 1e-12)


def floor_div(c, n: int) -> Column:
    """Exact integer floor division for long columns."""
    c = as_col(c).cast("long")
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("long")


def to_ms(c) -> Column:
    """Epoch number of unknown unit to milliseconds; the unit is read from its magnitude."""
    c = as_col(c).cast("long")
    size = F.abs(c)
    return (
        F.when(size >= 100_000_000_000_000, floor_div(c, 1000))
        .when(size >= 100_000_000_000, c)
        .otherwise(c * 1000)
    )


def minute(c) -> Column:
    """Minute number since the epoch of an epoch value of unknown unit."""
    return floor_div(to_ms(c), MS_PER_MINUTE)


def day_of(ms) -> Column:
    """'YYYY-MM-DD' in UTC; a date cast is much cheaper per row than a pattern."""
    return F.timestamp_millis(as_col(ms)).cast("date").cast("string")


def month_of(ms) -> Column:
    return F.substring(day_of(ms), 1, 7)


def candidate_id(*cols) -> Column:
    """sha1 over the parts joined by a pipe; null parts count as empty text."""
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("")) for c in cols]
    return F.sha1(F.concat_ws("|", *parts))


def fold_index(c, default: int = 0) -> Column:
    """Fold number out of '7', 'fold_7', 'walkforward_fold_3' or any text that ends in digits."""
    text = F.trim(as_col(c).cast("string"))
    direct = text.try_cast("double").cast("int")
    tail = F.regexp_extract(text, r"(\d+)$", 1)
    return F.coalesce(direct, F.nullif(tail, F.lit("")).try_cast("int"), F.lit(default))


def rnd(c, digits: int = 6) -> Column:
    """Round with the half point moved off round decimals, so that the last bit of a sum cannot flip it."""
    scale = float(10**digits)
    return F.floor(as_col(c) * scale + 0.5000017) / F.lit(scale)
