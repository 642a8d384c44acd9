"""Column helpers. Each returns a Column; none needs Python workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: ColumnOrName, digits: int) -> Column:
    """Round half away from zero on the decimal value, as SQL NUMERIC does.

    The first rounding removes binary noise such as 101.14999999999999, so a
    mean that is an exact tie in decimal rounds up on every engine.
    """
    return F.round(F.round(as_col(c).cast("double"), 10), digits)


def one_if(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def rate(cond: Column) -> Column:
    """Share of rows where cond holds; an unknown condition counts as no."""
    return F.avg(one_if(cond))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """Rows meeting num per row meeting den, NULL when den never holds."""
    return F.sum(one_if(num)) / F.nullif(F.sum(one_if(den)), F.lit(0.0))


def no_nan(c: ColumnOrName) -> Column:
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c), c)


def truthy_or(c: ColumnOrName, default) -> Column:
    """Default for NULL, NaN and zero alike."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(no_nan(c), F.lit(0.0)), default.cast("double"))


def text_or_null(c: ColumnOrName) -> Column:
    """Empty text counts as missing."""
    c = as_col(c)
    return F.when(c != "", c)


def safe_int(c: ColumnOrName) -> Column:
    return as_col(c).cast("string").try_cast("int")


def safe_long(c: ColumnOrName) -> Column:
    return as_col(c).cast("string").try_cast("bigint")


def safe_float(c: ColumnOrName) -> Column:
    return no_nan(as_col(c).cast("string").try_cast("double"))


def trimmed(c: ColumnOrName) -> Column:
    """Missing becomes empty text, as for car numbers."""
    return F.trim(F.coalesce(as_col(c), F.lit("")))


def duration_ms(c: ColumnOrName) -> Column:
    """'H:M:S.f', 'M:S.f' or 'S.f' in whole milliseconds; NULL if unreadable."""
    part = F.split(as_col(c), ":")
    whole = lambda i: F.get(part, F.lit(i)).try_cast("bigint").cast("double")
    real = lambda i: F.get(part, F.lit(i)).try_cast("double")
    seconds = (
        F.when(F.size(part) == 3, whole(0) * 3600 + whole(1) * 60 + real(2))
        .when(F.size(part) == 2, whole(0) * 60 + real(1))
        .otherwise(real(0))
    )
    # Rounding the product first keeps 82.670 s from becoming 82669 ms.
    return no_nan(F.round(seconds * 1000, 6)).try_cast("bigint")


def map_code(c: ColumnOrName, mapping: dict, default=None) -> Column:
    """Label of a code; an unknown code keeps its own text unless default is given."""
    c = as_col(c)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    fallback = c.cast("string") if default is None else F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), fallback)


def match_text(c: ColumnOrName, pattern: str) -> Column:
    """Case-insensitive substring."""
    return as_col(c).ilike(f"%{pattern}%")


def match_unaccented(c: ColumnOrName, text: str) -> Column:
    """Substring regardless of case and accents."""
    return F.contains(
        F.collate(as_col(c), "UNICODE_CI_AI"), F.collate(F.lit(text), "UNICODE_CI_AI")
    )


def all_of(conditions) -> Column:
    """Conjunction of the conditions that are given; None entries are skipped."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def between_dates(c: ColumnOrName, start: str | None, end: str | None) -> Column:
    """ISO dates compare as text, so the range reaches the scan as a plain filter."""
    c = as_col(c)
    return all_of([
        c >= start if start else None,
        c <= end if end else None,
    ])


def json_root_is_array(c: ColumnOrName) -> Column:
    return F.ltrim(as_col(c)).startswith("[")


def in_zone(zone: ColumnOrName) -> Column:
    return as_col(zone).between(1, 9)


def safe_corr(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Pearson correlation, NULL where either side does not vary."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
