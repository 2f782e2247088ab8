"""Column and frame expressions that clean and derive values (all JVM-side)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

ColumnLike = Column | str


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---- dates and periods -------------------------------------------------------------------

def parse_compact_date(col: ColumnLike) -> Column:
    """``yyMMdd`` text (longer text is cut) to a date; years 69-99 are 19xx, 00-68 are 20xx."""
    text = F.substring(_c(col).cast("string"), 1, 6)
    year = F.substring(text, 1, 2).try_cast("int")
    century = F.when(year >= 69, "19").when(year < 69, "20")
    return F.try_to_date(F.concat(century, text), "yyyyMMdd")


def to_period(col: ColumnLike, unit: str = "month") -> Column:
    """First day of the period a date lies in."""
    return F.trunc(_c(col).cast("date"), unit) if unit != "day" else _c(col).cast("date")


def period_diff(later: ColumnLike, earlier: ColumnLike, unit: str = "month") -> Column:
    """Whole periods from ``earlier`` to ``later`` (integer)."""
    a, b = _c(later), _c(earlier)
    if unit == "month":
        return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))
    if unit == "day":
        return F.date_diff(a, b)
    raise ValueError(f"period unit {unit!r}: use 'month' or 'day'")


def decode_birth_number(col: ColumnLike, century: int = 1900) -> tuple[Column, Column]:
    """``YYMMDD`` with women's month + 50 to (gender, birth day)."""
    text = F.lpad(_c(col).cast("string"), 6, "0")
    month = F.substring(text, 3, 2).try_cast("int")
    female = month > 12
    gender = F.when(female, "female").when(~female, "male")
    year = F.substring(text, 1, 2).try_cast("int") + century
    day = F.substring(text, 5, 2).try_cast("int")
    written = F.format_string("%04d%02d%02d", year, F.when(female, month - 50).otherwise(month), day)
    return gender, F.try_to_date(written, "yyyyMMdd")


def age_at(birth: ColumnLike, base: dt.date = dt.date(1999, 12, 31)) -> Column:
    """Full years reached at ``base``."""
    b = _c(birth)
    ahead = (F.month(b) * 100 + F.dayofmonth(b)) > (base.month * 100 + base.day)
    return F.lit(base.year) - F.year(b) - ahead.cast("int")


def days_since_min(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Replace (or add) a date column by its distance in days from the column's minimum."""
    first = df.agg(F.min(col)).scalar()
    return df.withColumn(out or col, F.date_diff(F.col(col), first))


# ---- codes, domains, sentinels -----------------------------------------------------------

def _lookup(col: Column, codes: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.element_at(F.create_map(*pairs), col)


def recode_keep(col: ColumnLike, codes: Mapping[str, str]) -> Column:
    """Translate codes; values without a translation stay."""
    return F.coalesce(_lookup(_c(col), codes), _c(col))


def recode_strict(col: ColumnLike, codes: Mapping[str, str], default: str | None = None) -> Column:
    """Translate codes; values without a translation become null or ``default``."""
    found = _lookup(_c(col), codes)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def domain(values: Sequence[str], extra: Sequence[str] = ()) -> list[str]:
    """A closed value domain: sorted distinct values, added categories behind them."""
    base = sorted(set(values))
    return base + [v for v in extra if v not in base]


def categorize(col: ColumnLike, values: Sequence[str]) -> Column:
    """Keep values of the domain, everything else becomes null."""
    return F.when(_c(col).isin(list(values)), _c(col))


def sentinel_to_null(col: ColumnLike, sentinel: str = "?", cast: str | None = "double") -> Column:
    """Turn a sentinel into null, then cast (unreadable text also becomes null)."""
    cleaned = F.nullif(_c(col), F.lit(sentinel))
    return cleaned.try_cast(cast) if cast else cleaned


def to_numeric_coerce(df: DataFrame, cols: Sequence[str], drop: bool = True) -> DataFrame:
    """Cast text columns to double, unreadable values to null; optionally drop such rows."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in cols})
    return out.dropna(subset=list(cols)) if drop else out


def extract_int(col: ColumnLike) -> Column:
    """First run of digits as an integer, null when there is none."""
    return F.nullif(F.regexp_extract(_c(col), r"(\d+)", 1), F.lit("")).try_cast("int")


# ---- amounts, flags, fills ---------------------------------------------------------------

def signed_amount(amount: ColumnLike, kind: ColumnLike, negative: str = "withdrawal") -> Column:
    """Negate the amount of withdrawals."""
    return F.when(_c(kind) == negative, -_c(amount)).otherwise(_c(amount))


def fill_const(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Null to a constant per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def overwrite_when_null(target: ColumnLike, other: ColumnLike, value: object) -> Column:
    """``value`` where ``other`` is null, the column's own value elsewhere."""
    return F.when(_c(other).isNull(), F.lit(value)).otherwise(_c(target))


def complete_row_flag(cols: Sequence[str]) -> Column:
    """True when none of the columns is null."""
    flag = F.lit(True)
    for c in cols:
        flag = flag & F.col(c).isNotNull()
    return flag


def presence_flag(key: ColumnLike) -> Column:
    """True when the key of a left-joined side was found."""
    return _c(key).isNotNull()


def add_intercept(df: DataFrame, name: str = "const") -> DataFrame:
    """A constant column of ones."""
    return df.withColumn(name, F.lit(1.0))


# ---- column selection --------------------------------------------------------------------

def rename_select(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns and keep exactly those, in the mapping's order."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def add_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Every column name gets the suffix."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns})


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns; names that do not exist are ignored."""
    return df.drop(*names)


def select_by_pattern(
    df: DataFrame,
    contains: Sequence[str] = (),
    numbered: Mapping[str, int] | None = None,
    exact: Sequence[str] = (),
) -> list[str]:
    """Column names: exact ones, those containing a text, then ``prefix_1..prefix_n``."""
    picked = [c for c in exact if c in df.columns]
    for text in contains:
        picked += [c for c in df.columns if text in c and c not in picked]
    for prefix, last in (numbered or {}).items():
        picked += [f"{prefix}_{i}" for i in range(1, last + 1)]
    return picked


def columns_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric names, text names)."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return numeric, text
