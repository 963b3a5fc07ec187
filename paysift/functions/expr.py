"""Scalar column helpers: strings, formats, dates, math, arrays, JSON, conditionals.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- conditional
def lookup(col: ColumnOrName, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup with a default, as a CASE chain (no map object, null-safe)."""
    c = _c(col)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def safe_number(col: ColumnOrName, to: str = "double", default=None) -> Column:
    """Null-safe numeric coercion: bad text -> default (ANSI-safe ``try_cast``)."""
    v = _c(col).try_cast(to)
    return v if default is None else F.coalesce(v, F.lit(default).cast(to))


# -------------------------------------------------------------------- strings
def norm_upper(col: ColumnOrName) -> Column:
    """``upper(trim(x))`` — the country normalisation."""
    return F.upper(F.trim(_c(col)))


def title_case(col: ColumnOrName) -> Column:
    """Capitalise the first letter after every non-letter, lower the rest.

    ``initcap`` only starts words after white space, so a marker followed by a
    space is put after every non-letter, ``initcap`` runs, and the markers go.
    """
    marked = F.regexp_replace(F.lower(_c(col)), r"([^\p{L}])", "$1\u0001 ")
    return F.regexp_replace(F.initcap(marked), "\u0001 ", "")


def truncate_text(col: ColumnOrName, width: int = 80, ellipsis: str = "…") -> Column:
    c = _c(col)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit(ellipsis))).otherwise(c)


def contains_any(col: ColumnOrName, needles: Iterable[str]) -> Column:
    c = _c(col)
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def split_tokens(col: ColumnOrName, pattern: str = r",\s*") -> Column:
    """Regex split (``''`` gives ``['']``, size 1, as in the reference)."""
    return F.split(_c(col), pattern)


def clean_tokens(col: ColumnOrName, sep: str = ",") -> Column:
    """Split on ``sep``, trim every token, drop empty ones; null -> []."""
    arr = F.split(F.coalesce(_c(col), F.lit("")), sep)
    return F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x != "")


def digits_only(col: ColumnOrName) -> Column:
    return F.regexp_replace(_c(col), "[^0-9]", "")


# -------------------------------------------------------------------- formats
def money(col: ColumnOrName) -> Column:
    """``$1,234`` for an integral amount."""
    return F.concat(F.lit("$"), F.format_number(_c(col).cast("long"), 0))


def money_k(col: ColumnOrName) -> Column:
    """``$123K``: thousands rounded half-even."""
    return F.concat(F.lit("$"), F.bround(_c(col) / 1000.0, 0).cast("long").cast("string"), F.lit("K"))


def signed_pct(col: ColumnOrName) -> Column:
    """``+1.2%`` / ``-0.4%``."""
    return F.format_string("%+.1f%%", F.bround(_c(col), 1))


# ---------------------------------------------------------------------- dates
def to_date_safe(col: ColumnOrName, fmt: str | None = None) -> Column:
    """Text/timestamp -> date; unparseable text -> null (``errors='coerce'``)."""
    c = _c(col)
    return F.try_to_date(c.cast("string"), F.lit(fmt)) if fmt else F.try_to_date(c.cast("string"))


def year_month(col: ColumnOrName) -> Column:
    return F.date_format(_c(col), "yyyy-MM")


def days_between_clipped(end: ColumnOrName, start: ColumnOrName) -> Column:
    """``max(end - start, 0)`` in days; null when either side is null."""
    d = F.datediff(_c(end), _c(start))
    return F.when(d.isNull(), F.lit(None).cast("int")).otherwise(F.greatest(d, F.lit(0)))


def next_month_start(col: ColumnOrName) -> Column:
    return F.add_months(F.trunc(_c(col), "MM"), 1)


# ----------------------------------------------------------------------- math
def truncate_int(col: ColumnOrName) -> Column:
    """Python ``int(x)``: toward zero."""
    return _c(col).cast("long")


def ratio_minus_one(num: ColumnOrName, den: ColumnOrName) -> Column:
    return F.when(_c(den) != 0, _c(num) / _c(den) - 1)


# --------------------------------------------------------------------- arrays
def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def array_mean(arrays_col: ColumnOrName, dim: int) -> Column:
    """Element-wise mean of an ``array<array<double>>``; zeros when empty."""
    a = _c(arrays_col)
    summed = F.aggregate(a, zeros(dim), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return F.when(F.size(a) > 0, F.transform(summed, lambda x: x / F.size(a))).otherwise(zeros(dim))


def array_max(arrays_col: ColumnOrName, dim: int) -> Column:
    """Element-wise max of an ``array<array<double>>``; zeros when empty."""
    a = _c(arrays_col)
    first = F.element_at(a, 1)
    maxed = F.aggregate(a, first, lambda acc, v: F.zip_with(acc, v, lambda x, y: F.greatest(x, y)))
    return F.when(F.size(a) > 0, maxed).otherwise(zeros(dim))


# ----------------------------------------------------------------------- json
def json_get(col: ColumnOrName, path: str, default=None, to: str | None = None) -> Column:
    """``get_json_object`` with a default; malformed JSON -> default."""
    v = F.get_json_object(_c(col), path)
    if to:
        v = v.try_cast(to)
    return v if default is None else F.coalesce(v, F.lit(default))


def json_parse_or_empty(col: ColumnOrName, value_type: str = "string") -> Column:
    """Parse a JSON object into ``map<string, value_type>``; ``{}`` on failure."""
    parsed = F.from_json(_c(col), f"map<string,{value_type}>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.create_map().cast(f"map<string,{value_type}>"))


# ------------------------------------------------------------- feature names
def feature_display(col: ColumnOrName) -> Column:
    """Raw feature name -> label: fixed names first, then the prefix rules."""
    from paysift.functions import constants as K
    c = _c(col)
    out = F.when(lookup(c, K.FEATURE_DISPLAY).isNotNull(), lookup(c, K.FEATURE_DISPLAY))
    for prefix, before, after in K.FEATURE_PREFIX_DISPLAY:
        rest = F.substr(c, F.lit(len(prefix) + 1))
        rest = title_case(rest) if prefix == "ctry_" else rest
        out = out.when(c.startswith(prefix), F.concat(F.lit(before), rest, F.lit(after)))
    return out.otherwise(c)


# --------------------------------------------------------- order-free means
def exact_sum(col: ColumnOrName) -> Column:
    """Sum (aggregate) in decimals with ten places: exact, so it does not depend on
    the order in which partial sums merge, and good for sums up to 10^28."""
    return F.sum(_c(col).cast("decimal(28,10)"))


def exact_mean(col: ColumnOrName, digits: int = 4) -> Column:
    """Mean (aggregate) from an exact sum, rounded once, half-even, to ``digits``."""
    return F.bround((exact_sum(col) / F.count(_c(col))).cast("double"), digits)


def exact_mean_whole(col: ColumnOrName) -> Column:
    """Mean (aggregate) from an exact sum, rounded half-even to a whole unit."""
    return exact_mean(col, 0)
