"""String column helpers (F6, F7, F8, F9, null tokens)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Remove leading/trailing whitespace the way ``str.strip()`` does."""
    return F.btrim(_c(col), F.lit(C.STRIP_CHARS))


def as_text(col, null_text: str = "nan") -> Column:
    """``astype(str)`` semantics: a missing value becomes the text ``nan``."""
    return F.coalesce(_c(col).cast("string"), F.lit(null_text))


def na_to_null(col) -> Column:
    """Turn the missing-value tokens of a pandas CSV read into null."""
    c = _c(col)
    return F.when(c.isin(C.NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def collapse_ws(col) -> Column:
    """runs of whitespace become one space, trimmed; null -> ''."""
    return F.coalesce(
        py_strip(F.regexp_replace(_c(col).cast("string"), r"\s+", " ")), F.lit(""))


def to_number(col) -> Column:
    """``pd.to_numeric(errors='coerce')``: unparsable text -> null (double)."""
    return py_strip(_c(col).cast("string")).try_cast("double")


def usable_map_value(map_col, keys: list[str]) -> Column:
    """F8: first key whose whitespace-collapsed value is non-blank and not an
    ignored placeholder; '' when none qualifies."""
    m = _c(map_col)
    cands = []
    for k in keys:
        v = collapse_ws(F.element_at(m, F.lit(k)))
        cands.append(F.when((v != "") & ~v.isin(C.EVENT_DATA_IGNORED), v))
    return F.coalesce(*cands, F.lit(""))


def int_map_value(map_col, keys: list[str]) -> Column:
    """first key whose value parses as an int; 0 when none does."""
    m = _c(map_col)
    cands = [collapse_ws(F.element_at(m, F.lit(k))).try_cast("int") for k in keys]
    return F.coalesce(*cands, F.lit(0))
