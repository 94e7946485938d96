"""Timestamp parsing and calendar functions.

Two views of every log time are kept:

* ``ts_utc`` (TIMESTAMP) - the instant; offsets in the text are honoured.
  Window arithmetic, report timelines and heat maps use it.
* ``local_ts`` (TIMESTAMP_NTZ) - the log's own wall clock (the text with any
  offset removed).  ``hour``/``minute``/``day_of_week``/``is_night`` use it.

Each row is parsed on its own, so mixed offsets in one column are fine.
The session time zone is expected to be UTC (see ``session.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as C

_OFFSET = r"\s*(Z|z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$"
# an offset has one of these among the last characters; most texts have none
_MAY_OFFSET, _OFFSET_TAIL = "[zZCT+-]", 8


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_log_time(df: DataFrame, col: str = "timestamp") -> tuple[Column, Column]:
    """Return ``(ts_utc, local_ts)`` expressions for ``df[col]``.

    Strings are parsed per row (unparsable -> null); TIMESTAMP_NTZ input is a
    wall clock taken as UTC; TIMESTAMP input is an instant.
    """
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, T.TimestampNTZType):
        return c.cast("timestamp"), c
    if isinstance(dtype, T.TimestampType):
        return c, c.cast("timestamp_ntz")
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp"), c.cast("timestamp_ntz")
    text = F.btrim(c.cast("string"), F.lit(C.STRIP_CHARS))
    may = F.right(text, F.lit(_OFFSET_TAIL)).rlike(_MAY_OFFSET)
    local = F.when(may, F.regexp_replace(text, _OFFSET, "")).otherwise(text).try_cast("timestamp_ntz")
    instant = text.try_cast("timestamp")
    # a bare "UTC"/"GMT" suffix is not understood by the cast: use the wall clock
    instant = F.coalesce(instant, local.cast("timestamp"))
    return instant, local


def epoch_ms(ts_utc) -> Column:
    """Whole milliseconds since the epoch (window arithmetic)."""
    return F.unix_millis(_c(ts_utc))


def calendar_columns(local_ts) -> dict[str, Column]:
    """F1/F2 from the wall clock: hour, minute, day_of_week (Mon=0), is_night."""
    lt = _c(local_ts)
    hour = F.hour(lt)
    return {
        "hour": hour,
        "minute": F.minute(lt),
        "day_of_week": F.weekday(lt),
        "is_night": F.when((hour < C.NIGHT_END_HOUR) | (hour >= C.NIGHT_START_HOUR), 1)
                     .otherwise(0),
    }


def minute_text(ts) -> Column:
    """``%Y-%m-%d %H:%M``."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm")


def utc_text(ts) -> Column:
    """``str()`` of a UTC pandas Timestamp: fraction only when non-zero."""
    t = _c(ts)
    frac = F.unix_micros(t) % 1_000_000
    return F.concat(
        F.when(frac == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
         .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS")),
        F.lit("+00:00"))


def range_text(start, end) -> Column:
    """``start → end``."""
    return F.concat(utc_text(start), F.lit(" → "), utc_text(end))


def day_name(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def as_wall_clock(ts_utc) -> Column:
    """Present an instant as a UTC wall clock (TIMESTAMP_NTZ) for output."""
    return _c(ts_utc).cast("timestamp_ntz")
