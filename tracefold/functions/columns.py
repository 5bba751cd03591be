"""Scalar Column functions (JVM-side, codegen-friendly; no Python UDFs).

Each function maps Columns to a Column so that it can be used inside any
select/withColumn and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_ms(ts: ColumnOrName) -> Column:
    """TIMESTAMP_NTZ -> epoch milliseconds, floored, independent of the session zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


# P1 ------------------------------------------------------------------------
def null_sentinel(x: ColumnOrName, numeric: bool = True) -> Column:
    """-1 in a number, or "null" in a string, means absent; missing JSON keys already read as NULL.

    A string "-1" is a value like any other.
    """
    c = _c(x)
    return F.when(c != (F.lit(-1) if numeric else F.lit("null")), c)


def to_sentinel(x: ColumnOrName, numeric: bool = True) -> Column:
    """Reverse of P1 for the message writer: NULL -> -1 or "null"."""
    return F.coalesce(_c(x), F.lit(-1) if numeric else F.lit("null"))


# P2 ------------------------------------------------------------------------
def valid_time(t: ColumnOrName) -> Column:
    """Negative times are absent."""
    c = _c(t)
    return F.when(c >= 0, c)


# P4 ------------------------------------------------------------------------
def html_escape(s: ColumnOrName) -> Column:
    """Escape &, <, > in that order."""
    c = _c(s)
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def short_name(s: ColumnOrName) -> Column:
    """HTML-escaped name, part before the first blank."""
    return F.split(html_escape(s), " ").getItem(0)


# P8 ------------------------------------------------------------------------
def duration_ms(start: ColumnOrName, end: ColumnOrName) -> Column:
    """end - start; NULL while not ended."""
    return _c(end) - _c(start)


# P9 ------------------------------------------------------------------------
def format_duration(ms: ColumnOrName, with_millis: bool = False) -> Column:
    """Render a duration as ``[d]d [h]h:mm[m]:ss[s]`` (+ ``:SS[ms]``).

    Leading zero units are trimmed: days only when >= 1 day, hours only when
    >= 1 hour; minutes and seconds always, two digits once a larger unit shows.
    """
    m = _c(ms).cast("long")
    d = F.floor(m / 86400000)
    h = F.floor((m % 86400000) / 3600000)
    mi = F.floor((m % 3600000) / 60000)
    s = F.floor((m % 60000) / 1000)
    frac = m % 1000
    days = F.when(d > 0, F.concat(d.cast("string"), F.lit("d "))).otherwise(F.lit(""))
    hours = F.when(m >= 3600000, F.concat(h.cast("string"), F.lit("h:"))).otherwise(F.lit(""))
    mins = F.when(m >= 3600000, F.lpad(mi.cast("string"), 2, "0")).otherwise(mi.cast("string"))
    out = F.concat(days, hours, mins, F.lit("m:"), F.lpad(s.cast("string"), 2, "0"), F.lit("s"))
    if with_millis:
        out = F.concat(out, F.lit(":"), F.lpad(frac.cast("string"), 3, "0"), F.lit("ms"))
    return F.when(m.isNotNull(), out)


# P10 -----------------------------------------------------------------------
def to_proportion(time: ColumnOrName, total: ColumnOrName) -> Column:
    """Percent of the task wall time; divide first, then times 100. Total 0 gives NULL."""
    return F.try_divide(_c(time).cast("double"), _c(total).cast("double")) * F.lit(100.0)


# P15/P16 -------------------------------------------------------------------
def executor_group(executor_id: ColumnOrName, host: ColumnOrName) -> Column:
    return F.concat_ws("-", _c(executor_id).cast("string"), _c(host))


def item_label(entity_id: ColumnOrName, name: ColumnOrName | None = None) -> Column:
    if name is None:
        return _c(entity_id).cast("string")
    return F.concat(_c(entity_id).cast("string"), F.lit(":"), _c(name))


# P20 -----------------------------------------------------------------------
def error_message(reason: ColumnOrName, message: ColumnOrName) -> Column:
    """Failure text; NULL when the task succeeded or has not ended."""
    r = _c(reason)
    return F.when(r.isNotNull() & (r != F.lit("Success")), F.coalesce(_c(message), r))


# P21 -----------------------------------------------------------------------
def qualified_key(prefix: str, app_id: ColumnOrName, entity_id: ColumnOrName) -> Column:
    return F.concat(F.lit("app"), _c(app_id).cast("string"), F.lit(prefix), _c(entity_id).cast("string"))
