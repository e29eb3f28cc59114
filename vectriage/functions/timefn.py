"""Time helpers that do not depend on the session time zone.

Ticket and review times are wall-clock ``timestamp_ntz`` values; every
conversion here stays in that type, so results are the same whatever
``spark.sql.session.timeZone`` the cluster runs with.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "CAST(DATE'1970-01-01' AS TIMESTAMP_NTZ)"


def ts_ntz(value) -> Column:
    """A ``timestamp_ntz`` literal from a datetime, date or ISO string."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def epoch_seconds_ntz(c) -> Column:
    """Whole seconds between 1970-01-01 00:00 and a timestamp_ntz wall time."""
    x = F.col(c) if isinstance(c, str) else c
    days = F.datediff(F.to_date(x), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(x) * 3600 + F.minute(x) * 60 + F.floor(F.second(x)).cast("long")


def ntz_from_epoch_seconds(c) -> Column:
    """timestamp_ntz wall time of Unix seconds (the UTC reading)."""
    x = F.col(c) if isinstance(c, str) else c
    days = F.floor(x / F.lit(86400)).cast("int")
    secs = (x - days.cast("long") * 86400).cast("long")
    return (F.expr(_EPOCH) + F.make_dt_interval(days, F.lit(0), F.lit(0), secs.cast("decimal(18,6)")))
