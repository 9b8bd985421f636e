"""Days, ISO text and ages."""

from pyspark.sql import Column
from pyspark.sql import functions as F


# Days and texts are those of UTC whatever the session's zone is: they go by the number of microseconds since 1970.


_DAY = 86_400_000_000


def utc_day(instant: Column) -> Column:
    micros = F.unix_micros(instant.cast("timestamp"))
    return F.date_from_unix_date(((micros - F.pmod(micros, F.lit(_DAY))) / _DAY).cast("int"))


def midnight(day: Column) -> Column:
    """The instant at which a day begins in UTC."""
    return F.timestamp_micros(F.unix_date(day).cast("long") * _DAY)


def iso(instant: Column) -> Column:
    millis = F.floor(F.pmod(F.unix_micros(instant.cast("timestamp")), F.lit(_DAY)) / 1000)
    clock = F.format_string(
        "T%02d:%02d:%02d.%03dZ", F.floor(millis / 3_600_000), F.floor(millis / 60_000) % 60, F.floor(millis / 1000) % 60, millis % 1000)
    return F.when(instant.isNotNull(), F.concat(utc_day(instant).cast("string"), clock))


def iso_day(day: Column) -> Column:
    """A day as the text of its first instant."""
    return F.concat(day.cast("string"), F.lit("T00:00:00.000Z"))


def age(instant: Column, as_of: Column) -> Column:
    """How long ago, in the largest whole unit: struct of `count` and `unit` (day, hour, minute or now)."""
    minutes = F.floor((F.unix_millis(as_of) - F.unix_millis(instant)) / 60000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    count = F.when(days > 0, days).when(hours > 0, hours).when(minutes > 0, minutes).otherwise(F.lit(0))
    unit = F.when(days > 0, "day").when(hours > 0, "hour").when(minutes > 0, "minute").otherwise("now")
    return F.when(instant.isNotNull(), F.struct(count.alias("count"), unit.alias("unit")))
