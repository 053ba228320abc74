"""Column functions over dates as registers write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.text import squeeze

_NAMES = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
_CLOCK = r"(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.][0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"


def _month(name: Column) -> Column:
    return F.floor((F.position(F.substring(F.lower(name), 1, 3), F.lit(_STARTS)) + 2) / 3).cast("string")


def parse_date(x: Column) -> Column:
    """A day in ISO form (with or without a time) or one of the nine register formats, day before month; else null."""
    return parse_squeezed(squeeze(x))


def parse_squeezed(t: Column) -> Column:
    """``parse_date`` of text without needless white space. t should be a plain column: it is looked at many times."""
    iso = rf"^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}}){_CLOCK}$"
    last = r"^([0-9]{1,2})(?:-([0-9]{1,2})-|/([0-9]{1,2})/|[.]([0-9]{1,2})[.])([0-9]{4})$"
    day_name, name_day = rf"(?i)^([0-9]{{1,2}}) ({_NAMES}) ([0-9]{{4}})$", rf"(?i)^({_NAMES}) ([0-9]{{1,2}}), ([0-9]{{4}})$"
    named = lambda p, y, m, d: F.concat_ws("-", F.regexp_extract(t, p, y), _month(F.regexp_extract(t, p, m)), F.regexp_extract(t, p, d))
    text = (
        F.when(t.rlike(iso), F.regexp_replace(t, iso, "$1-$2-$3"))
        .when(t.rlike(last), F.regexp_replace(t, last, "$5-$2$3$4-$1"))
        .when(t.rlike("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.replace(t, F.lit("/"), F.lit("-")))
        .when(t.rlike(day_name), named(day_name, 3, 2, 1))
        .when(t.rlike(name_day), named(name_day, 3, 1, 2))
        .when(t.rlike("^[0-9]{8}$"), F.regexp_replace(t, "^(....)(..)(..)$", "$1-$2-$3"))
    )
    return text.try_cast("date")


def lag_days(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier)


def fiscal_year(day: Column) -> Column:
    """The April-to-March year, written with both years in full."""
    y = F.year(F.add_months(day, -3))
    return F.when(day.isNull(), "UNKNOWN").otherwise(F.concat_ws("-", y.cast("string"), (y + 1).cast("string")))
