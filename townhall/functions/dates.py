"""Date text parsing. A finite list of formats; other text gives null.

Local wall-clock results are TIMESTAMP_NTZ; UTC results too, so that nothing
depends on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from townhall.functions.text import EDGE_LEFT, EDGE_RIGHT, squish

NTZ = "timestamp_ntz"


def to_utc(local: Column, zone: Column) -> Column:
    """Wall-clock time in ``zone`` to UTC wall-clock."""
    return F.convert_timezone(zone, F.lit("UTC"), local)


def to_local(utc: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, utc)


def try_ntz(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast(NTZ)


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_WORD = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
WEEKDAY_WORD = r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
CLOCK = r"^(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?\s*(am|pm)?$"

# Every known shape becomes year-month-day; a missing year leaves a leading dash.
# Slashes are month first, dashes with a trailing year are day first, two digits
# mean 1970 to 2069.
DATE_SHAPES = [
    (rf"^{MONTH_WORD}\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?(?=$|[,\s])", "$3-$1-$2"),
    (rf"^(\d{{1,2}})\s+{MONTH_WORD},?\s+(\d{{4}})(?=$|[,\s])", "$3-$2-$1"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?=$|[,\s])", "$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})/([0-6]\d)(?=$|[,\s])", "20$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})/([7-9]\d)(?=$|[,\s])", "19$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})(?=$|[,\s])", "-$1-$2"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})(?=$|[,\s])", "$3-$2-$1"),
]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_date_part(text: Column, default_year: Column) -> Column:
    """The date at the start of ``text`` (a clock part after it is ignored), as DATE.

    A chain in which each step reads the previous one once, so the plan stays small. Text that begins with
    year-month-day would pass all steps as it is, so it is read at once.
    """
    day = r"^(\d{4}-\d{1,2}-\d{1,2})(?=$|[t,\s])"

    def shaped(t: Column) -> Column:
        t = F.regexp_replace(t, WEEKDAY_WORD, "")
        for shape, canonical in DATE_SHAPES:
            t = F.regexp_replace(t, shape, canonical)
        t = F.regexp_replace(t, F.lit("^-"), F.concat(default_year.cast("string"), F.lit("-")))
        for i, name in enumerate(MONTHS, 1):
            t = F.replace(t, F.lit(f"-{name}-"), F.lit(f"-{i}-"))
        return F.regexp_extract(t, day, 1)

    def read(t: Column) -> Column:
        return let(F.regexp_extract(t, day, 1), lambda d: F.when(d != "", d).otherwise(shaped(t)))

    return let(F.lower(squish(text)), read).try_cast("date")


def clock_seconds(text: Column) -> Column:
    """Seconds since midnight of a clock text such as 7 pm, 7:30 p.m. or 18:30."""
    t = squish(F.replace(F.replace(F.lower(text), F.lit("a.m."), F.lit("am")), F.lit("p.m."), F.lit("pm")))

    def seconds(g: Column) -> Column:
        # g: hour, minute, second, meridiem; one element when the text is no clock.
        num = lambda i: F.nullif(F.try_element_at(g, F.lit(i)), F.lit("")).try_cast("int")
        mer = F.try_element_at(g, F.lit(4))
        ok = (F.size(g) == 4) & ((mer != "") | num(2).isNotNull())
        ok = ok & F.coalesce(num(2) < 60, F.lit(True)) & F.coalesce(num(3) < 60, F.lit(True))
        hour = (
            F.when((mer == "") & (num(1) < 24), num(1))
            .when((mer != "") & num(1).between(1, 12), F.pmod(num(1), F.lit(12)) + F.when(mer == "pm", 12).otherwise(0))
        )
        return F.when(ok, hour * 3600 + F.coalesce(num(2), F.lit(0)) * 60 + F.coalesce(num(3), F.lit(0)))

    return let(F.split(F.regexp_replace(t, CLOCK, "$1|$2|$3|$4"), r"\|"), seconds)


def at_clock(date: Column, seconds: Column) -> Column:
    """DATE plus seconds of the day as wall-clock time."""
    return F.timestamp_add("SECOND", seconds, date.cast(NTZ))


def has_time(text: Column) -> Column:
    return F.coalesce(
        text.rlike(r"\d{1,2}:\d{2}") | text.rlike("(?i)" + EDGE_LEFT + "(am|pm)" + EDGE_RIGHT), F.lit(False)
    )


ZONED = r"(?:(?<=\d)z|(?<=:\d\d|\.\d{1,6})\s?[+-]\d{2}:?\d{2}|\s(?:gmt|utc))$"


def parse_moment(text: Column, zone: Column, default_year: Column) -> Column:
    """Date with optional clock and offset, as wall-clock time of the text's own offset.

    Text without an offset is taken in ``zone``; nothing is converted, as the
    stored value is the wall-clock reading.
    """

    def read(t: Column) -> Column:
        date = parse_date_part(t, default_year)
        clock = F.regexp_extract(t, r"(?:t|\s|,)(\d{1,2}(?::\d{2}){0,2})(?:\.\d+)?(\s*(?:[ap]\.?m\.?)?)$", 1)
        mer = F.regexp_extract(t, r"(\s*[ap]\.?m\.?)$", 1)
        timed = t.rlike(r"\d:\d{2}|\d\s*[ap]\.?m")
        return F.when(timed, at_clock(date, clock_seconds(F.concat(clock, mer)))).otherwise(date.cast(NTZ))

    return let(F.regexp_replace(F.lower(squish(text)), ZONED, ""), read)


def offset_minutes(text: Column) -> Column:
    """Offset written at the end of the text in minutes; null when there is none."""

    def read(t: Column) -> Column:
        p = r"^.*\d:\d{2}.*([+-])(\d{2}):?(\d{2})$"
        n = F.regexp_extract(t, p, 2).try_cast("int") * 60 + F.regexp_extract(t, p, 3).try_cast("int")
        signed = F.when(F.regexp_extract(t, p, 1) == "-", -n).otherwise(n)
        return F.when(t.rlike(r"(?:z|\s(?:gmt|utc))$"), F.lit(0)).otherwise(signed)

    return let(F.lower(squish(text)), read)


def moment_utc(text: Column, zone: Column, default_year: Column) -> Column:
    """As ``parse_moment`` but converted to UTC."""
    return let(
        F.struct(parse_moment(text, zone, default_year).alias("at"), offset_minutes(text).alias("off")),
        lambda r: F.when(r["off"].isNotNull(), F.timestamp_add("MINUTE", -r["off"], r["at"])).otherwise(to_utc(r["at"], zone)),
    )


def _result(start: Column, end: Column, all_day: Column) -> Column:
    made = F.struct(start.cast(NTZ).alias("starts_at"), end.cast(NTZ).alias("ends_at"), all_day.alias("all_day"))
    return let(made, lambda r: F.when(r["starts_at"].isNotNull(), r))


def parse_iso_date(text: Column, zone: Column, default_year: Column) -> Column:
    """Struct (starts_at, ends_at, all_day); without a clock part it is an all-day date."""
    return let(squish(text), lambda t: _result(parse_moment(t, zone, default_year), F.lit(None), ~has_time(t)))


MERIDIEM = r"(am|pm)(?![a-z0-9_])"


def clock_range(text: Column) -> Column:
    """Seconds of the start and end of a time range; the meridiem may be written once at the end."""

    def read(parts: Column) -> Column:
        shared = F.regexp_extract(F.try_element_at(parts, F.lit(-1)), MERIDIEM, 1)
        mark = lambda p: F.when((shared != "") & ~p.rlike(MERIDIEM), F.concat(p, F.lit(" "), shared)).otherwise(p)
        return F.filter(F.transform(parts, lambda p: clock_seconds(mark(p))), lambda s: s.isNotNull())

    low = F.replace(F.replace(F.lower(text), F.lit("a.m."), F.lit("am")), F.lit("p.m."), F.lit("pm"))
    parts = F.filter(F.transform(F.split(low, r"\s*(?:-|to|–|—)\s*"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    return let(parts, read)


LAST_COMMA = r"^(.*\S)\s*,\s*([^,]*\S)\s*$"


def parse_event_date(date_text: Column, time_text: Column, zone: Column, default_year: Column) -> Column:
    """Date and time text to (starts_at, ends_at, all_day).

    Knows all-day words, "date, time" in one string (split at the last comma)
    and time ranges whose meridiem may be written once at the end.
    """
    none = F.lit(None).cast("struct<starts_at:timestamp_ntz,ends_at:timestamp_ntz,all_day:boolean>")

    def split_text(p: Column) -> Column:
        cut = (p["t"] == "") & has_time(p["d"]) & p["d"].rlike(LAST_COMMA)
        return F.when(cut, F.struct(
            F.regexp_extract(p["d"], LAST_COMMA, 1).alias("d"), F.regexp_extract(p["d"], LAST_COMMA, 2).alias("t"))).otherwise(p)

    def dated(p: Column) -> Column:
        date = parse_date_part(p["d"], default_year)
        words = F.concat_ws(" ", p["d"], p["t"]).rlike(r"(?i)all\s*day")
        return let(
            F.struct(date.alias("day"), clock_range(p["t"]).alias("s"), words.alias("whole")),
            lambda r: F.when(r["whole"], _result(r["day"], F.lit(None), F.lit(True))).otherwise(_result(
                at_clock(r["day"], F.try_element_at(r["s"], F.lit(1))),
                at_clock(r["day"], F.try_element_at(r["s"], F.lit(2))), F.lit(False))),
        )

    def read(p: Column) -> Column:
        return (
            F.when((p["d"] == "") & (p["t"] == ""), none)
            .when(p["d"] == "", parse_iso_date(p["t"], zone, default_year))
            .when(p["t"] == "", parse_iso_date(p["d"], zone, default_year))
            .otherwise(dated(p))
        )

    texts = F.struct(F.coalesce(squish(date_text), F.lit("")).alias("d"), F.coalesce(squish(time_text), F.lit("")).alias("t"))
    return let(let(texts, split_text), read)


def parse_ics_date(value: Column, tzid: Column, zone: Column) -> Column:
    """Calendar-file date to (starts_at, ends_at, all_day) in its own zone."""
    v = F.trim(value)
    z = F.coalesce(F.nullif(tzid, F.lit("")), zone)
    utc = try_ntz(F.regexp_replace(v, "Z$", ""), "yyyyMMdd'T'HHmmss")
    day = try_ntz(v, "yyyyMMdd")
    return (
        F.when(v.rlike(r"^\d{8}$"), _result(day, F.lit(None), F.lit(True)))
        .when(v.rlike(r"^\d{8}T\d{6}Z$"), _result(to_local(utc, z), F.lit(None), F.lit(False)))
        .when(v.rlike(r"^\d{8}T\d{6}$"), _result(utc, F.lit(None), F.lit(False)))
        .otherwise(parse_iso_date(v, z, F.lit(1970)))
    )


def parse_local_datetime(date_text: Column, time_text: Column, zone: Column, default_year: Column) -> Column:
    """Struct (starts_at_utc, has_time); a date without a clock is pinned to local noon."""
    d, tm = squish(date_text), F.nullif(squish(time_text), F.lit(""))
    date = parse_date_part(d, default_year)
    seconds = clock_seconds(tm)
    local = F.when(tm.isNull(), at_clock(date, F.lit(12 * 3600))).otherwise(at_clock(date, seconds))
    starts = to_utc(local, zone)
    return F.struct(starts.alias("starts_at"), (tm.isNotNull() & starts.isNotNull()).alias("has_time"))


def parse_timeline_date(text: Column, zone: Column, default_year: Column) -> Column:
    """Struct (at, has_time) in UTC for a timeline date text."""
    timed = F.coalesce(text.rlike(r"\d{1,2}:\d{2}") | text.contains("T"), F.lit(False))
    noon = at_clock(parse_date_part(text, default_year), F.lit(12 * 3600))
    at = F.when(timed, moment_utc(text, zone, default_year)).otherwise(to_utc(noon, zone))
    return let(
        F.struct(at.alias("at"), timed.alias("timed")),
        lambda r: F.struct(r["at"].alias("at"), (r["timed"] & r["at"].isNotNull()).alias("has_time")),
    )
