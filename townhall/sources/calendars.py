"""Calendar feeds: ICS, RSS, JSON and HTML payload tables to event items.

Event items: HEAD columns, pos, title, starts_at, ends_at, all_day (wall-clock of the
feed's zone), location_name, location_address, description, event_url,
external_id, given_hash. ``zone`` is a column of the payload table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall import config as C
from townhall.functions import html as H
from townhall.functions.dates import (
    at_clock, clock_seconds, moment_utc, parse_event_date, parse_ics_date, parse_iso_date, parse_moment, to_local, to_utc,
)
from townhall.functions.text import blank_to_null, strip_tags, trim_all
from townhall.functions.urls import absolute_url, url_equal
from townhall.sources.feeds import HEAD, read_feed

EVENT_COLUMNS = [
    *HEAD, "pos", "title", "starts_at", "ends_at", "all_day", "location_name", "location_address", "description", "event_url",
    "external_id", "given_hash",
]
UNTITLED = "Untitled event"


def _null() -> Column:
    return F.lit(None).cast("string")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _titled(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(UNTITLED))


# --- ICS ---------------------------------------------------------------------

def ics_blocks(payloads: DataFrame) -> DataFrame:
    """One row per VEVENT with its unfolded, non-empty lines."""
    unfolded = F.regexp_replace("body", r"[ \t]*(?:\r\n|\n|\r)[ \t]+", "")
    body = F.regexp_replace(unfolded, r"[ \t]*(?:\r\n|\n|\r)+", "\n")
    block = F.regexp_extract_all(body, F.lit(r"(?s)(?<![^\n])BEGIN:VEVENT\n(.*?)(?<=\n)END:VEVENT(?![^\n])"), F.lit(1))
    return payloads.select(*HEAD, "zone", F.posexplode(block).alias("pos", "_b")).withColumn("_lines", F.split("_b", "\n")).drop("_b")


def _property(name: str) -> Column:
    """First line of the property that has a value, as (value, params)."""
    line = F.filter("_lines", lambda l: l.rlike(rf"(?i)^{name}(?:;[^:]*)?:.*\S"))
    first = F.try_element_at(line, F.lit(1))
    return F.struct(
        trim_all(F.regexp_replace(first, "^[^:]*:", "")).alias("value"), F.regexp_extract(first, "^([^:]*):", 1).alias("params"))


def _zone_param(params: Column) -> Column:
    return _some(F.regexp_extract(params, r"(?i);TZID=([^;]*)", 1))


def ics_events(payloads: DataFrame, fix: bool = True) -> DataFrame:
    """Events with summary and start. The start's zone also serves an end without one."""
    rows = ics_blocks(payloads)
    for name in ("SUMMARY", "DTSTART", "DTEND", "LOCATION", "DESCRIPTION", "URL", "UID"):
        rows = rows.withColumn("_" + name.lower(), _property(name))
    c = F.col
    start_zone = _zone_param(c("_dtstart.params"))
    start = parse_ics_date(c("_dtstart.value"), start_zone, c("zone"))
    end = parse_ics_date(c("_dtend.value"), F.coalesce(_zone_param(c("_dtend.params")), start_zone), c("zone"))
    rows = rows.filter("_summary.value IS NOT NULL AND _dtstart.value IS NOT NULL").withColumns({"_start": start, "_end": end}).filter("_start IS NOT NULL")
    rows = rows.withColumns({
        "title": c("_summary.value"), "starts_at": c("_start.starts_at"), "ends_at": c("_end.starts_at"),
        "all_day": c("_start.all_day") | F.coalesce(c("_end.all_day"), F.lit(False)),
        "location_name": c("_location.value"), "description": c("_description.value"), "raw_url": c("_url.value"),
        "external_id": c("_uid.value"), "location_address": _null(), "given_hash": _null(),
    })
    if not fix:
        return rows.select(*[x for x in EVENT_COLUMNS if x != "event_url"], "raw_url")
    return url_location_fix(rows).select(*EVENT_COLUMNS)


def url_location_fix(rows: DataFrame) -> DataFrame:
    """Use a lone URL in the description as event URL; move HTML locations into the description."""
    c = F.col
    lone = F.when(c("description").rlike(r"^(?:https?://|/)\S*$"), absolute_url(c("description"), c("request_url")))
    staged = rows.withColumns({"_url_abs": absolute_url(c("raw_url"), c("request_url")), "_lone": lone})
    take = c("_lone").isNotNull() & (
        c("_url_abs").isNull() | url_equal(c("_url_abs"), c("request_url")) | (c("_url_abs") == c("_lone")))
    staged = staged.withColumns({
        "event_url": F.when(take, c("_lone")).otherwise(c("_url_abs")), "description": F.when(F.coalesce(take, F.lit(False)), _null()).otherwise(c("description")), "location_name": blank_to_null(c("location_name"))})
    html = F.coalesce(c("location_name").rlike("<[^>]+>"), F.lit(False))
    merged = F.concat_ws("\n\n", blank_to_null(c("description")), c("location_name"))
    return staged.withColumns({
        "description": F.when(html, merged).otherwise(c("description")), "location_name": F.when(~html, c("location_name"))})


# --- RSS ---------------------------------------------------------------------

# Letters of source date formats and the patterns they stand for.
FORMAT_LETTERS = {
    "d": "dd", "j": "d", "m": "MM", "n": "M", "Y": "yyyy", "y": "yy", "H": "HH", "G": "H", "h": "hh", "g": "h", "i": "mm", "s": "ss",
    "A": "a", "a": "a", "F": "MMMM", "M": "MMM", "D": "EEE", "l": "EEEE", "T": "'T'",
}


def format_pattern(fmt: Column) -> Column:
    """Source format letters to a Spark date pattern."""
    letters = F.create_map(*[F.lit(x) for kv in FORMAT_LETTERS.items() for x in kv])
    return F.array_join(F.transform(F.split(fmt, ""), lambda ch: F.coalesce(F.try_element_at(letters, ch), ch)), "")


def config_moment(text: Column, regex: Column, fmt: Column, zone: Column, year: int) -> Column:
    """Date found by a source's own expression: named group datetime, else group 1, else the whole match."""
    java = F.replace(regex, F.lit("(?P<"), F.lit("(?<"))
    bare = F.regexp_replace(java, r"\\[(\[]", "")
    before = F.split_part(bare, F.lit("(?<datetime>"), F.lit(1))
    groups = lambda t: F.regexp_count(t, F.lit(r"\((?!\?)|\(\?<(?![=!])"))
    index = F.when(bare.contains("(?<datetime>"), groups(before) + 1).when(groups(bare) > 0, 1).otherwise(0)
    value = _some(F.call_function("regexp_extract", text, java, index))
    free = parse_moment(value, zone, F.lit(year))
    formatted = F.try_to_timestamp(value, format_pattern(fmt)).cast("timestamp_ntz")
    return F.when(regex.isNull(), F.lit(None)).when(fmt.isNotNull(), formatted).otherwise(free)


def rss_events(payloads: DataFrame, configs: DataFrame, year: int = 1970) -> DataFrame:
    """Events of RSS and Atom feeds. ``configs``: source_id, regex, format, all_day (one row per source)."""
    c = F.col
    feeds = read_feed(payloads).select(*HEAD, "zone", F.posexplode("items").alias("pos", "i"))
    rows = feeds.join(configs, "source_id", "left")
    description = F.coalesce(blank_to_null(c("i.description")), c("i.encoded"))
    rows = rows.withColumn("_d", F.coalesce(description, F.lit("")))
    text = trim_all(F.concat_ws(" ", c("i.title"), c("_d")))
    whole = F.coalesce(c("all_day"), F.lit(False))
    rows = rows.withColumns({
        "_own": config_moment(text, c("regex"), c("format"), c("zone"), year),
        "_published": F.date_trunc("DAY", parse_moment(_some(c("i.published")), c("zone"), F.lit(year))).cast("timestamp_ntz"), "_whole": whole})
    return rows.withColumns({
        "title": _titled(c("i.title")),
        "starts_at": F.when(c("_own").isNull(), c("_published")).when(c("_whole"), F.date_trunc("DAY", c("_own")).cast("timestamp_ntz")).otherwise(c("_own")),
        "ends_at": F.lit(None).cast("timestamp_ntz"), "all_day": c("_own").isNull() | c("_whole"), "location_name": _null(), "location_address": _null(),
        "description": _some(c("_d")), "event_url": absolute_url(c("i.link"), c("request_url")), "external_id": blank_to_null(c("i.guid")), "given_hash": _null(),
    }).filter("starts_at IS NOT NULL").select(*EVENT_COLUMNS)


# --- JSON --------------------------------------------------------------------

def json_items(payloads: DataFrame, list_path: str) -> DataFrame:
    """One row per element of the list at the dotted path, as a variant."""
    path = "$" + "".join("." + p for p in list_path.split(".") if p)
    items = F.try_variant_get(F.try_parse_json("body"), path, "array<variant>")
    return payloads.select(*HEAD, "zone", F.posexplode(items).alias("pos", "v"))


def field(path: str) -> Column:
    """Text at a dotted path, null when missing."""
    return F.try_variant_get("v", "$." + path, "string")


def _text(path: str) -> Column:
    return F.coalesce(trim_all(field(path)), F.lit(""))


def _when(value: Column, year: int) -> Column:
    return parse_iso_date(_some(value), F.col("zone"), F.lit(year))


def _finish(rows: DataFrame, **columns: Column) -> DataFrame:
    base = {"ends_at": F.lit(None).cast("timestamp_ntz"), "location_name": _null(), "location_address": _null(), "description": _null(),
            "external_id": _null(), "given_hash": _null()}
    return rows.withColumns({**base, **columns}).filter("starts_at IS NOT NULL").select(*EVENT_COLUMNS)


GENERIC_FIELDS = {
    "title": ["title", "name"], "starts_at": ["starts_at", "start", "start_time", "start_date"], "ends_at": ["ends_at", "end", "end_time", "end_date"],
    "location_name": ["location_name", "location", "venue.name"], "location_address": ["location_address", "venue.address"],
    "description": ["description", "summary"], "event_url": ["event_url", "url", "link"], "external_id": ["id", "external_id", "uid"], "all_day": ["all_day"],
}


def json_generic(payloads: DataFrame, list_path: str = "data.events", mapping: dict[str, str] | None = None, year: int = 1970) -> DataFrame:
    """Events of any JSON list: mapped fields, else the first known name that is present."""
    mapping = mapping or {}
    get = lambda k: field(mapping[k]) if k in mapping else F.coalesce(*[field(n) for n in GENERIC_FIELDS[k]])
    c = F.col
    rows = json_items(payloads, list_path).withColumns({"_s": _when(get("starts_at"), year), "_e": _when(get("ends_at"), year), "_flag": F.lower(get("all_day"))})
    derived = F.coalesce(c("_s.all_day"), F.lit(False)) | F.coalesce(c("_e.all_day"), F.lit(False))
    return _finish(
        rows, title=_titled(get("title")), starts_at=c("_s.starts_at"), ends_at=c("_e.starts_at"),
        all_day=F.when(c("_flag").isNotNull(), c("_flag").isin("true", "1", "yes")).otherwise(derived),
        location_name=blank_to_null(get("location_name")), location_address=blank_to_null(get("location_address")), description=blank_to_null(get("description")),
        event_url=absolute_url(get("event_url"), c("request_url")), external_id=blank_to_null(get("external_id")))


def json_century(payloads: DataFrame, list_path: str = "events", names: dict[str, str] | None = None, year: int = 1970) -> DataFrame:
    """Arena calendar: the place is the first h4 of the description that is not the word venue."""
    n = {"id": "EventID", "title": "Title", "description": "Description", "start": "StartDateTime", "end": "EndDateTime", "url": "URL", **(names or {})}
    c = F.col
    headings = F.transform(F.regexp_extract_all(_text(n["description"]), F.lit(r"(?is)<h4[^>]*>(.*?)</h4>"), F.lit(1)), lambda h: trim_all(strip_tags(h)))
    place = F.try_element_at(F.filter(headings, lambda h: (F.length(h) > 0) & (F.lower(h) != "venue")), F.lit(1))
    rows = json_items(payloads, list_path).withColumns({"_s": _when(_text(n["start"]), year), "_e": _when(_text(n["end"]), year)})
    token = F.coalesce(_some(_text(n["id"])), _some(_text(n["url"])))
    return _finish(
        rows, title=_titled(_text(n["title"])), starts_at=c("_s.starts_at"), ends_at=c("_e.starts_at"),
        all_day=c("_s.all_day") | F.coalesce(c("_e.all_day"), F.lit(False)), location_name=place, description=_some(_text(n["description"])),
        event_url=absolute_url(_some(_text(n["url"])), c("request_url")), external_id=_some(_text(n["id"])),
        given_hash=F.sha1(F.concat(F.lit(C.CENTURY_KEY + ":"), token, F.lit(":"), _text(n["start"])).cast("binary")))


def json_simpleview(payloads: DataFrame, site: str, list_path: str = "docs.docs", names: dict[str, str] | None = None, year: int = 1970) -> DataFrame:
    """Visitor calendar: the date is a UTC moment read in the local zone, the time is separate."""
    n = {"id": "recid", "date": "date", "time": "startTime", "place": "location", "place2": "listing.title", "street": "address1", "city": "city",
         "state": "state", "url": "url", "title": "title", "description": "description", **(names or {})}
    c = F.col
    rows = json_items(payloads, list_path).withColumns({
        "_day": to_local(moment_utc(_some(_text(n["date"])), F.lit("UTC"), F.lit(year)), c("zone")).cast("date"), "_time": _text(n["time"])})
    start = F.when(c("_time") == "", c("_day").cast("timestamp_ntz")).otherwise(at_clock(c("_day"), clock_seconds(c("_time"))))
    rows = rows.withColumns({"starts_at": start, "_url": absolute_url(_some(_text(n["url"])), F.lit(site))})
    iso = F.concat(F.date_format("starts_at", "yyyy-MM-dd'T'HH:mm:ss"), utc_offset(c("starts_at"), c("zone")))
    token = F.concat_ws(":", F.lit(C.SIMPLEVIEW_KEY), _text(n["id"]), _text(n["date"]), F.coalesce(_some(c("_time")), F.lit("all_day")))
    address = F.array_join(F.filter(F.array(_text(n["street"]), _text(n["city"]), _text(n["state"])), lambda p: F.length(p) > 0), ", ")
    return _finish(
        rows, title=_titled(_text(n["title"])), starts_at=c("starts_at"), all_day=c("_time") == "",
        location_name=F.coalesce(_some(_text(n["place"])), _some(_text(n["place2"]))), location_address=_some(address),
        description=_some(_text(n["description"])), event_url=c("_url"), external_id=_some(_text(n["id"])),
        given_hash=F.when(_text(n["id"]) != "", token).when(c("_url").isNotNull(), F.sha1(F.concat_ws("|", c("_url"), iso).cast("binary"))))


def utc_offset(local: Column, zone: Column) -> Column:
    """+hh:mm of a wall-clock time in its zone."""
    minutes = F.timestamp_diff("MINUTE", to_utc(local, zone), local)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60))


def json_libcal(payloads: DataFrame, list_path: str = "", names: dict[str, str] | None = None, year: int = 1970) -> DataFrame:
    """Library calendar: never all-day, double slashes in URLs collapse."""
    n = {"id": "id", "start": "event_start", "raw_start": "raw_start_time", "end": "event_end", "raw_end": "raw_end_time", "url": "url",
         "long": "long_description", "short": "description", "place": "location", "library": "library", "title": "title", **(names or {})}
    c = F.col
    first = lambda a, b: F.coalesce(_some(_text(n[a])), _some(_text(n[b])))
    rows = json_items(payloads, list_path).withColumns({"_s": _when(first("start", "raw_start"), year), "_e": _when(first("end", "raw_end"), year)})
    key = F.concat_ws(":", F.lit(C.LIBCAL_KEY), _some(_text(n["id"])), _some(_text(n["start"])))
    return _finish(
        rows, title=_titled(_text(n["title"])), starts_at=c("_s.starts_at"), ends_at=c("_e.starts_at"), all_day=F.lit(False),
        location_name=first("place", "library"), description=first("long", "short"),
        event_url=F.regexp_replace(absolute_url(_some(_text(n["url"])), c("request_url")), "(?<!:)/{2,}", "/"), external_id=_some(_text(n["id"])),
        given_hash=F.when(_text(n["id"]) != "", F.sha1(key.cast("binary"))))


# --- HTML --------------------------------------------------------------------

def html_list_events(payloads: DataFrame, item: str, title: str, date: str, time: str | None = None, location: str | None = None,
                     link: str = "a", link_attr: str = "href", datetime: str | None = None, datetime_attr: str = "datetime", max_items: int = 0,
                     details: DataFrame | None = None, year: int = 1970) -> DataFrame:
    """Events of list pages. A datetime attribute beats the texts.

    ``details`` (event_url, detail_title, detail_location, detail_description,
    detail_starts_at, detail_ends_at, detail_all_day; one row per URL) fills title and place
    where the list has none and overrides the date.
    """
    c = F.col
    text = lambda sel: H.first_text(c("_b"), sel) if sel else F.lit("")
    stamp = H.first_attribute(c("_b"), datetime or time, datetime_attr) if (datetime or time) else F.lit("")
    rows = payloads.select(*HEAD, "zone", F.posexplode(H.blocks(c("body"), item)).alias("pos", "_b")).withColumns({
        "_title": text(title), "_date": text(date), "_time": text(time), "_place": text(location), "_stamp": stamp,
        "event_url": absolute_url(_some(H.first_attribute(c("_b"), link, link_attr)), c("request_url"))})
    when = F.when(c("_stamp") != "", parse_iso_date(c("_stamp"), c("zone"), F.lit(year))).otherwise(
        parse_event_date(c("_date"), c("_time"), c("zone"), F.lit(year)))
    rows = rows.withColumn("_when", when).drop("_b")
    names = ["detail_title", "detail_location", "detail_description", "detail_starts_at", "detail_ends_at", "detail_all_day"]
    if details is None:
        for n in names:
            kind = "timestamp_ntz" if n.endswith("_at") else "boolean" if n.endswith("day") else "string"
            rows = rows.withColumn(n, F.lit(None).cast(kind))
    else:
        rows = rows.join(details, "event_url", "left")
    own = c("detail_starts_at").isNull()
    found = _finish(
        rows, title=_titled(F.coalesce(_some(c("_title")), c("detail_title"))), starts_at=F.coalesce(c("detail_starts_at"), c("_when.starts_at")),
        ends_at=F.when(own, c("_when.ends_at")).otherwise(c("detail_ends_at")), all_day=F.when(own, c("_when.all_day")).otherwise(c("detail_all_day")),
        location_name=F.coalesce(_some(c("_place")), c("detail_location")), description=c("detail_description"), event_url=c("event_url"))
    return cap_per_payload(found, max_items)


def cap_per_payload(items: DataFrame, max_items: int) -> DataFrame:
    """All items; or, if the caller gives a maximum, the first ones of each payload, with ``n_items``, the number before the cut."""
    from pyspark.sql import Window as W

    if max_items <= 0:
        return items
    c = F.col
    all_ = items.groupBy(c("payload_id").alias("_payload")).agg(F.count("*").alias("n_items"))
    first = items.withColumn("_rn", F.row_number().over(W.partitionBy("payload_id").orderBy("pos"))).filter(c("_rn") <= max_items).drop("_rn")
    return first.join(all_, c("payload_id").eqNullSafe(c("_payload"))).drop("_payload")


CLOCK_TOKEN = r"(?i)(?<![A-Za-z0-9_])\d{1,2}(?::\d{2})?\s*(?:am|pm)(?![A-Za-z0-9_])"


def chamber_events(payloads: DataFrame, max_items: int = 0, year: int = 1970) -> DataFrame:
    """Events whose meta line holds date, time and place in one string."""
    c = F.col
    rows = payloads.select(*HEAD, "zone", F.posexplode(H.blocks(c("body"), ".event")).alias("pos", "_b")).withColumns({
        "_title": H.first_text(c("_b"), "h3.name"), "_link": H.first_attribute(c("_b"), ".name a", "href"),
        "_place": H.first_text(c("_b"), "span.location"), "_meta": H.first_text(c("_b"), "div.meta"),
        "_year": H.attribute(c("_b"), "data-year"), "_text": H.first_text(c("_b"), "p.description_short")}).drop("_b")
    tail = F.when((c("_place") != "") & c("_meta").endswith(c("_place")), F.substr(c("_meta"), F.lit(1), F.length("_meta") - F.length("_place"))).otherwise(c("_meta"))
    rows = rows.withColumn("_m", trim_all(F.regexp_replace(tail, r"[-\s]+$", "")))
    split = lambda i: F.regexp_extract(c("_m"), rf"(?s)^(.*?)({CLOCK_TOKEN}.*)$", i)
    timed = c("_m").rlike(CLOCK_TOKEN)
    date = F.regexp_replace(F.when(timed, split(1)).otherwise(c("_m")), r"[,\s-]+$", "")
    date = F.when((c("_year") != "") & ~date.rlike(r"(?<![A-Za-z0-9_])\d{4}(?![A-Za-z0-9_])"), F.trim(F.concat_ws(" ", _some(date), c("_year")))).otherwise(date)
    time = F.when(timed, F.regexp_replace(split(2), r"^[-\s]+|[-\s]+$", "")).otherwise("")
    rows = rows.withColumns({"_date": date, "_time": time, "event_url": absolute_url(_some(c("_link")), c("request_url"))})
    rows = rows.withColumn("_when", parse_event_date(c("_date"), c("_time"), c("zone"), F.lit(year)))
    rows = rows.withColumn("_iso", F.concat(F.date_format("_when.starts_at", "yyyy-MM-dd'T'HH:mm:ss"), utc_offset(c("_when.starts_at"), c("zone"))))
    found = _finish(
        rows, title=_titled(c("_title")), starts_at=c("_when.starts_at"), ends_at=c("_when.ends_at"), all_day=c("_when.all_day"),
        location_name=_some(c("_place")), description=_some(c("_text")), event_url=c("event_url"),
        given_hash=F.when(c("event_url").isNotNull(), F.sha1(F.concat_ws("|", c("event_url"), c("_iso")).cast("binary"))))
    return cap_per_payload(found, max_items)


# --- dispatch and request plans --------------------------------------------------

Parser = Callable[[DataFrame], DataFrame]


def resolve_profile(profile: Column, known: list[str], default: str = "generic") -> Column:
    return F.when(profile.isin(known), profile).otherwise(default)


def dispatch(payloads: DataFrame, parsers: dict[str, Parser], default: str = "generic") -> DataFrame:
    """Route every payload to the parser of its profile and unite the items."""
    staged = payloads.withColumn("_profile", resolve_profile(F.col("profile"), list(parsers), default))
    out = None
    for name, parse in parsers.items():
        part = parse(staged.filter(F.col("_profile") == name)).withColumn("profile", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def month_requests(sources: DataFrame, as_of: Column) -> DataFrame:
    """One request URL per source and month.

    Needs id, url_template with {year} and {month}, months_forward, start_month
    text (null or a word like current means the month of ``as_of``), month_query map.
    """
    c = F.col
    word = F.lower(F.trim("start_month"))
    named = F.when(~word.isin("", "current", "now", "today"), parse_moment(F.when(word.rlike(r"^\d{4}-\d{1,2}$"), F.concat(word, F.lit("-01"))).otherwise(word), F.lit("UTC"), F.year(as_of)).cast("date"))
    first = F.trunc(F.coalesce(named, as_of.cast("date")), "MONTH")
    months = F.sequence(first, F.add_months(first, c("months_forward") - 1), F.expr("interval 1 month"))
    rows = sources.filter("months_forward > 0").select("*", F.posexplode(months).alias("month_no", "month"))
    url = F.replace(F.replace(c("url_template"), F.lit("{year}"), F.date_format("month", "yyyy")), F.lit("{month}"), F.date_format("month", "M"))
    own = F.filter(F.split(F.coalesce(F.regexp_extract(url, r"\?(.*)$", 1), F.lit("")), "&"),
                   lambda p: (F.length(p) > 0) & ~F.array_contains(F.map_keys("month_query"), F.split_part(p, F.lit("="), F.lit(1))))
    added = F.transform(F.map_entries("month_query"), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])))
    merged = F.array_join(F.concat(own, added), "&")
    full = F.when(F.cardinality("month_query") == 0, url).otherwise(F.concat(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("?"), merged))
    return rows.select("id", "month_no", full.alias("request_url"))
