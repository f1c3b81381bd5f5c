"""Queries over feed parsing. The oracles compute the items from the base tables the payloads were built from."""

from __future__ import annotations

from pyspark.sql import functions as F

from townhall.sources import calendars as CAL
from townhall.sources import feeds, imports
from townhall.plans.fixtures import with_views
from townhall.plans.registry import query, stamp, stamp_sql

SRC = """src AS (SELECT o.*, o_orderkey AS k, o_orderkey // 10 AS payload_id, (o_orderkey // 10) % (SELECT count(*) FROM supplier) + 1 AS source_id, timezone,
  'https://feed.example.org/list/' || (o_orderkey // 10) || '/index' AS request_url, 'https://feed.example.org/list/' || (o_orderkey // 10) || '/' AS folder,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate + to_minutes(cast(o_orderkey % 48 * 30 as int)), '%Y-%m-%dT%H:%M:%S') END AS start_text,
  CASE WHEN o_orderkey % 6 = 1 THEN o_orderdate ELSE o_orderdate + to_minutes(cast(o_orderkey % 48 * 30 as int)) END AS start_at
  FROM orders o JOIN v_city c ON c.id = (o_orderkey // 10) % 25 + 1)"""


def _sql(select, extra=""):
    return with_views(select, "v_city", extra=SRC + extra)


def _payloads(s, name):
    zone = s.view("v_city").select(F.col("id").alias("city_id"), F.col("timezone").alias("zone"))
    return s.view(name).join(zone, "city_id", "left")


@query("rss_articles", _sql("""SELECT payload_id, 'News ' || k AS title, 'Short ' || o_custkey AS summary, 'https://n.example.org/' || k AS canonical_url,
  sha256(CASE WHEN k % 3 = 0 THEN 'Full text ' || k ELSE 'Short ' || o_custkey END) AS content_hash, strftime(o_orderdate + interval 6 hour, '%Y-%m-%d %H:%M:%S') AS published_at, 'g-' || k AS source_uid
FROM src WHERE k % 17 <> 0"""))
def _(s):
    r = feeds.rss_articles(s.view("v_payload_rss"))
    return r.select("payload_id", "title", "summary", "canonical_url", "content_hash", stamp("published_at").alias("published_at"), "source_uid")


@query("rss_counts", _sql("""SELECT payload_id, count(*) AS found, count(*) FILTER (k % 17 = 0) AS incomplete, greatest(count(*) FILTER (k % 17 <> 0) - 4, 0) AS cut,
  least(count(*) FILTER (k % 17 <> 0), 4) AS written FROM src GROUP BY 1"""))
def _(s):
    return feeds.rss_counts(s.view("v_payload_rss"), max_items=4).drop("source_id", "city_id", "request_url")


LINKS = """, links AS (SELECT *, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '/stories/' || k % 5 WHEN 2 THEN 'a/' || k WHEN 3 THEN '//cdn.example.org/' || k WHEN 4 THEN 'https://docs.google.com/d/' || k % 4 ELSE 'Archive.aspx?ADID=' || k % 3 END AS href,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://feed.example.org/stories/' || k % 5 WHEN 2 THEN folder || 'a/' || k WHEN 3 THEN 'https://cdn.example.org/' || k WHEN 4 THEN 'https://docs.google.com/d/' || k % 4 ELSE folder || 'Archive.aspx?ADID=' || k % 3 END AS url,
  CASE WHEN k % 7 = 0 THEN 'Story' ELSE 'Story ' || k END AS title FROM src)"""


@query("listing_links", _sql("SELECT payload_id, url, arg_min(title, k) AS title FROM links WHERE url IS NOT NULL GROUP BY 1, 2", LINKS))
def _(s):
    return feeds.listing_links(s.view("v_listing_page"), "li a.story").select("payload_id", "url", "title")


@query("listing_counts", _sql("""SELECT payload_id, count(*) AS found, count(*) FILTER (url IS NULL) AS invalid, count(url) - count(DISTINCT url) AS duplicate,
  greatest(count(DISTINCT url) - 3, 0) AS cut, least(count(DISTINCT url), 3) AS written FROM links GROUP BY 1""", LINKS))
def _(s):
    return feeds.listing_counts(s.view("v_listing_page"), "li a.story", max_links=3).drop("source_id", "city_id", "request_url")


H1 = "trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query("article_pages", f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'OG ' || page_id WHEN page_id % 4 = 0 THEN 'TW ' || page_id ELSE {H1} END AS title,
  CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^https?://[^/?#]+') || '/canon/' || page_id WHEN page_id % 5 = 0 THEN 'https://og.example.org/' || page_id ELSE url END AS canonical_url,
  CASE page_id % 3 WHEN 1 THEN '2024-06-0' || (page_id % 9 + 1) || ' 12:00:00' WHEN 2 THEN '2024-07-0' || (page_id % 9 + 1) || ' 00:00:00' END AS published_at,
  CASE WHEN page_id % 2 = 1 THEN 'About ' || page_id END AS summary FROM pages""")
def _(s):
    return feeds.article_pages(s.view("v_page")).select("page_id", "title", "canonical_url", stamp("published_at").alias("published_at"), "summary")


VISIBLE = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g')"
BLOCKS = lambda tag: f"list_transform(regexp_extract_all(art, '(?is)<{tag}(?:[\\s/][^>]*)?>.*?</{tag}\\s*>'), lambda x: trim(regexp_replace(DECODE(regexp_replace(x, '<[^>]*>', '', 'g')), '\\s+', ' ', 'g')))"


def _decode(sql):
    from townhall.functions.html import ENTITIES

    import re
    def wrap(inner):
        for name, text in ENTITIES.items():
            text = text.replace("'", "''")
            inner = f"replace({inner}, '{name}', '{text}')"
        return inner
    return sql.replace("DECODE(regexp_replace(x, '<[^>]*>', '', 'g'))", wrap("regexp_replace(x, '<[^>]*>', '', 'g')"))


@query("page_body_text", _decode(f"""SELECT page_id, length(t) AS n, sha1(t) AS text_hash FROM (SELECT page_id, array_to_string(list_filter(list_concat({', '.join(BLOCKS(t) for t in ('h1', 'h2', 'h3', 'p', 'li'))}), lambda x: x <> ''), chr(10) || chr(10)) AS t
 FROM (SELECT page_id, regexp_extract({VISIBLE}, '(?is)<article[^>]*>(.*?)</article>', 1) AS art FROM pages))"""))
def _(s):
    r = s.table("pages").select("page_id", feeds.body_text(F.col("html")).alias("t"))
    return r.select("page_id", F.length("t").alias("n"), F.sha1(F.col("t").cast("binary")).alias("text_hash"))


@query("content_type", """SELECT content_type, count(*) AS n FROM (SELECT CASE WHEN len(regexp_extract_all(text, '[A-Za-z''-]+')) >= 80 OR length(text) >= 600 THEN 'full' ELSE 'snippet' END AS content_type FROM documents) GROUP BY 1""")
def _(s):
    return s.table("documents").select(feeds.content_type(F.col("text")).alias("content_type")).groupBy("content_type").agg(F.count("*").alias("n"))


@query("archive_pdf_links", _sql("""SELECT payload_id, k % 10 AS pos, url, outcome, CASE WHEN outcome = 'item' AND k % 6 = 5 THEN cast(k % 3 as varchar) END AS source_uid FROM (
  SELECT *, CASE WHEN href NOT LIKE '%a%' THEN 'unmatched_href' WHEN r > 3 THEN 'max_links' WHEN k = fk THEN 'item' ELSE 'duplicate' END AS outcome
  FROM (SELECT *, dense_rank() OVER (PARTITION BY payload_id, href LIKE '%a%' ORDER BY fk) AS r FROM (SELECT *, min(k) OVER (PARTITION BY payload_id, url) AS fk FROM links)))""", LINKS))
def _(s):
    outcomes = feeds.archive_outcomes(s.view("v_listing_page"), "a", max_links=3)
    items = feeds.archive_pdf_links(outcomes).select("payload_id", "pos", "source_uid")
    return outcomes.select("payload_id", "pos", "url", "outcome").join(items, ["payload_id", "pos"], "left")


@query("documenters_links", _sql("""SELECT DISTINCT payload_id, url, strftime(day, '%Y-%m-%d') AS meeting_date FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY payload_id) AS day FROM links) WHERE k % 6 = 4""", LINKS))
def _(s):
    r = feeds.documenters_links(s.view("v_listing_page"), "https://docs.example.org")
    return r.select("payload_id", "url", F.date_format("meeting_date", "yyyy-MM-dd").alias("meeting_date"))


ICS = """SELECT payload_id, k % 10 AS pos, CASE WHEN k % 13 = 0 THEN 'second value' ELSE 'Meeting' || k END AS title,
  strftime(CASE k % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN (o_orderdate + to_hours(cast(k % 24 as int))) AT TIME ZONE 'UTC' AT TIME ZONE timezone ELSE o_orderdate + to_hours(cast(k % 24 as int)) END, '%Y-%m-%d %H:%M:%S') AS starts_at,
  CASE WHEN k % 3 = 2 THEN strftime(o_orderdate + to_hours(cast(k % 24 + 1 as int)), '%Y-%m-%d %H:%M:%S') END AS ends_at, k % 3 = 0 AS all_day, 'u-' || k AS external_id FROM src"""


@query("ics_events", _sql(ICS))
def _(s):
    r = CAL.ics_events(_payloads(s, "v_payload_ics"))
    return r.select("payload_id", "pos", "title", stamp("starts_at").alias("starts_at"), stamp("ends_at").alias("ends_at"), "all_day", "external_id")


@query("ics_url_location_fix", _sql("""SELECT payload_id, k % 10 AS pos, event_url, CASE WHEN k % 4 = 0 THEN concat_ws(chr(10) || chr(10), d, '<b>Hall</b>') ELSE d END AS description, CASE WHEN k % 4 = 1 THEN 'Hall ' || k % 9 END AS location_name
FROM (SELECT *, CASE WHEN k % 2 = 1 THEN folder || 'sub/' || k WHEN k % 5 = 0 THEN 'https://feed.example.org/event/' || k ELSE request_url END AS event_url,
  CASE k % 5 WHEN 0 THEN CASE WHEN k % 2 = 1 THEN '/event/' || k END WHEN 1 THEN 'Some words here' END AS d FROM src)"""))
def _(s):
    return CAL.ics_events(_payloads(s, "v_payload_ics")).select("payload_id", "pos", "event_url", "description", "location_name")


def _rss_configs(s):
    return s.view("v_event_source").select(
        F.col("id").alias("source_id"), F.when(F.col("id") % 2 == 0, F.lit(r"on (?P<datetime>\d{4}-\d{2}-\d{2} \d{2}:\d{2})")).alias("regex"),
        F.when(F.col("id") % 4 == 0, F.lit("Y-m-d H:i")).alias("format"), (F.col("id") % 6 == 0).alias("all_day"))


@query("rss_events", _sql("""SELECT payload_id, title, external_id, event_url, all_day, strftime(at, '%Y-%m-%d %H:%M:%S') AS starts_at FROM (SELECT payload_id, 'Show ' || k || CASE WHEN k % 3 = 0 THEN ' on ' || strftime(o_orderdate, '%Y-%m-%d') || ' 18:30' ELSE '' END AS title,
  'e-' || k AS external_id, 'https://feed.example.org/e/' || k AS event_url, NOT (k % 3 = 0 AND source_id % 2 = 0) OR source_id % 6 = 0 AS all_day,
  o_orderdate + CASE WHEN k % 3 = 0 AND source_id % 2 = 0 AND source_id % 6 <> 0 THEN interval 1110 minute ELSE interval 0 minute END AS at FROM src WHERE k % 3 <> 2)""".replace(" AS at FROM", " AS tat FROM").replace("strftime(at,", "strftime(tat,")))
def _(s):
    r = CAL.rss_events(_payloads(s, "v_payload_rss_events"), _rss_configs(s))
    return r.select("payload_id", "title", "external_id", "event_url", "all_day", stamp("starts_at").alias("starts_at"))


JSON_URL = "CASE k % 2 WHEN 0 THEN 'https://feed.example.org/e//' || k ELSE 'https://x.example.org//e//' || k END"


@query("json_events_generic", _sql(f"""SELECT payload_id, CASE WHEN k % 12 = 0 THEN 'Untitled event' ELSE 'Event ' || k END AS title, {stamp_sql('start_at')} AS starts_at, k % 6 = 1 OR k % 7 = 0 AS all_day,
  CASE WHEN k % 5 = 0 THEN 'V0' ELSE 'Room ' || k % 5 END AS location_name, '1 Main' AS location_address, {JSON_URL} AS event_url, cast(k as varchar) AS external_id FROM src WHERE k % 6 <> 0"""))
def _(s):
    r = CAL.json_generic(_payloads(s, "v_payload_json"))
    return r.select("payload_id", "title", stamp("starts_at").alias("starts_at"), "all_day", "location_name", "location_address", "event_url", "external_id")


@query("json_events_century", _sql(f"""SELECT payload_id, cast(k as varchar) AS external_id, {stamp_sql('start_at')} AS starts_at, k % 6 = 1 AS all_day, CASE WHEN k % 3 = 0 THEN 'Arena ' || k % 7 END AS location_name,
  sha1('century2:' || k || ':' || start_text) AS given_hash FROM src WHERE k % 6 <> 0"""))
def _(s):
    names = {"id": "id", "title": "title", "description": "description", "start": "start_date", "end": "end_date", "url": "url"}
    r = CAL.json_century(_payloads(s, "v_payload_json"), "data.events", names)
    return r.select("payload_id", "external_id", stamp("starts_at").alias("starts_at"), "all_day", "location_name", "given_hash")


@query("json_events_simpleview", _sql(f"""SELECT payload_id, cast(k as varchar) AS external_id, {stamp_sql("date_trunc('day', start_at AT TIME ZONE 'UTC' AT TIME ZONE timezone) + CASE WHEN k % 3 = 0 THEN interval 0 minute ELSE interval 1170 minute END")} AS starts_at,
  k % 3 = 0 AS all_day, 'V' || k % 5 AS location_name, concat_ws(', ', '1 Main', CASE WHEN k % 4 <> 1 THEN 'Town' END, 'KS') AS location_address,
  'visitwichita:' || k || ':' || start_text || ':' || CASE WHEN k % 3 = 0 THEN 'all_day' ELSE '19:30:00' END AS given_hash FROM src WHERE k % 6 <> 0"""))
def _(s):
    names = {"id": "id", "date": "start_date", "place": "nowhere", "place2": "venue.name", "street": "venue.address"}
    r = CAL.json_simpleview(_payloads(s, "v_payload_json"), "https://visit.example.org", "data.events", names)
    return r.select("payload_id", "external_id", stamp("starts_at").alias("starts_at"), "all_day", "location_name", "location_address", "given_hash")


@query("json_events_libnet", _sql(f"""SELECT payload_id, cast(k as varchar) AS external_id, {stamp_sql('start_at')} AS starts_at, false AS all_day, CASE WHEN k % 5 = 0 THEN 'Central' ELSE 'Room ' || k % 5 END AS location_name,
  CASE k % 2 WHEN 0 THEN 'https://feed.example.org/e/' || k ELSE 'https://x.example.org/e/' || k END AS event_url, CASE WHEN k % 4 = 0 THEN 'Long' WHEN k % 3 = 0 THEN '<h4>Venue</h4><p>x</p><h4 class=v> Arena <i>' || k % 7 || '</i></h4>' END AS description,
  sha1('libnet:' || k || ':' || start_text) AS given_hash FROM src WHERE k % 6 <> 0"""))
def _(s):
    names = {"start": "start_date", "raw_start": "begin", "end": "end_date"}
    r = CAL.json_libcal(_payloads(s, "v_payload_json"), "data.events", names)
    return r.select("payload_id", "external_id", stamp("starts_at").alias("starts_at"), "all_day", "location_name", "event_url", "description", "given_hash")


@query("html_list_events", _sql(f"""SELECT payload_id, k % 10 AS pos, CASE WHEN k % 11 <> 0 THEN 'Talk & Tea ' || k WHEN k % 50 = 0 THEN 'Detail ' || k % 1000 ELSE 'Untitled event' END AS title,
  {stamp_sql("CASE WHEN k % 9 = 0 THEN o_orderdate + interval 20 hour WHEN k % 2 = 0 THEN o_orderdate + interval 10 hour ELSE o_orderdate END")} AS starts_at, NOT (k % 9 = 0 OR k % 2 = 0) AS all_day,
  CASE WHEN k % 3 <> 0 THEN 'Pier ' || k % 8 WHEN k % 50 = 0 THEN 'Detail hall' END AS location_name, 'https://feed.example.org/ev/' || k % 1000 AS event_url, CASE WHEN k % 50 = 0 THEN 'D' END AS description FROM src"""))
def _(s):
    k = F.col("o_orderkey") % 1000
    details = s.table("orders").filter("o_orderkey % 50 = 0").select(k.alias("x")).distinct().select(
        F.concat(F.lit("https://feed.example.org/ev/"), F.col("x").cast("string")).alias("event_url"), F.concat(F.lit("Detail "), F.col("x").cast("string")).alias("detail_title"),
        F.lit("Detail hall").alias("detail_location"), F.lit("D").alias("detail_description"), F.lit(None).cast("timestamp_ntz").alias("detail_starts_at"),
        F.lit(None).cast("timestamp_ntz").alias("detail_ends_at"), F.lit(None).cast("boolean").alias("detail_all_day"))
    r = CAL.html_list_events(_payloads(s, "v_payload_html"), ".event", title=".name a", date="span.date", time="span.time", location="span.location",
                             link=".name a", datetime="time", details=details)
    return r.select("payload_id", "pos", "title", stamp("starts_at").alias("starts_at"), "all_day", "location_name", "event_url", "description")


@query("chamber_events", _sql(f"""SELECT payload_id, k % 10 AS pos, {stamp_sql('st')} AS starts_at, CASE WHEN k % 4 = 0 THEN {stamp_sql('o_orderdate + interval 1230 minute')} END AS ends_at, k % 4 = 1 AS all_day,
  CASE WHEN k % 3 <> 0 THEN 'Pier ' || k % 8 END AS location_name,
  sha1(url || '|' || strftime(st, '%Y-%m-%dT%H:%M:%S') || CASE WHEN off < 0 THEN '-' ELSE '+' END || lpad(cast(abs(off) // 60 as varchar), 2, '0') || ':' || lpad(cast(abs(off) % 60 as varchar), 2, '0')) AS given_hash
FROM (SELECT *, 'https://feed.example.org/ev/' || k % 1000 AS url, cast(date_diff('minute', st AT TIME ZONE timezone AT TIME ZONE 'UTC', st) as bigint) AS off FROM (
  SELECT *, o_orderdate + CASE k % 4 WHEN 0 THEN interval 19 hour WHEN 1 THEN interval 0 hour ELSE interval 555 minute END AS st FROM src WHERE k % 4 <> 2))"""))
def _(s):
    r = CAL.chamber_events(_payloads(s, "v_payload_html"))
    return r.select("payload_id", "pos", stamp("starts_at").alias("starts_at"), stamp("ends_at").alias("ends_at"), "all_day", "location_name", "given_hash")


@query("profile_dispatch", with_views("""SELECT payload_id, CASE WHEN profile IN ('century', 'libcal', 'simpleview') THEN profile ELSE 'generic' END AS profile, count(*) AS n
FROM src JOIN v_event_source e ON e.id = source_id WHERE k % 6 <> 0 GROUP BY ALL""", "v_city", "v_event_source", extra=SRC))
def _(s):
    profiles = s.view("v_event_source").select(F.col("id").alias("source_id"), "profile")
    named = {"id": "id", "title": "title", "description": "description", "start": "start_date", "end": "end_date", "url": "url", "date": "start_date", "raw_start": "begin"}
    parsers = {
        "generic": CAL.json_generic, "century": lambda p: CAL.json_century(p, "data.events", named),
        "simpleview": lambda p: CAL.json_simpleview(p, "https://visit.example.org", "data.events", named), "libcal": lambda p: CAL.json_libcal(p, "data.events", named)}
    items = CAL.dispatch(_payloads(s, "v_payload_json").join(profiles, "source_id", "left"), parsers)
    return items.groupBy("payload_id", "profile").agg(F.count("*").alias("n"))


@query("month_request_plan", """SELECT s_suppkey + 1 AS id, m AS month_no, 'https://cal' || s_suppkey || '.example.org/' || year(d) || '/' || month(d) || '?a=1&q=x+y' AS request_url FROM (
 SELECT s_suppkey, m, CASE WHEN s_suppkey % 3 = 0 THEN date'2026-11-01' ELSE date'2026-03-01' END + to_months(cast(m as int)) AS d FROM supplier, range(4) t(m) WHERE m < s_suppkey % 5)""")
def _(s):
    k = F.col("s_suppkey")
    src = s.table("supplier").select(
        (k + 1).alias("id"), F.concat(F.lit("https://cal"), k.cast("string"), F.lit(".example.org/{year}/{month}?a=1&q=old")).alias("url_template"),
        F.least(k % 5, F.lit(4)).cast("int").alias("months_forward"), F.when(k % 3 == 0, "2026-11").when(k % 3 == 1, F.lit(" Current ")).alias("start_month"),
        F.create_map(F.lit("q"), F.lit("x y")).alias("month_query"))
    return CAL.month_requests(src, F.lit("2026-03-15 10:00:00").cast("timestamp_ntz"))


def _org_rows(s):
    k = F.col("s_suppkey")
    return s.table("supplier").select(
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(k.cast("string")).alias("id"), F.when(k % 17 == 0, F.lit("  ")).otherwise(
            F.concat(F.lit(" Café "), (k % 20).cast("string"))).alias("name"),
        F.when(k % 3 == 0, "Gov").when(k % 3 == 1, "ngo").otherwise("club").alias("type"), k.alias("pos"))


def _org_state(s):
    k = F.col("s_suppkey")
    return s.table("supplier").filter("s_suppkey % 10 = 1").select(
        k.alias("id"), F.lit(1).cast("bigint").alias("city_id"), F.lit("Old").alias("name"), F.concat(F.lit("old-name-"), k.cast("string")).alias("slug"), F.lit("other").alias("type"))


ORG_NEW = "s_suppkey % 13 <> 0 AND s_suppkey % 17 <> 0"


@query("import_organizations", f"""SELECT s_suppkey AS id, 'Café ' || s_suppkey % 20 AS name, 'cafe-' || s_suppkey % 20 || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug,
  CASE s_suppkey % 3 WHEN 0 THEN 'government' WHEN 1 THEN 'nonprofit' ELSE 'club' END AS type FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey % 20 ORDER BY s_suppkey) AS n FROM supplier WHERE {ORG_NEW})
UNION ALL SELECT s_suppkey, 'Old', 'old-name-' || s_suppkey, 'other' FROM supplier WHERE s_suppkey % 10 = 1 AND NOT ({ORG_NEW})""")
def _(s):
    return imports.import_organizations(_org_rows(s), _org_state(s), 1).select("id", "name", "slug", "type")


@query("import_counts", f"""SELECT count(*) AS total, count(*) FILTER ({ORG_NEW} AND s_suppkey % 10 <> 1) AS created, count(*) FILTER ({ORG_NEW} AND s_suppkey % 10 = 1) AS updated,
  count(*) FILTER (NOT ({ORG_NEW})) AS skipped FROM supplier""")
def _(s):
    return imports.import_counts(_org_rows(s), _org_state(s))


@query("import_scrapers", """SELECT slug, type, schedule_cron, legacy_id, is_enabled FROM (SELECT 'feed-' || s_suppkey % 30 || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug,
  CASE s_suppkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'html' WHEN 2 THEN 'api' ELSE 'unknown' END AS type,
  CASE s_suppkey % 5 WHEN 0 THEN '0 * * * *' WHEN 1 THEN '0 3 * * *' WHEN 2 THEN '0 3 * * 1' WHEN 3 THEN '0 3 1 * *' END AS schedule_cron, cast(s_suppkey as varchar) AS legacy_id, s_suppkey % 2 = 1 AS is_enabled
FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey % 30 ORDER BY s_suppkey) AS n FROM supplier))""")
def _(s):
    k = F.col("s_suppkey")
    rows = s.table("supplier").select(
        k.cast("string").alias("id"), F.concat(F.lit("Feed "), (k % 30).cast("string")).alias("name"),
        F.when(k % 4 == 0, "rss_feed").when(k % 4 == 1, "html_scrape").when(k % 4 == 2, "json_api").otherwise("fax").alias("scrape_type"),
        F.lit("https://x.example.org").alias("scrape_url"), F.when(k % 2 == 1, "True").otherwise("0").alias("is_active"),
        F.when(k % 5 == 0, "hourly").when(k % 5 == 1, "daily").when(k % 5 == 2, "weekly").when(k % 5 == 3, "monthly").alias("frequency"), k.alias("pos"))
    # Stored sources: those of the first legacy ids, which keep their slug.
    old = s.table("supplier").filter("s_suppkey < 10").select(
        F.lit(7).cast("bigint").alias("city_id"), F.concat(F.lit("feed-"), k.cast("string")).alias("slug"), F.lit("old").alias("name"), F.lit("rss").alias("type"),
        F.lit("u").alias("source_url"), F.lit(True).alias("is_enabled"), F.lit(None).cast("string").alias("schedule_cron"), k.cast("string").alias("legacy_id"))
    return imports.import_scrapers(rows, old, 7).select("slug", "type", "schedule_cron", "legacy_id", "is_enabled")


@query("article_source_text", "SELECT doc_id + 1 AS article_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN 'raw ' || doc_id ELSE 'Source text unavailable.' END AS source_text FROM documents")
def _(s):
    k = F.col("doc_id")
    b = s.table("documents").select((k + 1).alias("article_id"), F.when(k % 3 == 0, F.col("text")).alias("cleaned_text"),
                                    F.when(k % 3 == 1, F.concat(F.lit("raw "), k.cast("string"))).alias("raw_text"))
    return feeds.article_source_text(b)


@query("extraction_triage", """SELECT doc_id + 1 AS article_id,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'success' WHEN doc_id % 2 = 0 THEN 'empty' WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 5 = 1 THEN 'empty' ELSE 'ocr_success' END AS status,
  CASE WHEN doc_id % 7 = 0 THEN 'HTTP request failed (status 404)' WHEN doc_id % 11 = 0 THEN 'Non-PDF response detected' WHEN doc_id % 13 = 0 THEN 'pdftotext failed (exit code 3)' WHEN doc_id % 3 = 0 THEN NULL
    WHEN doc_id % 2 = 0 THEN 'Scanned PDF (no text layer); OCR not enabled for this scraper.' WHEN doc_id % 5 = 0 THEN 'OCR failed' WHEN doc_id % 5 = 1 THEN 'No extractable text after OCR' END AS error,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') WHEN doc_id % 2 = 1 AND doc_id % 5 > 1 THEN 'scanned ' || doc_id END AS cleaned_text FROM documents""")
def _(s):
    k = F.col("doc_id")
    r = s.table("documents").select(
        (k + 1).alias("article_id"), F.when(k % 7 == 0, 404).otherwise(200).alias("http_status"), F.when(k % 11 == 0, "text/html").otherwise("application/PDF; x").alias("content_type"),
        F.when(k % 13 == 0, 3).otherwise(0).alias("exit_code"), F.when(k % 3 == 0, F.col("text")).otherwise(F.lit(" \n\f ")).alias("text"), (k % 2 == 1).alias("ocr_enabled"),
        F.when(k % 5 == 0, "failed").otherwise("done").alias("ocr_status"), F.lit(None).cast("string").alias("ocr_error"),
        F.when(k % 5 == 1, F.lit("\n")).otherwise(F.concat(F.lit(" scanned "), k.cast("string"), F.lit("\r\n"))).alias("ocr_text"))
    return imports.extraction_triage(r)
