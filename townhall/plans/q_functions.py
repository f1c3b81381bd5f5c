"""Queries over the column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from townhall.functions import dates, scalars, text, urls
from townhall.plans.fixtures import with_views
from townhall.plans.registry import query, stamp, stamp_sql

SQUISH = lambda e: f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
BLANK = lambda e: f"nullif(regexp_replace({e}, '^\\s+|\\s+$', '', 'g'), '')"
LOC = lambda e: f"nullif({SQUISH(f'replace({e}, chr(92), chr(39)[1:0])')}, '')"


@query("norm_title", with_views(f"SELECT pos, lower({SQUISH('title')}) AS title_norm FROM v_event_item", "v_event_item"))
def _(s):
    return s.wide("v_event_item", "lineitem").select("pos", text.norm_title(F.col("title")).alias("title_norm"))


NORM_LOC = f"lower({SQUISH('concat_ws(chr(32), ' + LOC('location_name') + ', ' + LOC('location_address') + ')')})"


@query("norm_location", with_views(
    f"SELECT pos, {LOC('location_name')} AS name_clean, {LOC('location_address')} AS address_clean, {NORM_LOC} AS location_norm FROM v_event_item", "v_event_item"))
def _(s):
    n, a = text.clean_location(F.col("location_name")), text.clean_location(F.col("location_address"))
    return s.wide("v_event_item", "lineitem").select(
        "pos", n.alias("name_clean"), a.alias("address_clean"), text.norm_location(n, a).alias("location_norm"))


@query("absolute_url", with_views("""
SELECT pos, CASE WHEN event_url IS NULL THEN NULL WHEN event_url LIKE 'http%' THEN event_url
  WHEN event_url LIKE '/%' THEN regexp_extract(feed_url, '^https://[^/]+') || event_url
  ELSE regexp_replace(feed_url, '/[^/]*$', '/') || event_url END AS url_abs,
  'https:' || '//cdn.example.org/x' AS url_scheme FROM v_event_item""", "v_event_item"))
def _(s):
    return s.wide("v_event_item", "lineitem").select(
        "pos", urls.absolute_url(F.col("event_url"), F.col("feed_url")).alias("url_abs"),
        urls.absolute_url(F.lit("//cdn.example.org/x"), F.col("feed_url")).alias("url_scheme"))


@query("url_equal", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE
  coalesce(regexp_extract(url, '[?]([^#]*)', 1), '') = '' END AS same FROM pages""")
def _(s):
    u = F.col("url")
    flipped = F.concat(
        F.regexp_extract(u, r"^([^?#]*)", 1),
        F.when(u.contains("?"), F.concat(F.lit("?"), F.array_join(F.reverse(F.split(urls.query(u), "&")), "&"))).otherwise(""))
    other = F.when(F.col("page_id") % 3 == 0, flipped).when(F.col("page_id") % 3 == 1, F.concat(u, F.lit("/x"))).otherwise(
        F.regexp_extract(u, r"^([^?#]*)", 1))
    # A fragment is not part of the comparison, so the suffix goes before it.
    other = F.when(F.col("page_id") % 3 == 1, F.regexp_replace(u, r"^(https?://[^/?#]+)", "$1.example")).otherwise(other)
    return s.table("pages").select("page_id", urls.url_equal(u, other).alias("same"))


@query("strip_query", """
SELECT page_id, split_part(url, '?', 1) AS base,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages""")
def _(s):
    params = urls.query_params(F.col("url"))
    return s.table("pages").select(
        "page_id", urls.strip_query(F.col("url")).alias("base"), params["page"].alias("page"), params["ref"].alias("ref"))


@query("slugify", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(replace(
  translate(lower(text), '{text.FOLD_FROM}', '{text.FOLD_TO}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '_+', '-', 'g'), '@', '-at-'),
  '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents""")
def _(s):
    return s.table("documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("limit_text", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN regexp_replace(substring(text, 1, 200), '\\s+$', '') || '...' ELSE text END AS short FROM documents""")
def _(s):
    return s.table("documents").select("doc_id", text.limit_text(F.col("text"), 200).alias("short"))


@query("first_sentence", """
SELECT doc_id, regexp_replace(text, '([.!?])\\s(.|\\n)*$', '\\1') AS unused,
  CASE WHEN regexp_matches(text, '[.!?]\\s') THEN regexp_extract(text, '^((?s:.*?)[.!?])\\s', 1) ELSE text END AS sentence
FROM documents""".replace("regexp_replace(text, '([.!?])\\s(.|\\n)*$', '\\1') AS unused,\n  ", ""))
def _(s):
    return s.table("documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("html_to_text", """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?i)<\\s*br\\s*/?>', chr(10), 'g'), '(?i)</\\s*(p|div|li|tr|h[1-6])\\s*>', chr(10) || chr(10), 'g'),
  '<[^>]*>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS plain FROM pages""")
def _(s):
    return s.table("pages").select("page_id", text.html_to_text(F.col("html")).alias("plain"))


@query("meaningful_length", """
SELECT doc_id, length(regexp_replace(text, '[\\p{C}\\s]+', '', 'g')) AS n FROM documents""")
def _(s):
    return s.table("documents").select("doc_id", text.meaningful_length(F.col("text")).alias("n"))


@query("clean_newlines", """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', chr(13) || chr(10) || chr(10) || chr(13)),
  '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM documents""")
def _(s):
    raw = F.replace("text", F.lit(". "), F.lit("\r\n\n\r"))
    return s.table("documents").select("doc_id", text.clean_newlines(raw).alias("cleaned"))


def _parts(r, *keep):
    return [*keep, stamp(r["starts_at"]).alias("starts_at"), stamp(r["ends_at"]).alias("ends_at"), r["all_day"].alias("all_day")]


@query("parse_event_date", with_views(f"""
SELECT id, {stamp_sql('''CASE shape WHEN 0 THEN day + interval 19 hour WHEN 1 THEN day WHEN 2 THEN moment_day WHEN 3 THEN day
    WHEN 4 THEN day + interval 9 hour WHEN 5 THEN moment WHEN 6 THEN NULL
    ELSE make_timestamp(1998, month(day), day_n, 18, 15, 0) END''')} AS starts_at,
  {stamp_sql('''CASE shape WHEN 0 THEN day + interval 20 hour + interval 30 minute WHEN 4 THEN day + interval 11 hour + interval 30 minute
    WHEN 7 THEN make_timestamp(1998, month(day), day_n, 19, 45, 0) END''')} AS ends_at,
  CASE WHEN shape = 6 THEN NULL WHEN shape = 7 AND month(day) = 2 AND day_n = 29 THEN NULL ELSE shape IN (1, 3) END AS all_day
FROM (SELECT *, day + (moment - date_trunc('day', moment)) AS moment_day, extract(day FROM day) AS day_n FROM v_date_text
      WHERE NOT (shape = 7 AND month(day) = 2 AND extract(day FROM day) = 29))
UNION ALL SELECT id, NULL, NULL, NULL FROM v_date_text WHERE shape = 7 AND month(day) = 2 AND extract(day FROM day) = 29""", "v_date_text"))
def _(s):
    r = dates.parse_event_date(F.col("date_text"), F.col("time_text"), F.col("zone"), F.lit(1998))
    return s.view("v_date_text").select("id", r.alias("r")).select(*_parts(F.col("r"), "id"))


@query("parse_iso_date", with_views(f"""
SELECT id, {stamp_sql("CASE WHEN id % 4 = 1 THEN day ELSE moment END")} AS starts_at, cast(NULL as varchar) AS ends_at, id % 4 = 1 AS all_day FROM v_date_text""", "v_date_text"))
def _(s):
    r = dates.parse_iso_date(F.col("iso_text"), F.col("zone"), F.lit(1998))
    return s.view("v_date_text").select("id", r.alias("r")).select(*_parts(F.col("r"), "id"))


@query("parse_ics_date", with_views(f"""
SELECT id, {stamp_sql('''CASE id % 3 WHEN 0 THEN day WHEN 1 THEN (moment AT TIME ZONE 'UTC') AT TIME ZONE coalesce(tzid, zone) ELSE moment END''')} AS starts_at,
  cast(NULL as varchar) AS ends_at, id % 3 = 0 AS all_day FROM v_date_text""", "v_date_text"))
def _(s):
    r = dates.parse_ics_date(F.col("ics_text"), F.col("tzid"), F.col("zone"))
    return s.view("v_date_text").select("id", r.alias("r")).select(*_parts(F.col("r"), "id"))


LOCAL_START = """CASE WHEN date IS NULL OR date = 'soon' THEN NULL
  ELSE (cast(date as timestamp) + CASE WHEN time IS NULL THEN interval 12 hour WHEN time = '18:30' THEN interval 1110 minute ELSE interval 18 hour END)
       AT TIME ZONE timezone AT TIME ZONE 'UTC' END"""


@query("parse_local_datetime", with_views(f"""
SELECT o.pos, {stamp_sql(LOCAL_START)} AS starts_at, time IS NOT NULL AND date IS NOT NULL AND date <> 'soon' AS has_time
FROM v_opportunity o JOIN v_city c ON c.id = o.city_id""", "v_opportunity", "v_city"))
def _(s):
    r = dates.parse_local_datetime(F.col("date"), F.col("time"), F.col("timezone"), F.lit(1998))
    city = s.view("v_city").select(F.col("id").alias("city_id"), "timezone")
    return s.view("v_opportunity").join(city, "city_id").select(
        "pos", r.alias("r")).select("pos", stamp(F.col("r.starts_at")).alias("starts_at"), F.col("r.has_time").alias("has_time"))


@query("value_hash", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sha1('{' || CASE WHEN l_partkey % 2 = 0 THEN '"name":"' || p_name || ' / é"' ELSE '"address":"' || p_brand || '","name":"' || p_name || ' / é"' END || '}') AS value_hash
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(s):
    j = s.table("lineitem").join(s.table("part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    h = scalars.json_hash({
        "name": F.concat(F.col("p_name"), F.lit(" / é")),
        "address": F.when(F.col("l_partkey") % 2 == 1, F.col("p_brand")),
    })
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", h.alias("value_hash"))


EVENT_HASH = f"""CASE WHEN regexp_full_match({BLANK('given_hash')}, '[0-9a-fA-F]{{40}}') THEN lower({BLANK('given_hash')})
  WHEN {BLANK('given_hash')} IS NOT NULL THEN sha1({BLANK('given_hash')})
  ELSE sha1(cast(e.city_id as varchar) || '|' || lower({SQUISH('title')}) || '|'
    || strftime(starts_at_local AT TIME ZONE timezone AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || '|' || {NORM_LOC}) END"""
EVENT_CTE = f"""hashed AS (SELECT e.*, timezone, {EVENT_HASH} AS source_hash FROM v_event_item e JOIN v_city c ON c.id = e.city_id
  WHERE {BLANK('title')} IS NOT NULL AND starts_at_local IS NOT NULL)"""


@query("source_hash", with_views("SELECT pos, source_hash FROM hashed", "v_event_item", "v_city", extra=EVENT_CTE))
def _(s):
    from townhall.operators.events import normalize_events

    city = s.view("v_city").select(F.col("id").alias("city_id"), "timezone")
    return normalize_events(s.wide("v_event_item", "lineitem"), city).select("pos", "source_hash")


@query("clean_string", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'x ' || l_suppkey END AS cleaned,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE cast(round(l_quantity) as bigint) END AS whole,
  CASE WHEN l_partkey % 4 = 0 THEN 0.0 ELSE least(1.0, l_tax * 20) END AS unit FROM lineitem""")
def _(s):
    raw = F.when(F.col("l_partkey") % 5 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  x "), F.col("l_suppkey").cast("string"), F.lit("\n")))
    num = F.when(F.col("l_partkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    conf = F.when(F.col("l_partkey") % 4 == 0, F.lit("high")).otherwise((F.col("l_tax") * 20).cast("string"))
    return s.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.blank_to_null(raw).alias("cleaned"), scalars.clean_number(num).alias("whole"),
        scalars.clamp01(conf).alias("unit"))


@query("normalize_evidence", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS n_quotes,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'quote ' || o_custkey END AS quote,
  CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS start_at FROM orders""")
def _(s):
    k = F.col("o_orderkey")
    item = F.struct(
        F.when(k % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" quote "), F.col("o_custkey").cast("string"))).alias("quote"),
        F.when(k % 3 == 1, F.col("o_custkey").cast("string")).otherwise(F.lit("later")).alias("start"),
        F.lit(None).cast("string").alias("end"))
    e = scalars.normalize_evidence(F.array(item, F.struct(F.lit(None).cast("string").alias("quote"), F.lit("1").alias("start"), F.lit("2").alias("end"))))
    return s.table("orders").select("o_orderkey", e.alias("e")).select(
        "o_orderkey", F.size("e").alias("n_quotes"), F.try_element_at("e", F.lit(1))["quote"].alias("quote"),
        F.try_element_at("e", F.lit(1))["start"].alias("start_at"))


@query("normalize_bullets", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 5 END AS n, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Cost' END AS label,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_custkey as varchar) END AS value,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'point ' || o_orderkey END AS text FROM orders""")
def _(s):
    k = F.col("o_orderkey").cast("string")
    doc = F.when(F.col("o_orderkey") % 4 == 0, F.lit('["  ", {"label":" "}, 5]')).otherwise(F.concat(
        F.lit('[{"label":"Cost","value":" '), F.col("o_custkey").cast("string"), F.lit('"}," point '), k,
        F.lit(' ",{"text":"t"},{"label":"only"},"d","e","f"]')))
    b = scalars.normalize_bullets(F.parse_json(doc).cast("array<variant>"))
    return s.table("orders").select("o_orderkey", b.alias("b")).select(
        "o_orderkey", F.when(F.col("b").isNotNull(), F.size("b")).alias("n"), F.try_element_at("b", F.lit(1))["label"].alias("label"),
        F.try_element_at("b", F.lit(1))["value"].alias("value"), F.try_element_at("b", F.lit(2))["text"].alias("text"))


@query("normalize_evidence_map", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'why_it_matters' ELSE NULL END AS sections,
  CASE WHEN o_orderkey % 2 = 0 THEN 'q' || o_custkey END AS quote FROM orders""")
def _(s):
    ev = lambda q: F.array(F.struct(q.alias("quote"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end")))
    m = F.create_map(
        F.lit("whats_happening"), ev(F.lit(" ")),
        F.lit("why_it_matters"), ev(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("q"), F.col("o_custkey").cast("string")))))
    r = scalars.normalize_evidence_map(m)
    return s.table("orders").select("o_orderkey", r.alias("r")).select(
        "o_orderkey", F.when(F.col("r").isNotNull(), F.array_join(F.map_keys("r"), ",")).alias("sections"),
        F.col("r")["why_it_matters"][0]["quote"].alias("quote"))


@query("location_line", with_views("""
SELECT pos, CASE WHEN trim(location) = '' THEN NULL ELSE trim(split_part(location, ',', 1)) || ', ' || trim(split_part(location, ',', 2)) END AS line FROM v_opportunity""", "v_opportunity"))
def _(s):
    return s.view("v_opportunity").select("pos", text.location_line(F.col("location")).alias("line"))


@query("is_document_url", with_views("""
SELECT pos, coalesce(lower(url) LIKE '%.pdf%' OR lower(url) LIKE '%download%', false) AS is_document FROM v_opportunity""", "v_opportunity"))
def _(s):
    return s.view("v_opportunity").select("pos", urls.is_document_url(F.col("url")).alias("is_document"))


@query("calendar_link", with_views("""
SELECT id, 'https://www.google.com/calendar/render?' || concat_ws('&', 'action=TEMPLATE', 'text=' || replace(title, ' ', '%20'),
  'dates=' || strftime(starts_at, '%Y%m%dT%H%M%SZ') || '%2F' || strftime(starts_at + interval 1 hour, '%Y%m%dT%H%M%SZ'),
  'details=' || replace(replace(event_url, ':', '%3A'), '/', '%2F')) AS link FROM v_event""", "v_event"))
def _(s):
    return s.view("v_event").select("id", urls.calendar_link(
        F.col("starts_at"), F.lit(None).cast("timestamp_ntz"), F.col("title"), F.lit(None).cast("string"), F.col("event_url")).alias("link"))


@query("extract_urls", with_views("""
SELECT article_id, array_to_string(list_distinct(regexp_extract_all(cleaned_text, '(?i)https?://[^\\s)]+')), ' ') AS urls FROM civic_text""", "civic_text"))
def _(s):
    return s.view("civic_text").select("article_id", F.array_join(text.extract_urls(F.col("cleaned_text")), " ").alias("urls"))
