"""Queries over retrieval, listings, read models, schedule and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from townhall import config as C
from townhall.operators import article_view as A
from townhall.operators import checks, listings, rerank, schedule, timeline
from townhall.plans.fixtures import with_views
from townhall.plans.q_claims import _cities, _timeline, TI_CTE, as_of as claims_as_of
from townhall.plans.registry import query, stamp, stamp_sql


def at(text):
    return F.lit(text).cast("timestamp_ntz")


ACTIONABLE = " OR ".join(f"lower(question) LIKE '%{p}%'" for p in C.ACTIONABLE_PHRASES)


@query("actionable_query", with_views(f"SELECT query_id, ({ACTIONABLE}) AS actionable FROM v_query", "v_query"))
def _(s):
    return s.view("v_query").select("query_id", rerank.is_actionable(F.col("question")).alias("actionable"))


def _scored_sql(wc, wa, wt, agency="agency", time="timeliness"):
    return f"""scored AS (SELECT c.*, coalesce(civic, 0) AS civic, coalesce({agency}, 0) AS agency, coalesce({time}, 0) AS timeliness, q.city_id AS question_city,
  round(CASE WHEN {ACTIONABLE} THEN coalesce(civic, 0) * {wc} + coalesce({agency}, 0) * {wa} + coalesce({time}, 0) * {wt} ELSE coalesce(civic, 0) END, 9) AS score
  FROM v_candidate c JOIN v_question q USING (query_id) LEFT JOIN v_analysis a USING (article_id))"""


RV = ["v_candidate", "v_question", "v_analysis"]


@query("rerank", with_views("SELECT query_id, article_id, candidate_pos, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_pos) AS rank FROM scored",
    *RV, extra=_scored_sql(0.6, 0.25, 0.15, "CASE WHEN status = 'llm_done' THEN 0 ELSE agency END", "CASE WHEN status = 'llm_done' THEN 0 ELSE timeliness END")))
def _(s):
    r = rerank.rerank(s.view("v_candidate"), s.view("v_question"), s.view("v_analysis"), legacy_flat_only=True)
    return r.select("query_id", "article_id", "candidate_pos", F.round("score", 6).alias("score"), "rank")


@query("rerank_nested", with_views("SELECT query_id, article_id, candidate_pos, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_pos) AS rank FROM scored",
    *RV, extra=_scored_sql(0.6, 0.25, 0.15)))
def _(s):
    r = rerank.rerank(s.view("v_candidate"), s.view("v_question"), s.view("v_analysis"))
    return r.select("query_id", "article_id", "candidate_pos", F.round("score", 6).alias("score"), "rank")


def _evidence_sql(agency="agency", time="timeliness"):
    return with_views("""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_pos) AS rank, article_id, a.title, count(*) OVER (PARTITION BY query_id) AS n_local,
  CASE WHEN length(x) > 280 THEN regexp_replace(substring(x, 1, 280), '\\s+$', '') || '...' ELSE x END AS excerpt, u.source_url, round(score, 6) AS score
FROM scored JOIN (SELECT v.*, trim(regexp_replace(coalesce(nullif(summary, ''), nullif(cleaned_text, ''), ''), '^\\s+|\\s+$', '', 'g')) AS x FROM v_article v LEFT JOIN v_body b ON b.article_id = v.id) a ON a.id = scored.article_id
LEFT JOIN (SELECT article_id, arg_min(source_url, (created_at, id)) AS source_url FROM v_article_source GROUP BY 1) u USING (article_id)
WHERE question_city = a.city_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_pos) <= 5""",
    *RV, "v_article", "v_body", "v_article_source", extra=_scored_sql(0.55, 0.25, 0.2, agency, time))


def _evidence(s, flat):
    urls = s.view("v_article_source").groupBy("article_id").agg(F.min_by("source_url", F.struct("created_at", "id")).alias("source_url"))
    r = rerank.select_evidence(s.view("v_candidate"), s.view("v_question"), s.view("v_article"), s.view("v_body"), urls, s.view("v_analysis"), limit=5, legacy_flat_only=flat)
    return r.select("query_id", "n_local", "rank", "article_id", "title", "excerpt", "source_url", F.round("score", 6).alias("score"))


@query("select_evidence", _evidence_sql())
def _(s):
    return _evidence(s, False)


@query("select_evidence_flat", _evidence_sql("CASE WHEN status = 'llm_done' THEN 0 ELSE agency END", "CASE WHEN status = 'llm_done' THEN 0 ELSE timeliness END"))
def _(s):
    return _evidence(s, True)


@query("text_candidates", with_views("""SELECT query_id, article_id, n_words, tf, row_number() OVER (PARTITION BY query_id ORDER BY n_words DESC, tf DESC, article_id) AS candidate_pos,
  count(*) OVER (PARTITION BY query_id) AS n_found
FROM (SELECT query_id, article_id, count(*) AS n_words, sum(tf) AS tf FROM asked JOIN post USING (city_id, token) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_words DESC, tf DESC, article_id) <= 20""", "v_query", "v_article", "v_body",
    extra="""asked AS (SELECT DISTINCT query_id, city_id, unnest(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]{3,}')) AS token FROM v_query),
 words AS (SELECT id AS article_id, city_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, summary, cleaned_text)), '[\\p{L}\\p{N}]{3,}')) AS token FROM v_article LEFT JOIN v_body ON article_id = id),
 post AS (SELECT city_id, token, article_id, count(*) AS tf FROM words GROUP BY ALL)"""))
def _(s):
    docs = s.view("v_article").select(F.col("id").alias("article_id"), "city_id", "title", "summary").join(
        s.view("v_body").select("article_id", "cleaned_text"), "article_id", "left")
    return rerank.text_candidates(s.view("v_query"), docs, limit=20)


# --- dashboard and listings -----------------------------------------------------

@query("dashboard_counts", with_views("""SELECT (SELECT count(*) FROM v_city) AS cities, (SELECT count(*) FROM v_org) AS organizations, (SELECT count(*) FROM v_scraper) AS scrapers,
  (SELECT count(*) FROM v_scraper WHERE is_enabled) AS active_scrapers""", "v_city", "v_org", "v_scraper"))
def _(s):
    return listings.dashboard_counts(s.view("v_city"), s.view("v_org"), s.view("v_scraper"))


@query("articles_recent", with_views("""SELECT count(*) FILTER (created_at >= timestamp'2024-01-19 00:00:00') AS last_24h, count(*) FILTER (created_at >= timestamp'2024-01-13 00:00:00') AS last_7d FROM v_article""", "v_article"))
def _(s):
    return listings.articles_recent(s.view("v_article"), at("2024-01-20 00:00:00"))


@query("events_written_recent", with_views("""SELECT sum(items_written) FILTER (finished_at >= timestamp'2001-07-30 12:00:00') AS last_24h, sum(items_written) AS last_7d FROM v_run WHERE finished_at >= timestamp'2001-07-24 12:00:00'""", "v_run"))
def _(s):
    return listings.events_written_recent(s.view("v_run"), at("2001-07-31 12:00:00"))


@query("recent_runs", with_views("""SELECT r.id, r.status, s.name AS scraper_name, c.name AS city_name, o.name AS organization_name FROM (SELECT * FROM v_run ORDER BY finished_at DESC NULLS FIRST, started_at DESC NULLS FIRST, id LIMIT 5) r
 LEFT JOIN v_scraper s ON s.id = r.scraper_id LEFT JOIN v_city c ON c.id = s.city_id LEFT JOIN v_org o ON o.id = s.organization_id""", "v_run", "v_scraper", "v_city", "v_org"))
def _(s):
    return listings.recent_runs(s.view("v_run"), s.view("v_scraper"), s.view("v_city"), s.view("v_org"), n=5).select("id", "status", "scraper_name", "city_name", "organization_name")


@query("events_listing", with_views(f"""SELECT id, title, city_id, {stamp_sql('starts_at')} AS starts_at FROM v_event e WHERE starts_at >= timestamp'1997-01-01' AND starts_at < timestamp'1999-01-01' AND event_url <> ''
 AND EXISTS (SELECT 1 FROM v_event_source_item i WHERE i.event_id = e.id AND i.event_source_id = 7) ORDER BY e.starts_at, e.id LIMIT 20 OFFSET 20""", "v_event", "v_event_source_item"))
def _(s):
    rows = listings.events_listing(s.view("v_event"), s.view("v_event_source_item"), "1998-12-31", "1997-01-01", source_id=7, with_url=True)
    return listings.page(rows, [F.col("starts_at"), F.col("id")], 2, 20).select("id", "title", "city_id", stamp("starts_at").alias("starts_at"))


@query("event_sources_search", with_views("""SELECT s.id, s.name, c.name AS city_name, r.latest_status FROM v_event_source s LEFT JOIN v_city c ON c.id = s.city_id
 LEFT JOIN (SELECT scraper_id, arg_max(status, (created_at, id)) AS latest_status FROM v_run GROUP BY 1) r ON r.scraper_id = s.id
 WHERE (s.name LIKE '%2%' OR s.source_url LIKE '%2%' OR s.source_type LIKE '%2%' OR c.name LIKE '%2%') AND is_active ORDER BY s.name LIMIT 15""", "v_event_source", "v_city", "v_run"))
def _(s):
    rows = listings.event_sources_search(s.view("v_event_source"), s.view("v_city"), " 2 ", active_only=True)
    rows = listings.page(rows, [F.col("name")], 1, 15)
    latest = listings.latest_run(s.view("v_run")).select(F.col("scraper_id").alias("id"), "latest_status")
    return rows.join(latest, "id", "left").select("id", "name", "city_name", "latest_status")


@query("scrapers_listing", with_views("""SELECT s.id, s.name, s.slug, o.name AS organization_name FROM v_scraper s LEFT JOIN v_org o ON o.id = s.organization_id
 WHERE is_enabled AND (s.name LIKE '%3%' OR s.slug LIKE '%3%' OR s.source_url LIKE '%3%' OR o.name LIKE '%3%') ORDER BY o.name NULLS LAST, s.id LIMIT 15""", "v_scraper", "v_org"))
def _(s):
    rows = listings.scrapers_listing(s.view("v_scraper"), s.view("v_org"), "3", active_only=True)
    return listings.page(rows, listings.scraper_order("organization_name"), 1, 15).select("id", "name", "slug", "organization_name")


@query("directory_listing", with_views("SELECT id, name, type FROM v_org WHERE city_id = 5 ORDER BY name, id LIMIT 15", "v_org"))
def _(s):
    return listings.page(s.view("v_org").filter("city_id = 5"), [F.col("name"), F.col("id")], 1, 15).select("id", "name", "type")


@query("source_run_history", with_views(f"SELECT scraper_id, id, rank, {stamp_sql('created_at')} AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY scraper_id ORDER BY created_at DESC, id DESC) AS rank FROM v_run) WHERE rank <= 10", "v_run"))
def _(s):
    return listings.source_run_history(s.view("v_run"), n=10).select("scraper_id", "id", "rank", stamp("created_at").alias("created_at"))


@query("latest_run", with_views(f"""SELECT scraper_id, arg_max(id, (created_at, id)) AS latest_run_id, arg_max(status, (created_at, id)) AS latest_status,
  arg_max(id, (finished_at, id)) FILTER (status = 'success' AND finished_at IS NOT NULL) AS success_run_id, {stamp_sql("max(finished_at) FILTER (status = 'success')")} AS success_at FROM v_run GROUP BY 1""", "v_run"))
def _(s):
    return listings.latest_run(s.view("v_run")).withColumn("success_at", stamp("success_at"))


@query("calendar_day", with_views(f"""SELECT id, city_id, strftime(starts_at, '%Y-%m-%d') AS day, CASE WHEN all_day THEN 'all_day' ELSE 'timed' END AS section, CASE WHEN NOT all_day THEN strftime(starts_at, '%H:%M') END AS time_label,
  row_number() OVER (PARTITION BY city_id, cast(starts_at as date), all_day ORDER BY starts_at, id) AS position FROM v_event""", "v_event"))
def _(s):
    return listings.calendar_days(s.view("v_event")).select("id", "city_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "section", "time_label", "position")


@query("calendar_one_day", with_views("""SELECT id, CASE WHEN all_day THEN 'all_day' ELSE 'timed' END AS section, CASE WHEN NOT all_day THEN strftime(starts_at, '%H:%M') END AS time_label,
  row_number() OVER (PARTITION BY all_day ORDER BY starts_at, id) AS position FROM v_event WHERE city_id = 3 AND cast(starts_at as date) = (SELECT min(cast(starts_at as date)) FROM v_event WHERE city_id = 3)""", "v_event"))
def _(s):
    events = s.view("v_event")
    day = events.filter("city_id = 3").agg(F.date_format(F.min("starts_at"), "yyyy-MM-dd")).first()[0]
    return listings.calendar_day(events, 3, day).select("id", "section", "time_label", "position")


@query("event_trace", with_views("""SELECT e.id, e.title, i.item_id, i.event_source_id, i.raw_payload FROM v_event e LEFT JOIN (
  SELECT event_id, min(id) AS item_id, arg_min(event_source_id, id) AS event_source_id, arg_min(raw_payload, id) AS raw_payload FROM v_event_source_item GROUP BY 1) i ON i.event_id = e.id""", "v_event", "v_event_source_item"))
def _(s):
    # Items share an id only when all their fields are equal in the id's formula; take the distinct ones.
    return listings.event_trace(s.view("v_event"), s.view("v_event_source_item")).select("id", "title", "item_id", "event_source_id", "raw_payload")


# --- article page -----------------------------------------------------------------

@query("entity_groups", with_views("""SELECT article_id, CASE WHEN t = 'organization' AND regexp_matches(lower(nm), 'city|commission|board|council') THEN 'Decision-makers' WHEN t = 'organization' THEN 'Organizations mentioned'
   WHEN t = 'person' THEN 'People mentioned' ELSE 'Locations mentioned' END AS "group", nm AS name, t AS type
FROM (SELECT e.article_id, lower(entity_type) AS t, coalesce(o.name, c.c_name, n.n_name, trim(display_name)) AS nm FROM v_entity e
  LEFT JOIN v_org o ON lower(entity_type) = 'organization' AND o.id = entity_id LEFT JOIN customer c ON entity_type = 'person' AND c.c_custkey + 1 = entity_id
  LEFT JOIN nation n ON entity_type = 'location' AND n.n_nationkey + 1 = entity_id) WHERE nm <> ''""", "v_entity", "v_org"))
def _(s):
    people = s.table("customer").select((F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("name"))
    places = s.table("nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("id"), F.col("n_name").alias("name"))
    return A.entity_groups(s.view("v_entity"), s.view("v_org"), people, places)


@query("article_dimensions", """SELECT doc_id + 1 AS article_id,
  CASE WHEN doc_id % 4 < 2 THEN (doc_id % 10) / 10.0 WHEN doc_id % 5 = 0 THEN NULL ELSE 0.9 END AS agency, CASE WHEN doc_id % 4 < 2 THEN 0.4 END AS timeliness,
  cast(NULL as double) AS orientation,
  CASE WHEN doc_id % 4 = 1 OR doc_id % 5 <> 0 THEN 'said ' || doc_id ELSE '' END AS why_agency, '' AS why_relevance FROM documents""")
def _(s):
    return A.article_dimensions(s.view("v_scores")).select("article_id", "agency", "timeliness", "orientation", "why_agency", "why_relevance")


def _opportunity_list(s):
    o = s.view("v_opportunity")
    payload = o.filter("article_id % 2 = 0").withColumns({
        "title": F.when(F.col("pos") % 5 == 0, F.lit("Titled")), "starts_text": F.when(F.col("pos") % 19 == 0, F.lit("1999-05-05T10:00:00Z")), "ends_text": F.lit(None).cast("string")})
    stored = o.withColumns({
        "kind": F.col("type"), "title": F.when(F.col("pos") % 2 == 0, F.lit(" ")).otherwise(F.lit("Stored")), "notes": F.lit("Noted"),
        "starts_at": F.when(F.col("pos") % 3 > 0, F.timestamp_add("HOUR", (F.col("pos") % 24).cast("int"), F.try_to_date("date").cast("timestamp_ntz"))),
        "ends_at": F.when(F.col("pos") % 3 == 0, F.try_to_date("date").cast("timestamp_ntz"))})
    return A.opportunity_list(A.payload_opportunities(payload, _cities(s), claims_as_of()), A.table_opportunities(stored))


OL_CTE = """op AS (SELECT article_id, o.city_id, pos, CASE WHEN lower(type) IN ('meeting', 'hearing') THEN 'meeting' WHEN type IN ('public_comment', 'deadline', 'application') THEN type ELSE 'other' END AS type,
   CASE WHEN pos % 5 = 0 THEN 'Titled' END AS title, coalesce(nullif(trim(description), ''), CASE WHEN pos % 5 = 0 THEN 'Titled' END) AS description,
   nullif(trim(location), '') AS location, CASE WHEN lower(url) = 'null' THEN NULL ELSE url END AS url,
   CASE WHEN pos % 19 = 0 THEN timestamp'1999-05-05 10:00:00' WHEN date IS NULL OR date = 'soon' THEN NULL ELSE (cast(date as timestamp) + CASE WHEN time IS NULL THEN interval 0 hour WHEN time = '18:30' THEN interval 1110 minute ELSE interval 18 hour END)
       AT TIME ZONE timezone AT TIME ZONE 'UTC' END AS starts_at, cast(NULL as timestamp) AS ends_at, time IS NOT NULL AS has_time FROM v_opportunity o JOIN v_city c ON c.id = o.city_id WHERE article_id % 2 = 0),
 st0 AS (SELECT *, try_cast(date as timestamp) AS dd FROM v_opportunity WHERE article_id % 2 = 1),
 st AS (SELECT article_id, city_id, pos, CASE WHEN lower(type) IN ('meeting', 'hearing') THEN 'meeting' WHEN type IN ('public_comment', 'deadline', 'application') THEN type ELSE 'other' END AS type,
   CASE WHEN pos % 2 = 1 THEN 'Stored' END AS title, CASE WHEN pos % 2 = 1 THEN 'Stored' ELSE 'Noted' END AS description, nullif(trim(location), '') AS location, CASE WHEN lower(url) = 'null' THEN NULL ELSE url END AS url,
   CASE WHEN pos % 3 > 0 THEN dd + to_hours(cast(pos % 24 as int)) END AS starts_at, CASE WHEN pos % 3 = 0 THEN dd END AS ends_at, coalesce(CASE WHEN pos % 3 > 0 THEN dd IS NOT NULL AND pos % 24 > 0 END, false) AS has_time FROM st0),
 ol AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY coalesce(starts_at, ends_at) ASC NULLS LAST, pos) AS position FROM (SELECT * FROM op UNION ALL SELECT * FROM st))"""


@query("opportunity_list", with_views(f"SELECT article_id, position, type, title, description, url, has_time, {stamp_sql('starts_at')} AS starts_at, {stamp_sql('ends_at')} AS ends_at FROM ol", "v_opportunity", "v_city", extra=OL_CTE))
def _(s):
    return _opportunity_list(s).select("article_id", "position", "type", "title", "description", "url", "has_time", stamp("starts_at").alias("starts_at"), stamp("ends_at").alias("ends_at"))


ENC = lambda e: f"replace(replace(replace({e}, ',', '%2C'), ' ', '%20'), '/', '%2F')"


@query("participation_actions", with_views(f"""SELECT article_id, position, CASE type WHEN 'meeting' THEN 'Attend the Hearing' WHEN 'public_comment' THEN 'Submit a Comment' WHEN 'deadline' THEN 'Deadline' WHEN 'application' THEN 'Apply / Submit' ELSE 'Take Action' END AS card_title,
  CASE WHEN type = 'other' THEN coalesce(description, title) ELSE coalesce(title, description) END AS subtitle,
  concat_ws(' · ', CASE WHEN has_time THEN strftime(loc, '%b %-d, %Y %-I:%M %p') ELSE strftime(loc, '%b %-d, %Y') END, location) AS meta,
  CASE WHEN type = 'meeting' AND starts_at IS NOT NULL THEN 'Add to calendar' WHEN url IS NULL THEN NULL WHEN type = 'public_comment' THEN 'Submit online' WHEN type = 'application' THEN 'Apply now' ELSE 'View details' END AS cta_label,
  CASE WHEN type = 'meeting' AND starts_at IS NOT NULL THEN 'https://www.google.com/calendar/render?' || concat_ws('&', 'action=TEMPLATE', 'text=' || {ENC("coalesce(title, 'Attend the Hearing')")},
     'dates=' || strftime(starts_at, '%Y%m%dT%H%M%SZ') || '%2F' || strftime(coalesce(ends_at, starts_at + interval 1 hour), '%Y%m%dT%H%M%SZ'), 'details=' || {ENC('description')}, 'location=' || {ENC('location')}) ELSE url END AS cta_url,
  CASE WHEN type = 'public_comment' THEN 'Closes ' || strftime(eloc, '%b %-d') WHEN type IN ('deadline', 'application') THEN 'Due ' || strftime(eloc, '%b %-d') END AS badge
FROM (SELECT ol.*, starts_at AT TIME ZONE 'UTC' AT TIME ZONE timezone AS loc, coalesce(ends_at, starts_at) AT TIME ZONE 'UTC' AT TIME ZONE timezone AS eloc FROM ol JOIN v_city c ON c.id = ol.city_id)
UNION ALL SELECT a.id, NULL, 'Read the Proposal', 'Full application and supporting documents', '', 'View documents', canonical_url, NULL FROM v_article a""", "v_opportunity", "v_city", "v_article", extra=OL_CTE))
def _(s):
    articles = s.view("v_article").select(F.col("id").alias("article_id"), "canonical_url")
    urls = s.view("v_article_source").groupBy("article_id").agg(F.min_by("source_url", F.struct("created_at", "id")).alias("source_url"))
    return A.participation_actions(_opportunity_list(s), articles, urls, _cities(s))


@query("timeline_view", with_views("""SELECT article_id, position, label, CASE WHEN has_time THEN strftime(loc, '%b %-d, %Y %-I:%M %p') ELSE strftime(loc, '%b %-d, %Y') END AS date_label,
  tat IS NOT NULL AS has_date, st AS item_status, badge FROM (SELECT *, tat AT TIME ZONE 'UTC' AT TIME ZONE timezone AS loc FROM items)""", "v_timeline", "v_city", extra=TI_CTE))
def _(s):
    return A.timeline_view(timeline.timeline_items(_timeline(s), claims_as_of()), _cities(s))


@query("article_page", with_views("""SELECT a.id, a.title, c.name AS city_name, s.name AS scraper_name, o.name AS organization_name, length(b.cleaned_text) AS body_chars, x.civic, x.status AS analysis_status,
  coalesce(u.n, 0) AS n_sources, u.first_source, coalesce(cl.n, 0) AS n_claims, coalesce(ti.n, 0) AS n_timeline, coalesce(op.n, 0) AS n_opportunities
FROM v_article a LEFT JOIN v_city c ON c.id = a.city_id LEFT JOIN v_scraper s ON s.id = a.scraper_id LEFT JOIN v_org o ON o.id = s.organization_id LEFT JOIN v_body b ON b.article_id = a.id
 LEFT JOIN v_analysis x ON x.article_id = a.id LEFT JOIN (SELECT article_id, count(*) AS n, arg_min(source_url, (created_at, id)) AS first_source FROM v_article_source GROUP BY 1) u ON u.article_id = a.id
 LEFT JOIN (SELECT article_id, count(*) AS n FROM v_claim GROUP BY 1) cl ON cl.article_id = a.id LEFT JOIN (SELECT article_id, count(*) AS n FROM v_timeline GROUP BY 1) ti ON ti.article_id = a.id
 LEFT JOIN (SELECT article_id, count(*) AS n FROM v_opportunity GROUP BY 1) op ON op.article_id = a.id""",
    "v_article", "v_city", "v_scraper", "v_org", "v_body", "v_analysis", "v_article_source", "v_claim", "v_timeline", "v_opportunity"))
def _(s):
    children = {"claims": s.view("v_claim"), "timeline": s.view("v_timeline"), "opportunities": s.view("v_opportunity")}
    p = A.article_page(s.view("v_article"), s.view("v_city"), s.view("v_body"), s.view("v_scraper"), s.view("v_org"), s.view("v_analysis"), s.view("v_article_source"), children)
    return p.select("id", "title", "city_name", "scraper_name", "organization_name", "body_chars", "civic", "analysis_status", "n_sources", "first_source",
                    "n_claims", "n_timeline", "n_opportunities")


# --- schedule and checks -------------------------------------------------------------

DUE = """SELECT s.id, frequency, strftime(success_at, '%Y-%m-%d %H:%M:%S') AS success_at FROM (
 SELECT s.*, c.timezone, r.success_at, timestamp'2001-07-30 16:10:00' AT TIME ZONE 'UTC' AT TIME ZONE timezone AS nl, success_at AT TIME ZONE 'UTC' AT TIME ZONE timezone AS ll,
   cast(split_part(coalesce(run_at, '08:00'), ':', 1) as int) * 60 + cast(split_part(coalesce(run_at, '08:00'), ':', 2) as int) AS mins
 FROM v_scraper s JOIN v_city c ON c.id = s.city_id LEFT JOIN (SELECT scraper_id, max(finished_at) AS success_at FROM v_run WHERE status = 'success' GROUP BY 1) r ON r.scraper_id = s.id
 WHERE is_enabled AND type IN ('rss', 'html') AND NOT EXISTS (SELECT 1 FROM v_run r WHERE r.scraper_id = s.id AND status IN ('queued', 'running'))) s
WHERE CASE frequency WHEN 'hourly' THEN success_at IS NULL OR timestamp'2001-07-30 16:10:00' >= success_at + interval 60 minute
  WHEN 'daily' THEN hour(nl) * 60 + minute(nl) >= mins AND (ll IS NULL OR cast(ll as date) <> cast(nl as date))
  ELSE coalesce(dayofweek(nl) = run_day_of_week, false) AND hour(nl) * 60 + minute(nl) >= mins
     AND (ll IS NULL OR cast(ll as date) - cast(dayofweek(ll) as int) < cast(nl as date) - cast(dayofweek(nl) as int)) END"""


@query("due_scrapers", with_views(DUE, "v_scraper", "v_city", "v_run"))
def _(s):
    r = schedule.due_scrapers(s.view("v_scraper"), s.view("v_city"), s.view("v_run"), at("2001-07-30 16:10:00"))
    return r.select("id", "frequency", stamp("success_at").alias("success_at"))


@query("runnable_sources", with_views("SELECT id, source_type, city_id FROM v_event_source WHERE is_active AND source_type IN ('ics', 'json_api', 'rss', 'html')", "v_event_source"))
def _(s):
    return listings.runnable_sources(s.view("v_event_source"), ["ics", "json_api", "rss", "html"], "source_type", "is_active").select("id", "source_type", "city_id")


@query("record_checks", with_views("""SELECT id, 'scraper' AS record, 'run_day_required' AS rule FROM v_scraper WHERE frequency = 'weekly' AND run_day_of_week IS NULL
 UNION ALL SELECT id, 'scraper', 'slug_unique' FROM (SELECT id, count(*) OVER (PARTITION BY city_id, slug) AS n FROM v_scraper) WHERE n > 1
 UNION ALL SELECT id, 'organization', 'website_shape' FROM v_org WHERE website = 'not a url'
 UNION ALL SELECT id, 'organization', 'type_allowed' FROM v_org WHERE type = 'other'
 UNION ALL SELECT id, 'event_source', 'source_type_allowed' FROM v_event_source WHERE source_type = 'manual'
 UNION ALL SELECT id, 'event', 'city_exists' FROM v_event WHERE city_id NOT IN (SELECT id FROM v_city WHERE id <> 9)
 UNION ALL SELECT id, 'scraper', 'organization_exists' FROM v_scraper WHERE organization_id % 10 = 4""", "v_scraper", "v_org", "v_event_source", "v_event", "v_city"))
def _(s):
    some_cities = s.view("v_city").filter("id <> 9")
    some_orgs = s.view("v_org").filter("id % 10 <> 4")
    tag = lambda df, name: df.select("id", F.lit(name).alias("record"), "rule")
    return (
        tag(checks.scraper_checks(s.view("v_scraper"), s.view("v_city"), some_orgs), "scraper")
        .unionByName(tag(checks.organization_checks(s.view("v_org"), s.view("v_city"), C.ORGANIZATION_TYPES[:5]), "organization"))
        .unionByName(tag(checks.event_source_checks(s.view("v_event_source"), s.view("v_city"), ["ics", "json_api", "rss", "html"]), "event_source"))
        .unionByName(tag(checks.event_checks(s.view("v_event"), some_cities), "event"))
        .unionByName(tag(checks.city_checks(s.view("v_city")), "city"))
    )


@query("dashboard_rollup", with_views("""SELECT s.city_id, r.scraper_id, r.status, cast(GROUPING(s.city_id, r.scraper_id, r.status) AS bigint) AS level, count(*) AS runs, cast(sum(items_written) AS bigint) AS items_written
 FROM v_run r LEFT JOIN v_scraper s ON s.id = r.scraper_id GROUP BY ROLLUP (s.city_id, r.scraper_id, r.status)""", "v_run", "v_scraper"))
def _(s):
    return listings.dashboard_rollup(s.view("v_run"), s.view("v_scraper"))


LATE_PAGE = "SELECT count(*) // 20 * 9 // 10 FROM v_event"


@query("deep_page", with_views(f"""SELECT id, title, {stamp_sql('starts_at')} AS starts_at, position FROM (SELECT *, row_number() OVER (ORDER BY starts_at, id) AS position FROM v_event)
 WHERE position > (({LATE_PAGE}) - 1) * 20 AND position <= ({LATE_PAGE}) * 20""", "v_event"))
def _(s):
    rows = s.view("v_event").select("id", "title", "starts_at")
    pages = listings.paged(rows, [F.col("starts_at"), F.col("id")], 20)
    late = pages.starts[-1] // 20 * 9 // 10
    return pages.page(late).select("id", "title", stamp("starts_at").alias("starts_at"), "position")


@query("page_bounds", with_views(f"""SELECT cast((position - 1) // 20 + 1 AS bigint) AS page, position AS first_position, id, {stamp_sql('starts_at')} AS starts_at
 FROM (SELECT *, row_number() OVER (ORDER BY starts_at, id) AS position FROM v_event) WHERE (position - 1) % 20 = 0""", "v_event"))
def _(s):
    pages = listings.paged(s.view("v_event").select("id", "starts_at"), [F.col("starts_at"), F.col("id")], 20)
    return pages.bounds().select("page", "first_position", "id", stamp("starts_at").alias("starts_at"))
