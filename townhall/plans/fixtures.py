"""Derived views over the base tables, written once for Spark and for DuckDB.

Each view is a function of a dialect that returns SQL text. ``view`` runs it in
Spark over Parquet; ``with_views`` puts the same text in front of an oracle
query. The views only rename and combine columns of the base tables, so they
grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


class SparkDialect:
    formats = {"mdy": "MMMM d, yyyy", "ymd": "yyyy-MM-dd", "hm": "HH:mm", "ics": "yyyyMMdd'T'HHmmss",
               "ts": "yyyy-MM-dd HH:mm:ss", "rfc": "EEE, dd MMM yyyy HH:mm:ss", "y": "yyyy", "md": "MMMM d",
               "iso": "yyyy-MM-dd'T'HH:mm:ss", "h12": "h:mm a", "compact": "yyyyMMdd"}

    def table(self, name: str, sf_dir: str) -> str:
        return f"parquet.`{sf_dir}/{name}.parquet`"

    def fmt(self, expr: str, kind: str) -> str:
        pattern = self.formats[kind].replace("'", "\\'")
        return f"date_format({expr}, '{pattern}')"

    def plus(self, ts: str, unit: str, n: str) -> str:
        return f"timestampadd({unit}, cast({n} as int), {ts})"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def agg(self, expr: str, order: str, sep: str = "''") -> str:
        return f"listagg({expr}, {sep}) WITHIN GROUP (ORDER BY {order})"

    def str(self, expr: str) -> str:
        return f"cast({expr} as string)"

    def ts(self, text: str) -> str:
        return f"timestamp_ntz'{text}'"


class DuckDialect:
    formats = {"mdy": "%B %-d, %Y", "ymd": "%Y-%m-%d", "hm": "%H:%M", "ics": "%Y%m%dT%H%M%S",
               "ts": "%Y-%m-%d %H:%M:%S", "rfc": "%a, %d %b %Y %H:%M:%S", "y": "%Y", "md": "%B %-d",
               "iso": "%Y-%m-%dT%H:%M:%S", "h12": "%-I:%M %p", "compact": "%Y%m%d"}

    def table(self, name: str, sf_dir: str) -> str:
        return name

    def fmt(self, expr: str, kind: str) -> str:
        return f"strftime({expr}, '{self.formats[kind]}')"

    def plus(self, ts: str, unit: str, n: str) -> str:
        return f"({ts} + to_{unit.lower()}s(cast({n} as int)))"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def agg(self, expr: str, order: str, sep: str = "''") -> str:
        return f"string_agg({expr}, {sep} ORDER BY {order})"

    def str(self, expr: str) -> str:
        return f"cast({expr} as varchar)"

    def ts(self, text: str) -> str:
        return f"timestamp'{text}'"


NL = "chr(10)"
VIEWS: dict[str, object] = {}


def _view(fn):
    VIEWS[fn.__name__] = fn
    return fn


@_view
def v_city(d):
    return f"""
    SELECT cast(n_nationkey + 1 as bigint) AS id, n_name AS name,
           lower(replace(n_name, '_', '-')) AS slug,
           CASE n_nationkey % 4 WHEN 0 THEN 'America/Chicago' WHEN 1 THEN 'America/New_York'
                WHEN 2 THEN 'America/Los_Angeles' ELSE 'UTC' END AS timezone
    FROM @nation"""


@_view
def v_org(d):
    return f"""
    SELECT s_suppkey + 1 AS id, cast(s_nationkey + 1 as bigint) AS city_id,
           CASE WHEN s_suppkey % 6 = 0 THEN 'Planning Board ' || {d.str('s_suppkey % 40')} ELSE s_name END AS name,
           lower(replace(s_name, '#', '-')) AS slug,
           CASE s_suppkey % 6 WHEN 0 THEN 'government' WHEN 1 THEN 'news_media' WHEN 2 THEN 'nonprofit'
                WHEN 3 THEN 'business' WHEN 4 THEN 'school' ELSE 'other' END AS type,
           CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 9 = 0 THEN 'not a url'
                ELSE 'https://org' || {d.str('s_suppkey')} || '.example.org' END AS website
    FROM @supplier"""


@_view
def v_scraper(d):
    return f"""
    SELECT s_suppkey + 1 AS id, cast(s_nationkey + 1 as bigint) AS city_id,
           CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE s_suppkey + 1 END AS organization_id,
           'Feed ' || s_name AS name, 'feed-' || {d.str('s_suppkey % 60')} AS slug,
           CASE s_suppkey % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'html' WHEN 2 THEN 'rss' WHEN 3 THEN 'html' ELSE 'api' END AS type,
           'https://feed' || {d.str('s_suppkey')} || '.example.org/list?page=1' AS source_url,
           s_suppkey % 10 <> 0 AS is_enabled,
           CASE s_suppkey % 3 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' ELSE 'weekly' END AS frequency,
           CASE WHEN s_suppkey % 12 = 0 THEN NULL
                ELSE lpad({d.str('s_suppkey % 12 + 2')}, 2, '0') || ':' || CASE WHEN s_suppkey % 2 = 0 THEN '30' ELSE '00' END END AS run_at,
           CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE cast(s_suppkey % 7 as int) END AS run_day_of_week,
           {d.plus(d.ts('2001-01-01 00:00:00'), 'HOUR', 's_suppkey % 977')} AS updated_at
    FROM @supplier"""


@_view
def v_event_source(d):
    return f"""
    SELECT s_suppkey + 1 AS id, cast(s_nationkey + 1 as bigint) AS city_id, 'Calendar ' || s_name AS name,
           CASE s_suppkey % 5 WHEN 0 THEN 'ics' WHEN 1 THEN 'json_api' WHEN 2 THEN 'rss' WHEN 3 THEN 'html' ELSE 'manual' END AS source_type,
           'https://cal' || {d.str('s_suppkey')} || '.example.org/feed/index' AS source_url,
           s_suppkey % 9 <> 0 AS is_active,
           CASE s_suppkey % 4 WHEN 0 THEN 'century' WHEN 1 THEN 'libcal'
                WHEN 2 THEN 'simpleview' ELSE 'unheard_of' END AS profile
    FROM @supplier"""


@_view
def v_run(d):
    return f"""
    SELECT o.o_orderkey AS id, o.o_custkey % (SELECT count(*) FROM @supplier) + 1 AS scraper_id,
           CASE WHEN o.o_orderkey % 997 = 0 THEN 'running' WHEN o.o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status,
           o.o_orderdate AS created_at,
           {d.plus('o.o_orderdate', 'MINUTE', 'o.o_orderkey % 30')} AS started_at,
           CASE WHEN o.o_orderkey % 997 = 0 THEN NULL
                ELSE {d.plus('o.o_orderdate', 'MINUTE', 'o.o_orderkey % 1440 + 30')} END AS finished_at,
           o.o_orderkey % 80 AS items_found, o.o_orderkey % 50 AS items_written
    FROM @orders o"""


FILLER = "The department staff reviewed the proposal while residents of the valley shared their views. "


@_view
def civic_text(d):
    mdy = d.fmt("o_orderdate", "mdy")
    ymd = d.fmt("o_orderdate", "ymd")
    k = "o_orderkey"
    fill = f"repeat('{FILLER}', cast(CASE WHEN {k} % 50 = 0 THEN 24 WHEN {k} % 7 = 0 THEN 6 ELSE {k} % 3 END as int))"
    return f"""
    SELECT o_orderkey AS article_id, cast(c_nationkey + 1 as bigint) AS city_id,
           o_custkey % (SELECT count(*) FROM @supplier) + 1 AS scraper_id,
           CASE WHEN {k} % 31 = 0 THEN NULL ELSE 'Notice ' || {d.str(k)} || ' Zoning Board Review' END AS title,
           CASE WHEN {k} % 3 = 0 THEN NULL WHEN {k} % 3 = 1 THEN '  ' ELSE 'Summary of matter ' || {d.str(k)} || '.' END AS summary,
           CASE WHEN {k} % 4 = 0 THEN 'PUBLIC NOTICE' || {NL} || {NL} WHEN {k} % 4 = 1 THEN 'Agenda Items Listed:' || {NL} ELSE '' END
           || {fill} || {NL} || {NL}
           || CASE {k} % 5 WHEN 0 THEN 'Public hearing on ' || {mdy} || ' at 6:00 PM. '
                WHEN 1 THEN 'Submit comments by ' || {ymd} || ' or register at the desk. '
                WHEN 2 THEN 'The Zoning Board will vote on the ordinance on Monday. '
                WHEN 3 THEN 'The comment period closes ' || {d.fmt('o_orderdate', 'md')} || '. '
                ELSE 'City Council meeting set for 10/12/98, 9 am. ' END
           || CASE WHEN {k} % 6 = 0 THEN 'See https://city.example.org/doc/' || {d.str(k)} || ') for details. ' ELSE '' END
           || CASE WHEN {k} % 8 = 0 THEN 'Write to clerk' || {d.str(k)} || '@example.org today. ' ELSE '' END
           || CASE WHEN {k} % 9 = 0 THEN 'Call 316-555-' || lpad({d.str(k + ' % 10000')}, 4, '0') || ' now. ' ELSE '' END
           || CASE WHEN {k} % 10 = 0 THEN 'The variance and easement were published on file with a notary. ' ELSE '' END
           || {NL} || {NL} || {fill}
           || CASE WHEN {k} % 11 = 0 THEN {NL} || '- first item' || {NL} || '- second item' || {NL} || '1. numbered item' ELSE '' END
           || CASE WHEN {k} % 13 = 0 THEN {NL} || {NL} || 'Mayor Jane Doe' || {NL} || {NL} || 'The deadline is ' || {ymd} || '.' ELSE '' END
           AS cleaned_text
    FROM @orders JOIN @customer ON o_custkey = c_custkey"""


@_view
def v_article(d):
    return f"""
    SELECT doc_id + 1 AS id, doc_id % 25 + 1 AS city_id, doc_id % (SELECT count(*) FROM @supplier) + 1 AS scraper_id,
           'Document ' || {d.str('doc_id')} AS title,
           CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS summary,
           'https://docs.example.org/' || {d.str('doc_id')} AS canonical_url,
           CASE WHEN doc_id % 4 = 0 THEN 'pdf' ELSE 'news' END AS content_type, 'published' AS status,
           {d.plus(d.ts('2024-01-01 00:00:00'), 'MINUTE', 'doc_id * 37')} AS created_at,
           CASE WHEN doc_id % 6 = 0 THEN NULL ELSE {d.plus(d.ts('2023-06-01 06:00:00'), 'HOUR', 'doc_id % 9000')} END AS published_at
    FROM @documents"""


@_view
def v_body(d):
    return f"""
    SELECT doc_id + 1 AS article_id, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE text END AS cleaned_text, lang,
           CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {d.plus(d.ts('2024-02-01 00:00:00'), 'MINUTE', 'doc_id')} END AS extracted_at,
           CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'success' END AS extraction_status
    FROM @documents"""


@_view
def v_article_source(d):
    one = lambda n, shift: f"""
    SELECT doc_id * 2 + {n} AS id, doc_id + 1 AS article_id, doc_id % 25 + 1 AS city_id,
           'https://src{n}.example.org/' || {d.str('doc_id')} AS source_url,
           {d.plus(d.ts('2024-01-01 00:00:00'), 'MINUTE', shift)} AS created_at
    FROM @documents"""
    return one(1, "doc_id % 50") + " WHERE doc_id % 7 <> 0 UNION ALL " + one(2, "doc_id % 30")


@_view
def v_item(d):
    city = "l_orderkey % 25 + 1"
    return f"""
    SELECT lpad({d.str('l_orderkey')}, 10, '0') || lpad({d.str('l_linenumber')}, 2, '0')
             || lpad({d.str('l_partkey')}, 8, '0') || lpad({d.str('l_suppkey')}, 6, '0') || lpad({d.str('cast(round(l_extendedprice * 100) as bigint)')}, 10, '0') AS pos,
           l_orderkey % 1000 AS run_id, {city} AS city_id, l_suppkey + 1 AS scraper_id,
           CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE 'Item ' || {d.str('l_partkey')} END AS title,
           CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'About ' || p_name END AS summary,
           CASE WHEN l_partkey % 5 = 0 THEN NULL
                ELSE 'https://news.example.org/' || {d.str(city)} || '/' || {d.str('l_partkey')} || '/' || {d.str('l_suppkey % 20')} END AS canonical_url,
           CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE 'https://feeds.example.org/o/' || {d.str('l_orderkey')} END AS source_url,
           CASE WHEN l_partkey % 7 = 0 THEN NULL
                ELSE 'uid-' || {d.str('l_partkey')} || '-' || {d.str('l_suppkey % 30')} END AS source_uid,
           CASE WHEN l_partkey % 3 = 0 THEN NULL
                ELSE sha1(p_name || '#' || {d.str('l_partkey')} || '#' || {d.str('l_suppkey % 10')}) END AS content_hash,
           CASE WHEN l_linenumber = 4 THEN 'pdf' WHEN l_linenumber = 5 THEN NULL ELSE 'news' END AS content_type,
           CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'Body of ' || p_name || ' ' || {d.str('l_orderkey')} END AS cleaned_text,
           l_shipdate AS fetched_at, l_returnflag AS flag
    FROM @lineitem JOIN @part ON l_partkey = p_partkey"""


@_view
def v_known_article(d):
    return """
    SELECT min(substring(pos, 1, 10)) AS order_key, cast(substring(pos, 1, 10) as bigint) + 1 AS id, city_id,
           max(canonical_url) AS canonical_url, max(content_hash) AS content_hash,
           max(title) AS title, max(fetched_at) AS published_at
    FROM v_item WHERE flag = 'R' GROUP BY cast(substring(pos, 1, 10) as bigint) + 1, city_id"""


@_view
def v_known_source(d):
    return """
    SELECT DISTINCT cast(substring(pos, 1, 10) as bigint) + 1 AS article_id, city_id,
           CASE WHEN cast(substring(pos, 1, 10) as bigint) % 3 = 0 THEN source_url
                ELSE 'https://other.example.org/' || substring(pos, 1, 10) END AS source_url, source_uid
    FROM v_item WHERE flag = 'R'"""


@_view
def v_event_item(d):
    return f"""
    SELECT lpad({d.str('l_orderkey')}, 10, '0') || lpad({d.str('l_linenumber')}, 2, '0')
             || lpad({d.str('l_partkey')}, 8, '0') || lpad({d.str('l_suppkey')}, 6, '0') || lpad({d.str('cast(round(l_extendedprice * 100) as bigint)')}, 10, '0') AS pos,
           l_suppkey + 1 AS event_source_id, cast(s_nationkey + 1 as bigint) AS city_id, l_orderkey % 500 AS run_id,
           CASE WHEN l_partkey % 101 = 0 THEN '  ' WHEN l_orderkey % 2 = 0 THEN '  ' || upper(p_name) || '  ' ELSE p_name END AS title,
           CASE WHEN l_partkey % 103 = 0 THEN NULL ELSE {d.plus('l_shipdate', 'HOUR', 'l_suppkey % 12 + 8')} END AS starts_at_local,
           l_linenumber = 1 AS all_day, ' ' || s_name || chr(92) || ' Hall ' AS location_name,
           CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE '  12   Main St ' END AS location_address,
           CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN 'event/' || {d.str('l_partkey')}
                WHEN l_partkey % 4 = 2 THEN '/event/' || {d.str('l_partkey')} ELSE 'https://ev.example.org/' || {d.str('l_partkey')} END AS event_url,
           CASE WHEN l_linenumber = 3 THEN NULL ELSE 'ext-' || {d.str('l_partkey')} END AS external_id,
           CASE WHEN l_partkey % 10 = 0 THEN 'key:' || {d.str('l_partkey')} WHEN l_partkey % 10 = 1 THEN upper(sha1({d.str('l_partkey')}))
                WHEN l_partkey % 10 = 2 THEN ' ' ELSE NULL END AS given_hash,
           'https://cal' || {d.str('l_suppkey')} || '.example.org/feed/index' AS feed_url, p_name
    FROM @lineitem JOIN @part ON l_partkey = p_partkey JOIN @supplier ON l_suppkey = s_suppkey"""


@_view
def v_event(d):
    return f"""
    SELECT o_orderkey + 1 AS id, o_custkey % 25 + 1 AS city_id, 'Event ' || {d.str('o_orderkey')} AS title,
           {d.plus('o_orderdate', 'MINUTE', '(o_orderkey % 48) * 30')} AS starts_at, o_orderkey % 5 = 0 AS all_day,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE 'https://ev.example.org/' || {d.str('o_orderkey')} END AS event_url
    FROM @orders"""


@_view
def v_event_source_item(d):
    return f"""
    SELECT lpad({d.str('l_orderkey')}, 10, '0') || lpad({d.str('l_linenumber')}, 2, '0')
             || lpad({d.str('l_partkey')}, 8, '0') || lpad({d.str('l_suppkey')}, 6, '0') || lpad({d.str('cast(round(l_extendedprice * 100) as bigint)')}, 10, '0') AS id, l_orderkey + 1 AS event_id, l_suppkey + 1 AS event_source_id,
           '{{"part":' || {d.str('l_partkey')} || '}}' AS raw_payload
    FROM @lineitem"""


@_view
def v_claim(d):
    return f"""
    SELECT lpad({d.str('l_orderkey')}, 10, '0') || lpad({d.str('l_linenumber')}, 2, '0')
             || lpad({d.str('l_partkey')}, 8, '0') || lpad({d.str('l_suppkey')}, 6, '0') || lpad({d.str('cast(round(l_extendedprice * 100) as bigint)')}, 10, '0') AS pos,
           l_orderkey AS article_id, l_orderkey % 25 + 1 AS city_id,
           CASE l_linenumber % 5 WHEN 0 THEN 'article_mentions_person' WHEN 1 THEN 'article_mentions_org'
                WHEN 2 THEN 'article_mentions_location' WHEN 3 THEN 'article_keyword' ELSE 'article_issue_area' END AS claim_type,
           CASE WHEN l_partkey % 53 = 0 THEN ' '
                WHEN l_linenumber % 5 = 1 AND l_partkey % 3 = 0 THEN 'Planning  Commission ' || {d.str('l_partkey % 3')}
                WHEN l_suppkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name || ' ' END AS value_text,
           p_brand AS brand, round(l_discount * 10, 1) AS confidence, 'model' AS source,
           CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'proposed' ELSE 'rejected' END AS status
    FROM @lineitem JOIN @part ON l_partkey = p_partkey"""


@_view
def v_issue_area(d):
    return f"""
    SELECT DISTINCT (l_orderkey % 25 + 1) * 1000 + cast(replace(p_brand, 'Brand#', '') as int) AS id,
           l_orderkey % 25 + 1 AS city_id, replace(p_brand, '#', '-') AS slug
    FROM @lineitem JOIN @part ON l_partkey = p_partkey WHERE p_brand NOT LIKE '%7'"""


@_view
def v_model_output(d):
    """Finished model answers as JSON text, one per order."""
    k, s = "o_orderkey", lambda e: d.str(e)
    return f"""
    SELECT {k} AS article_id, {k} % 25 + 1 AS city_id, o_custkey % (SELECT count(*) FROM @supplier) + 1 AS scraper_id,
      CASE WHEN {k} % 41 = 0 THEN 'not json' ELSE
      '{{"analysis":{{"dimensions":{{"agency":' || CASE WHEN {k} % 5 = 0 THEN '1.7' ELSE '0.' || {s(k + ' % 10')} END
      || ',"orientation":0.' || {s(k + ' % 9')} || ',"representation":"0.5","relevance":"high","timeliness":0.2}},'
      || '"justifications":{{"agency":"  because ' || {s(k)} || ' "}},"opportunities":[{{"type":"'
      || CASE {k} % 3 WHEN 0 THEN 'Meeting' WHEN 1 THEN 'public_comment' ELSE 'party' END || '","date":"' || {d.fmt('o_orderdate', 'ymd')}
      || '","time":"18:30","location":"City Hall, 1 Main St, Springfield","description":' || CASE WHEN {k} % 4 = 0 THEN 'null' ELSE '"Public hearing now. Come."' END
      || ',"evidence":[{{"quote":" seen ","start":"4","end":9.6}},{{"quote":" "}}]}}],"confidence":' || CASE WHEN {k} % 2 = 0 THEN '0' ELSE '0.75' END || '}},'
      || '"process_timeline":{{"current_key":" Step-2 ","items":[' || CASE WHEN {k} % 6 = 0 THEN '' ELSE
         '{{"key":"step-1","label":" Filed ","status":"COMPLETED","date":"' || {d.fmt('o_orderdate', 'ymd')} || '"}},{{"key":"step-2","label":"Vote","status":"maybe"}},{{"key":" ","label":"x"}}' END || ']}},'
      || '"enrichment":{{"people":[{{"name":" Jane ' || {s('o_custkey')} || ' ","role":" ","confidence":0.9,"evidence":[{{"quote":"q1"}}]}},{{"name":" "}}],'
      || '"organizations":[{{"name":"City Council","type_guess":"Government","confidence":"0.' || {s(k + ' % 10')} || '"}},{{"name":"Acme","type_guess":"guild","confidence":2}}],'
      || '"locations":[{{"name":"Old Town","address":"' || {s(k + ' % 100')} || ' Elm St","confidence":0.6}}],'
      || '"keywords":[{{"keyword":"Road Works ' || {s(k + ' % 13')} || '","confidence":0.8}},{{"keyword":"road works ' || {s(k + ' % 13')} || '","confidence":0.7}}],'
      || '"issue_areas":[{{"slug":"Brand-' || {s(k + ' % 30')} || '","confidence":0.7}}],"confidence":0.6}},'
      || '"explainer":{{"whats_happening":" News ' || {s(k)} || ' ","why_it_matters":" ","key_details":["a"," ","b","c","d","e","f"],"what_to_watch":null,'
      || '"evidence":{{"whats_happening":[{{"quote":"shown"}}],"why_it_matters":[{{"quote":" "}}]}}}},"confidence":0.4}}' END AS payload
    FROM @orders"""


@_view
def v_opportunity(d):
    k = "o_orderkey"
    return f"""
    SELECT o_custkey AS article_id, cast(c_nationkey + 1 as bigint) AS city_id, o_orderkey AS pos,
           CASE {k} % 7 WHEN 0 THEN 'Meeting' WHEN 1 THEN 'public_comment' WHEN 2 THEN 'deadline' WHEN 3 THEN 'application'
                WHEN 4 THEN 'hearing' WHEN 5 THEN 'document' ELSE NULL END AS type,
           CASE WHEN {k} % 19 = 0 THEN NULL WHEN {k} % 23 = 0 THEN 'soon' ELSE {d.fmt('o_orderdate', 'ymd')} END AS date,
           CASE WHEN {k} % 3 = 0 THEN NULL WHEN {k} % 3 = 1 THEN '18:30' ELSE '6:00 PM' END AS time,
           CASE WHEN {k} % 5 = 0 THEN ' ' ELSE 'City Hall, ' || {d.str(k + ' % 90')} || ' Main St, Springfield' END AS location,
           CASE WHEN {k} % 4 = 0 THEN NULL WHEN {k} % 9 = 0 THEN 'null'
                WHEN {k} % 4 = 1 THEN 'https://city.example.org/files/' || {d.str(k)} || '.pdf'
                ELSE 'https://city.example.org/p/' || {d.str(k)} END AS url,
           CASE WHEN {k} % 6 = 0 THEN NULL WHEN {k} % 6 = 1 THEN 'Public hearing  on the plan. Bring notes.'
                WHEN {k} % 6 = 2 THEN 'A public comment window.' ELSE repeat('Very long notice text ', 10) || '.' END AS description,
           CASE WHEN {k} % 2 = 0 THEN '  Quoted   evidence ' || {d.str(k)} || '. More.  ' ELSE NULL END AS evidence_quote
    FROM @orders JOIN @customer ON o_custkey = c_custkey"""


@_view
def v_timeline(d):
    return f"""
    SELECT l_orderkey AS article_id, l_orderkey % 25 + 1 AS city_id,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx,
           CASE WHEN l_linenumber = 7 THEN ' ' WHEN l_linenumber = 6 THEN 'STEP-1' WHEN l_linenumber = 5 THEN 'Comment_Period'
                ELSE 'step-' || {d.str('l_linenumber')} END AS key,
           'Label ' || {d.str('l_partkey % 50')} AS label,
           CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN {d.fmt('l_shipdate', 'ymd')}
                ELSE {d.fmt(d.plus('l_shipdate', 'HOUR', 'l_suppkey % 12 + 8'), 'iso')} END AS date,
           CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE {d.fmt(d.plus('l_shipdate', 'DAY', '200'), 'ymd')} END AS ends_at,
           CASE l_linestatus WHEN 'O' THEN 'Upcoming' WHEN 'F' THEN 'completed' ELSE 'odd' END AS status,
           CASE WHEN l_orderkey % 2 = 0 THEN 'STEP-2' ELSE NULL END AS current_key
    FROM @lineitem"""


@_view
def v_query(d):
    return f"""
    SELECT conv_id * 1000 + turn AS query_id, conv_id % 25 + 1 AS city_id,
           CASE WHEN turn % 2 = 0 AND conv_id % 2 = 0 THEN text || ' How do I sign up?' ELSE text END AS question
    FROM @conversations WHERE role = 'user'"""


@_view
def v_analysis(d):
    return f"""
    SELECT doc_id + 1 AS article_id, doc_id % 25 + 1 AS city_id,
           CASE WHEN doc_id % 17 = 0 THEN NULL ELSE cast(doc_id * 7 % 101 as double) / 100 END AS civic,
           cast(doc_id * 13 % 101 as double) / 100 AS agency, cast(doc_id * 29 % 101 as double) / 100 AS timeliness,
           CASE WHEN doc_id % 3 = 0 THEN 'llm_done' WHEN doc_id % 3 = 1 THEN 'heuristics_done' ELSE 'failed' END AS status
    FROM @documents WHERE doc_id % 11 <> 0"""


def _cte_order(names, d) -> list[str]:
    """The named views and the views they read, dependencies first."""
    done: list[str] = []

    def add(name):
        if name in done:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name](d)):
                add(other)
        done.append(name)

    for n in names:
        add(n)
    return done


def _resolve(text: str, d, sf_dir: str) -> str:
    names = "|".join(TABLES)
    return re.sub(rf"@({names})\b", lambda m: d.table(m.group(1), sf_dir), text)


def view_sql(name: str, sf_dir: str) -> str:
    d = SparkDialect()
    parts = [f"{n} AS ({VIEWS[n](d)})" for n in _cte_order([name], d)]
    return _resolve("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}", d, sf_dir)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy DataFrame; unused columns are pruned at the scan."""
    return spark.sql(view_sql(name, sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(body: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """Oracle SQL: the named views as CTEs, further CTE text, then the query."""
    d = DuckDialect()
    parts = [f"{n} AS ({VIEWS[n](d)})" for n in _cte_order(names, d)]
    if extra:
        parts.append(extra)
    head = "WITH " + ("RECURSIVE " if recursive else "")
    text = (head + ",\n".join(parts) + "\n" if parts else "") + body
    return _resolve(text, d, "")


@_view
def v_date_text(d):
    k = "o_orderkey"
    hour = d.plus("o_orderdate", "MINUTE", "(o_orderkey % 40) * 30")
    return f"""
    SELECT {k} AS id, o_orderdate AS day, {hour} AS moment,
           CASE {k} % 4 WHEN 0 THEN 'America/Chicago' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'America/Los_Angeles' ELSE 'UTC' END AS zone,
           {k} % 8 AS shape,
           CASE {k} % 8 WHEN 0 THEN {d.fmt('o_orderdate', 'mdy')} || ', 7:00 PM - 8:30 PM'
                WHEN 1 THEN '  ' || {d.fmt('o_orderdate', 'mdy')} WHEN 2 THEN {d.fmt('o_orderdate', 'ymd')}
                WHEN 3 THEN {d.fmt('o_orderdate', 'mdy')} WHEN 4 THEN {d.fmt('o_orderdate', 'mdy')}
                WHEN 5 THEN '' WHEN 6 THEN 'to be announced' ELSE {d.fmt('o_orderdate', 'md')} END AS date_text,
           CASE {k} % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN {d.fmt(hour, 'h12')}
                WHEN 3 THEN 'All day' WHEN 4 THEN '9-11:30 a.m.' WHEN 5 THEN {d.fmt(hour, 'iso')}
                WHEN 6 THEN '6 pm' ELSE '18:15 – 19:45' END AS time_text,
           CASE {k} % 4 WHEN 0 THEN {d.fmt(hour, 'iso')} WHEN 1 THEN {d.fmt('o_orderdate', 'ymd')}
                WHEN 2 THEN {d.fmt(hour, 'iso')} || 'Z' ELSE {d.fmt(hour, 'ymd')} || ' ' || {d.fmt(hour, 'hm')} END AS iso_text,
           CASE {k} % 3 WHEN 0 THEN {d.fmt('o_orderdate', 'compact')} WHEN 1 THEN {d.fmt(hour, 'ics')} || 'Z'
                ELSE {d.fmt(hour, 'ics')} END AS ics_text,
           CASE WHEN {k} % 5 = 0 THEN 'America/Los_Angeles' ELSE NULL END AS tzid
    FROM @orders"""


@_view
def v_question(d):
    return """
    SELECT o_orderkey AS query_id, o_orderkey % 25 + 1 AS city_id,
           CASE o_orderkey % 5 WHEN 0 THEN 'How do I object?' WHEN 1 THEN 'Budget news' WHEN 2 THEN 'When is the HEARING'
                WHEN 3 THEN o_orderpriority ELSE 'can I Sign Up today' END AS question
    FROM @orders"""


@_view
def v_candidate(d):
    return """
    SELECT l_orderkey AS query_id, l_partkey % (SELECT count(*) FROM @documents) + 1 AS article_id,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS candidate_pos
    FROM @lineitem"""


@_view
def v_entity(d):
    return f"""
    SELECT l_orderkey AS article_id, CASE l_linenumber % 4 WHEN 0 THEN 'Organization' WHEN 1 THEN 'person' WHEN 2 THEN 'location' ELSE 'organization' END AS entity_type,
           CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_suppkey + 1 END AS entity_id,
           CASE WHEN l_partkey % 11 = 0 THEN ' ' WHEN l_partkey % 7 = 0 THEN ' Parks Commission ' ELSE p_name END AS display_name
    FROM @lineitem JOIN @part ON l_partkey = p_partkey"""


@_view
def v_scores(d):
    flat = f"""'"agency":0.' || {d.str('doc_id % 10')} || ',"timeliness":"0.4","relevance":null,"orientation":"high"'"""
    just = f"""'"justifications":{{"agency":" said ' || {d.str('doc_id')} || ' ","relevance":" "}}'"""
    return f"""
    SELECT doc_id + 1 AS article_id,
           CASE doc_id % 4 WHEN 0 THEN '{{' || {flat} || '}}' WHEN 1 THEN '{{"dimensions":{{' || {flat} || '}},' || {just} || '}}'
                WHEN 2 THEN NULL ELSE '{{}}' END AS final_scores,
           CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '{{"dimensions":{{"agency":0.9}},' || {just} || '}}' END AS llm_scores
    FROM @documents"""


# --- names, announcements -------------------------------------------------------

@_view
def v_alias(d):
    return f"""
    SELECT id AS entity_id, CASE WHEN id % 2 = 0 THEN 'The Friends of ' || substring(sha1(slug), 1, 9) ELSE 'Desk ' || {d.str('id')} || ' West' END AS alias
    FROM v_org WHERE id % 5 <> 0"""


@_view
def v_mention(d):
    """Names as texts write them: exact, in capitals, as slug, by alias, misspelt, with an ending, and names of nobody known."""
    odd = "substring(sha1(cast(l_partkey % 300 AS varchar(20))), 1, 12)".replace("cast(l_partkey % 300 AS varchar(20))", d.str("l_partkey % 300"))
    at = "cast(l_orderkey % 6 + 3 as int)"
    return f"""
    SELECT lpad({d.str('l_orderkey')}, 10, '0') || lpad({d.str('l_linenumber')}, 2, '0')
             || lpad({d.str('l_partkey')}, 8, '0') || lpad({d.str('l_suppkey')}, 6, '0') || lpad({d.str('cast(round(l_extendedprice * 100) as bigint)')}, 10, '0') AS mention_id,
           CASE WHEN l_orderkey % 301 = 0 THEN NULL ELSE o.city_id END AS city_id,
           CASE l_partkey % 9 WHEN 0 THEN o.name WHEN 1 THEN '  ' || upper(replace(o.name, ' ', '   ')) WHEN 2 THEN o.slug WHEN 3 THEN lower(a.alias)
                WHEN 4 THEN substring(o.name, 1, {at}) || substring(o.name, {at} + 2) WHEN 5 THEN a.alias || ' Inc'
                WHEN 6 THEN 'Union ' || {odd} WHEN 7 THEN 'union ' || substring({odd}, 1, {at}) || substring({odd}, {at} + 2)
                ELSE CASE WHEN l_orderkey % 2 = 0 THEN ' ' ELSE 'Union  ' || {odd} || ' s' END END AS name
    FROM @lineitem JOIN v_org o ON o.id = l_suppkey + 1 LEFT JOIN v_alias a ON a.entity_id = o.id"""


@_view
def v_announcement(d):
    """Announced items; most of them on one day."""
    k = "o_orderkey"
    return f"""
    SELECT {k} AS id, CASE WHEN {k} % 211 = 0 THEN NULL ELSE {k} % 25 + 1 END AS city_id,
           CASE WHEN {k} % 97 = 0 THEN '--' WHEN {k} % 3 = 0 THEN upper(p_name) || ' public hearing, room ' || {d.str(k + ' % 40')}
                WHEN {k} % 3 = 1 THEN 'Public hearing: ' || p_name || ' room ' || {d.str(k + ' % 40')} ELSE p_name || ' workshop ' || {d.str('o_custkey')} END AS title,
           CASE WHEN {k} % 89 = 0 THEN NULL WHEN {k} % 10 < 6 THEN {d.plus(d.ts('1997-05-05 00:00:00'), 'MINUTE', k + ' % 1440')}
                ELSE {d.plus('o_orderdate', 'MINUTE', k + ' % 1440')} END AS at
    FROM @orders JOIN @part ON p_partkey = o_custkey % 37"""


# --- raw payloads: ten orders per payload ---------------------------------------

PAYLOAD_HEAD = """cast({idiv} as bigint) AS payload_id, {idiv} % (SELECT count(*) FROM @supplier) + 1 AS source_id, {idiv} % 25 + 1 AS city_id,
           'https://feed.example.org/list/' || {idiv_s} || '/index' AS request_url"""


def _payload(d, item, before="''", after="''", order="o_orderkey"):
    idiv = d.idiv("o_orderkey", "10")
    head = PAYLOAD_HEAD.format(idiv=idiv, idiv_s=d.str(idiv))
    return f"""
    SELECT payload_id, source_id, city_id, request_url, {before} || {d.agg('item', 'ord')} || {after} AS body
    FROM (SELECT {head}, o_orderkey AS ord, {item} AS item FROM @orders) x GROUP BY payload_id, source_id, city_id, request_url"""


@_view
def v_payload_rss(d):
    k = "o_orderkey"
    item = f"""'<item><title>' || CASE WHEN {k} % 17 = 0 THEN ' ' ELSE 'News ' || {d.str(k)} END || '</title><link>https://n.example.org/' || {d.str(k)}
      || '</link><description>&lt;p&gt;Short  ' || {d.str('o_custkey')} || '&lt;/p&gt;</description>'
      || CASE WHEN {k} % 3 = 0 THEN '<content:encoded><![CDATA[<div>Full <b>text</b>  ' || {d.str(k)} || '</div>]]></content:encoded>' ELSE '' END
      || '<pubDate>' || {d.fmt('o_orderdate', 'rfc')} || ' -0600</pubDate><guid>g-' || {d.str(k)} || '</guid></item>'"""
    return _payload(d, item, "'<rss version=\"2.0\" xmlns:content=\"http://purl.org/rss/1.0/modules/content/\"><channel><title>Feed</title>'", "'</channel></rss>'")


@_view
def v_payload_rss_events(d):
    k = "o_orderkey"
    item = f"""'<item><title>Show ' || {d.str(k)} || CASE {k} % 3 WHEN 0 THEN ' on ' || {d.fmt('o_orderdate', 'ymd')} || ' 18:30' ELSE '' END || '</title><link>/e/' || {d.str(k)}
      || '</link><description>About it</description>' || CASE WHEN {k} % 3 = 2 THEN '' ELSE '<pubDate>' || {d.fmt('o_orderdate', 'rfc')} || ' -0600</pubDate>' END || '<guid>e-' || {d.str(k)} || '</guid></item>'"""
    return _payload(d, item, "'<rss version=\"2.0\"><channel><title>Feed</title>'", "'</channel></rss>'")


@_view
def v_payload_ics(d):
    k = "o_orderkey"
    nl = "chr(13) || chr(10)"
    item = f"""'BEGIN:VEVENT' || {nl} || 'UID:u-' || {d.str(k)} || {nl}
      || CASE WHEN {k} % 13 = 0 THEN '' ELSE 'SUMMARY:Meeting ' || {nl} || '  ' || {d.str(k)} || {nl} END
      || CASE {k} % 3 WHEN 0 THEN 'DTSTART;VALUE=DATE:' || {d.fmt('o_orderdate', 'compact')} WHEN 1 THEN 'DTSTART:' || {d.fmt(d.plus('o_orderdate', 'HOUR', k + ' % 24'), 'ics')} || 'Z'
           ELSE 'DTSTART;TZID=America/Denver:' || {d.fmt(d.plus('o_orderdate', 'HOUR', k + ' % 24'), 'ics')} || {nl} || 'DTEND:' || {d.fmt(d.plus('o_orderdate', 'HOUR', k + ' % 24 + 1'), 'ics')} END || {nl}
      || CASE {k} % 4 WHEN 0 THEN 'LOCATION:<b>Hall</b>' WHEN 1 THEN 'LOCATION:Hall ' || {d.str(k + ' % 9')} ELSE 'LOCATION: ' END || {nl}
      || CASE {k} % 5 WHEN 0 THEN 'DESCRIPTION:/event/' || {d.str(k)} WHEN 1 THEN 'DESCRIPTION:Some words here' ELSE 'CLASS:PUBLIC' END || {nl}
      || CASE {k} % 2 WHEN 0 THEN 'URL:https://feed.example.org/list/' || {d.str(d.idiv(k, '10'))} || '/index' ELSE 'URL:sub/' || {d.str(k)} END || {nl}
      || 'SUMMARY:second value' || {nl} || 'END:VEVENT' || {nl}"""
    return _payload(d, item, f"'BEGIN:VCALENDAR' || {nl}", "'END:VCALENDAR'")


@_view
def v_payload_json(d):
    k = "o_orderkey"
    start = d.fmt(d.plus("o_orderdate", "MINUTE", k + " % 48 * 30"), "iso")
    idiv = d.idiv(k, "10")
    item = f"""'{{{{"id":' || {d.str(k)} || ',"title":"' || CASE WHEN {k} % 12 = 0 THEN '' ELSE 'Event ' || {d.str(k)} END || '","start_date":"'
      || CASE {k} % 6 WHEN 0 THEN '' WHEN 1 THEN {d.fmt('o_orderdate', 'ymd')} ELSE {start} END || '","url":"'
      || CASE {k} % 2 WHEN 0 THEN '/e//' || {d.str(k)} ELSE 'https://x.example.org//e//' || {d.str(k)} END || '","description":"'
      || CASE {k} % 3 WHEN 0 THEN '<h4>Venue</h4><p>x</p><h4 class=v> Arena <i>' || {d.str(k + ' % 7')} || '</i></h4>' ELSE '' END || '","long_description":"' || CASE {k} % 4 WHEN 0 THEN 'Long' ELSE '' END
      || '","venue":{{{{"name":"V' || {d.str(k + ' % 5')} || '","address":"1 Main"}}}},"location":' || CASE {k} % 5 WHEN 0 THEN 'null' ELSE '"Room ' || {d.str(k + ' % 5')} || '"' END
      || ',"library":"Central","state":"KS","city":"' || CASE {k} % 4 WHEN 1 THEN '' ELSE 'Town' END || '","all_day":' || CASE {k} % 7 WHEN 0 THEN '"Yes"' ELSE 'null' END
      || ',"startTime":"' || CASE {k} % 3 WHEN 0 THEN '' ELSE '19:30:00' END || '"}}}}' """.replace("{{", "{").replace("}}", "}")
    head = PAYLOAD_HEAD.format(idiv=idiv, idiv_s=d.str(idiv))
    return f"""
    SELECT payload_id, source_id, city_id, request_url, '{{"data":{{"events":[' || {d.agg('item', 'ord', "','")} || ']}}}}' AS body
    FROM (SELECT {head}, o_orderkey AS ord, {item} AS item FROM @orders) x GROUP BY payload_id, source_id, city_id, request_url"""


@_view
def v_payload_html(d):
    k = "o_orderkey"
    item = f"""'<div class="card event" data-year="' || {d.fmt('o_orderdate', 'y')} || '"><h3 class="name"><a href="/ev/' || {d.str(k + ' % 1000')} || '">' || CASE WHEN {k} % 11 = 0 THEN '' ELSE 'Talk  &amp; Tea ' || {d.str(k)} END
      || '</a></h3><div class="meta">' || CASE {k} % 4 WHEN 0 THEN {d.fmt('o_orderdate', 'md')} || ', 7 pm - 8:30 pm' WHEN 1 THEN {d.fmt('o_orderdate', 'mdy')} WHEN 2 THEN 'soon' ELSE {d.fmt('o_orderdate', 'md')} || ' 9:15 am' END
      || CASE WHEN {k} % 3 = 0 THEN '' ELSE ' - <span class="location">Pier ' || {d.str(k + ' % 8')} || '</span>' END
      || '</div><span class="date">' || {d.fmt('o_orderdate', 'mdy')} || '</span><span class="time">' || CASE {k} % 2 WHEN 0 THEN '10 am' ELSE '' END || '</span>'
      || CASE WHEN {k} % 9 = 0 THEN '<time datetime="' || {d.fmt(d.plus('o_orderdate', 'HOUR', '20'), 'iso')} || '">tonight</time>' ELSE '' END
      || '<div class="description"><p class="description_short">Short ' || {d.str(k)} || '</p></div></div>'"""
    return _payload(d, item, "'<html><body><div id=\"list\">'", "'</div></body></html>'")


@_view
def v_listing_page(d):
    k = "o_orderkey"
    item = f"""'<li><a class="story" href="' || CASE {k} % 6 WHEN 0 THEN '' WHEN 1 THEN '/stories/' || {d.str(k + ' % 5')} WHEN 2 THEN 'a/' || {d.str(k)} WHEN 3 THEN '//cdn.example.org/' || {d.str(k)}
        WHEN 4 THEN 'https://docs.google.com/d/' || {d.str(k + ' % 4')} ELSE 'Archive.aspx?ADID=' || {d.str(k + ' % 3')} END || '"> Story  <b>' || CASE WHEN {k} % 7 = 0 THEN '' ELSE {d.str(k)} END || '</b></a></li>'"""
    return _payload(d, item, "'<html><body><p>Date: ' || " + d.fmt("min(day)", "mdy") + " || '</p><ul>'", "'</ul></body></html>'").replace(
        "o_orderkey AS ord,", "o_orderkey AS ord, o_orderdate AS day,")


@_view
def v_page(d):
    """The given pages with head metadata added to some of them."""
    p = d.str("page_id")
    q = '\"'
    return f"""
    SELECT page_id, url, replace(html, '<head>', '<head>'
      || CASE WHEN page_id % 2 = 0 THEN '<link rel="canonical" href="/canon/' || {p} || '">' ELSE '' END
      || CASE WHEN page_id % 5 = 0 THEN '<meta property="og:url" content="https://og.example.org/' || {p} || '">' ELSE '' END
      || CASE WHEN page_id % 3 = 0 THEN '<meta property="og:title" content="OG ' || {p} || '">' ELSE '' END
      || CASE WHEN page_id % 4 = 0 THEN '<meta name="twitter:title" content="TW ' || {p} || '">' ELSE '' END
      || CASE WHEN page_id % 3 = 1 THEN '<meta property="article:published_time" content="2024-06-0' || {d.str('page_id % 9 + 1')} || 'T12:00:00Z">' ELSE '' END
      || CASE WHEN page_id % 3 = 2 THEN '<meta name="date" content="never">' ELSE '' END
      || CASE WHEN page_id % 2 = 1 THEN '<meta name="description" content="About ' || {p} || '">' ELSE '' END)
      || CASE WHEN page_id % 3 = 2 THEN '<time datetime="2024-07-0' || {d.str('page_id % 9 + 1')} || '">x</time>' ELSE '' END AS html FROM @pages"""


def view_over(spark: SparkSession, sf_dir: str, name: str, **tables: DataFrame) -> DataFrame:
    """A derived view in which some base tables are given DataFrames, such as a micro-batch."""
    text = view_sql(name, sf_dir)
    for t, df in tables.items():
        alias = f"batch_{t}"
        df.createOrReplaceTempView(alias)
        text = text.replace(SparkDialect().table(t, sf_dir), alias)
    return spark.sql(text)
