"""Queries over heuristic scoring."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from townhall import config as C
from townhall.operators import heuristics as H
from townhall.plans.fixtures import with_views
from townhall.plans.registry import query, stamp

AS_OF = "1998-10-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


TEXT_SQL = """txt AS (SELECT *, regexp_replace(concat_ws(' ', CASE WHEN trim(title) <> '' THEN title END,
  CASE WHEN trim(summary) <> '' THEN summary END, CASE WHEN regexp_matches(cleaned_text, '\\S') THEN cleaned_text END), '^\\s+|\\s+$', '', 'g') AS t FROM civic_text)"""


# Every non-word character is doubled so that neighbouring phrases do not share their edge.
LOW_SQL = TEXT_SQL + """, low AS (SELECT *, regexp_replace(' ' || lower(t) || ' ', '([^a-z0-9_])', '\\1\\1', 'g') AS low2 FROM txt)"""


def _hits(phrases):
    one = lambda p: re.sub(r"([^a-z0-9_])", r"\1\1", p)
    return "(" + " + ".join(f"len(regexp_extract_all(low2, '[^a-z0-9_]{one(p)}[^a-z0-9_]'))" for p in phrases) + ")"


WORDS_SQL = "CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\\s+')) END"
SENT_SQL = "CASE WHEN t = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(t, '[.!?]+'))) END"
SYL_SQL = """list_sum(list_transform(string_split_regex(lower(t), '\\s+'), lambda w0: list_transform([regexp_replace(w0, '[^a-z]', '', 'g')], lambda w:
  CASE WHEN w = '' THEN 0 WHEN length(w) <= 3 THEN 1
    ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND w NOT LIKE '%le' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END)[1]))"""
READ_SQL = "greatest(0.0, least(1.0, (206.835 - 1.015 * (cast(w as double) / s) - 84.6 * (cast(y as double) / w)) / 100))"
COUNTS_SQL = LOW_SQL + f""", counts AS (SELECT *, cast({WORDS_SQL} as bigint) AS w, cast({SENT_SQL} as bigint) AS s, cast({SYL_SQL} as bigint) AS y,
  {_hits(C.JARGON_TERMS)} AS jargon, {_hits(C.AGENCY_PHRASES)} AS agency_n, {_hits(C.ORIENTATION_PHRASES)} AS orient_n,
  {_hits(C.REPRESENTATION_PHRASES)} AS repr_n, {_hits(C.RELEVANCE_PHRASES)} AS rel_n,
  {_hits(C.MEETING_PHRASES)} AS meet_n, {_hits(C.COMMENT_PERIOD_PHRASES)} AS com_n, {_hits(C.DEADLINE_PHRASES)} AS dead_n,
  len(regexp_extract_all(regexp_replace(t, '([^A-Za-z0-9_])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9_])[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+(?:$|[^A-Za-z0-9_])')) AS names FROM low)"""
MONTH_NUM = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substring({}, 1, 3)))"
DATES_SQL = COUNTS_SQL + f""", cand AS (SELECT article_id, unnest(list_distinct(list_concat(
    regexp_extract_all(t, '(?i)\\b{C.MONTH}[.]?\\s+\\d{{1,2}}(?:,\\s*\\d{{4}})?\\b'),
    regexp_extract_all(t, '\\b\\d{{1,2}}[/-]\\d{{1,2}}(?:[/-]\\d{{2,4}})?\\b'), regexp_extract_all(t, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b')))) AS c FROM counts),
  parsed AS (SELECT *, CASE WHEN regexp_full_match(c, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(c as date)
     WHEN regexp_matches(c, '^[A-Za-z]') THEN try_cast(coalesce(nullif(regexp_extract(c, ',\\s*(\\d{{4}})', 1), ''), '1998') || '-' || {MONTH_NUM.format('c')} || '-' || regexp_extract(c, '\\s(\\d{{1,2}})', 1) as date)
     WHEN regexp_full_match(c, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') THEN try_cast('19' || split_part(c, '/', 3) || '-' || split_part(c, '/', 1) || '-' || split_part(c, '/', 2) as date) END AS d0 FROM cand),
  fut AS (SELECT article_id, CASE WHEN NOT regexp_matches(c, '\\b\\d{{4}}\\b') AND d0 < date'1998-10-01' THEN cast(d0 + interval 1 year as date) ELSE d0 END AS d FROM parsed),
  nxt AS (SELECT article_id, min(d) AS d, count(*) AS n FROM fut WHERE d > timestamp'{AS_OF}' GROUP BY 1),
  scored AS (SELECT c.*, n.d AS next_date, coalesce(n.n, 0) AS n_future, o.type AS org_type,
    {READ_SQL} AS readability, CASE WHEN w > 0 THEN cast(jargon as double) / w ELSE 0 END AS density
    FROM counts c LEFT JOIN nxt n USING (article_id) LEFT JOIN v_scraper sc ON sc.id = c.scraper_id LEFT JOIN v_org o ON o.id = sc.organization_id),
  dims AS (SELECT *, greatest(0, least(1, readability - least(0.5, density * 2.5))) AS comprehensibility,
    CASE orient_n WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 0.85 END AS orientation,
    least(1, 0.25 + least(0.5, names * 0.1) + CASE WHEN repr_n > 0 THEN 0.2 ELSE 0 END) AS representation,
    CASE agency_n WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 0.85 END + CASE WHEN next_date IS NOT NULL THEN 0.1 ELSE 0 END AS agency,
    CASE WHEN org_type = 'government' THEN 0.65 ELSE 0.4 END + CASE WHEN rel_n > 0 THEN 0.15 ELSE 0 END AS relevance,
    CASE WHEN next_date IS NULL THEN 0.2 WHEN next_date <= date'1998-10-08' THEN 0.9 WHEN next_date <= date'1998-10-31' THEN 0.7 ELSE 0.5 END AS timeliness
    FROM scored),
  final AS (SELECT *, least(1, comprehensibility * 0.25 + orientation * 0.2 + agency * 0.2 + representation * 0.15 + relevance * 0.1 + timeliness * 0.1) AS civic FROM dims)"""


def _o(select):
    return with_views(select, "civic_text", "v_scraper", "v_org", extra=DATES_SQL)


def _c(select, extra=COUNTS_SQL):
    return with_views(select, "civic_text", extra=extra)


def _signals(s):
    return H.text_signals(s.wide("civic_text"), as_of())


def _scored(s):
    return H.score_articles(s.wide("civic_text"), s.view("v_scraper"), s.view("v_org"), as_of())


@query("scoring_text", _c("SELECT article_id, t AS scoring_text FROM txt", TEXT_SQL))
def _(s):
    return s.wide("civic_text").select("article_id", H.scoring_text().alias("scoring_text"))


@query("text_counts", _c("SELECT article_id, w AS word_count, s AS sentence_count, y AS syllable_count FROM counts"))
def _(s):
    return _signals(s).select("article_id", "word_count", "sentence_count", "syllable_count")


@query("readability", _c(f"SELECT article_id, round({READ_SQL}, 6) AS readability FROM counts"))
def _(s):
    c = F.col
    return _signals(s).select("article_id", F.round(H.readability(c("word_count"), c("sentence_count"), c("syllable_count")), 6).alias("readability"))


@query("jargon", _o("SELECT article_id, jargon AS hits, round(density, 6) AS density, round(least(0.5, density * 2.5), 6) AS penalty, round(comprehensibility, 6) AS comprehensibility FROM dims"))
def _(s):
    d = F.col("jargon_density")
    return _scored(s).select("article_id", F.col("jargon_hits").alias("hits"), F.round(d, 6).alias("density"),
                             F.round(F.least(F.lit(0.5), d * 2.5), 6).alias("penalty"), F.round("comprehensibility", 6).alias("comprehensibility"))


@query("future_dates", _o("SELECT article_id, strftime(d, '%Y-%m-%d') AS future_date FROM fut WHERE d > timestamp'1998-10-01 00:00:00'"))
def _(s):
    return _signals(s).select("article_id", F.explode("future_dates").alias("d")).select(
        "article_id", F.date_format("d", "yyyy-MM-dd").alias("future_date"))


@query("timeliness", _o("SELECT article_id, n_future, strftime(next_date, '%Y-%m-%d') AS next_date, timeliness FROM dims"))
def _(s):
    return _scored(s).select("article_id", F.size("future_dates").alias("n_future"), F.date_format("next_date", "yyyy-MM-dd").alias("next_date"), "timeliness")


@query("agency", _o("SELECT article_id, agency_n AS matches, round(agency, 6) AS agency FROM dims"))
def _(s):
    return _scored(s).select("article_id", F.col("agency_matches").alias("matches"), F.round("agency", 6).alias("agency"))


@query("orientation", _o("SELECT article_id, orient_n AS matches, round(orientation, 6) AS orientation FROM dims"))
def _(s):
    return _scored(s).select("article_id", F.col("orientation_matches").alias("matches"), F.round("orientation", 6).alias("orientation"))


@query("representation", _o("SELECT article_id, names AS named_entities, repr_n AS matches, round(representation, 6) AS representation FROM dims"))
def _(s):
    return _scored(s).select("article_id", "named_entities", F.col("representation_matches").alias("matches"), F.round("representation", 6).alias("representation"))


@query("relevance", _o("SELECT article_id, org_type, rel_n AS matches, round(relevance, 6) AS relevance FROM dims"))
def _(s):
    return _scored(s).select("article_id", "org_type", F.col("relevance_matches").alias("matches"), F.round("relevance", 6).alias("relevance"))


OPP_ROW = """SELECT article_id, '{kind}' AS kind, CASE WHEN title <> '' THEN '{pre}: ' || title ELSE '{bare}' END AS title,
  {st} AS starts_at, {en} AS ends_at, (regexp_extract_all(t, '(?i)https?://[^\\s)]+'))[1] AS url, {conf} AS confidence FROM dims WHERE next_date IS NOT NULL AND {cond}"""
D_SQL = "strftime(next_date, '%Y-%m-%d')"
N_SQL = "cast(NULL as varchar)"


@query("heuristic_opportunities", _o(" UNION ALL ".join([
    OPP_ROW.format(kind="meeting", pre="Meeting", bare="Public meeting", st=D_SQL, en=N_SQL, conf=0.55, cond="meet_n > 0"),
    OPP_ROW.format(kind="comment_period", pre="Comment period", bare="Comment period", st=N_SQL, en=D_SQL, conf=0.55, cond="com_n > 0"),
    OPP_ROW.format(kind="deadline", pre="Deadline", bare="Deadline", st=N_SQL, en=D_SQL, conf=0.5, cond="dead_n > 0")])))
def _(s):
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return H.heuristic_opportunities(_scored(s), F.lit(None).cast("string")).select(
        "article_id", "kind", "title", fmt("starts_at"), fmt("ends_at"), "url", "confidence")


@query("civic_relevance", """
SELECT doc_id, round(least(1, 0.25 * least(1, (doc_id * 7 % 151) / 100.0) + 0.2 * (doc_id * 11 % 101) / 100.0 + 0.2 * (doc_id * 13 % 101) / 100.0
  + 0.15 * greatest(0, (doc_id * 17 % 121 - 20) / 100.0) + 0.1 * (doc_id * 19 % 101) / 100.0), 6) AS civic FROM documents""")
def _(s):
    k = F.col("doc_id")
    dims = {"comprehensibility": (k * 7 % 151) / 100, "orientation": (k * 11 % 101) / 100, "agency": (k * 13 % 101) / 100,
            "representation": (k * 17 % 121 - 20) / 100, "relevance": (k * 19 % 101) / 100, "timeliness": F.lit(None).cast("double")}
    return s.table("documents").select("doc_id", F.round(H.civic_relevance(dims), 6).alias("civic"))


FINAL = ["comprehensibility", "orientation", "representation", "agency", "relevance", "timeliness"]


@query("score_articles", _o("SELECT article_id, 'heuristics_done' AS status, " + ", ".join(f"round({d}, 6) AS {d}" for d in FINAL) + ", round(civic, 8) AS civic_relevance FROM final"))
def _(s):
    return _scored(s).select("article_id", "status", *[F.round(d, 6).alias(d) for d in FINAL], F.round("civic_relevance", 8).alias("civic_relevance"))
