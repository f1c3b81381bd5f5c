"""Queries over de-duplication, keyed writes and run accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from townhall import config as C
from townhall.operators import dedupe, merge, runs
from townhall.operators.events import normalize_events, packed, unpacked
from townhall.operators.ranking import number_rows
from townhall.plans.fixtures import with_views
from townhall.plans.q_functions import EVENT_CTE
from townhall.plans.registry import query, stamp, stamp_sql

OK = "city_id IS NOT NULL AND title IS NOT NULL AND source_url IS NOT NULL"
KNOWN = ["v_item", "v_known_article", "v_known_source"]
MATCH_CTE = f"""good AS (SELECT * FROM v_item WHERE {OK}),
k1 AS (SELECT city_id, canonical_url AS k, min(id) AS id FROM v_known_article WHERE canonical_url IS NOT NULL GROUP BY ALL),
k2 AS (SELECT s.city_id, source_url AS k, min(article_id) AS id FROM v_known_source s JOIN v_known_article a ON a.id = s.article_id AND a.city_id = s.city_id GROUP BY ALL),
k3 AS (SELECT s.city_id, source_uid AS k, min(article_id) AS id FROM v_known_source s JOIN v_known_article a ON a.id = s.article_id AND a.city_id = s.city_id WHERE source_uid IS NOT NULL GROUP BY ALL),
k4 AS (SELECT city_id, content_hash AS k, min(id) AS id FROM v_known_article WHERE content_hash IS NOT NULL GROUP BY ALL),
matched AS (SELECT pos, run_id, g.city_id, coalesce(k1.id, k2.id, k3.id, k4.id) AS article_id,
   CASE WHEN k1.id IS NOT NULL THEN 1 WHEN k2.id IS NOT NULL THEN 2 WHEN k3.id IS NOT NULL THEN 3 WHEN k4.id IS NOT NULL THEN 4 END AS tier
 FROM good g LEFT JOIN k1 ON k1.city_id = g.city_id AND k1.k = coalesce(g.canonical_url, g.source_url)
 LEFT JOIN k2 ON k2.city_id = g.city_id AND k2.k = g.source_url LEFT JOIN k3 ON k3.city_id = g.city_id AND k3.k = g.source_uid
 LEFT JOIN k4 ON k4.city_id = g.city_id AND k4.k = g.content_hash)"""
COMP_CTE = MATCH_CTE + """,
keys AS (SELECT pos, 1 AS t, city_id, coalesce(canonical_url, source_url) AS k FROM good UNION ALL SELECT pos, 2, city_id, source_url FROM good
  UNION ALL SELECT pos, 3, city_id, source_uid FROM good WHERE source_uid IS NOT NULL UNION ALL SELECT pos, 4, city_id, content_hash FROM good WHERE content_hash IS NOT NULL),
link AS (SELECT DISTINCT a.pos AS a, b.pos AS b FROM keys a JOIN (SELECT t, city_id, k, min(pos) AS pos FROM keys GROUP BY ALL) b USING (t, city_id, k) WHERE a.pos <> b.pos),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT pos AS a, pos AS b FROM good UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
labels AS (SELECT a AS pos, min(b) AS label FROM reach GROUP BY a)"""


def _good(s):
    items = s.wide("v_item", "lineitem")
    return items.filter(dedupe.has_required(items))


def _matches(s):
    return dedupe.match_existing(_good(s), s.view("v_known_article"), s.view("v_known_source"))


def _labels(s):
    return dedupe.label_batch(_good(s))


@query("dedupe_cascade", with_views("SELECT pos, tier, article_id FROM matched", *KNOWN, extra=MATCH_CTE))
def _(s):
    return _good(s).select("pos").join(_matches(s), "pos", "left")


@query("dedupe_within_batch", with_views("""SELECT label, count(*) AS n_items, max(pos) AS last_pos, arg_max(g.title, pos) AS title,
  arg_max(coalesce(g.canonical_url, '-'), pos) AS canonical_url FROM labels JOIN good g USING (pos) GROUP BY label""", *KNOWN, extra=COMP_CTE, recursive=True))
def _(s):
    return dedupe.collapse_batch(_good(s), _labels(s)).select(
        "label", "n_items", "last_pos", "title", F.coalesce("canonical_url", F.lit("-")).alias("canonical_url"))


@query("dedupe_tier_stats", with_views("SELECT city_id, coalesce(cast(tier as varchar), 'new') AS tier, count(*) AS n FROM matched GROUP BY ALL", *KNOWN, extra=MATCH_CTE))
def _(s):
    return _good(s).select("pos", "city_id").join(_matches(s), "pos", "left").groupBy(
        "city_id", F.coalesce(F.col("tier").cast("string"), F.lit("new")).alias("tier")).agg(F.count("*").alias("n"))


def _events(s):
    city = s.view("v_city").select(F.col("id").alias("city_id"), "timezone")
    return normalize_events(s.wide("v_event_item", "lineitem"), city)


EV = ["v_event_item", "v_city"]


@query("event_dedupe", with_views("SELECT source_hash, count(*) AS n_items, count(DISTINCT event_source_id) AS n_sources, max(pos) AS last_pos FROM hashed GROUP BY 1", *EV, extra=EVENT_CTE))
def _(s):
    return _events(s).groupBy("source_hash").agg(
        F.count("*").alias("n_items"), F.countDistinct("event_source_id").alias("n_sources"), F.max("pos").alias("last_pos"))


@query("scrape_run_accounting", with_views(f"""SELECT run_id, count(*) AS items_found, count(*) FILTER (o = 'created') AS items_created,
  count(*) FILTER (o = 'updated') AS items_updated, count(*) FILTER (o = 'skipped') AS skipped_missing_required, 'success' AS status
FROM (SELECT i.run_id, CASE WHEN l.pos IS NULL THEN 'skipped' WHEN m.article_id IS NOT NULL OR l.label < i.pos THEN 'updated' ELSE 'created' END AS o
  FROM v_item i LEFT JOIN labels l ON l.pos = i.pos LEFT JOIN matched m ON m.pos = i.pos) GROUP BY run_id""", *KNOWN, extra=COMP_CTE, recursive=True))
def _(s):
    return runs.scrape_run_accounting(runs.classify_items(s.wide("v_item", "lineitem"), _matches(s), _labels(s)))


@query("event_run_accounting", with_views("""SELECT run_id, count(*) AS items_found, count(*) FILTER (trim(title) <> '' AND starts_at_local IS NOT NULL) AS items_written
FROM v_event_item GROUP BY 1""", "v_event_item"))
def _(s):
    return runs.event_run_accounting(s.wide("v_event_item", "lineitem"))


@query("pdf_extraction_worklist", with_views("""SELECT id, city_id, canonical_url FROM v_article a WHERE content_type = 'pdf'
  AND NOT EXISTS (SELECT 1 FROM v_body b WHERE b.article_id = a.id AND extracted_at IS NOT NULL)""", "v_article", "v_body"))
def _(s):
    return runs.pdf_worklist(s.view("v_article"), s.view("v_body")).select("id", "city_id", "canonical_url")


@query("enrichment_worklist", with_views("""SELECT id, city_id, length(regexp_replace(cleaned_text, '^\\s+|\\s+$', '', 'g')) AS text_chars FROM v_article JOIN v_body ON article_id = id
WHERE length(regexp_replace(cleaned_text, '^\\s+|\\s+$', '', 'g')) >= 800""", "v_article", "v_body"))
def _(s):
    return runs.enrichment_worklist(s.view("v_article"), s.view("v_body")).select("id", "city_id", "text_chars")


@query("active_run_guard", with_views("SELECT id, name FROM v_scraper s WHERE EXISTS (SELECT 1 FROM v_run r WHERE r.scraper_id = s.id AND status IN ('queued', 'running'))", "v_scraper", "v_run"))
def _(s):
    return runs.sources_with_active_run(s.view("v_scraper"), s.view("v_run")).select("id", "name")


@query("llm_done_articles", with_views("SELECT id, title FROM v_article a WHERE city_id = 4 AND EXISTS (SELECT 1 FROM v_analysis x WHERE x.article_id = a.id AND x.status = 'llm_done') ORDER BY id LIMIT 20", "v_article", "v_analysis"))
def _(s):
    return runs.llm_done_articles(s.view("v_article"), s.view("v_analysis"), city_id=4, limit=20).select("id", "title")


# --- keyed writes ----------------------------------------------------------

NEW_CTE = MATCH_CTE + f""", resolved AS (SELECT g.*, coalesce(m.article_id, -1) AS article_id,
   CASE WHEN m.article_id IS NULL THEN coalesce(g.canonical_url, g.source_url) END AS new_key FROM good g JOIN matched m USING (pos)),
 written AS (SELECT city_id, article_id, new_key, arg_max(pos, pos) AS pos FROM resolved GROUP BY ALL),
 fresh AS (SELECT city_id, new_key, (SELECT max(id) FROM v_known_article) + row_number() OVER (ORDER BY sha1(cast(city_id as varchar) || '|' || new_key)) AS id FROM (SELECT DISTINCT city_id, new_key FROM written WHERE article_id = -1))"""


def resolve_items(s):
    """Items with their article id; items without a match get a new id per city and URL."""
    items = _good(s).join(_matches(s).select("pos", "article_id"), "pos", "left")
    key = F.when(F.col("article_id").isNull(), F.coalesce("canonical_url", "source_url"))
    items = items.withColumn("new_key", key)
    top = s.view("v_known_article").agg(F.max("id")).scalar()
    fresh = items.filter("article_id IS NULL").select("city_id", "new_key").distinct()
    fresh = number_rows(fresh, F.concat_ws("|", F.col("city_id").cast("string"), F.col("new_key")), "new_id", top)
    return items.join(fresh, ["city_id", "new_key"], "left").withColumn("article_id", F.coalesce("article_id", "new_id")).drop("new_id", "new_key")


@query("upsert_articles", with_views("""SELECT id, city_id, title, summary, content_type, status, canonical_url FROM (
  SELECT coalesce(f.id, w.article_id) AS id, i.city_id, i.title,
    coalesce(i.summary, i.cleaned_text) AS summary, coalesce(i.content_type, 'unknown') AS content_type, 'published' AS status, i.canonical_url
  FROM written w JOIN v_item i USING (pos) LEFT JOIN fresh f ON f.city_id = w.city_id AND f.new_key = w.new_key
  UNION ALL SELECT id, city_id, title, cast(NULL as varchar), 'unknown', 'published', canonical_url FROM v_known_article
  WHERE id NOT IN (SELECT article_id FROM written))""", *KNOWN, extra=NEW_CTE))
def _(s):
    old = s.view("v_known_article").select(
        "id", "city_id", "title", F.lit(None).cast("string").alias("summary"), F.lit("unknown").alias("content_type"), F.lit("published").alias("status"), "canonical_url")
    batch = merge.article_rows(resolve_items(s)).withColumn("id", F.col("article_id"))
    return merge.upsert(old, batch, ["id"], "pos")


@query("upsert_article_bodies", with_views("""SELECT article_id, cleaned_text, 'en' AS lang FROM (
  SELECT article_id, arg_max(cleaned_text, pos) AS cleaned_text FROM matched m JOIN v_item i USING (pos) WHERE article_id IS NOT NULL AND cleaned_text IS NOT NULL GROUP BY 1)
 UNION ALL SELECT id, 'old body', 'en' FROM v_known_article WHERE id NOT IN (SELECT article_id FROM matched JOIN v_item USING (pos) WHERE article_id IS NOT NULL AND cleaned_text IS NOT NULL)""", *KNOWN, extra=MATCH_CTE))
def _(s):
    old = s.view("v_known_article").select(F.col("id").alias("article_id"), F.lit("old body").alias("cleaned_text"), F.lit("en").alias("lang"))
    batch = _good(s).filter("cleaned_text IS NOT NULL").join(_matches(s), "pos").withColumn("lang", F.lit("en"))
    return merge.upsert(old, batch, ["article_id"], "pos")


@query("upsert_article_sources", with_views(f"""SELECT article_id, source_url, source_uid, source_type FROM (
  SELECT m.article_id, source_url, arg_max(coalesce(source_uid, '-'), pos) AS source_uid, 'web' AS source_type FROM matched m JOIN v_item i USING (pos) WHERE article_id IS NOT NULL GROUP BY 1, 2)
 UNION ALL SELECT article_id, source_url, max(coalesce(source_uid, '-')), 'old' FROM v_known_source s
 WHERE NOT EXISTS (SELECT 1 FROM matched m JOIN v_item i USING (pos) WHERE m.article_id = s.article_id AND i.source_url IS NOT DISTINCT FROM s.source_url) GROUP BY 1, 2""", *KNOWN, extra=MATCH_CTE))
def _(s):
    uid = F.coalesce("source_uid", F.lit("-"))
    old = s.view("v_known_source").groupBy("article_id", "source_url").agg(F.max(uid).alias("source_uid")).withColumn("source_type", F.lit("old"))
    batch = _good(s).join(_matches(s), "pos").withColumn("source_type", F.lit("web")).withColumn("source_uid", uid)
    return merge.upsert(old, batch, ["article_id", "source_url"], "pos")


@query("upsert_events", with_views(f"""SELECT source_hash, city_id, trim(title) AS title, {stamp_sql('starts_at_local')} AS starts_at, all_day
FROM (SELECT *, row_number() OVER (PARTITION BY source_hash ORDER BY pos DESC) AS rn FROM hashed) WHERE rn = 1""", *EV, extra=EVENT_CTE))
def _(s):
    ev = _events(s).withColumnRenamed("starts_at_local", "starts_at").select("pos", "source_hash", "city_id", "title", "starts_at", "all_day", "event_source_id")
    cols = ["source_hash", "city_id", "title", "starts_at", "all_day"]
    old, batch = ev.filter("event_source_id % 2 = 0"), ev
    snapshot = merge.upsert(old.limit(0).select(*cols), old, ["source_hash"], "pos")
    return merge.upsert(snapshot, batch, ["source_hash"], "pos").withColumn("starts_at", stamp("starts_at"))


@query("upsert_event_source_items", with_views("""SELECT source_hash, event_source_id, external_id, max(pos) AS last_pos FROM hashed GROUP BY ALL""", *EV, extra=EVENT_CTE))
def _(s):
    ev = packed(_events(s)).select("source_hash", "event_source_id", "source_url", "external_id", "pos", F.col("pos").alias("last_pos"))
    keys = ["source_hash", "event_source_id", "source_url", "external_id"]
    old = ev.filter("event_source_id % 3 = 0").groupBy(*keys).agg(F.max("pos").alias("last_pos"))
    merged = merge.upsert(old, ev, keys, "pos")
    return unpacked(merged.groupBy("source_hash", "event_source_id", "external_id").agg(F.max("last_pos").alias("last_pos")))


CL = "article_id, claim_type, value_text, status, confidence, pos"


@query("replace_claims", with_views(f"""SELECT {CL} FROM v_claim c WHERE substring(pos, 11, 2) <> '07' AND NOT (status = 'proposed' AND EXISTS (
   SELECT 1 FROM v_claim b WHERE b.article_id = c.article_id AND substring(b.pos, 11, 2) = '07'))
 UNION ALL SELECT article_id, claim_type, value_text, 'proposed', confidence, pos FROM v_claim WHERE substring(pos, 11, 2) = '07'""", "v_claim"))
def _(s):
    cols = [c.strip() for c in CL.split(",")]
    claims = s.wide("v_claim", "lineitem")
    is_new = F.substring("pos", 11, 2) == "07"
    batch = claims.filter(is_new).withColumn("status", F.lit("proposed")).select(*cols, "source")
    old = claims.filter(~is_new).select(*cols, "source")
    return merge.replace_groups(old, batch, ["article_id", "source"], replaceable=F.col("status") == "proposed").select(*cols)


@query("replace_projection", with_views("""SELECT article_id, idx, key FROM v_timeline t WHERE article_id % 10 <> 3
 UNION ALL SELECT article_id, idx + 100, 'new-' || key FROM v_timeline WHERE article_id % 10 = 3 AND article_id % 20 <> 3""", "v_timeline"))
def _(s):
    old = s.wide("v_timeline", "lineitem").select("article_id", "idx", "key").withColumn("source", F.lit("analysis"))
    touched = old.filter("article_id % 10 = 3").select("article_id", "source")
    batch = old.filter("article_id % 10 = 3 AND article_id % 20 <> 3").withColumns({"idx": F.col("idx") + 100, "key": F.concat(F.lit("new-"), F.col("key"))})
    return merge.replace_groups(old, batch, ["article_id", "source"], touched).drop("source")


@query("upsert_analysis", with_views("""SELECT article_id, CASE WHEN article_id % 2 = 0 THEN 'llm_done' ELSE status END AS status,
  CASE WHEN article_id % 5 = 4 THEN NULL ELSE agency END AS heuristic_score, CASE WHEN article_id % 2 = 0 THEN round(timeliness / 2, 6) ELSE civic END AS civic
FROM v_analysis WHERE article_id % 5 <> 4 OR article_id % 2 = 0""", "v_analysis"))
def _(s):
    a = s.view("v_analysis")
    old = a.filter("article_id % 5 <> 4").select("article_id", "status", F.col("agency").alias("heuristic_score"), "civic")
    batch = a.filter("article_id % 2 = 0").select("article_id", F.lit("llm_done").alias("status"), F.round(F.col("timeliness") / 2, 6).alias("civic"), F.lit(1).alias("pos"))
    return merge.upsert(old, batch, ["article_id"], "pos", keep=["heuristic_score"])


@query("search_documents", with_views("""SELECT a.id, a.city_id, a.title, a.summary, coalesce(substring(b.cleaned_text, 1, 20000), '') AS body, greatest(0, coalesce(length(b.cleaned_text), 0) - 20000) AS body_cut,
  strftime(a.published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published_at, strftime(a.created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at,
  s.organization_id, a.scraper_id, b.extraction_status, x.source_url
FROM v_article a LEFT JOIN v_body b ON b.article_id = a.id LEFT JOIN v_scraper s ON s.id = a.scraper_id
LEFT JOIN (SELECT article_id, source_url FROM v_article_source QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at, id) = 1) x ON x.article_id = a.id""",
    "v_article", "v_body", "v_scraper", "v_article_source"))
def _(s):
    return merge.search_documents(s.view("v_article"), s.view("v_body"), s.view("v_scraper"), s.view("v_article_source"), C.SEARCH_BODY_CHARS)
