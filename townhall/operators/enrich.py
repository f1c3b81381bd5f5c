"""The whole enrichment job over finished model answers, as one set of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall import config as C
from townhall.functions.scalars import clamp01
from townhall.functions.text import trim_all
from townhall.operators import actions, claims, timeline
from townhall.operators.heuristics import civic_relevance
from townhall.operators.skew import by_key


@dataclass
class Enriched:
    analyses: DataFrame
    claims: DataFrame
    keywords: DataFrame
    entities: DataFrame
    issue_areas: DataFrame
    civic_actions: DataFrame
    timeline_items: DataFrame
    explainers: DataFrame
    dictionary: DataFrame


def normalize_outputs(outputs: DataFrame) -> DataFrame:
    """Parsed and normalised answers: a (analysis), e (entities), t (timeline), x (explainer)."""
    p = F.col("p")
    return claims.read_payload(outputs).select(
        "article_id", "city_id", "scraper_id", claims.normalize_analysis(p["analysis"]).alias("a"),
        claims.normalize_entities(p["enrichment"]).alias("e"), claims.normalize_timeline(p["process_timeline"]).alias("t"),
        claims.normalize_explainer(p["explainer"]).alias("x"), clamp01(p["confidence"]).alias("overall_confidence"))


def analysis_rows(normal: DataFrame) -> DataFrame:
    dims = {d: F.col("a.dimensions")[d] for d in C.DIMENSIONS}
    return normal.select(
        "article_id", "city_id", *[c.alias(k) for k, c in dims.items()], civic_relevance(dims).alias("civic_relevance"),
        claims.merge_confidence(F.col("a.confidence"), F.col("overall_confidence")).alias("confidence"), F.lit("llm_done").alias("status"), F.lit(C.SCORE_VERSION).alias("score_version"))


def claim_values(rows: DataFrame) -> DataFrame:
    """Claims in the shape the projections read."""
    v = F.col("value")
    pos = F.concat(F.lpad(F.col("article_id").cast("string"), 19, "0"), F.lpad(F.col("pos").cast("string"), 6, "0"))
    return rows.withColumns({"value_text": F.coalesce(v["name"], v["keyword"], v["slug"]), "pos": pos})


def gated(outputs: DataFrame, bodies: DataFrame, min_chars: int = C.MIN_TEXT_CHARS) -> DataFrame:
    """Answers of articles whose text is too short, or missing, count as empty. Only lengths are shuffled."""
    long_enough = bodies.filter(F.length(trim_all(F.col("cleaned_text"))) >= min_chars).select(F.col("article_id").alias("_long")).distinct()
    return outputs.join(by_key(long_enough), F.col("article_id") == F.col("_long"), "left").withColumn(
        "payload", F.when(F.col("_long").isNotNull(), F.col("payload"))).drop("_long")


def enrich(outputs: DataFrame, cities: DataFrame, scrapers: DataFrame, organizations: DataFrame, areas: DataFrame,
           keywords: DataFrame, as_of: Column, settle: Callable[[DataFrame], DataFrame] = lambda df: df,
           bodies: DataFrame | None = None, stored_claims: DataFrame | None = None, source: str = "llm") -> Enriched:
    """All tables one enrichment pass writes.

    ``settle`` writes and re-reads the normalised answers, so that the JSON is parsed
    once although eight tables are made from it. With ``bodies`` the length gate applies. ``stored_claims``
    are those of earlier passes: proposed ones of ``source`` are replaced, all others of the articles
    stay and take part in the projections.
    """
    normal = settle(normalize_outputs(outputs if bodies is None else gated(outputs, bodies)))
    claim_rows = claims.listed_areas(claim_values(claims.explode_claims(normal, source)), areas)
    if stored_claims is not None:
        replaced = (F.col("source") == source) & (F.col("status") == "proposed")
        stay = stored_claims.filter(~F.coalesce(replaced, F.lit(False))).join(by_key(normal.select("article_id").distinct()), "article_id", "left_semi")
        claim_rows = stay.select(*claim_rows.columns).unionByName(claim_rows)
    usable = claims.usable_claims(claim_rows, source=source)
    dictionary = claims.keyword_dictionary(usable, keywords)

    written = normal.select("article_id", "city_id", F.posexplode("a.opportunities").alias("pos", "o")).select(
        "article_id", "city_id", "pos", "o.type", "o.date", "o.time", "o.location", "o.url", "o.description",
        F.try_element_at("o.evidence", F.lit(1))["quote"].alias("evidence_quote"))
    opportunities = actions.opportunities_or_claims(written, claims.claimed_opportunities(claim_rows), normal)
    body = claims.decision_body(claim_rows, normal.select("article_id", "scraper_id"), scrapers, organizations)
    labelled = actions.label_actions(opportunities, cities, body, as_of)

    items = normal.select("article_id", "city_id", F.col("t.current_key").alias("current_key"), F.posexplode("t.items").alias("idx", "i")).select(
        "article_id", "city_id", "current_key", "idx", "i.key", "i.label", "i.date", F.lit(None).cast("string").alias("ends_at"), "i.status"
    ).join(cities, "city_id", "left").withColumn("timezone", F.coalesce("timezone", F.lit("UTC")))

    return Enriched(
        analyses=analysis_rows(normal), claims=claim_rows, keywords=claims.project_keywords(usable, dictionary),
        entities=claims.project_entities(usable), issue_areas=claims.project_issue_areas(usable, areas),
        civic_actions=actions.civic_actions(labelled), timeline_items=timeline.timeline_items(items, as_of),
        explainers=normal.select("article_id", "city_id", "x.*"), dictionary=dictionary)


TABLES = ("claims", "keywords", "entities", "issue_areas", "civic_actions", "timeline_items", "explainers", "analyses")


def enrichment_counts(result: Enriched, keywords: DataFrame) -> DataFrame:
    """Rows written per article and table, and how many of its keywords stood in ``keywords``, the dictionary before the pass; one long union and one grouping."""
    parts = result.keywords.join(keywords.select(F.col("id").alias("keyword_id")), "keyword_id", "left_semi").select("article_id", F.lit("known_keywords").alias("t"))
    for name in TABLES:
        parts = parts.unionByName(getattr(result, name).select("article_id", F.lit(name).alias("t")))
    n = lambda t: F.count_if(F.col("t") == t).alias("n_" + t)
    return parts.groupBy("article_id").agg(*[n(t) for t in (*TABLES, "known_keywords")])
