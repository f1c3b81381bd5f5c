"""Run accounting, worklists and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.config import MIN_TEXT_CHARS
from townhall.functions.text import trim_all
from townhall.operators.dedupe import has_required
from townhall.operators.events import writable

ACTIVE = ["queued", "running"]


def classify_items(items: DataFrame, matches: DataFrame, labels: DataFrame) -> DataFrame:
    """pos, run_id, outcome: skipped, updated or created.

    An item updates when it matches a stored article or an earlier item of the batch.
    ``matches`` and ``labels`` cover the items with all required fields.
    """
    ok = items.select("pos", "run_id", has_required(items).alias("ok"))
    known = matches.select("pos", F.lit(True).alias("matched"))
    outcome = (
        F.when(~F.col("ok"), "skipped")
        .when(F.col("matched") | (F.col("label") < F.col("pos")), "updated")
        .otherwise("created")
    )
    return ok.join(known, "pos", "left").join(labels, "pos", "left").select("pos", "run_id", outcome.alias("outcome"))


def scrape_run_accounting(outcomes: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("items_found"), n("created").alias("items_created"), n("updated").alias("items_updated"),
        n("skipped").alias("skipped_missing_required"), F.lit("success").alias("status"))


def event_run_accounting(items: DataFrame) -> DataFrame:
    return items.groupBy("run_id").agg(
        F.count("*").alias("items_found"),
        F.count_if(writable(F.col("title"), F.col("starts_at_local"))).alias("items_written"))


def pdf_worklist(articles: DataFrame, bodies: DataFrame) -> DataFrame:
    """PDF articles that have no extracted body yet."""
    done = bodies.filter("extracted_at IS NOT NULL").select(F.col("article_id").alias("id"))
    return articles.filter("content_type = 'pdf'").join(done, "id", "left_anti")


def enrichment_worklist(articles: DataFrame, bodies: DataFrame, min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Articles with enough text; the text is measured at the scan and not carried on."""
    long_enough = bodies.select(F.col("article_id").alias("id"), F.length(trim_all(F.col("cleaned_text"))).alias("text_chars")).filter(
        F.col("text_chars") >= min_chars)
    return articles.join(long_enough, "id")


def sources_with_active_run(sources: DataFrame, runs: DataFrame, key: str = "scraper_id") -> DataFrame:
    active = runs.filter(F.col("status").isin(ACTIVE)).select(F.col(key).alias("id"))
    return sources.join(active, "id", "left_semi")


def sources_without_active_run(sources: DataFrame, runs: DataFrame, key: str = "scraper_id") -> DataFrame:
    active = runs.filter(F.col("status").isin(ACTIVE)).select(F.col(key).alias("id"))
    return sources.join(active, "id", "left_anti")


def llm_done_articles(articles: DataFrame, analyses: DataFrame, city_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Articles with a finished analysis by id; the limit is the caller's page size."""
    done = analyses.filter("status = 'llm_done'").select(F.col("article_id").alias("id"))
    rows = articles if city_id is None else articles.filter(F.col("city_id") == city_id)
    rows = rows.join(done, "id", "left_semi").orderBy("id")
    return rows if limit is None else rows.limit(limit)
