"""One ingestion batch: de-duplicate against the state and inside the batch, then write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.operators import dedupe, merge
from townhall.operators.ranking import number_rows

ARTICLE_COLUMNS = ["id", "city_id", "title", "summary", "content_type", "status", "canonical_url", "content_hash"]
BODY_COLUMNS = ["article_id", "cleaned_text", "lang"]
SOURCE_COLUMNS = ["article_id", "city_id", "source_url", "source_uid", "source_type"]


def resolve(items: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Writable items with the article they belong to.

    A group of items that match each other takes the stored article of its best
    match; groups without one get a new id.
    """
    good = items.filter(dedupe.has_required(items))
    matches = dedupe.match_existing(good, articles, sources)
    labels = dedupe.label_batch(good)
    groups = labels.join(matches, "pos", "left").groupBy("label").agg(
        F.min(F.when(F.col("article_id").isNotNull(), F.struct("tier", "article_id")))["article_id"].alias("known"))
    top = articles.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new = number_rows(groups.filter("known IS NULL").select("label"), F.col("label"), "new_id", top)
    ids = groups.join(new, "label", "left").select("label", F.coalesce("known", "new_id").alias("article_id"))
    # Ids meet first; the items join last.
    return good.join(labels.join(ids, "label").select("pos", "article_id"), "pos")


def write_batch(resolved: DataFrame, articles: DataFrame, bodies: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New snapshots of articles, bodies and sources."""
    rows = merge.article_rows(resolved).withColumns({
        "id": F.col("article_id"), "lang": F.lit("en"), "source_type": F.lit("web")})
    return (
        merge.upsert(articles, rows, ["id"], "pos"),
        merge.upsert(bodies, rows.filter("cleaned_text IS NOT NULL"), ["article_id"], "pos"),
        merge.upsert(sources, rows, ["article_id", "source_url"], "pos"),
    )


def ingest(items: DataFrame, articles: DataFrame, bodies: DataFrame, sources: DataFrame,
           settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``settle`` may write and re-read the resolved items, so that the three merges share one computation."""
    return write_batch(settle(resolve(items, articles, sources)), articles, bodies, sources)
