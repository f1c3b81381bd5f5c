"""Read models of the article page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall.config import DIMENSIONS
from townhall.functions.dates import moment_utc, parse_local_datetime, to_local
from townhall.functions.text import blank_to_null, contains_any, snake
from townhall.functions.urls import calendar_link, usable_url
from townhall.operators.ranking import rank_in_buckets
from townhall.operators.skew import lookup_join
from townhall.session import settle

DECISION_MAKER_WORDS = ["city", "commission", "board", "council"]


def entity_groups(entities: DataFrame, organizations: DataFrame, people: DataFrame, locations: DataFrame) -> DataFrame:
    """article_id, group, name per entity; a known id replaces the written name.

    The three name tables are looked up as one table keyed by (type, id).
    """
    c = F.col
    names = None
    for kind, df in (("organization", organizations), ("person", people), ("location", locations)):
        one = df.select(F.lit(kind).alias("type"), c("id").alias("entity_id"), c("name").alias("known_name"))
        names = one if names is None else names.unionByName(one)
    rows = entities.withColumn("type", F.lower("entity_type"))
    rows = lookup_join(rows, names, ["type", "entity_id"], how="left", spread="article_id")
    name = F.coalesce("known_name", blank_to_null(c("display_name")), F.lit(""))
    group = (
        F.when((c("type") == "organization") & contains_any(F.lower("name"), DECISION_MAKER_WORDS), "Decision-makers")
        .when(c("type") == "organization", "Organizations mentioned").when(c("type") == "person", "People mentioned")
        .when(c("type") == "location", "Locations mentioned")
    )
    return rows.withColumn("name", name).filter(F.length("name") > 0).withColumn("group", group).filter("group IS NOT NULL").select(
        "article_id", "group", "name", "type")


def article_dimensions(analyses: DataFrame) -> DataFrame:
    """Dimensions and justifications out of open JSON, nested or flat, final then model scores."""
    final, model = F.try_parse_json("final_scores"), F.try_parse_json("llm_scores")
    staged = analyses.withColumns({"_final": final, "_llm": model})
    empty = F.col("_final").isNull() | F.col("final_scores").rlike(r"^\s*(\{\s*\}|\[\s*\]|null)\s*$")
    staged = staged.withColumn("_payload", F.when(empty, F.col("_llm")).otherwise(F.col("_final")))
    text = lambda v, path: F.try_variant_get(v, path, "string")
    nested = text(F.col("_payload"), "$.dimensions").isNotNull()
    own = text(F.col("_payload"), "$.justifications").isNotNull()
    dim = lambda d: F.when(nested, text(F.col("_payload"), f"$.dimensions.{d}")).otherwise(text(F.col("_payload"), f"$.{d}")).try_cast("double")
    why = lambda d: F.coalesce(blank_to_null(
        F.when(own, text(F.col("_payload"), f"$.justifications.{d}")).otherwise(text(F.col("_llm"), f"$.justifications.{d}"))), F.lit(""))
    return staged.select("article_id", *[dim(d).alias(d) for d in DIMENSIONS], *[why(d).alias("why_" + d) for d in DIMENSIONS])


VIEW_TYPES = {
    "meeting": "meeting", "hearing": "meeting", "comment": "public_comment", "comment_period": "public_comment",
    "public_comment": "public_comment", "deadline": "deadline", "application": "application",
}


def view_type(c: Column) -> Column:
    t = snake(F.lower(blank_to_null(c)))
    out = None
    for k, v in VIEW_TYPES.items():
        out = F.when(t == k, v) if out is None else out.when(t == k, v)
    return out.otherwise("other")


def payload_opportunities(payload: DataFrame, cities: DataFrame, as_of: Column) -> DataFrame:
    """Opportunities of an analysis with parsed dates. Needs pos, type, title, date, time, starts_at, ends_at text."""
    c = F.col
    zone = F.coalesce("timezone", F.lit("UTC"))
    rows = payload.join(cities, "city_id", "left").withColumn("_when", parse_noonless(c("date"), c("time"), zone, F.year(as_of)))
    return rows.select(
        "article_id", "city_id", "pos", view_type(c("type")).alias("type"), blank_to_null(c("title")).alias("title"),
        F.coalesce(blank_to_null(c("description")), blank_to_null(c("title"))).alias("description"), blank_to_null(c("location")).alias("location"),
        usable_url(c("url")).alias("url"), F.coalesce(c("_when"), moment_utc(c("starts_text"), F.lit("UTC"), F.year(as_of))).alias("starts_at"),
        moment_utc(c("ends_text"), F.lit("UTC"), F.year(as_of)).alias("ends_at"), blank_to_null(c("time")).isNotNull().alias("has_time"))


def parse_noonless(date: Column, time: Column, zone: Column, year: Column) -> Column:
    """UTC start of date and time; a date alone is local midnight."""
    t = F.coalesce(blank_to_null(time), F.lit("00:00"))
    return parse_local_datetime(blank_to_null(date), t, zone, year)["starts_at"]


def table_opportunities(rows: DataFrame) -> DataFrame:
    """Stored opportunity rows in the same shape."""
    c = F.col
    title = blank_to_null(c("title"))
    return rows.select(
        "article_id", "city_id", "pos", view_type(c("kind")).alias("type"), title.alias("title"),
        F.coalesce(title, blank_to_null(c("notes"))).alias("description"), blank_to_null(c("location")).alias("location"),
        usable_url(c("url")).alias("url"), "starts_at", "ends_at",
        F.coalesce(F.date_format("starts_at", "HH:mm:ss") != "00:00:00", F.lit(False)).alias("has_time"))


def opportunity_list(payload: DataFrame, stored: DataFrame) -> DataFrame:
    """Payload opportunities, or the stored ones of articles without any, by start else end, none last."""
    c = F.col
    payload = settle(payload)
    rest = stored.join(payload.select("article_id").distinct(), "article_id", "left_anti")
    rows = payload.unionByName(rest).withColumn("_sort", F.coalesce("starts_at", "ends_at"))
    bucket = F.struct(F.coalesce(F.unix_date(c("_sort").cast("date")), F.lit(9_999_999)).alias("d"), F.when(c("_sort").isNull(), F.floor(c("pos") / 1024)).otherwise(0).cast("bigint").alias("p"))
    return rank_in_buckets(rows, ["article_id"], bucket, [c("_sort").asc_nulls_last(), c("pos")], "position").drop("_sort")


ACTION_TITLES = {"meeting": "Attend the Hearing", "public_comment": "Submit a Comment", "deadline": "Deadline", "application": "Apply / Submit"}


def participation_actions(opportunities: DataFrame, articles: DataFrame, first_urls: DataFrame, cities: DataFrame) -> DataFrame:
    """One card per opportunity plus a source-document card per article with a URL."""
    c = F.col
    zone = F.coalesce("timezone", F.lit("UTC"))
    local = to_local(c("starts_at"), zone)
    date_line = F.when(c("has_time"), F.date_format(local, "MMM d, yyyy h:mm a")).otherwise(F.date_format(local, "MMM d, yyyy"))
    link = calendar_link(c("starts_at"), c("ends_at"), F.coalesce("title", F.lit("Attend the Hearing")), c("location"), c("description"))
    title = F.coalesce(*[F.when(c("type") == k, v) for k, v in ACTION_TITLES.items()], F.lit("Take Action"))
    has_url = c("url").isNotNull()
    meeting = c("type") == "meeting"
    cta = (
        F.when(meeting & c("starts_at").isNotNull(), "Add to calendar").when(~has_url, F.lit(None))
        .when(c("type") == "public_comment", "Submit online").when(c("type") == "application", "Apply now").otherwise("View details")
    )
    due = F.date_format(to_local(F.coalesce("ends_at", "starts_at"), zone), "MMM d")
    badge = F.when(c("type") == "public_comment", F.concat(F.lit("Closes "), due)).when(c("type").isin("deadline", "application"), F.concat(F.lit("Due "), due))
    cards = opportunities.join(cities, "city_id", "left").select(
        "article_id", "position", title.alias("card_title"),
        F.when(c("type") == "other", F.coalesce("description", "title")).otherwise(F.coalesce("title", "description")).alias("subtitle"),
        F.array_join(F.array_compact(F.array(date_line, c("location"))), " · ").alias("meta"), cta.alias("cta_label"),
        F.when(meeting, F.coalesce(link, c("url"))).otherwise(c("url")).alias("cta_url"), badge.alias("badge"))
    source = articles.join(first_urls, "article_id", "left").withColumn("u", F.coalesce(blank_to_null(c("canonical_url")), c("source_url"))).filter("u IS NOT NULL")
    none = F.lit(None).cast("string")
    last = source.select(
        "article_id", F.lit(None).cast("bigint").alias("position"), F.lit("Read the Proposal").alias("card_title"),
        F.lit("Full application and supporting documents").alias("subtitle"), F.lit("").alias("meta"), F.lit("View documents").alias("cta_label"),
        c("u").alias("cta_url"), none.alias("badge"))
    return cards.unionByName(last)


def timeline_view(items: DataFrame, cities: DataFrame) -> DataFrame:
    """Items with the date label of their city zone."""
    local = to_local(F.col("at"), F.coalesce("timezone", F.lit("UTC")))
    label = F.when(F.col("has_time"), F.date_format(local, "MMM d, yyyy h:mm a")).otherwise(F.date_format(local, "MMM d, yyyy"))
    return items.join(cities, "city_id", "left").select(
        "article_id", "position", "label", label.alias("date_label"), F.col("at").isNotNull().alias("has_date"), "item_status", "badge")


def article_page(articles: DataFrame, cities: DataFrame, bodies: DataFrame, scrapers: DataFrame, organizations: DataFrame, analyses: DataFrame,
                 sources: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """The head of every article page: one row with names, scores, first source and child counts.

    Children stay in their own tables, keyed by article and position; here each is
    reduced to one number per article, all of them in one grouping.
    """
    tagged = None
    for name, df in children.items():
        one = df.select("article_id", F.lit(name).alias("t"))
        tagged = one if tagged is None else tagged.unionByName(one)
    counts = tagged.groupBy("article_id").agg(*[F.count_if(F.col("t") == n).alias("n_" + n) for n in children])
    first = sources.groupBy("article_id").agg(F.count("*").alias("n_sources"), F.min_by("source_url", F.struct("created_at", "id")).alias("first_source"))
    by_id = lambda df: df.withColumnRenamed("article_id", "id")
    s = scrapers.select(F.col("id").alias("scraper_id"), F.col("name").alias("scraper_name"), "organization_id")
    o = organizations.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"))
    c = cities.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"))
    b = bodies.select("article_id", F.length("cleaned_text").alias("body_chars"))
    a = analyses.select("article_id", "civic", F.col("status").alias("analysis_status"))
    rows = articles.join(c, "city_id", "left").join(s, "scraper_id", "left").join(o, "organization_id", "left")
    for part in (b, a, first, counts):
        rows = rows.join(by_id(part), "id", "left")
    return rows.fillna(0, ["n_sources", *["n_" + n for n in children]])
