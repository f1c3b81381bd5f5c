"""CSV imports of organisations and sources, and triage of document extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall.config import CRON_BY_FREQUENCY, IMPORT_TYPES
from townhall.functions.text import blank_to_null, clean_newlines, meaningful_length, slugify
from townhall.operators.merge import upsert
from townhall.operators.ranking import rank_in_buckets
from townhall.session import settle


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Import files with a header; every column is text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, header=True, schema=schema, multiLine=False)


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def organization_type(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t == "", "unknown").when(t.isin("government", "gov"), "government").when(t.isin("nonprofit", "ngo"), "nonprofit").otherwise(t)


def suffixed(base: Column, n: Column) -> Column:
    """base, base-2, base-3, ..."""
    return F.when(n == 1, base).otherwise(F.concat(base, F.lit("-"), n.cast("string")))


def _numbers(slugs: DataFrame) -> DataFrame:
    """base, n: what each slug takes: itself as number 1, and number n of its base if it ends in -n."""
    c = F.col
    tail = F.regexp_extract("slug", r"^(.+)-([1-9]\d{0,8})$", 2)
    both = slugs.select(F.explode(F.array_compact(F.array(
        F.struct(c("slug").alias("base"), F.lit(1).alias("n")),
        F.when((tail != "") & (tail != "1"), F.struct(F.regexp_extract("slug", r"^(.+)-([1-9]\d{0,8})$", 1).alias("base"), tail.cast("int").alias("n")))))).alias("x"))
    return both.select("x.base", "x.n").distinct()


def free_numbers(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """base, k, n: the k-th number of a base that nobody has taken, for as many k as ``wanted`` (base, rows) says.

    Candidates are as many numbers as there are rows and taken numbers, less the taken ones.
    """
    c = F.col
    own = taken.join(wanted.select("base"), "base", "left_semi")
    most = wanted.join(own.groupBy("base").agg(F.count("*").alias("held")), "base", "left").select(
        "base", F.explode(F.sequence(F.lit(1), (c("rows") + F.coalesce("held", F.lit(0))).cast("int"))).alias("n"))
    return rank_in_buckets(most.join(own, ["base", "n"], "left_anti"), ["base"], F.floor(c("n") / 4096), [c("n")], "k")


def _name_rows(rows: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """``rows`` with a slug: the first numbers of their base that are free, in ``order``.

    ``stored`` has the slugs others own. A base of this import that itself looks like a numbered slug keeps its place free.
    """
    c = F.col
    bases = rows.groupBy("base").agg(F.count("*").alias("rows"))
    numbered = _numbers(bases.select(c("base").alias("slug"))).filter("n > 1")
    free = settle(free_numbers(settle(bases), _numbers(stored).unionByName(numbered).distinct()))
    ranked = rank_in_buckets(rows, ["base"], F.floor(c(order) / 4096), [c(order)], "k")
    return ranked.join(free, ["base", "k"]).withColumn("slug", suffixed(c("base"), c("n"))).drop("k", "n")


def import_organizations(rows: DataFrame, existing: DataFrame, city_id: int) -> DataFrame:
    """New organisation snapshot after a CSV import, keyed by id; the last row of an id wins.

    A slug is the first free one of base, base-2, base-3, ... in file order; the slugs of
    organisations outside the import are taken. Rows need id, name, type, pos (file order).
    """
    c = F.col
    valid = rows.withColumns({"name": blank_to_null(c("name")), "id": c("id").try_cast("bigint")}).filter("id IS NOT NULL AND id <> 0 AND name IS NOT NULL")
    valid = valid.withColumns({
        "city_id": F.lit(city_id).cast("bigint"), "base": F.coalesce(F.nullif(slugify(c("name")), F.lit("")), F.lit("organization")),
        "type": organization_type(c("type"))})
    last = settle(valid.groupBy("id").agg(F.max_by(F.struct("city_id", "name", "base", "type", "pos"), "pos").alias("v")).select("id", "v.*"))
    others = existing.join(last.select("id"), "id", "left_anti").filter(c("city_id") == city_id).select("slug")
    return upsert(existing, _name_rows(last, others, "pos"), ["id"], "pos")


def import_counts(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """total, created, updated, skipped of an organisation import."""
    c = F.col
    valid = (c("id").try_cast("bigint").isNotNull()) & (c("id") != "0") & blank_to_null(c("name")).isNotNull()
    tagged = rows.select(c("id").try_cast("bigint").alias("id"), valid.alias("ok")).join(
        existing.select("id", F.lit(True).alias("known")), "id", "left")
    return tagged.agg(F.count("*").alias("total"), F.count_if(c("ok") & c("known").isNull()).alias("created"),
                      F.count_if(c("ok") & c("known").isNotNull()).alias("updated"), F.count_if(~c("ok")).alias("skipped"))


def import_scrapers(rows: DataFrame, existing: DataFrame, city_id: int) -> DataFrame:
    """New source snapshot after a CSV import, keyed by (city, slug).

    The slug a legacy id owns under its base is kept; other rows take the first free one in file order, so no
    stored source of another id is written over.
    ``rows``: id, name, scrape_type, scrape_url, is_active, frequency, pos.
    ``existing``: city_id, slug, name, type, source_url, is_enabled, schedule_cron, legacy_id.
    """
    c = F.col
    valid = rows.filter(F.length("name") > 0).withColumns({
        "city_id": F.lit(city_id).cast("bigint"), "base": F.coalesce(F.nullif(slugify(c("name")), F.lit("")), F.lit("scraper")),
        "type": F.coalesce(F.try_element_at(_literal_map(IMPORT_TYPES), c("scrape_type")), F.lit("unknown")), "source_url": c("scrape_url"),
        "is_enabled": F.lower(F.trim("is_active")).isin("1", "true", "on", "yes"),
        "schedule_cron": F.try_element_at(_literal_map(CRON_BY_FREQUENCY), c("frequency")), "legacy_id": c("id")})
    stored = existing.filter(c("city_id") == city_id)
    # Any slug of the base that the legacy id already has: the base itself first, then the lowest number.
    held = stored.select("legacy_id", "slug").withColumn("_tail", F.regexp_extract("slug", r"-([1-9]\d{0,8})$", 1))
    held = held.select("legacy_id", F.explode(F.array_compact(F.array(
        F.struct(c("slug").alias("base"), F.lit(1).alias("n"), c("slug").alias("own")),
        F.when(c("_tail") != "", F.struct(F.regexp_replace("slug", r"-[1-9]\d{0,8}$", "").alias("base"), c("_tail").cast("int").alias("n"), c("slug").alias("own")))))).alias("h"))
    owned = settle(held.groupBy("legacy_id", "h.base").agg(F.min(F.struct("h.n", "h.own"))["own"].alias("own")))
    known = settle(valid.join(owned, ["legacy_id", "base"], "left"))
    groups = settle(known.filter("own IS NULL").groupBy("base", "legacy_id").agg(F.min("pos").alias("first")))
    names = _name_rows(groups, stored.select("slug"), "first").select("base", c("legacy_id").alias("_legacy"), c("slug").alias("_new"), c("base").alias("_base"))
    same = (known["base"] == c("_base")) & known["legacy_id"].eqNullSafe(c("_legacy"))
    named = known.join(names.drop("base"), same, "left").withColumn("slug", F.coalesce("own", "_new"))
    return upsert(existing, named, ["city_id", "slug"], "pos")


def extraction_triage(results: DataFrame) -> DataFrame:
    """Status, error and text of document extraction.

    ``results``: article_id, http_status, content_type, exit_code, text, ocr_enabled,
    ocr_status, ocr_error, ocr_text. The first condition that holds decides.
    """
    c = F.col
    staged = results.withColumns({"_n": meaningful_length(F.coalesce("text", F.lit(""))), "_ocr": meaningful_length(F.coalesce("ocr_text", F.lit("")))})
    http_bad = ~c("http_status").between(200, 299)
    no_pdf = ~F.coalesce(F.lower("content_type").contains("application/pdf"), F.lit(False))
    status = (
        F.when(http_bad | no_pdf | (c("exit_code") != 0), "failed").when(c("_n") > 0, "success").when(~c("ocr_enabled"), "empty")
        .when(c("ocr_status") == "failed", "failed").when(c("_ocr") == 0, "empty").otherwise("ocr_success")
    )
    error = (
        F.when(http_bad, F.concat(F.lit("HTTP request failed (status "), c("http_status").cast("string"), F.lit(")")))
        .when(no_pdf, "Non-PDF response detected").when(c("exit_code") != 0, F.concat(F.lit("pdftotext failed (exit code "), c("exit_code").cast("string"), F.lit(")")))
        .when(c("_n") > 0, F.lit(None)).when(~c("ocr_enabled"), "Scanned PDF (no text layer); OCR not enabled for this scraper.")
        .when(c("ocr_status") == "failed", F.coalesce("ocr_error", F.lit("OCR failed"))).when(c("_ocr") == 0, "No extractable text after OCR")
    )
    text = F.when(status == "success", clean_newlines(c("text"))).when(status == "ocr_success", clean_newlines(c("ocr_text")))
    return staged.select("article_id", status.alias("status"), error.alias("error"), text.alias("cleaned_text"))
