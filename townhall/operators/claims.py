"""Structured model answers: normalisation, claims and their projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall import config as C
from townhall.functions.scalars import clamp01, json_hash, normalize_evidence, normalize_evidence_map, normalize_strings
from townhall.functions.text import blank_to_null, contains_any, slugify, squish, trim_all
from townhall.operators.ranking import number_rows
from townhall.operators.skew import lookup_join
from townhall.session import settle

_EV = "array<struct<quote:string,start:string,end:string>>"
_ENTITY = "confidence:string,evidence:" + _EV
_DIMS = ",".join(f"{d}:string" for d in C.DIMENSIONS)
# Every leaf is read as text and cleaned by expressions, so a wrong type is not an error.
PAYLOAD_SCHEMA = (
    f"analysis struct<dimensions:struct<{_DIMS}>,justifications:struct<{_DIMS}>,"
    f"opportunities:array<struct<type:string,date:string,time:string,location:string,url:string,description:string,evidence:{_EV}>>,confidence:string>,"
    f"process_timeline struct<items:array<struct<key:string,label:string,date:string,ends_at:string,status:string,badge_text:string,note:string,position:string,evidence:{_EV}>>,current_key:string>,"
    f"enrichment struct<people:array<struct<name:string,role:string,{_ENTITY}>>,organizations:array<struct<name:string,type_guess:string,{_ENTITY}>>,"
    f"locations:array<struct<name:string,address:string,{_ENTITY}>>,keywords:array<struct<keyword:string,{_ENTITY}>>,"
    f"issue_areas:array<struct<slug:string,{_ENTITY}>>,confidence:string>,"
    f"explainer struct<whats_happening:string,why_it_matters:string,key_details:array<string>,what_to_watch:array<string>,evidence:map<string,{_EV}>>,"
    "confidence string"
)


def read_payload(outputs: DataFrame) -> DataFrame:
    """Parse the JSON once; an unreadable answer becomes a null payload."""
    parsed = F.from_json("payload", PAYLOAD_SCHEMA)
    return outputs.withColumn("p", parsed)


def _clean(items: Column, row, keep) -> Column:
    """Normalise every element and keep the valid ones; a missing list stays null."""
    return F.filter(F.transform(items, row), keep)


def normalize_analysis(a: Column) -> Column:
    """Clamped dimensions, justifications without nulls, opportunities of an allowed type."""
    opps = _clean(
        a["opportunities"],
        lambda o: F.struct(
            F.lower(blank_to_null(o["type"])).alias("type"),
            *[blank_to_null(o[f]).alias(f) for f in ("date", "time", "location", "url")],
            F.coalesce(blank_to_null(o["description"]), F.lit("")).alias("description"),
            normalize_evidence(o["evidence"]).alias("evidence")),
        lambda o: o["type"].isin(C.OPPORTUNITY_TYPES))
    return F.struct(
        F.struct(*[clamp01(a["dimensions"][d]).alias(d) for d in C.DIMENSIONS]).alias("dimensions"),
        F.struct(*[F.coalesce(blank_to_null(a["justifications"][d]), F.lit("")).alias(d) for d in C.DIMENSIONS]).alias("justifications"),
        opps.alias("opportunities"), clamp01(a["confidence"]).alias("confidence"))


def normalize_entities(e: Column, allowed_slugs: Column | None = None) -> Column:
    """People, organisations, locations, keywords and issue areas with clean names.

    ``allowed_slugs`` is the lower-cased list of the city; a missing or empty list allows all.
    """
    tail = lambda i: [clamp01(i["confidence"]).alias("confidence"), normalize_evidence(i["evidence"]).alias("evidence")]
    kind = lambda i: F.lower(blank_to_null(i["type_guess"]))
    named = lambda i: i["name"].isNotNull()
    slug_ok = lambda i: i["slug"].isNotNull()
    if allowed_slugs is not None:
        slug_ok = lambda i: i["slug"].isNotNull() & (
            F.coalesce(F.size(allowed_slugs) == 0, F.lit(True)) | F.array_contains(allowed_slugs, i["slug"]))
    return F.struct(
        _clean(e["people"], lambda i: F.struct(blank_to_null(i["name"]).alias("name"), blank_to_null(i["role"]).alias("role"), *tail(i)), named).alias("people"),
        _clean(e["organizations"], lambda i: F.struct(
            blank_to_null(i["name"]).alias("name"),
            F.when(kind(i).isin(C.ORGANIZATION_TYPES), kind(i)).otherwise("other").alias("type_guess"), *tail(i)), named).alias("organizations"),
        _clean(e["locations"], lambda i: F.struct(blank_to_null(i["name"]).alias("name"), blank_to_null(i["address"]).alias("address"), *tail(i)), named).alias("locations"),
        _clean(e["keywords"], lambda i: F.struct(blank_to_null(i["keyword"]).alias("keyword"), *tail(i)), lambda i: i["keyword"].isNotNull()).alias("keywords"),
        _clean(e["issue_areas"], lambda i: F.struct(F.lower(blank_to_null(i["slug"])).alias("slug"), *tail(i)), slug_ok).alias("issue_areas"),
        clamp01(e["confidence"]).alias("confidence"))


def normalize_timeline(t: Column) -> Column:
    """Items with key and label; a status outside the list is unknown."""
    status = lambda i: F.lower(blank_to_null(i["status"]))
    items = _clean(
        t["items"],
        lambda i: F.struct(
            blank_to_null(i["key"]).alias("key"), blank_to_null(i["label"]).alias("label"), blank_to_null(i["date"]).alias("date"),
            F.when(status(i).isin(C.TIMELINE_STATUSES), status(i)).otherwise("unknown").alias("status"),
            blank_to_null(i["badge_text"]).alias("badge_text"), blank_to_null(i["note"]).alias("note"),
            normalize_evidence(i["evidence"]).alias("evidence")),
        lambda i: i["key"].isNotNull() & i["label"].isNotNull())
    return F.struct(items.alias("items"), blank_to_null(t["current_key"]).alias("current_key"))


def normalize_explainer(x: Column) -> Column:
    sections = F.map_filter(x["evidence"], lambda k, _: k.isin("whats_happening", "why_it_matters"))
    return F.struct(
        blank_to_null(x["whats_happening"]).alias("whats_happening"), blank_to_null(x["why_it_matters"]).alias("why_it_matters"),
        normalize_strings(x["key_details"]).alias("key_details"), normalize_strings(x["what_to_watch"]).alias("what_to_watch"),
        normalize_evidence_map(sections).alias("evidence"))


def merge_confidence(civic: Column, enrichment: Column) -> Column:
    return F.when(civic > 0, civic).otherwise(enrichment)


def enrichment_gate(bodies: DataFrame, min_chars: int = C.MIN_TEXT_CHARS, max_chars: int | None = None) -> DataFrame:
    """Bodies long enough to be enriched; if the caller gives the longest text a model takes, cut to it. ``cut_chars`` says how much went."""
    text = trim_all(F.col("cleaned_text"))
    return bodies.withColumn("text", text).filter(F.length("text") >= min_chars).withColumns({
        "text": F.col("text") if max_chars is None else F.substring("text", 1, max_chars),
        "cut_chars": F.lit(0) if max_chars is None else F.greatest(F.length("text") - max_chars, F.lit(0))})


def explode_claims(entities: DataFrame, source: str = "llm") -> DataFrame:
    """One claim row per list element. Input: article_id, city_id, e (normalised entities).

    The five lists become one array, so the answers are read and exploded once.
    """
    null = F.lit(None).cast("string")

    def lift(items: Column, kind: str, **fields) -> Column:
        def row(i):
            values = {f: fields[f](i) if f in fields else null for f in ("address", "keyword", "name", "role", "slug", "type_guess")}
            return F.struct(F.lit(kind).alias("claim_type"), *[v.alias(k) for k, v in values.items()],
                            i["confidence"].alias("confidence"), i["evidence"].alias("evidence"))
        return F.coalesce(F.transform(items, row), F.array().cast(_LIFTED))

    g = lambda f: (lambda i: i[f])
    e = F.col("e")
    items = F.concat(
        lift(e["people"], C.CLAIM_PERSON, name=g("name"), role=g("role")),
        lift(e["organizations"], C.CLAIM_ORG, name=g("name"), type_guess=g("type_guess")),
        lift(e["locations"], C.CLAIM_LOCATION, name=g("name"), address=g("address")),
        lift(e["keywords"], C.CLAIM_KEYWORD, keyword=g("keyword")),
        lift(e["issue_areas"], C.CLAIM_ISSUE_AREA, slug=g("slug")))
    rows = entities.select("article_id", "city_id", F.posexplode(items).alias("pos", "i"))
    fields = {f: F.col("i")[f] for f in ("address", "keyword", "name", "role", "slug", "type_guess")}
    value = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return rows.select(
        "article_id", "city_id", "pos", F.col("i.claim_type"), value.alias("value"), F.to_json(value).alias("value_json"),
        F.when(F.size("i.evidence") > 0, F.col("i.evidence")).alias("evidence"), F.col("i.confidence"),
        F.lit(source).alias("source"), F.lit("proposed").alias("status"), json_hash(fields).alias("value_hash"))


_LIFTED = (
    "array<struct<claim_type:string,address:string,keyword:string,name:string,role:string,slug:string,type_guess:string,"
    "confidence:double,evidence:array<struct<quote:string,start:bigint,end:bigint>>>>"
)


def usable_claims(claims: DataFrame, min_confidence: float = C.PROJECTION_MIN_CONFIDENCE, source: str | None = None) -> DataFrame:
    """Approved and proposed claims of enough confidence, of one source if it is named. A projection is made per source."""
    rows = claims.filter(F.col("status").isin("approved", "proposed") & (F.col("confidence") >= min_confidence))
    return rows if source is None else rows.filter(F.col("source") == source)


def listed_areas(claims: DataFrame, areas: DataFrame) -> DataFrame:
    """Claims without issue areas that are not in their city's list; a city without a list takes all.

    ``areas``: city_id, slug. Two lookups by unique keys; no list is carried into a row.
    """
    c = F.col
    known = settle(areas.filter("slug IS NOT NULL").select(c("city_id").alias("_city"), F.lower("slug").alias("_slug")).distinct())
    cities = known.select(c("_city").alias("_listed")).distinct()
    area = F.when(c("claim_type") == C.CLAIM_ISSUE_AREA, c("value")["slug"])
    rows = claims.withColumn("_area", area).join(cities, c("city_id") == c("_listed"), "left").join(
        known, (c("city_id") == c("_city")) & (c("_area") == c("_slug")), "left")
    return rows.filter(c("_area").isNull() | c("_listed").isNull() | c("_slug").isNotNull()).select(*claims.columns)


OPPORTUNITY = "type string, date string, time string, location string, url string, description string, evidence array<struct<quote:string>>"


def claimed_opportunities(claims: DataFrame) -> DataFrame:
    """Opportunities written in approved or proposed opportunity claims: a list under ``opportunities``, or one object.

    The claim's own evidence stands in where the opportunity has none.
    """
    c = F.col
    rows = claims.filter((c("claim_type") == C.CLAIM_OPPORTUNITY) & c("status").isin("approved", "proposed"))
    kind = f"struct<{OPPORTUNITY.replace(' string', ':string').replace(' array', ':array')}>"
    many = F.from_json("value_json", f"opportunities array<{kind}>")["opportunities"]
    # An empty object says nothing.
    one = F.when(F.coalesce(F.size(F.from_json("value_json", "map<string,string>")), F.lit(0)) > 0, F.array(F.from_json("value_json", OPPORTUNITY)))
    rows = rows.select("article_id", "city_id", c("pos").alias("_claim"), c("evidence").alias("_evidence"), F.posexplode(F.coalesce(many, one)).alias("_i", "o"))
    first = lambda e: F.try_element_at(e, F.lit(1))["quote"]
    return rows.select(
        "article_id", "city_id", (F.coalesce(F.right("_claim", F.lit(6)).try_cast("int"), F.lit(0)) * 1000 + c("_i")).alias("pos"), F.lower(blank_to_null(c("o.type"))).alias("type"),
        *[blank_to_null(c(f"o.{f}")).alias(f) for f in ("date", "time", "location", "url")], F.coalesce(blank_to_null(c("o.description")), F.lit("")).alias("description"),
        first(c("o.evidence")).alias("evidence_quote"), F.when(c("o.evidence").isNull(), first(c("_evidence"))).alias("claim_quote"))


# Projections read: pos, article_id, city_id, claim_type, value_text, confidence.


def _keyword_claims(claims: DataFrame) -> DataFrame:
    name = blank_to_null(F.col("value_text"))
    return claims.filter(F.col("claim_type") == C.CLAIM_KEYWORD).withColumn("name", name).withColumn("slug", slugify(name)).filter(
        F.length("slug") > 0)


def keyword_dictionary(claims: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing keywords (id, city_id, slug, name) plus new (city, slug) pairs with their first name.

    New ids continue after the largest id.
    """
    seen = _keyword_claims(claims).groupBy("city_id", "slug").agg(F.min_by("name", "pos").alias("name"))
    new = seen.join(existing.select("city_id", "slug"), ["city_id", "slug"], "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = number_rows(new, F.concat_ws("|", F.col("city_id").cast("string"), "slug"), "id", top)
    cols = ["id", "city_id", "slug", "name"]
    return existing.select(*cols).unionByName(numbered.select(*cols))


def project_keywords(claims: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(article, keyword) with the largest confidence; claims are combined before the lookup."""
    best = _keyword_claims(claims).groupBy("article_id", "city_id", "slug").agg(F.max("confidence").alias("confidence"))
    ids = dictionary.select("city_id", "slug", F.col("id").alias("keyword_id"))
    return lookup_join(best, ids, ["city_id", "slug"], spread="article_id").select("article_id", "keyword_id", "confidence")


def project_issue_areas(claims: DataFrame, areas: DataFrame) -> DataFrame:
    """(article, issue area) with the largest confidence; slugs unknown to the city are dropped."""
    slug = F.lower(blank_to_null(F.col("value_text")))
    best = (
        claims.filter(F.col("claim_type") == C.CLAIM_ISSUE_AREA).withColumn("slug", slug).filter("slug IS NOT NULL")
        .groupBy("article_id", "city_id", "slug").agg(F.max("confidence").alias("confidence"))
    )
    ids = areas.filter("slug IS NOT NULL").groupBy("city_id", F.lower("slug").alias("slug")).agg(F.max("id").alias("issue_area_id"))
    joined = lookup_join(best, ids, ["city_id", "slug"], spread="article_id")
    return joined.select("article_id", "issue_area_id", "confidence")


ENTITY_TYPES = {C.CLAIM_PERSON: "person", C.CLAIM_ORG: "organization", C.CLAIM_LOCATION: "location"}


def project_entities(claims: DataFrame) -> DataFrame:
    """(article, type, name ignoring case): largest confidence, last written form of the name."""
    kind = F.col("claim_type")
    entity = F.when(kind == C.CLAIM_PERSON, "person").when(kind == C.CLAIM_ORG, "organization").when(kind == C.CLAIM_LOCATION, "location")
    rows = claims.filter(kind.isin(list(ENTITY_TYPES))).withColumns({
        "entity_type": entity, "display_name": squish(blank_to_null(F.col("value_text")))}).filter("display_name IS NOT NULL")
    return rows.groupBy("article_id", "entity_type", F.lower("display_name").alias("name_key")).agg(
        F.max("confidence").alias("confidence"), F.max_by("display_name", "pos").alias("display_name")).drop("name_key")


def is_decision_body(name: Column) -> Column:
    return contains_any(F.lower(name), C.DECISION_BODY_WORDS)


def decision_body(claims: DataFrame, articles: DataFrame, scrapers: DataFrame, organizations: DataFrame) -> DataFrame:
    """article_id -> the one decision body named by claims or by a government source.

    Articles with none or several candidates have no row. Candidates are first
    combined per (article, name), so the last count is over distinct names only.
    """
    name = blank_to_null(F.col("value_text"))
    from_claims = claims.filter(F.col("claim_type") == C.CLAIM_ORG).select("article_id", name.alias("name"), "pos").filter(
        is_decision_body(F.col("name")))
    government = scrapers.select(F.col("id").alias("scraper_id"), "organization_id").join(
        organizations.filter("type = 'government'").select(F.col("id").alias("organization_id"), blank_to_null(F.col("name")).alias("name")), "organization_id")
    from_source = articles.select("article_id", "scraper_id").join(government, "scraper_id").select(
        "article_id", "name", F.lit("~").alias("pos")).filter("name IS NOT NULL")
    names = from_claims.unionByName(from_source).groupBy("article_id", F.lower("name").alias("k")).agg(F.max_by("name", "pos").alias("name"))
    return names.groupBy("article_id").agg(F.count("*").alias("n"), F.min("name").alias("decision_body")).filter("n = 1").drop("n")
