"""Scalar cleaning, scores, hashes and structured value normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from townhall.config import BULLET_LIMIT
from townhall.functions.text import blank_to_null, norm_title, trim_all


def clamp01(c: Column) -> Column:
    """A number inside [0, 1]; anything that is not a number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def clean_number(c: Column) -> Column:
    """Numeric text rounded to a whole number, else null."""
    return F.round(c.try_cast("double")).cast("bigint")


def json_hash(fields: dict[str, Column]) -> Column:
    """sha1 of the JSON of the non-null fields in alphabetical order."""
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return F.sha1(F.to_json(F.struct(*ordered)).cast("binary"))


def source_hash(given: Column, city: Column, title: Column, starts_at_utc: Column,
                name: Column, address: Column) -> Column:
    """Identity of a calendar event: the given key, else city, title, UTC start and place."""
    key = trim_all(given)
    natural = F.concat_ws(
        "|", city.cast("string"), norm_title(title),
        F.date_format(starts_at_utc, "yyyy-MM-dd HH:mm:ss"),
        norm_title(F.replace(F.concat_ws(" ", name, address), F.lit("\\"), F.lit(""))),
    )
    return (
        F.when(key.rlike("^[0-9a-fA-F]{40}$"), F.lower(key))
        .when(F.length(key) > 0, F.sha1(key.cast("binary")))
        .otherwise(F.sha1(natural.cast("binary")))
    )


EVIDENCE_TYPE = "array<struct<quote:string,start:bigint,end:bigint>>"


def normalize_evidence(items: Column) -> Column:
    """Drop blank quotes, keep offsets that are numbers. Input: array of structs of text."""
    cleaned = F.transform(
        items,
        lambda e: F.struct(
            blank_to_null(e["quote"]).alias("quote"),
            clean_number(e["start"]).alias("start"),
            clean_number(e["end"]).alias("end"),
        ),
    )
    kept = F.filter(cleaned, lambda e: e["quote"].isNotNull())
    return F.coalesce(kept, F.array().cast(EVIDENCE_TYPE))


def normalize_strings(items: Column, limit: int = BULLET_LIMIT) -> Column:
    """Trimmed non-blank strings, at most ``limit``; an empty list is null."""
    kept = F.filter(F.transform(items, lambda s: trim_all(s)), lambda s: F.length(s) > 0)
    return F.when(F.size(kept) > 0, F.slice(kept, 1, limit))


def normalize_bullets(items: Column, limit: int = BULLET_LIMIT) -> Column:
    """Bullets from an array of variants: plain strings or label / value / text maps."""

    def field(v: Column, name: str) -> Column:
        return blank_to_null(F.try_variant_get(v, f"$.{name}", "string"))

    def one(v: Column) -> Column:
        is_map = F.schema_of_variant(v).startswith("OBJECT")
        plain = F.when(F.schema_of_variant(v) == "STRING", blank_to_null(F.try_variant_get(v, "$", "string")))
        label, value = field(v, "label"), field(v, "value")
        pair = is_map & label.isNotNull() & value.isNotNull()
        single = F.when(is_map & ~pair, F.coalesce(field(v, "text"), label, value))
        return F.struct(
            F.when(pair, label).alias("label"),
            F.when(pair, value).alias("value"),
            F.coalesce(plain, single).alias("text"),
        )

    kept = F.filter(F.transform(items, one), lambda b: b["label"].isNotNull() | b["text"].isNotNull())
    return F.when(F.size(kept) > 0, F.slice(kept, 1, limit))


def normalize_evidence_map(sections: Column) -> Column:
    """Section to evidence list; sections left without a quote are dropped."""
    m = F.transform_values(sections, lambda _, v: normalize_evidence(v))
    kept = F.map_filter(m, lambda _, v: F.size(v) > 0)
    return F.when(F.cardinality(kept) > 0, kept)
