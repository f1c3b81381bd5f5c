"""Heuristic scoring of articles: six dimensions from one pass over the text.

Every signal is a native expression over one text column, computed in a single
projection, so a text is read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall import config as C
from townhall.functions.dates import let, parse_date_part
from townhall.functions.text import extract_urls, find_phrases, found_hits, trim_all, word
from townhall.functions.scalars import clamp01


def scoring_text() -> Column:
    """Title, summary and cleaned text, blanks skipped."""
    some = lambda c: F.when(F.length(trim_all(F.col(c))) > 0, F.col(c))
    return trim_all(F.concat_ws(" ", *[some(c) for c in ("title", "summary", "cleaned_text")]))


def words(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, r"\s+"))


def word_count(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, r"\s+")))


def sentence_count(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]+"))))


def syllable_count(text: Column) -> Column:
    """Vowel groups per word; words of up to three letters have one, a silent e does not count.

    Three counts over the letters-only text give the same sum as a loop over the
    words: groups in long words, short words, and words that lose their final e.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z\s]+", ""), r"[^\S ]\s*| \s+", " "), F.lit(" "))
    # Every word follows a blank of its own, with which the patterns begin, so that they are tried at blanks only.
    short = r" [a-z]{1,3}(?= )"
    n = lambda t, p: F.regexp_count(t, F.lit(p))

    def count(t: Column) -> Column:
        groups = n(t, "[aeiouy]+")
        no_vowel = n(t, " [b-df-hj-np-tv-xz]{4,}(?= )")
        # A long word ending in a lone e (not le) with an earlier vowel group loses one.
        silent = n(t, " (?=[a-z]{4,}+(?<=[b-df-hj-km-np-tv-xz]e) )[b-df-hj-np-tv-xz]*+[aeiouy](?=[a-z])")
        return groups + no_vowel - silent

    return let(plain, lambda t: n(t, short) + let(F.regexp_replace(t, short, ""), count))


def readability(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    score = (F.lit(206.835) - F.lit(1.015) * (n_words / n_sentences) - F.lit(84.6) * (n_syllables / n_words)) / 100
    return F.when((n_words == 0) | (n_sentences == 0), F.lit(0.4)).otherwise(clamp01(score))


NAMED_DATE = rf"((?i){word(C.MONTH + r'[.]?\s+\d{1,2}(?:,\s*\d{4})?', C.MONTH_LETTERS)})"
NUMBER_DATE = "(" + word(r"\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?", r"\d") + ")"
ISO_DATE = "(" + word(r"\d{4}-\d{2}-\d{2}", r"\d") + ")"
HAS_YEAR = word(r"\d{4}")


def future_dates(text: Column, as_of: Column) -> Column:
    """Distinct dates in the text that lie after ``as_of``, in order of appearance per shape.

    A date without a four-digit year that has passed moves to the next year.
    """
    found = F.array_distinct(F.concat(*[
        F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (NAMED_DATE, NUMBER_DATE, ISO_DATE)]))
    today = as_of.cast("date")

    def read(t: Column) -> Column:
        rolled = lambda d: F.when(~t.rlike(HAS_YEAR) & (d < today), F.add_months(d, 12)).otherwise(d)
        return let(parse_date_part(t, F.year(as_of)), rolled)

    return F.filter(F.transform(found, read), lambda d: d.cast("timestamp_ntz") > as_of)


def timeliness(next_date: Column, as_of: Column) -> Column:
    days = (F.unix_seconds(next_date.cast("timestamp_ntz").cast("timestamp")) - F.unix_seconds(as_of.cast("timestamp"))) / 86400
    return F.when(next_date.isNull(), 0.2).when(days <= 7, 0.9).when(days <= 30, 0.7).otherwise(0.5)


def step_score(hits: Column) -> Column:
    return F.when(hits <= 0, 0.2).when(hits == 1, 0.5).when(hits == 2, 0.7).otherwise(0.85)


NAME_RUN = word(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", "A-Z")
PHRASES = [C.JARGON_TERMS, C.AGENCY_PHRASES, C.ORIENTATION_PHRASES, C.REPRESENTATION_PHRASES, C.RELEVANCE_PHRASES,
           C.MEETING_PHRASES, C.COMMENT_PERIOD_PHRASES, C.DEADLINE_PHRASES]


def civic_relevance(dims: dict[str, Column]) -> Column:
    """Weighted sum of the clamped dimensions, clamped."""
    total = sum((clamp01(dims[k]) * w for k, w in C.DIMENSION_WEIGHTS.items()), F.lit(0.0))
    return clamp01(total)


def text_signals(articles: DataFrame, as_of: Column) -> DataFrame:
    """The counts every score is made of. Input needs title, summary, cleaned_text."""
    text = F.col("_text")
    staged = articles.withColumn("_text", F.coalesce(scoring_text(), F.lit(""))).withColumn("_found", find_phrases(F.lower("_text"), *PHRASES))
    hits = lambda phrases: found_hits(F.col("_found"), phrases, *PHRASES)
    return staged.withColumns({
        "word_count": word_count(text),
        "sentence_count": sentence_count(text),
        "syllable_count": syllable_count(text),
        "jargon_hits": hits(C.JARGON_TERMS),
        "future_dates": future_dates(text, as_of),
        "agency_matches": hits(C.AGENCY_PHRASES),
        "orientation_matches": hits(C.ORIENTATION_PHRASES),
        "named_entities": F.regexp_count(text, F.lit(NAME_RUN)),
        "representation_matches": hits(C.REPRESENTATION_PHRASES),
        "relevance_matches": hits(C.RELEVANCE_PHRASES),
        "mentions_meeting": hits(C.MEETING_PHRASES) > 0,
        "mentions_comment_period": hits(C.COMMENT_PERIOD_PHRASES) > 0,
        "mentions_deadline": hits(C.DEADLINE_PHRASES) > 0,
        "urls": extract_urls(text),
    }).drop("_text", "_found")


def score_signals(signals: DataFrame, as_of: Column) -> DataFrame:
    """Dimensions and the civic score from the signals (plus org_type)."""
    c = F.col
    staged = signals.withColumns({
        "next_date": F.array_min("future_dates"),
        "readability": readability(c("word_count"), c("sentence_count"), c("syllable_count")),
        "jargon_density": F.when(c("word_count") > 0, c("jargon_hits") / c("word_count")).otherwise(0.0),
    })
    scored = staged.withColumns({
        "comprehensibility": clamp01(c("readability") - F.least(F.lit(0.5), c("jargon_density") * 2.5)),
        "orientation": step_score(c("orientation_matches")),
        "representation": clamp01(
            F.lit(0.25) + F.least(F.lit(0.5), c("named_entities") * 0.1) + F.when(c("representation_matches") > 0, 0.2).otherwise(0.0)),
        "agency": clamp01(step_score(c("agency_matches")) + F.when(c("next_date").isNotNull(), 0.1).otherwise(0.0)),
        "relevance": clamp01(
            F.when(c("org_type").eqNullSafe("government"), 0.65).otherwise(0.4) + F.when(c("relevance_matches") > 0, 0.15).otherwise(0.0)),
        "timeliness": timeliness(c("next_date"), as_of),
    })
    return scored.withColumn("civic_relevance", civic_relevance({k: c(k) for k in C.DIMENSIONS}))


def score_articles(articles: DataFrame, scrapers: DataFrame, organizations: DataFrame, as_of: Column) -> DataFrame:
    """One analysis row per article, status heuristics_done.

    The text leaves the row before any join: the two joins carry signals only,
    and the source tables are joined with each other first.
    """
    source_type = scrapers.select(F.col("id").alias("scraper_id"), "organization_id").join(
        organizations.select(F.col("id").alias("organization_id"), F.col("type").alias("org_type")), "organization_id", "left"
    ).select("scraper_id", "org_type")
    signals = text_signals(articles, as_of).drop("cleaned_text", "summary")
    return score_signals(signals.join(source_type, "scraper_id", "left"), as_of).withColumns({
        "status": F.lit("heuristics_done"), "score_version": F.lit(C.SCORE_VERSION)})


def heuristic_opportunities(scored: DataFrame, primary_url: Column) -> DataFrame:
    """Meeting, comment period and deadline rows for scored articles with a future date."""
    c = F.col
    url = F.coalesce(primary_url, F.try_element_at("urls", F.lit(1)))
    title = lambda prefix, bare: F.when(F.length(c("title")) > 0, F.concat(F.lit(prefix + ": "), c("title"))).otherwise(bare)
    none = F.lit(None).cast("date")

    def row(kind, prefix, bare, starts, ends, notes, confidence):
        return F.struct(
            F.lit(kind).alias("kind"), title(prefix, F.lit(bare)).alias("title"), starts.alias("starts_at"), ends.alias("ends_at"),
            url.alias("url"), F.lit(notes).alias("notes"), F.lit(confidence).alias("confidence"))

    d = c("next_date")
    rows = F.array_compact(F.array(
        F.when(c("mentions_meeting"), row("meeting", "Meeting", "Public meeting", d, none, "Detected meeting language with a future date.", 0.55)),
        F.when(c("mentions_comment_period"), row("comment_period", "Comment period", "Comment period", none, d, "Detected comment period language with a future date.", 0.55)),
        F.when(c("mentions_deadline"), row("deadline", "Deadline", "Deadline", none, d, "Detected deadline language with a future date.", 0.5)),
    ))
    return scored.filter(d.isNotNull()).select("article_id", F.explode(rows).alias("o")).select("article_id", "o.*")
