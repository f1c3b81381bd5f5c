"""Text column expressions. All native, all null-safe."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_LEFT = r"(?<![A-Za-z0-9_])"
EDGE_RIGHT = r"(?![A-Za-z0-9_])"

# Latin letters with marks and their plain forms, position by position.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyy"
FOLD_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe"}


def word(pattern: str, first: str = "") -> str:
    """``pattern`` between ASCII word edges; the same in every regex dialect with look-around.

    ``first`` names the characters a match can begin with, so that others are refused at once.
    """
    return (f"(?=[{first}])" if first else "") + EDGE_LEFT + "(?:" + pattern + ")" + EDGE_RIGHT


def squish(c: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


SPACE = " \t\n\r\f\x0b"


def trim_all(c: Column) -> Column:
    """Trim any white space, not only blanks. No regular expression, as it runs on long texts."""
    return F.trim(c, F.lit(SPACE))


def rtrim_all(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(trim_all(c), F.lit(""))


def norm_title(c: Column) -> Column:
    return F.lower(squish(c))


def clean_location(c: Column) -> Column:
    """Drop backslashes, squish, empty becomes null."""
    return F.nullif(squish(F.replace(c, F.lit("\\"), F.lit(""))), F.lit(""))


def norm_location(name: Column, address: Column) -> Column:
    """Name and address joined and normalised; '' when both are blank."""
    return F.coalesce(norm_title(F.concat_ws(" ", name, address)), F.lit(""))


def limit_text(c: Column, n: int, end: str = "...") -> Column:
    """Cut to ``n`` characters and add ``end`` only when something was cut."""
    return F.when(F.length(c) > n, F.concat(rtrim_all(F.substring(c, 1, n)), F.lit(end))).otherwise(c)


def first_sentence(c: Column) -> Column:
    """Text up to the first sentence mark that is followed by white space."""
    return F.element_at(F.split(c, r"(?<=[.!?])\s+", 2), 1)


def meaningful_length(c: Column) -> Column:
    """Characters left once control characters and white space are gone."""
    return F.length(F.regexp_replace(c, r"[\p{C}\s]+", ""))


def clean_newlines(c: Column) -> Column:
    t = F.regexp_replace(c, "\r\n?", "\n")
    return trim_all(F.regexp_replace(t, "\n{3,}", "\n\n"))


def slugify(c: Column) -> Column:
    """Lower-case ASCII words joined by dashes."""
    t = F.translate(F.lower(c), FOLD_FROM, FOLD_TO)
    for mark, plain in FOLD_PAIRS.items():
        t = F.replace(t, F.lit(mark), F.lit(plain))
    t = F.replace(F.regexp_replace(t, "_+", "-"), F.lit("@"), F.lit("-at-"))
    t = F.regexp_replace(t, r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(t, r"[\s-]+", "-"), "^-+|-+$", "")


def snake(c: Column) -> Column:
    """Snake form of lower-cased words: blanks become underscores."""
    return F.regexp_replace(trim_all(c), r"\s+", "_")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def html_to_text(c: Column) -> Column:
    """Tag-aware strip: breaks become a newline, block ends a blank line."""
    t = F.regexp_replace(c, r"(?i)<\s*br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</\s*(p|div|li|tr|h[1-6])\s*>", "\n\n")
    t = F.regexp_replace(strip_tags(t), "\n{3,}", "\n\n")
    return F.coalesce(trim_all(t), F.lit(""))


def phrase_finder(phrases: list[str]) -> str:
    """Pattern whose first group is, at every word of a lower-cased text, the longest of the phrases that begins there.

    Matches are empty, so phrases may overlap; one scan finds those of many lists.
    """
    rest: dict[str, list[str]] = {}
    for p in sorted(set(phrases), key=lambda p: (-len(p), p)):
        rest.setdefault(p[0], []).append(_escape(p[1:]))
    body = "|".join(_escape(a) + "(?:" + "|".join(r) + ")" for a, r in sorted(rest.items()))
    return f"{EDGE_LEFT}(?=({body}){EDGE_RIGHT})"


def find_phrases(lowered: Column, *lists: list[str]) -> Column:
    """What ``phrase_finder`` finds for all phrases of the lists, in text order."""
    return F.regexp_extract_all(lowered, F.lit(phrase_finder([p for phrases in lists for p in phrases])), F.lit(1))


def found_hits(found: Column, phrases: list[str], *lists: list[str]) -> Column:
    """Hits of ``phrases`` among what ``find_phrases`` found for ``lists``: a found phrase also counts for those it begins with."""
    begins = lambda h, p: h == p or (h.startswith(p) and not re.match("[A-Za-z0-9_]", h[len(p)]))
    hits = {h: sum(begins(h, p) for p in phrases) for other in lists for h in other}
    total = F.lit(0)
    for n in range(1, max(hits.values(), default=0) + 1):
        names = [h for h, k in hits.items() if k >= n]
        total = total + F.size(F.filter(found, lambda x: x.isin(names)))
    return F.coalesce(total, F.lit(0))


def phrase_hits(lowered: Column, phrases: list[str]) -> Column:
    """Sum of whole-phrase hits in lower-cased text; phrases may overlap each other. The text is scanned once."""
    return found_hits(find_phrases(lowered, phrases), phrases, phrases)


def contains_any(lowered: Column, words: list[str]) -> Column:
    """True when any of the strings occurs anywhere."""
    return F.coalesce(lowered.rlike("|".join(_escape(w) for w in words)), F.lit(False))


def _escape(text: str) -> str:
    return "".join("\\" + ch if ch in r".+*?()[]{}|^$\/-" and ch not in "/-" else ch for ch in text)


def extract_urls(c: Column) -> Column:
    """Distinct http(s) URLs in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?i)https?://[^\s)]+)"), F.lit(1)))


def location_line(c: Column) -> Column:
    """The first two non-empty comma parts."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: trim_all(p)), lambda p: (F.length(p) > 0) & (p != "0"))
    line = F.array_join(F.slice(parts, 1, 2), ", ")
    return F.when(F.size(parts) > 0, line)
