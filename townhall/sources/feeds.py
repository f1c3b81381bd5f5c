"""Article feeds: RSS, listing pages, article pages and archive lists, over tables of raw payloads.

Input tables hold payload_id, source_id, city_id, request_url, body. One payload is
one row, so every job is a projection and an explode without an exchange. Nothing is cut unless
the caller gives a maximum; the ``_counts`` jobs say per payload what was left out and why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall.functions import html as H
from townhall.functions.dates import let, moment_utc, parse_date_part
from townhall.functions.text import blank_to_null, squish, strip_tags, trim_all
from townhall.functions.urls import absolute_url, query_params

_RSS_ITEM = "title string,link string,description string,`content:encoded` string,pubDate string,guid string"
_FEED = (
    f"channel struct<item:array<struct<{_RSS_ITEM.replace(' string', ':string')}>>>,"
    "entry array<struct<title:string,link:struct<_href:string,_VALUE:string>,summary:string,content:string,updated:string,id:string>>"
)
HEAD = ["payload_id", "source_id", "city_id", "request_url"]


def read_feed(payloads: DataFrame) -> DataFrame:
    """Parse the XML once: ``items`` holds RSS items, or Atom entries in the same shape."""
    doc = payloads.withColumn("_f", F.from_xml("body", _FEED))
    rss = F.transform("_f.channel.item", lambda i: F.struct(
        trim_all(i["title"]).alias("title"), trim_all(i["link"]).alias("link"), trim_all(i["description"]).alias("description"),
        trim_all(i["content:encoded"]).alias("encoded"), trim_all(i["pubDate"]).alias("published"), trim_all(i["guid"]).alias("guid")))
    atom = F.transform("_f.entry", lambda i: F.struct(
        trim_all(i["title"]).alias("title"), F.coalesce(blank_to_null(i["link"]["_VALUE"]), i["link"]["_href"]).alias("link"),
        trim_all(i["summary"]).alias("description"), trim_all(i["content"]).alias("encoded"), trim_all(i["updated"]).alias("published"),
        F.lit(None).cast("string").alias("guid")))
    return doc.withColumn("items", F.coalesce(rss, atom)).drop("_f", "body")


def _complete(items: Column) -> Column:
    return F.filter(items, lambda i: (F.length(i["title"]) > 0) & (F.length(i["link"]) > 0))


def _first(items: Column, most: int) -> Column:
    return F.slice(items, 1, most) if most > 0 else items


def rss_articles(payloads: DataFrame, max_items: int = 0, year: int = 1970) -> DataFrame:
    """Article items of RSS feeds; title and link are needed, content beats description."""
    rows = read_feed(payloads).select(*HEAD, F.posexplode(_first(_complete(F.col("items")), max_items)).alias("pos", "i"))
    raw = F.coalesce(blank_to_null(F.col("i.encoded")), F.nullif("i.description", F.lit("")))
    staged = rows.withColumn("raw_html", raw).withColumn("cleaned_text", F.nullif(squish(strip_tags(F.col("raw_html"))), F.lit("")))
    return staged.select(
        *HEAD, "pos", F.col("i.title").alias("title"), F.nullif(squish(strip_tags(F.col("i.description"))), F.lit("")).alias("summary"),
        moment_utc(F.col("i.published"), F.lit("UTC"), F.lit(year)).alias("published_at"), F.col("i.link").alias("canonical_url"),
        F.sha2(F.col("cleaned_text"), 256).alias("content_hash"), "raw_html", "cleaned_text",
        F.lit("rss").alias("source_type"), F.col("i.link").alias("source_url"), F.col("i.guid").alias("source_uid"))


def rss_counts(payloads: DataFrame, max_items: int = 0) -> DataFrame:
    """Items of each payload: found, incomplete (no title or link), cut (beyond the caller's maximum), written."""
    n = F.size(F.coalesce("items", F.array()))
    whole = F.size(_complete(F.coalesce("items", F.array())))
    written = F.least(whole, F.lit(max_items)) if max_items > 0 else whole
    return read_feed(payloads).select(*HEAD, n.alias("found"), (n - whole).alias("incomplete"), (whole - written).alias("cut"), written.alias("written"))


def first_distinct(items: Column, key, cap: int) -> Column:
    """First element per key, in order, at most ``cap`` if that is positive. Sorts by key once: no element is compared with all others."""

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda s, i: (i == 0) | (F.get(ordered, F.greatest(i - 1, F.lit(0)))["key"] != s["key"]))

    ordered = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("x"))))
    kept = F.transform(F.array_sort(F.transform(let(ordered, firsts), lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])
    return _first(kept, cap)


def _anchors(selector: str, link_attr: str) -> Column:
    return F.transform(H.select(F.col("body"), selector), lambda a: F.struct(
        absolute_url(H.attribute(a, link_attr), F.col("request_url"), strict=True).alias("url"), H.node_text(a).alias("title")))


def listing_links(payloads: DataFrame, selector: str = "a", link_attr: str = "href", max_links: int = 0) -> DataFrame:
    """Distinct absolute links of listing pages with their text."""
    usable = F.filter(_anchors(selector, link_attr), lambda x: x["url"].isNotNull())
    return payloads.withColumn("_l", usable).select(*HEAD, F.posexplode(first_distinct(F.col("_l"), lambda x: x["url"], max_links)).alias("pos", "l")).select(
        *HEAD, "pos", "l.url", "l.title")


def listing_counts(payloads: DataFrame, selector: str = "a", link_attr: str = "href", max_links: int = 0) -> DataFrame:
    """Links of each page: found, invalid (no usable address), duplicate, cut (beyond the caller's maximum), written."""
    c = F.col
    rows = payloads.withColumn("_u", F.transform(_anchors(selector, link_attr), lambda x: x["url"]))
    rows = rows.select(*HEAD, F.size("_u").alias("found"), F.size(F.array_compact("_u")).alias("_ok"), F.size(F.array_distinct(F.array_compact("_u"))).alias("_d"))
    written = F.least(c("_d"), F.lit(max_links)) if max_links > 0 else c("_d")
    return rows.select(*HEAD, "found", (c("found") - c("_ok")).alias("invalid"), (c("_ok") - c("_d")).alias("duplicate"), (c("_d") - written).alias("cut"), written.alias("written"))


CLOSERS = {"p": "\n\n", "li": "\n", "h1": "\n\n", "h2": "\n\n", "h3": "\n\n", "tr": "\n"}


def plain_fallback(html: Column) -> Column:
    """Tag-strip that keeps line breaks."""
    t = F.regexp_replace(html, r"(?i)<br\s?/?>", "\n")
    for tag, gap in CLOSERS.items():
        t = F.regexp_replace(t, f"(?i)</{tag}>", gap)
    t = F.regexp_replace(H.decode_entities(strip_tags(t)), "\r\n?", "\n")
    return trim_all(F.regexp_replace(F.regexp_replace(t, r"[ \t\f\x0B]+", " "), "\n{3,}", "\n\n"))


def body_text(html: Column) -> Column:
    """Text blocks of the main part: all h1, then h2, h3, p, li, then tables as ``cell | cell`` lines."""

    def root(page: Column) -> Column:
        contents = F.regexp_extract(page, r"""(?is)<[^>]+\sid\s*=\s*["']contents["'][^>]*>(.*)</body""", 1)
        main = F.regexp_extract(page, r"(?is)<main[^>]*>(.*?)</main>", 1)
        article = F.regexp_extract(page, r"(?is)<article[^>]*>(.*?)</article>", 1)
        body = F.regexp_extract(page, r"(?is)<body[^>]*>(.*)</body", 1)
        return F.coalesce(*[F.nullif(x, F.lit("")) for x in (contents, main, article, body)], page)

    def texts(part: Column) -> Column:
        tags = [F.transform(H.select(part, t), H.node_text) for t in ("h1", "h2", "h3", "p", "li")]
        table = F.transform(H.select(part, "table"), lambda t: F.array_join(F.filter(F.transform(
            H.select(t, "tr"), lambda r: F.array_join(F.filter(F.transform(
                F.regexp_extract_all(r, F.lit(r"(?is)(<t[hd](?=[\s>])[^>]*>.*?</t[hd]\s*>)"), F.lit(1)), H.node_text),
                lambda c: F.length(c) > 0), " | ")), lambda r: F.length(r) > 0), "\n"))
        blocks = F.filter(F.concat(*tags, table), lambda t: F.length(t) > 0)
        return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).otherwise(plain_fallback(part))

    return let(root(H.visible(html)), texts)


def content_type(text: Column, best_effort: bool = False) -> Column:
    """full or snippet by words and characters."""
    words, chars = F.regexp_count(text, F.lit("[A-Za-z'-]+")), F.length(text)
    full = (words >= 80) | (chars >= 600)
    if best_effort:
        full = full | (words >= 30) | (chars >= 250)
    return F.when(full, "full").otherwise("snippet")


DATE_METAS = [
    'meta[property="article:published_time"]', 'meta[name="article:published_time"]', 'meta[name="pubdate"]',
    'meta[name="publish-date"]', 'meta[name="date"]', 'meta[itemprop="datePublished"]',
]


def article_pages(pages: DataFrame, best_effort: bool = False, year: int = 1970) -> DataFrame:
    """Article items of fetched pages (url, html, optional link_title); pages without text are dropped."""
    html, url = F.col("html"), F.col("url")
    hint = F.col("link_title") if "link_title" in pages.columns else F.lit(None).cast("string")
    some = lambda c: F.nullif(c, F.lit(""))
    meta = lambda sel: some(H.first_attribute(html, sel, "content"))
    canonical = F.coalesce(
        absolute_url(F.coalesce(some(H.first_attribute(html, 'link[rel="canonical"]', "href")), meta('meta[property="og:url"]')), url, strict=True), url)
    title = F.coalesce(
        meta('meta[property="og:title"]'), meta('meta[name="twitter:title"]'), some(H.first_text(html, "h1")), some(H.first_text(html, "title")),
        some(hint), F.col("canonical_url"))
    moment = lambda c: moment_utc(c, F.lit("UTC"), F.lit(year))
    time_text = F.coalesce(some(H.first_attribute(html, "time", "datetime")), some(H.first_text(html, "time")))
    published = F.coalesce(*[moment(meta(sel)) for sel in DATE_METAS], moment(time_text))
    description = F.coalesce(meta('meta[name="description"]'), meta('meta[property="og:description"]'))
    rows = pages.withColumns({"canonical_url": canonical, "summary": description, "_text": body_text(html)}).withColumns({
        "title": title, "published_at": published,
        "cleaned_text": F.coalesce(some(F.col("_text")), F.col("summary") if best_effort else F.lit(None).cast("string"))})
    rows = rows.filter("cleaned_text IS NOT NULL").withColumns({
        "content_type": content_type(F.col("cleaned_text"), best_effort), "content_hash": F.sha1(F.col("cleaned_text").cast("binary"))})
    return rows.drop("_text", "html")


def archive_outcomes(payloads: DataFrame, href_contains: str, max_links: int = 0) -> DataFrame:
    """Every anchor of an archive list page with its outcome: item, or why it was skipped."""
    c = F.col

    def anchor(a: Column, i: Column) -> Column:
        href = H.attribute(a, "href")
        url, title = absolute_url(href, c("request_url"), strict=True), H.node_text(a)
        why = F.when(~href.contains(href_contains), "unmatched_href").when(url.isNull(), "invalid_href").when(F.length(title) < 3, "empty_title")
        return F.struct(why.alias("why"), url.alias("url"), i.alias("i"), title.alias("title"))

    def marked(ordered: Column) -> Column:
        # Good anchors stand by address, then place: the first of an address differs from the one before it.
        return F.transform(ordered, lambda a, i: F.struct(
            a["i"].alias("i"), a["url"].alias("url"), a["title"].alias("title"), a["why"].alias("why"),
            (a["why"].isNull() & ((i == 0) | F.get(ordered, F.greatest(i - 1, F.lit(0)))["why"].isNotNull()
             | (F.get(ordered, F.greatest(i - 1, F.lit(0)))["url"] != a["url"]))).alias("first")))

    rows = payloads.withColumn("_a", F.array_sort(F.transform(H.select(c("body"), "a"), anchor)))
    rows = rows.withColumn("_m", F.array_sort(let(c("_a"), marked)))
    kept = _first(F.transform(F.filter("_m", lambda a: a["first"]), lambda a: a["url"]), max_links)
    head = [*HEAD, *([kept.alias("_kept")] if max_links > 0 else [])]
    rows = rows.select(*head, F.explode("_m").alias("a"))
    over = ~F.array_contains("_kept", c("a.url")) if max_links > 0 else F.lit(False)
    outcome = F.when(c("a.why").isNotNull(), c("a.why")).when(over, "max_links").when(c("a.first"), "item").otherwise("duplicate")
    return rows.select(*HEAD, c("a.i").alias("pos"), c("a.url").alias("url"), c("a.title").alias("title"), outcome.alias("outcome"))


def archive_pdf_links(outcomes: DataFrame) -> DataFrame:
    """Items of the outcomes: pdf articles with the archive id of their query string."""
    return outcomes.filter("outcome = 'item'").withColumns({
        "content_type": F.lit("pdf"), "source_uid": F.nullif(query_params(F.col("url"))["ADID"], F.lit(""))})


def documenters_links(payloads: DataFrame, site: str, selector: str = "a", host: str = "docs.google.com", max_links: int = 0, year: int = 1970) -> DataFrame:
    """Distinct links to the document host with the meeting date of the page."""
    def resolve(a: Column) -> Column:
        href = H.attribute(a, "href")
        return (F.when(F.length(href) == 0, F.lit(None)).when(href.startswith("//"), F.concat(F.lit("https:"), href))
                .when(href.rlike("^https?://"), href).otherwise(F.concat(F.lit(site + "/"), F.regexp_replace(href, "^/+", ""))))

    links = F.array_distinct(F.filter(F.transform(H.select(F.col("body"), selector), resolve), lambda u: u.contains(host)))
    return payloads.select(*HEAD, meeting_date(F.col("body"), year).alias("meeting_date"), F.posexplode(_first(links, max_links)).alias("pos", "url"))


MEETING = r"Date:\s*([A-Z][a-z]+\s+\d{1,2},\s+\d{4})"


def meeting_date(html: Column, year: int = 1970) -> Column:
    """The date after the label Date: in the markup, else in its text."""
    found = F.coalesce(F.nullif(F.regexp_extract(html, MEETING, 1), F.lit("")), F.nullif(F.regexp_extract(plain_fallback(html), MEETING, 1), F.lit("")))
    return parse_date_part(found, F.lit(year))


def article_source_text(bodies: DataFrame, placeholder: str = "Source text unavailable.") -> DataFrame:
    """Plain source text: cleaned, else raw, else a placeholder."""
    return bodies.select("article_id", F.coalesce("cleaned_text", "raw_text", F.lit(placeholder)).alias("source_text"))
