"""Reading HTML with regular expressions.

Block semantics are ours: an element runs from its opening tag to the first
closing tag of the same name. Markup is not repaired. Selectors of the source
configurations are compiled to patterns: ``tag``, ``.class``, ``#id``,
``tag.class``, ``tag[attr]``, ``tag[attr op "value"]`` with =, *=, ^=, $=, and
two levels separated by a blank. Anything else is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from townhall.functions.text import squish, strip_tags, trim_all

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&middot;": "·",
            "&copy;": "©", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}


def decode_entities(c: Column) -> Column:
    """The common named entities; the ampersand comes last."""
    for name, text in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(text))
    return c


def visible(html: Column) -> Column:
    """Without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")


def node_text(element: Column) -> Column:
    return squish(decode_entities(strip_tags(element)))


_SIMPLE = re.compile(r"""^([a-zA-Z][a-zA-Z0-9]*)?(\#[\w-]+)?((?:\.[\w-]+)*)(?:\[([\w:-]+)(?:([*^$]?=)["']?([^"'\]]*)["']?)?\])?$""")


def open_tag(selector: str) -> tuple[str, str]:
    """(tag name or '', pattern of the opening tag) of a one-level selector."""
    m = _SIMPLE.match(selector)
    if not m or not selector:
        raise ValueError(f"unsupported selector: {selector!r}")
    tag, id_, classes, attr, op, value = m.groups()
    checks = ""
    if id_:
        checks += rf"""(?=[^>]*\sid\s*=\s*["']?{re.escape(id_[1:])}["'\s>])"""
    for cls in filter(None, (classes or "").split(".")):
        checks += rf"""(?=[^>]*\sclass\s*=\s*["'](?:[^"']*\s)?{re.escape(cls)}(?:\s[^"']*)?["'])"""
    if attr:
        if op is None:
            checks += rf"(?=[^>]*\s{re.escape(attr)}[\s=>])"
        else:
            v = re.escape(value)
            inner = {"=": v, "*=": f"[^\"']*{v}[^\"']*", "^=": f"{v}[^\"']*", "$=": f"[^\"']*{v}"}[op]
            checks += rf"""(?=[^>]*\s{re.escape(attr)}\s*=\s*["']{inner}["'])"""
    return tag or "", rf"<{tag or '[a-zA-Z][a-zA-Z0-9]*'}(?=[\s>/]){checks}[^>]*>"


def _element_pattern(selector: str) -> str:
    tag, opening = open_tag(selector)
    if tag.lower() in ("meta", "link", "img", "br", "input"):
        return f"(?is)({opening})"
    if tag:
        return f"(?is)({opening}.*?</{tag}\\s*>)"
    named = opening.replace("<[a-zA-Z][a-zA-Z0-9]*", "<([a-zA-Z][a-zA-Z0-9]*)", 1)
    return f"(?is)({named}.*?</\\2\\s*>)"


def select(html: Column, selector: str) -> Column:
    """All elements of the selector, in page order."""
    levels = selector.split()
    if len(levels) > 2:
        raise ValueError(f"unsupported selector: {selector!r}")
    if len(levels) == 2:
        return F.flatten(F.transform(blocks(html, levels[0]), lambda b: select(b, levels[1])))
    return F.regexp_extract_all(html, F.lit(_element_pattern(selector)), F.lit(1))


def blocks(html: Column, selector: str) -> Column:
    """Stretches from one opening tag of the selector to the next one, for nested containers."""
    _, opening = open_tag(selector)
    return F.slice(F.split(html, f"(?is)(?={opening})"), 2, 2_000_000_000)


def first(html: Column, selector: str) -> Column:
    """The first element of the selector; null or '' when there is none. What follows it is not searched."""
    if len(selector.split()) == 1:
        return F.regexp_extract(html, _element_pattern(selector), 1)
    return F.try_element_at(select(html, selector), F.lit(1))


def first_text(html: Column, selector: str) -> Column:
    """Text of the first element, '' when there is none."""
    return F.coalesce(node_text(first(html, selector)), F.lit(""))


def attribute(element: Column, name: str) -> Column:
    """Attribute of the element's opening tag, '' when missing."""
    return F.coalesce(trim_all(decode_entities(
        F.regexp_extract(element, rf"""(?is)^<[^>]*?\s{re.escape(name)}\s*=\s*["']([^"'>]*)["']""", 1))), F.lit(""))


def first_attribute(html: Column, selector: str, name: str) -> Column:
    return F.coalesce(attribute(first(html, selector), name), F.lit(""))
